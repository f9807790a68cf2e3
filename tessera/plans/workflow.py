"""The result workflow as one composition of DataFrames: track, divide, downsample, validate, analyse."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import failures, raster, rescue, tracker, tracks, validate


@dataclass(frozen=True)
class Config:
    """Parameters of a run; they are checked before anything is read."""

    height: int
    width: int
    factor: int = 1
    offset: int = 0
    cooldown: int = 20
    min_frames: int = 1
    rule: str = "base"
    rescue_gap: int = 0
    limits: failures.Limits = field(default_factory=failures.Limits)

    def check(self) -> None:
        validate.check_parameters(factor=self.factor, offset=self.offset, cooldown=self.cooldown)


def pipeline(segments: DataFrame, config: Config, ground_truth: DataFrame | None = None, gt_tracks: DataFrame | None = None, segmentation: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a whole run, by name; from the repair on all are lazy, so only what is used is computed.

    tracked: pixels under track ids; parents; audits of both rescues (none with a gap of 0); tracks; sampled and sampled_tracks (every factor-th
    frame); violations; with ground truth also events, by_frame and by_track.
    """
    config.check()
    ids = tracker.strict_tracks(segments, config.height, config.width)
    tracked = segments.join(ids, ["seq", "frame", "label"]).select("seq", "frame", "y", "x", F.col("track").alias("label"))
    kept = tracks.survivors(tracked, config.min_frames)
    compact = tracked.join(kept.select("seq", "label", "new_label"), ["seq", "label"]).select("seq", "frame", "y", "x", F.col("new_label").alias("label"))
    repaired = rescue.repair(compact, config.cooldown, config.rule, config.rescue_gap)
    final, parents = repaired["pixels"], repaired["parents"]
    table = tracks.build_track_rows(tracks.spans(final), parents)
    sampled = tracks.downsample_pixels(final, config.factor, config.offset)
    sampled_tracks = tracks.downsample_tracks(final, parents, config.factor, config.offset)
    out = {
        "tracked": final,
        "objects": raster.objects(final),
        "parents": parents,
        "rescued_before": repaired["before"],
        "rescued_after": repaired["after"],
        "tracks": table,
        "sampled": sampled,
        "sampled_tracks": sampled_tracks,
        "violations": validate.violations(sampled, sampled_tracks),
    }
    if ground_truth is not None and gt_tracks is not None:
        failures.require_common_frames(ground_truth, sampled, segmentation)
        events = failures.events(ground_truth, sampled, gt_tracks, sampled_tracks, config.limits, segmentation)
        out |= {"events": events, "by_frame": failures.by_frame(events), "by_track": failures.by_track(events)}
    return out
