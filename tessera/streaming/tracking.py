"""The strict tracker on a stream of frame rows, in frame order whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.tracker import ASSIGNED, StrictTracker

_OWNED = "array<struct<track:int,label:int,kind:string>>"
TRACKER = f"next int, top int, started boolean, owners {_OWNED}, memory {_OWNED}"
WAITING = "segments array<int>, opened array<int>, overlaps array<struct<lag:int,kind:string,prev:int,label:int,n:int>>, arrived bigint"
_COLUMNS = ["seq", "frame", "label", "track"]


def _held(rows: Any) -> dict[int, tuple[int, str]]:
    return {int(r[0]): (int(r[1]), r[2]) for r in rows or []}


def _list(values: Any) -> list:
    return [] if values is None else list(values)


class FrameOrder(StatefulProcessor):
    """Steps a sequence's tracker through its frames.

    State of a sequence: the tracker (owners of the last frame, lost ids, the largest id, the next frame) and one map entry for each
    frame that came before its turn. With ``patient`` a timer gives up frames that have not come when the watermark passes
    the arrival of one that waits for them: the tracker goes on as if they were empty. Frames that come after their turn are dropped.
    """

    def __init__(self, patient: bool):
        self.patient = patient

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", TRACKER)
        self.waiting = handle.getMapState("waiting", "frame int", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at = self.state.get()[0] if self.state.exists() else 0
        for batch in rows:
            for r in batch.itertuples():
                if r.frame >= at:
                    overlaps = [tuple(o[k] if k == "kind" else int(o[k]) for k in ("lag", "kind", "prev", "label", "n")) for o in _list(r.overlaps)]
                    self.waiting.updateValue((int(r.frame),), ([int(s) for s in _list(r.segments)], [int(s) for s in _list(r.opened)], overlaps, int(r.arrived_ms)))
        yield self._go_on(key, at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due = [k[0] for k, v in self.waiting.iterator() if v[3] <= watermark]
        yield self._go_on(key, max(due, default=0))

    def _go_on(self, key: Any, upto: int) -> pd.DataFrame:
        """Every frame whose turn has come; frames before ``upto`` that are not there are given up."""
        if self.state.exists():
            at, top, started, owners, memory = self.state.get()
        else:
            at, top, started, owners, memory = 0, 0, False, [], []
        tracker = StrictTracker({"owners": _held(owners), "memory": _held(memory), "top": top, "started": started})
        out = []
        while at < upto or self.waiting.containsKey((at,)):
            if self.waiting.containsKey((at,)):
                segments, opened, overlaps, _ = self.waiting.getValue((at,))
                self.waiting.removeKey((at,))
            else:
                segments, opened, overlaps = [], [], []
            given = tracker.step(_list(segments), _list(opened), [dict(zip(("lag", "kind", "prev", "label", "n"), o, strict=True)) for o in _list(overlaps)])
            out += [(key[0], at, s, t) for s, t in sorted(given.items())]
            at += 1
        self.state.update((at, tracker.top, tracker.started, *[[(t, s, k) for t, (s, k) in held.items()] for held in (tracker.owners, tracker.memory)]))
        self._set_timer()
        return pd.DataFrame(out, columns=_COLUMNS).astype({"frame": "int32", "label": "int32", "track": "int32"})

    def _set_timer(self) -> None:
        """One timer while frames wait, at the first arrival of them."""
        if not self.patient:
            return
        arrived = min((v[3] for v in self.waiting.values()), default=None)
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != arrived:
                self.handle.deleteTimer(t)
        if arrived is not None and arrived not in timers:
            self.handle.registerTimer(arrived)

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, patience: str | None = None, arrived: str = "arrived") -> DataFrame:
    """Tracked segments of a stream of rows as made by ``overlap_table`` [O-157].

    Frames wait in the state until all before them have come, starting with frame 0. With a ``patience`` such as '10 minutes' rows
    carry the time at which they ``arrived``: a frame is given up once another that waits for it arrived that much before the latest row
    of the stream, so the state is bounded by what arrives in that time. None: frames wait for ever. Start the query inside ``state_in_rocksdb``.
    """
    if patience is None:
        rows, mode = frames.withColumn("arrived_ms", F.lit(0).cast("bigint")), "None"
    else:
        rows, mode = frames.withColumn("arrived_ms", F.unix_millis(arrived)).withWatermark(arrived, patience), "EventTime"
    return rows.groupBy("seq").transformWithStateInPandas(FrameOrder(patience is not None), ASSIGNED, "Append", mode)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that map states and timers need, for queries started inside; the session's setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def track_files(spark: SparkSession, source: str, out: str, checkpoint: str, schema: Any, patience: str | None = None, files_each_batch: int = 1000) -> None:
    """Track what is new in a folder of frame rows and append it to ``out``, until nothing is left."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each_batch).parquet(source)
    with state_in_rocksdb(spark):
        query = track_stream(stream, patience).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    try:
        query.awaitTermination()
    finally:
        query.stop()
