"""The tracker on a stream: frames in any order, late ones, lost ones, restarts."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.operators import raster, tracker
from tessera.plans import queries as plans
from tessera.streaming import tracking

PIXELS = "seq string, frame int, y int, x int, label int"


@pytest.fixture(scope="module")
def frames(spark):
    """Rows of ten frames of two sequences; frame 2 of sequence 02 has no pixels."""
    rng = np.random.default_rng(1)
    px = [(s, f, int(y), int(x), int(k)) for s in ("01", "02") for f in range(10) for k in range(1, 4) for y in range(6 * k, 6 * k + 4) for x in range(f, f + 5) if rng.random() < 0.97 and (f + k) % 5 and (s, f) != ("02", 2)]
    pixels = spark.createDataFrame(px, PIXELS)
    meta = spark.createDataFrame([(s, f) for s in ("01", "02") for f in range(10)], "seq string, frame int")
    table = tracker.overlap_table(pixels, raster.open_labels(pixels, 40, 40), meta)
    rows = table.collect()
    want = {tuple(r) for r in table.groupBy("seq").applyInPandas(tracker.track_sequence, tracker.ASSIGNED).collect()}
    return rows, table.schema, want


class Feed:
    def __init__(self, spark, schema, root, patience=None):
        self.spark, self.schema, self.root, self.patience, self.n = spark, schema, root, patience, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self):
        tracking.track_files(self.spark, f"{self.root}/in", f"{self.root}/out", f"{self.root}/mark", self.schema, self.patience, 1)
        return [tuple(r) for r in self.spark.read.schema(tracker.ASSIGNED).parquet(f"{self.root}/out").collect()]


def test_stream_equals_batch_in_any_order(spark, frames, tmp_path):
    rows, schema, want = frames
    feed, rng = Feed(spark, schema, tmp_path), np.random.default_rng(3)
    order = rng.permutation(len(rows))
    for part in np.array_split(order[:13], 3):
        feed.add([rows[i] for i in part])
    some = feed.run()
    assert len(some) == len(set(some)) and set(some) <= want
    feed.add([rows[i] for i in order[13:]] + [rows[i] for i in order[:2]])  # the rest, and two frames again
    got = feed.run()
    assert len(got) == len(set(got)) and set(got) == want


def test_lost_frames_are_given_up(spark, frames, tmp_path):
    rows, schema, want = frames
    schema = T.StructType([*schema.fields, T.StructField("arrived", T.TimestampType())])
    one = {r.frame: r for r in rows if r.seq == "02"}
    feed = Feed(spark, schema, tmp_path, patience="10 seconds")

    def add(second, *numbers):
        feed.add([(*one[n], dt.datetime(2024, 1, 1, 0, 0, second)) for n in numbers])

    add(0, 0, 1, 3, 4)
    assert {r[1] for r in feed.run()} == {0, 1}
    add(5, 6)  # frames 3 and 4 have waited for 5 seconds
    assert {r[1] for r in feed.run()} == {0, 1}
    add(12, 7)  # 12 seconds: frame 2 is given up, and frame 5 is not yet
    assert {r[1] for r in feed.run()} == {0, 1, 3, 4}  # frame 2 is empty, so that giving it up changes nothing
    add(13, 5, 2)  # in time, and too late
    got = feed.run()
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[0] == "02" and w[1] < 8}


def test_without_patience_frames_wait(spark, frames, tmp_path):
    rows, schema, _ = frames
    feed = Feed(spark, schema, tmp_path)
    feed.add([r for r in rows if r.seq == "01" and r.frame in (0, 2)])
    assert {r[1] for r in feed.run()} == {0}
    feed.add([r for r in rows if r.seq == "01" and r.frame == 3])
    assert {r[1] for r in feed.run()} == {0}


def test_the_session_keeps_its_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with tracking.state_in_rocksdb(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


def test_streamed_query_equals_batch(spark):
    q = plans.queries()
    got, want = (sorted(map(tuple, q[n](spark, "/root/testdata/sf0.001").collect())) for n in ("streamed_tracker", "strict_tracker"))
    assert got == want and got
