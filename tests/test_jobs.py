"""The jobs on copies of growing input: reruns, late rows, replays, odd rows, and the command line."""

from __future__ import annotations

import collections
import glob
import json
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import registry, series_audit, tracking_evaluation
from jobs.common import read_config

ROOT = Path(__file__).resolve().parents[1]
TURNS = "conv_id bigint, turn bigint, role string, text string"
PIXELS = "seq string, frame int, y int, x int, label int"
TRACKS = "seq string, label int, begin int, end int, parent int"
TABLES = "/root/testdata/sf0.001"


# series audit


def brute_audit(rows, first_number=0, ids=100_000):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = []
    for series, rs in groups.items():
        numbered = [r for r in rs if r[1] is not None]
        numbers = {r[1] for r in numbered}
        kinds = {(r[1], r[2]) for r in numbered}
        missing = max(numbers) - min(min(numbers), first_number) + 1 - len(numbers) if numbers else 0
        repeated, odd = len(numbered) - len(numbers), len(rs) - len(numbered)
        runs = sum(n - 1 not in numbers for n in numbers)
        streaks = sum((n - 1, k) not in kinds for n, k in kinds)
        size = sum(len((r[3] or "").encode()) for r in rs)
        out.append((series, len(rs), odd, len(numbers), min(numbers, default=None), max(numbers, default=None), missing, repeated, runs, streaks, size, not (missing or repeated or odd), -1 if series is None else series // ids))
    return sorted(out, key=str)


def audited(spark, out):
    return sorted(map(tuple, series_audit.read_audit(spark, out).collect()), key=str)


def put(spark, rows, folder, name):
    """One more Parquet file in a folder, as a copy from elsewhere."""
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("overwrite").parquet(f"{folder}-made/{name}")
    os.makedirs(folder, exist_ok=True)
    shutil.copy(glob.glob(f"{folder}-made/{name}/part-*.parquet")[0], f"{folder}/{name}.parquet")


def test_audit_of_growing_input(spark, tmp_path):
    rng = random.Random(5)
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    config = series_audit.Config(ids_each_part=10, numbers_each_block=4, files_each_batch=2)
    parts = [[(rng.choice([c, c, None]), rng.choice([None, *range(12)]), rng.choice(["user", "bot", None]), rng.choice([None, "", "é", "hello"])) for c in range(i * 8, i * 8 + 12) for _ in range(9)] for i in range(4)]
    for i, rows in enumerate(parts[:3]):
        put(spark, rows, source, f"a{i}")
    have = [r for p in parts[:3] for r in p]
    assert series_audit.run(spark, source, out, mark, config) == len(have)
    assert audited(spark, out) == brute_audit(have, ids=10)
    assert series_audit.run(spark, source, out, mark, config) == 0  # nothing new
    assert audited(spark, out) == brute_audit(have, ids=10)
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/audit/part=0/*.parquet")}
    put(spark, parts[3], source, "b")
    put(spark, [(25, 3, "user", "late"), (25, 99, "bot", "later")], source, "c")  # late rows of an audited series
    have += parts[3] + [(25, 3, "user", "late"), (25, 99, "bot", "later")]
    assert series_audit.run(spark, source, out, mark, config) == len(parts[3]) + 2
    assert audited(spark, out) == brute_audit(have, ids=10)
    assert before == {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/audit/part=0/*.parquet")}  # no new rows there: not written again
    fresh = f"{tmp_path}/fresh"
    assert series_audit.run(spark, source, fresh, f"{mark}-fresh", config) == len(have)
    assert audited(spark, fresh) == audited(spark, out)


def test_audit_replays_a_batch_that_was_not_committed(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    rows = [(c, n, "user", "x") for c in range(5) for n in range(6) if (c, n) != (3, 2)]
    put(spark, rows, source, "a")
    series_audit.run(spark, source, out, mark)
    put(spark, [(3, 9, "bot", "y")], source, "b")
    series_audit.run(spark, source, out, mark)
    want = audited(spark, out)
    for name in ("1", ".1.crc"):  # as if the driver had died between the writes and the commit
        os.remove(f"{mark}/commits/{name}")
    assert series_audit.run(spark, source, out, mark) == 1
    assert audited(spark, out) == want == brute_audit(rows + [(3, 9, "bot", "y")])


def test_audit_of_one_hot_series_and_columns_of_other_names(spark, tmp_path):
    rows = [(7, n, "user" if n % 300 else "bot", "") for n in range(20_000) if n % 4096 != 1 and n != 8192] + [(8, -3, "user", "t")]
    spark.createDataFrame([(*r, "mine", 1) for r in rows], TURNS + ", series string, part int").write.parquet(f"{tmp_path}/in")
    series_audit.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert audited(spark, f"{tmp_path}/out") == brute_audit(rows)


def test_audit_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        assert series_audit.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark") == 0
    assert audited(spark, f"{tmp_path}/out") == []


# tracking evaluation


def square(seq, frame, y, x, label, side=4):
    return [(seq, frame, y + i, x + j, label) for i in range(side) for j in range(side)]


def scene(tmp_path, spark, result):
    truth = [p for s in ("01", "02", "03", "04") for f in range(3) for p in square(s, f, 2, 2 + f, 1)]
    tables = {"truth": truth, "result": result}
    for name, rows in tables.items():
        spark.createDataFrame(rows, PIXELS).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        spans = {(r[0], r[4]) for r in rows}
        spark.createDataFrame([(s, n, 0, 2, 0) for s, n in spans], TRACKS).write.mode("overwrite").parquet(f"{tmp_path}/{name}_tracks")
    return {n: f"{tmp_path}/{n}" for n in ("truth", "result", "truth_tracks", "result_tracks")} | {"out": f"{tmp_path}/out"}


def evaluated(spark, paths):
    return sorted((r.seq, r.level, -1 if r.frame is None else r.frame, r.measure, r.n) for r in tracking_evaluation.read_evaluation(spark, paths["out"]).collect())


def test_evaluation_reruns_and_goes_on_past_bad_sequences(spark, tmp_path):
    good = [p for f in range(3) for p in square("01", f, 2, 2 + f, 5 if f < 2 else 6)]
    late = [p for f in range(7, 9) for p in square("03", f, 2, 2, 1)]
    paths = scene(tmp_path, spark, good + late + square("05", 0, 0, 0, 1))
    assert tracking_evaluation.run(spark, **paths) == len(rows := evaluated(spark, paths))
    state = {r[0]: r[3] for r in rows if r[3].startswith("status")}
    assert state == {"01": "status: ok", "02": "status: no result", "03": "status: no common frame", "04": "status: no result", "05": "status: no truth"}
    assert {r[3]: r[4] for r in rows if r[0] == "01" and r[1] == "sequence"} == {"status: ok": 1, "common frames": 3, "truth objects": 3, "result objects": 3, "result runs": 2}
    assert [(r[2], r[3], r[4]) for r in rows if r[0] == "01" and r[1] == "frame"] == [(0, "fragmented_gt_track", 1), (2, "id_switch", 1)]
    tracking_evaluation.run(spark, **paths)
    assert evaluated(spark, paths) == rows
    # the result of one sequence is mended: only that one is judged again, and its old failures go
    mended = [p for f in range(3) for p in square("01", f, 2, 2 + f, 5)]
    paths = scene(tmp_path, spark, mended + late)
    tracking_evaluation.run(spark, **paths, config=tracking_evaluation.Config(sequences=["01"]))
    after = evaluated(spark, paths)
    assert [r for r in after if r[0] != "01"] == [r for r in rows if r[0] != "01"]
    assert [r[3] for r in after if r[0] == "01" and r[1] == "frame"] == []


def test_evaluation_of_empty_tables(spark, tmp_path):
    for name in ("truth", "result"):
        spark.createDataFrame([], PIXELS).write.parquet(f"{tmp_path}/{name}")
        spark.createDataFrame([], TRACKS).write.parquet(f"{tmp_path}/{name}_tracks")
    paths = {n: f"{tmp_path}/{n}" for n in ("truth", "result", "truth_tracks", "result_tracks", "out")}
    assert tracking_evaluation.run(spark, **paths) == 0
    assert evaluated(spark, paths) == []


# queries, settings, command line


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_job_query_equals_its_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    found = duck.sql(registry.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(found, key=str)


def test_configuration(spark, tmp_path):
    assert read_config(spark, None, series_audit.Config) == series_audit.Config()
    assert read_config(spark, str(ROOT / "jobs/series_audit.json"), series_audit.Config) == series_audit.Config()
    found = read_config(spark, (ROOT / "jobs/tracking_evaluation.json").as_uri(), tracking_evaluation.Config)
    assert found == tracking_evaluation.Config() and found.limits().jump == 50.0
    (tmp_path / "c.json").write_text(json.dumps({"no_such": 1}))
    with pytest.raises(ValueError, match="no_such"):
        read_config(spark, str(tmp_path / "c.json"), series_audit.Config)


def test_command_line(spark, tmp_path):
    put(spark, [(1, 0, "user", "a"), (1, 2, "bot", "b")], f"{tmp_path}/in", "a")
    (tmp_path / "c.json").write_text(json.dumps({"first_number": 1, "ids_each_part": 1}))
    line = [sys.executable, str(ROOT / "jobs/series_audit.py"), "--source", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/c.json"]
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    for rows in (2, 0):
        done = subprocess.run(line, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"{rows} new rows" in done.stderr
    assert audited(spark, f"{tmp_path}/out") == [(1, 2, 0, 2, 0, 2, 1, 0, 2, 2, 2, False, 1)]
