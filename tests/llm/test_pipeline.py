"""Every pipeline stage on odd and empty tables, and the whole pipeline against plain Python."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import toxicity

from .test_llm_operators import DOCS, prose, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus: clean texts, copies, near copies, toxic ones, contaminated ones, depleted ones, odd rows."""
    root = str(tmp_path_factory.mktemp("tables"))
    banner = "accept all of our cookies before you read on"
    rows = [(i, prose(i, 120), "en", f"h{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "h0", 0) for i in range(5)]
    rows += [(210 + i, rows[i][1] + " tail", "en", "h1", 0) for i in range(5)]
    rows += [(300 + i, prose(500 + i, 60) + " dreadfulslur " + prose(600 + i, 60), "en", "h2", 0) for i in range(40)]
    rows += [(400, prose(900, 200), "en", "h0", 0), (401, "x " * 60, "en", "h0", 0), (402, "short text", "en", "h0", 0)]
    rows += [(500 + i, f"{banner}\n" * 8 + prose(700 + i, 20), "en", "h4", 0) for i in range(30)]
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (600, None, "en", "h0", 0), (None, prose(950, 90), None, None, None), (3, rows[3][1], "en", "h0", 0)]
    spark.createDataFrame(rows, DOCS).withColumn("k1", F.lit("extra")).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(300 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    item = " ".join(rows[[r[0] for r in rows].index(400)][1].split()[50:80])
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows


def test_stages_keep_the_columns_and_do_their_work(spark, tables):
    root, rows = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    ids = collections.Counter(r[0] for r in rows)
    gone = [{401: 1, 402: 1, 600: 1, None: 2} | {500 + i: 1 for i in range(30)}, {300 + i: 1 for i in range(40)}, {200 + i: 1 for i in range(5)} | {210 + i: 1 for i in range(5)} | {3: 1}, {400: 1}]
    for (name, stage), out in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        docs = stage(spark, docs, root)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5] == "k1"
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids -= collections.Counter(out)
        assert collections.Counter(r.doc_id for r in docs.collect()) == ids, name
        assert {r.k1 for r in docs.collect()} == {"extra"}
    packed = corpus_pipeline.run(spark, root).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == ids


def test_columns_of_the_caller_pass_every_stage(spark, tables):
    """Columns named as the operators name their own, and a very long text."""
    root, _ = tables
    names = ("kept", "qr_stats", "words_left", "base_failed", "toxicity_score", "toxic_predicted", "contamination", "row", "rest", "host", "stays", "bf_maybe")
    long = spark.createDataFrame([(9000, prose(3, 300_000, 40_000), "en", "h9", 1, "extra")], DOCS + ", k1 string")
    docs = spark.read.parquet(f"{root}/documents.parquet").unionByName(long).withColumns({n: F.lit("mine") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[n] == "mine" for r in rows for n in names), name
        assert [len(r.text) for r in rows if r.doc_id == 9000] == [len(long.first().text)], name
        docs = spark.createDataFrame(rows, docs.schema)
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, docs, root).collect()} >= {9000}


def test_stages_of_empty_and_odd_tables(spark, tables, tmp_path):
    root, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    odd = docs.filter("doc_id is null or text is null or doc_id < 3")
    for table in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, root).count() <= table.count() * 2
    empty = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[3:4]:  # no labels, no items: nothing goes
        assert stage(spark, docs, empty).count() == docs.count()


def test_pipeline_equals_plain_python(spark):
    """The stages over sf0.001 with rules written out in Python; the classifier is the fitted one."""
    root = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "", r.source or "") for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    held, hosts = collections.Counter(), collections.Counter(h for *_, h in rows)
    for _, t, h in rows:
        held.update({(h, norm(x)) for x in t.split("\n")} - {(h, "")})
    cut = {k for k, n in held.items() if n > 20 and n > 0.01 * hosts[k[0]]}
    kept = []
    for d, t, h in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {k + j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in range(3)}
        left = "\n".join(x for x in t.split("\n") if (h, norm(x)) not in cut)
        if len(w) >= 50 and 2 * len(rep) <= len(w) and len(re.findall(r"[^\x20\x09-\x0D]+", left)) >= 50:
            kept.append((d, left))
    cleaned = spark.createDataFrame(kept, "doc_id bigint, text string")
    model = toxicity.train(cleaned, spark.read.parquet(f"{root}/labels.parquet"))
    kept = [x for x, score in zip(kept, model.score([t for _, t in kept]), strict=True) if score < toxicity.THRESHOLD]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t) for _, t in kept)]
    alike = [{j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)} for a in sets]
    root_of = list(range(len(kept)))
    for _ in kept:
        root_of = [min(root_of[j] for j in alike[i]) for i in range(len(kept))]
    groups = collections.defaultdict(list)
    for i, r in enumerate(root_of):
        groups[r].append(kept[i])
    kept = [min(g) for g in groups.values()]
    windows = set()
    for r in spark.read.parquet(f"{root}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for d, t in kept:
        w = words(t)
        hit = {i + j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append((d, t))
    from tokenizers import Tokenizer

    from tessera.llm import packing

    own = Tokenizer.from_file(packing.tokenizer_path())
    want = {d: len(own.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, root).collect():
        got[r.doc_id] += r.length
    assert got == want
    assert np.mean(list(want.values())) > 50
