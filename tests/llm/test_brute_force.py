"""Classifiers and shards against plain versions of their definitions."""

from __future__ import annotations

import collections
import heapq
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, nearjoin, sharding, toxicity
from tessera.llm.words import string_buffers

from .test_llm_operators import words

TABLES = "/root/testdata/sf0.001"


# 1 n-gram join


def test_near_join_finds_every_link_of_the_documents(spark):
    """Against an exact set join over all documents of a table: by prefix, then the whole sets."""
    table = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{table}/documents.parquet").collect()]
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([("no words", t)]))
    times = collections.Counter(g for s in sets for g in s)
    held, links = collections.defaultdict(list), collections.Counter()
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        prefix = sorted(sets[i], key=lambda g: (times[g], g))[: len(sets[i]) - math.ceil(0.8 * len(sets[i])) + 1]
        for j in {j for g in prefix for j in held[g]}:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
        for g in prefix:
            held[g].append(i)
    want = sorted((rows[i][0], links[i]) for i in range(len(rows)))
    assert sorted((r.doc_id, r.n_links) for r in nearjoin.query(spark, table).collect()) == want
    assert sum(links.values()) > 100


# 4 toxicity


def plain_toxicity(rows, labels):
    """n-grams as strings in sets, a dense matrix, and the same descent."""
    truth = collections.defaultdict(int)
    for i, toxic in labels:
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            truth[i] = max(truth[i], toxic)
    texts = collections.defaultdict(str)
    for i, t in rows:
        if i in truth:
            texts[i] = max(texts[i], t or "")
    taught = {}
    for i, t in texts.items():
        taught[t] = max(taught.get(t, 0), truth[i])

    def grams(text):
        low = f" {(text or '').lower()} "
        return {low[a : a + n] for n in (3, 4, 5, 6) for a in range(len(low) - n + 1)}

    sets, y = [grams(t) for t in taught], np.array(list(taught.values()), float)
    least = min(max(len(y) * 0.003, 5), 20)
    seen = collections.Counter(g for s in sets for g in s)
    bad = collections.Counter(g for s, label in zip(sets, y, strict=True) if label for g in s)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    ratio = {g: math.log((bad[g] + 1) / (n1 + 2)) - math.log((n - bad[g] + 1) / (n0 + 2)) for g, n in seen.items() if n >= least}
    ratio = {g: r for g, r in ratio.items() if abs(r) > 0.5}
    names = {g: k for k, g in enumerate(ratio)}
    r = np.array(list(ratio.values()))
    x = np.zeros((len(sets), len(names)))
    for i, s in enumerate(sets):
        x[i, [names[g] for g in s if g in names]] = 1
    w, bias = np.zeros(len(r)), math.log(n1 / n0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, 61):
        e = (1 / (1 + np.exp(-np.clip(x @ (w * r) + bias, -40, 40))) - y) / len(y)
        g, gb = (x.T @ e) * r + 20 * w / len(y), e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        bias -= 0.02 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    weight = w * r
    return {i: 1 / (1 + math.exp(-max(-40, min(40, bias + sum(weight[names[g]] for g in grams(t) if g in names))))) for i, t in rows}


def test_toxicity_scores_equal_a_plain_classifier(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()]
    want = plain_toxicity(rows, labels)
    got = toxicity.query(spark, TABLES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 2e-3, r.doc_id
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)


def test_taught_texts_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_BYTES", 20_000)
    held = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, shift: held.extend(texts))
    docs = spark.createDataFrame([(i, f"word{i} " * (5000 if i % 7 == 0 else 100)) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    toxicity.train(docs, labels)
    assert 0 < sum(map(len, held)) <= 20_000 and max(map(len, held)) < 2000 and len(held) > 10


# 6 language


def plain_forward(net, window):
    """Probabilities of one byte window, loop by loop."""
    pooled = []
    for i, width in enumerate(langid.WIDTHS):
        for f in range(langid.FILTERS):
            k = i * langid.FILTERS + f
            best = -math.inf
            for at in range(langid.LENGTH - max(langid.WIDTHS) + 1):
                total = sum(float(net.embed[window[at + j], d]) * float(net.filters[j * langid.EMBED + d, k]) for j in range(width) for d in range(langid.EMBED))
                best = max(best, total)
            pooled.append(max(best + float(net.bias[k]), 0.0))
    z = [sum(p * float(net.out[k, c]) for k, p in enumerate(pooled)) + float(net.out_bias[c]) for c in range(len(net.out_bias))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def starting_network(classes, seed=7):
    rng, k = np.random.default_rng(seed), len(langid.WIDTHS) * langid.FILTERS
    span = max(langid.WIDTHS) * langid.EMBED
    return langid.Network(rng.normal(0, 0.5, (256, langid.EMBED)).astype(np.float32), (rng.normal(0, 0.3, (span, k)) * langid._mask()).astype(np.float32), np.zeros(k, np.float32), rng.normal(0, 0.2, (k, classes)).astype(np.float32), np.zeros(classes, np.float32))


def byte_windows(texts):
    return np.concatenate([b for b, _, _ in langid.windows(*string_buffers(__import__("pyarrow").array(texts)))])


def test_the_network_equals_plain_loops():
    net = starting_network(3)
    block = byte_windows(["the cat sat on the mat", "größer als je zuvor", ""])
    got = net.probabilities(block)
    for i in range(len(block)):
        assert np.abs(got[i] - plain_forward(net, block[i].tolist())).max() < 1e-5


def test_a_step_goes_down_the_measured_slope():
    """The first step of the descent has the sign of the loss's difference quotient, for weights of every kind."""
    texts = ["the cat sat on the mat", "der Hund und die Katze", "le chat est sur la table", "a dog and a bird"]
    labels, classes = np.array([0, 1, 2, 0]), 3
    block, start = byte_windows(texts), starting_network(3)
    after = langid.fit(block, labels, classes, epochs=1)
    weight = len(labels) / np.bincount(labels, minlength=classes) / classes

    def loss(net):
        p = net.probabilities(block).astype(np.float64)
        return float(np.mean([-weight[c] * math.log(p[i, c]) for i, c in enumerate(labels)]))

    rng, checked = np.random.default_rng(0), 0
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        values = getattr(start, name)
        moved = getattr(after, name) - values
        places = np.argwhere(np.abs(moved) > 3e-3)
        for at in map(tuple, places[rng.permutation(len(places))[:25]]):
            slopes = []
            for step in (2e-2, -2e-2):
                parts = {n: getattr(start, n).astype(np.float64).copy() for n in ("embed", "filters", "bias", "out", "out_bias")}
                parts[name][at] += step
                slopes.append(loss(langid.Network(**parts)))
            slope = slopes[0] - slopes[1]
            if abs(slope) > 1e-5:
                checked += 1
                assert np.sign(slope) == -np.sign(moved[at]), (name, at)
    assert checked > 40


# 7 shards


@pytest.mark.parametrize("hot", [0, 3])
def test_shards_equal_exact_borders(spark, hot):
    """Heavy texts where a plain greedy rule puts them, every border within its tolerance of the exact place, slots in hash order."""
    rng = np.random.default_rng(hot)
    rows = [(i, "x" * int(rng.integers(0, 300)) + str(i)) for i in range(4000)]
    rows += [(10_000 + 1000 * k + j, f"hot{k} " * 40) for k in range(hot) for j in range(60 * (k + 1))]
    shards, tolerance = 8, sharding.TOLERANCE
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.histogram_shards(docs, shards).withColumn("h", F.xxhash64("text")).collect()
    assert len(got) == len(rows)
    size = {r.doc_id: len(r.text) + 16 for r in got}
    assert all(r.hs_size == size[r.doc_id] for r in got)
    total = sum(size.values())
    share, weight, of = total / shards, collections.Counter(), collections.defaultdict(set)
    for r in got:
        weight[r.h] += r.hs_size
        of[r.h].add(r.hs_shard)
    heavy = sorted((h for h, w in weight.items() if w > sharding.HEAVY * share), key=lambda h: (-weight[h], h))
    assert all(weight[h] <= share for h in heavy)
    heap, load = [(0.0, s) for s in range(shards)], [0.0] * shards
    for h in heavy:
        used, s = heapq.heappop(heap)
        assert of[h] == {s}
        load[s] = used + weight[h]
        heapq.heappush(heap, (load[s], s))
    level = sharding.rooms(load, total)
    light = sorted((r.h, r.hs_size, r.hs_shard) for r in got if r.h not in set(heavy))
    assert [s for _, _, s in light] == sorted(s for _, _, s in light)  # contiguous in hash order
    assert all(len(s) == 1 for s in of.values())
    taken = collections.Counter()
    for _, b, s in light:
        taken[s] += b
    largest = max(b for _, b, _ in light)
    for k in range(1, shards):
        below, exact = sum(taken[s] for s in range(k)), sum(level[:k])
        assert abs(below - exact) <= max(tolerance * share, largest), k
    for s in range(shards):
        assert sorted(r.hs_slot for r in got if r.hs_shard == s) == list(range(sum(r.hs_shard == s for r in got)))
    dropped = sharding.histogram_shards(docs, shards, with_text=False)
    assert "text" not in dropped.columns and {(r.doc_id, r.hs_shard) for r in dropped.collect()} == {(r.doc_id, r.hs_shard) for r in got}
