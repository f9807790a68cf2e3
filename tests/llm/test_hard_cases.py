"""Clashing columns, very long texts, hash-hostile words, hot groups, and brute force of what SQL can't express."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, joins, langid, licences, nearjoin, packing, pretokens, quality, sharding, toxicity, urlfilter, warc
from tessera.llm.words import hash_words, string_buffers

from .test_llm_operators import DOCS, prose, words

MORSE = "".join("ab"[i.bit_count() & 1] for i in range(4096))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def clash(spark):
    """Columns named like the operators' own."""
    names = ("nj_row", "bf_block", "bf_maybe", "row", "s", "id", "lost", "removed", "host", "k1", "k2", "t1", "stays", "place", "part", "first", "rank", "at", "hs_size", "hs_shard", "hs_k1", "hs_piece", "qr_stats", "kept", "words_left", "base_failed", "own", "dir", "contamination", "language", "toxicity_score", "length", "offset")
    docs = spark.createDataFrame([(i, prose(i % 4, 70), "en", "a", 1) for i in range(12)] + [(None, None, None, None, None)], DOCS)
    return docs.withColumns({n: F.lit("mine") for n in names})


def test_columns_of_other_names_pass(spark, clash):
    n = clash.count()
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    mine = {c for c in clash.columns if clash.schema[c].dataType.simpleString() == "string"} - {"text", "lang", "source"}
    results = {
        "near": (nearjoin.one_of_each(clash), set()),
        "toxic": (toxicity.toxicity(clash, labels), {"toxicity_score"}),
        "items": (decontaminate.contamination(clash, items), {"contamination"}),
        "lang": (langid.identify(clash), {"language"}),
        "shards": (sharding.histogram_shards(clash), {"hs_size", "hs_shard", "hs_slot"}),
        "rules": (quality.quality_rules(clash, with_text="whole"), {"qr_stats", "kept", "words_left", "base_failed"}),
        "pack": (packing.pack(clash), {"length", "offset"}),
        "licence": (licences.licence_scan(licences.paths_of(clash)), set()),
    }
    for name, (df, replaced) in results.items():
        rows = df.collect()
        assert len(rows) == (5 if name == "near" else n), name
        assert len(set(df.columns)) == len(df.columns), name
        for r in rows:
            assert all(r[c] == "mine" for c in mine - replaced), name
        assert not any(r[c] == "mine" for r in rows for c in replaced), name


def test_very_long_texts(spark):
    long = prose(1, 1_500_000, 50_000) + " Größe"  # some 10 MB, one line
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, long + " end", "en", "a", 1), (3, prose(2, 80), "en", "a", 1), (5, long, "en", "b", 1)], DOCS)
    assert {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.near_join(docs).collect()} == {1: (1, 2), 2: (1, 2), 5: (1, 2), 3: (3, 0)}
    labels = spark.createDataFrame([(1, 0, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 4
    items = spark.createDataFrame([(7, " ".join(long.split()[-14:]))], "item_id bigint, text string")
    assert {r.doc_id: r.contamination.n_hit for r in decontaminate.contamination(docs, items).collect()} == {1: 14, 2: 14, 5: 14, 3: 0}
    assert {r.language.lang for r in langid.identify(docs).collect()} == {"en"}
    assert sharding.histogram_shards(docs, shards=3).count() == 4
    got = {r.doc_id: r.qr_stats.n_words for r in quality.quality_rules(docs).collect()}
    assert got == {1: 1_500_001, 2: 1_500_002, 5: 1_500_001, 3: 80}
    assert sum(r.length for r in packing.pack(docs.filter("doc_id < 2")).collect()) > 1_500_000
    files = spark.createDataFrame([(1, "LICENSE", long + "\nReleased under the MIT License."), (2, "x", long)], "doc_id bigint, path string, text string")
    assert {r.doc_id: r.licence_from for r in licences.licence_scan(files).collect()} == {1: "own", 2: ""}


# hashes


def test_words_that_collide_modulo_two_to_the_64(spark):
    texts = [x[:n] for n in (1024, 2048, 4096) for x in (MORSE, OTHER)]
    hashes = hash_words(*string_buffers(pa.array(texts)))[0]
    assert len(set(hashes.tolist())) == len(texts)
    own = pretokens.encoder(packing.tokenizer_path())
    for t, ids in zip(texts, pretokens.token_ids(pa.array(texts), packing.tokenizer_path(), packing.ranks_path()), strict=True):
        assert ids.tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert all(r.n_links == 0 for r in nearjoin.near_join(docs).collect())


def test_pieces_whose_hashes_collide_are_encoded_by_the_tokenizer(monkeypatch):
    monkeypatch.setattr(pretokens, "span_hashes", lambda codes, starts, ends: (ends - starts).astype(np.uint64))
    long = "abcdefghij" * 9
    texts = ["abc de fgh", "xyz de abc", "qrs tu vw", None, "日本", "ab\x00c", "é è ab éa èa abcdefgh abcdefghi bcdefghij", f"x {long}y", f"x {long}z", f"x {long[:20]} {long[:19]}q", f"x {long[:19]}q"]
    own = pretokens.PieceEncoder(packing.tokenizer_path(), packing.ranks_path())
    monkeypatch.setattr(pretokens, "encoder", lambda *_: own)
    for part in (texts, texts[::-1], texts[1:2], texts[5:6], texts[6:7], texts[8:]):  # later calls meet pieces of earlier ones
        for t, ids in zip(part, pretokens.token_ids(pa.array(part), "", None), strict=True):
            assert ids.tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_token_ids_of_the_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own = pretokens.encoder(packing.tokenizer_path(), packing.ranks_path())
    for t, ids in zip(texts, pretokens.token_ids(pa.array(texts), packing.tokenizer_path(), packing.ranks_path()), strict=True):
        assert ids.tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids


# joins


def test_hot_keys_meet_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_ROWS", 10)
    monkeypatch.setattr(joins, "MOST_HOT", 5)
    left = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 90).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("jn_rows")).filter("k <> 5").withColumn("v", F.col("k") * 2)
    want = sorted((r.k, r.id, None if r.k == 5 else 2 * r.k) for r in left.collect())
    got = joins.many_to_one(left, right, ["k"], "left").collect()
    assert sorted(((r.k, r.id, r.v) for r in got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert joins.many_to_one(left, right, ["k"]).count() == sum(w[2] is not None for w in want)
    assert joins.many_to_one(left, right.limit(0), ["k"], "left").count() == 1000


# 2 archives


def test_urls_come_back_as_they_were(spark, tmp_path):
    urls = ["http://a/%41?q=%2F", "http://a/ü ü?x=%", "a\r\nb: c", "", "http://a/%zz#%25", "日本"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r.page_id: r.url for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/u")).collect()}
    assert got == dict(enumerate(urls))


def test_large_payloads_twins_and_clashing_columns(spark, tmp_path, monkeypatch):
    """Payloads of megabytes, a third of the rows equal in everything, columns named like the operator's own."""
    monkeypatch.setattr(joins, "LEAST_ROWS", 10)
    monkeypatch.setattr(joins, "MOST_HOT", 5)
    big = "".join(chr(97 + (i * i) % 23) for i in range(3_000_000))
    rows = [(1, "http://a", big), (2, "http://b", big), (3, "http://c", big[:1_000_000])]
    rows += [(9, "http://twin", "same page")] * 40 + [(i, f"http://p/{i}", f"page {i % 50}") for i in range(100, 180)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({n: F.lit("mine") for n in ("wa_sha1", "wa_html", "wa_first", "row", "path", "jn_rows")})
    got = warc.read_archives(warc.write_archives(pages.repartition(7), f"file://{tmp_path}/w")).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    for html, ids in groups.items():
        mine = [r for r in got if r.payload_digest == warc_digest(html)]
        assert sorted(r.page_id or -1 for r in mine) == sorted(i or -1 for i in ids)
        (response,) = [r for r in mine if r.record_type == "response"]
        assert response.page_id == max(ids, key=lambda i: i or -1) and bytes(response.payload) == html.encode()
        assert all(r.payload_bytes == len(html) for r in mine)
        assert all(r.refers_to == response.page_id and not r.payload for r in mine if r.record_type == "revisit")


def warc_digest(html):
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


# 8 url filter


@pytest.mark.parametrize("small_list", [0, 1 << 20])
def test_hot_and_very_long_urls(spark, monkeypatch, small_list):
    """A listed url on a third of the pages, urls of a megabyte, and both ways of joining."""
    monkeypatch.setattr(joins, "LEAST_ROWS", 10)
    monkeypatch.setattr(joins, "MOST_HOT", 5)
    long = "http://long.net/" + "a/b" * 350_000
    urls = ["http://hot.net/x"] * 60 + [f"http://site{i}.net/p" for i in range(100)] + [long, long + "c", "http://hot.net/y", None, "no scheme", ""]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id bigint, url string, uf_key string")
    listed = spark.createDataFrame([("http://hot.net/x",), ("http://HOT.net/x",), (long,), ("http://site7.net/p",), (None,)], "url string")
    got = urlfilter.url_filter(pages, listed, small_list=small_list).collect()
    assert len(got) == len(urls) and all(r.uf_key == "mine" for r in got)
    blocked = {r.page_id for r in got if r.uf_verdict == "block"}
    assert blocked == {i for i, u in enumerate(urls) if u in ("http://hot.net/x", long, "http://site7.net/p")}


# 3 licences


def brute_licences(rows):
    """Every candidate of every file scored in plain Python, and ancestors walked one by one."""
    files = [t or "" for _, _, t in rows]
    held = collections.Counter(t for f in files for t in set(licences.terms_of(f)))
    templates = [(name, licences.terms_of(t)) for name, ts in licences.TEMPLATES.items() for t in ts]
    known = {t for _, c in templates for t in c}
    idf = {t: math.log((len(files) + 1) / (held[t] + 1)) + 1 for t in known}

    def cosine(a, b):
        x = {t: n * idf.get(t, licences.OTHER_IDF) for t, n in a.items()}
        y = {t: n * idf[t] for t, n in b.items()}
        return sum(v * y.get(t, 0) for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if x else 0.0

    def own(text):
        lines = text.split("\n")
        parts = {(i, j) for i in range(len(lines)) for j in range(i, min(i + licences.LINES, len(lines)))} | {(0, len(lines) - 1)}
        i = 0
        while i < len(lines):
            j = i
            while j + 1 < len(lines) and lines[i].strip() and lines[j + 1].strip():
                j += 1
            parts.add((i, j))
            i = j + 1
        scored = [(-round(cosine(licences.terms_of("\n".join(lines[a : b + 1])), c), 9), name) for a, b in parts for name, c in templates]
        score, name = min(scored)
        return (name, -score) if -score >= licences.THRESHOLD else None

    found = [own(t) for t in files]
    giving = {}
    for (_, path, _), f in zip(rows, found, strict=True):
        if path and f and path.split("/")[-1].split(".")[0].upper() in licences.LICENCE_NAMES:
            d = path.rpartition("/")[0]
            giving[d] = min(giving.get(d, (1, "")), (-f[1], f[0]))
    out = {}
    for (i, path, _), f in zip(rows, found, strict=True):
        out[i] = (f[0], "own") if f else (None, None)
        d = path.rpartition("/")[0] if path and not f else None
        while d is not None and out[i][0] is None:
            if d in giving:
                out[i] = (giving[d][1], d)
            d = d.rpartition("/")[0] if d else None
    return out


def test_licence_texts_of_any_length(spark):
    """A file equal to a long template, and files and paragraphs just below and above the length from which terms are hashed."""
    body = " ".join(f"clause{i} of the licence grants right{i % 90} to holder{i % 40}" for i in range(620))
    templates = {"Long-1.0": (body,), "MIT": licences.TEMPLATES["MIT"]}
    assert len(body) > 29_000
    held = {t: 1 for t in licences.terms_of(body)}
    model = licences.Templates(templates, held, 10)
    wrapped = body.replace(" clause", "\nclause")
    for text in (body, wrapped, f"intro words here\n\n{wrapped}\n\nmore words"):
        files = spark.createDataFrame([(1, "a/x", text), (2, "a/y", "plain words")], "doc_id bigint, path string, text string")
        got = {r.doc_id: (r.licence, r.licence_score) for r in licences.licence_scan(files, templates=templates).collect()}
        assert got[1][0] == "Long-1.0" and got[1][1] > 0.999 and got[2][0] is None
    mit = licences.MIT_TEXT
    for size in (19_999, 20_001, 60_000):
        text = (mit + "\n") * (size // (len(mit) + 1) + 1)
        whole = text[:size]
        scores = [model.best(whole)[1], model.best_long(whole)[1]]
        assert abs(scores[0] - scores[1]) < 1e-9 and scores[0] > 0.99
        assert model.scan(whole, [0])[0] == "MIT" and model.scan(whole, [0])[1] >= scores[0] - 1e-9


def test_licences_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    notices = [t for ts in licences.TEMPLATES.values() for t in ts]
    rows = []
    for i in range(150):
        lines = [prose(1000 + i * 9 + k, int(rng.integers(0, 12)), 40) for k in range(int(rng.integers(0, 8)))]
        for _ in range(int(rng.integers(0, 3))):
            w = notices[rng.integers(len(notices))].split()
            cut = [x for x in w if rng.random() < 0.9]
            wrap = int(rng.integers(4, 30))
            lines[int(rng.integers(len(lines) + 1)) : 0] = ["# " + " ".join(cut[a : a + wrap]) for a in range(0, len(cut), wrap)]
        depth = int(rng.integers(0, 4))
        name = rng.choice(["LICENSE", "a.py", "COPYING.txt", "b", "notice.md"]) + ("" if i % 7 else "")
        rows.append((i, "/".join([*(f"d{rng.integers(3)}" for _ in range(depth)), str(name)]), "\n".join(lines)))
    got = {r.doc_id: (r.licence, r.licence_from) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    want = brute_licences(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert len({v[0] for v in want.values()}) > 4


def test_licence_cosine_counts_every_term():
    model = licences.Templates(licences.TEMPLATES, {}, 10)
    assert model.best("All rights reserved.") == ("Proprietary", 1.0)
    assert model.best("All rights reserved. " + prose(1, 400))[1] < 0.3
    for text in ("x " * 500 + "All rights reserved.", licences.MIT_TEXT, prose(3, 50) + licences.APACHE_HEADER, "", "one"):
        assert model.best(text) == pytest.approx(model.best_long(text)) if model.best(text)[0] else model.best_long(text)[0] is None


# 6 language


def test_language_of_signs_that_are_no_letters(spark):
    rows = [(i, prose(i, 30), "en") for i in range(40)] + [(100, "² ½ ① Ⅷ 12 -", "en"), (101, "ª", "en"), (102, "́", "en"), (103, "日", "en")]
    got = {r.doc_id: r.language.lang for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert [got[i] for i in (100, 101, 102, 103)] == ["und", "en", "und", "en"]


def test_language_sample_is_bounded_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_DOCUMENTS", 200)
    sizes, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda block, labels, classes: sizes.append(len(labels)) or fit(block, labels, classes))
    for ids in ([None], [3], [0, None, 5]):
        rows = [(ids[i % len(ids)], prose(i, 20), "en" if i % 2 else "de") for i in range(3000)]
        _, names = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
        assert names == ["de", "en"]
    assert all(100 <= n <= 200 * langid.WINDOWS_EACH for n in sizes)


# 7 shards


def test_equal_texts_share_a_shard(spark):
    rows = [(i, prose(i % 37, 60) if i % 3 else prose(i, 20 + i % 50)) for i in range(3000)]
    rows += [(5000 + i, None if i % 2 else "") for i in range(50)] + [(7, "repeated"), (7, "repeated")]
    out = sharding.histogram_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=10).collect()
    where, weight = collections.defaultdict(set), collections.Counter()
    for r in out:
        where[r.text or ""].add(r.hs_shard)
        weight[r.hs_shard] += r.hs_size
    assert len(out) == len(rows) and {len(v) for v in where.values()} == {1}
    mean = sum(weight.values()) / 10
    assert all(abs(w - mean) < 0.02 * mean for w in weight.values())


@pytest.mark.parametrize("seed", range(5))
def test_heavy_texts_are_placed_whole_and_level(seed):
    rng = np.random.default_rng(seed)
    groups = {int(k): int(rng.integers(1, 3000)) for k in rng.integers(0, 1 << 60, 30)}
    share = 1000.0
    where, load = sharding.place_heavy(groups, 20, share)
    for k, size in groups.items():
        assert len(where[k]) == max(1, math.ceil(size / share))
    assert sum(load) == pytest.approx(sum(groups.values()))
    room = sharding.rooms(load, sum(load) + 5000)
    assert sum(room) == pytest.approx(5000)
    ends = [a + b for a, b in zip(load, room, strict=True) if b > 1e-9]
    assert max(ends) - min(ends) < 1e-6 and all(x >= max(ends) - 1e-6 for x, b in zip(load, room, strict=True) if b <= 1e-9)


# 9 quality


@pytest.mark.parametrize("once", [False, True])
def test_line_frequency_equals_brute_force(spark, once):
    rng = np.random.default_rng(8)
    pool = [f"Line  {i} " + prose(i, 9) for i in range(30)]
    rows = []
    for i in range(300):
        lines = [pool[int(k) % 30] if rng.random() < 0.8 else pool[int(k) % 30].upper() + "\t" for k in rng.geometric(0.08, int(rng.integers(1, 12)))]
        rows.append((i if i % 9 else None, "\n".join([prose(i, 20), *lines]), "en", [None, "", "a", "a", "b"][i % 5], 0))
    rows += [rows[3]] * 40
    out = quality.quality_rules(spark.createDataFrame(rows, DOCS), with_text="clean", min_words=40, min_line_docs=5, max_line_share=0.12, max_repeat_percent=100, copies_once=once).collect()

    def norm(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")

    holders, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for n, (_, t, _, h, _) in enumerate(rows):
        key = t if once else n
        hosts[h or ""].add(key)
        for x in t.split("\n"):
            holders[h or "", norm(x)].add(key)
    frequent = {k for k, v in holders.items() if len(v) > 5 and len(v) > 0.12 * len(hosts[k[0]])}
    want = []
    for d, t, _, h, _ in rows:
        kept = [x for x in t.split("\n") if (h or "", norm(x)) not in frequent]
        left = sum(len(x.split()) for x in kept)
        want.append((d or -1, "\n".join(kept), left, len(t.split()) < 40, len(t.split()) >= 40 and left >= 40))
    assert 3 < len(frequent) < len(holders)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.words_left, r.base_failed, r.kept) for r in out) == sorted(want)
    assert words("A b") == ["a", "b"]


# 10 packing


def test_ranks_inside_groups_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    rows = [(i, "a b c" if i % 3 else prose(i, i % 40)) for i in range(600)] + [(1, "a b c")] * 5
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(out) == 605 and sorted(places) == list(range(len(places)))
