"""Small tests of the training-data operators: brute force, round trips, nulls, ties, empty tables."""

from __future__ import annotations

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import bloom, decontaminate, langid, licences, nearjoin, packing, quality, sharding, toxicity, urlfilter, warc
from tessera.llm.components import components
from tessera.llm.words import hash_words, string_buffers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, very long, tied and repeated rows."""
    base = prose(1, 80)
    rows = [
        (1, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (3, None, None, None, None),
        (None, "", "fr", "b", 0),
        (None, None, None, None, None),
        (4, prose(2, 40_000), "en", "a", 1),
        (5, base + " extra words here", None, "b", 1),
        (6, "!!! ... ---", "de", "b", 1),
        (7, "éa ŒÜ 日本語", "ja", None, 3),
        (8, "word", "en", "a", 4),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_follow_the_pattern():
    texts = ["", None, "A b-C", "é É 1x", "x" * 2_500_000 + " y x", " \t", "a"]
    raw, offsets = string_buffers(pa.array(texts))
    hashes, _, _, at = hash_words(raw, offsets)
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        got = hashes[at[i] : at[i + 1]].tolist()
        assert len(w) == len(got)
        for a, b in zip(w, got, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


# 1 near join


def jaccard_links(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else {("", t or "")} for _, t in rows]
    return [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]


def test_near_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(12):
        base = prose(f, 120).split()
        for _ in range(8):
            t = list(base)
            for k in rng.integers(0, len(t), rng.integers(0, 6)):
                t[k] = f"x{rng.integers(1000)}"
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, ""), (len(rows) + 2, None)]
    got = {r.doc_id: r for r in nearjoin.near_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    links = jaccard_links(rows)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if links[i][j]) for i in range(len(rows))]
    for i in range(len(rows)):
        assert got[i].n_links == sum(links[i]) - 1
        assert got[i].class_id == root[i]


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK_CLASSES", 8)
    base = prose(9, 100).split()
    rows = [(i, " ".join([*base[:90], f"t{i}", *base[91:]])) for i in range(60)]
    got = nearjoin.near_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    links = jaccard_links(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: sum(links[i]) - 1 for i in range(60)}
    assert {r.class_id for r in got} == {0}


def test_near_join_odd_rows(odd, empty):
    got = nearjoin.near_join(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.class_id, r.n_links))
    assert by[1] == by[2] == {(1, 3)} and by[5] == {(1, 3)}  # three copies and one near copy
    assert nearjoin.near_join(empty).count() == 0
    kept = nearjoin.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8]  # null and empty texts are one, and null ids come last
    assert kept.filter("text is null or text = ''").count() == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (10, 3), (100, 101), (101, 102), (102, 103), (103, 104)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 4, **{n: 100 for n in range(100, 105)}}


def test_band_choice():
    n = nearjoin.band_count(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** n >= 0.9999 > 1 - (1 - 0.8**5) ** (n - 1)


# 2 archives


def test_archives_round_trip(spark, tmp_path):
    same = "<html>same</html>"
    rows = [(i, f"http://h.org/{i}?ü=1", f"<html>{prose(i, 800)}</html>") for i in range(300)]
    rows += [(1000, "u", same), (1001, "u", same), (1001, "u", same), (None, None, same), (1002, None, None), (1003, "x", ""), (None, "n", None), (1004, "long", "é" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).withColumn("wa_id2", F.lit(1))
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a", archive_bytes=200_000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    html = {(r[0], r[1]): r[2] for r in rows}
    kinds = collections.defaultdict(list)
    for r in got:
        data = (html[r.page_id, r.url] or "").encode()
        assert r.payload_bytes == len(data)
        import base64

        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        kinds[r.payload_digest].append(r)
        if r.record_type == "response":
            assert bytes(r.payload) == data and r.refers_to is None
    for group in kinds.values():
        top = max((r.page_id for r in group if r.page_id is not None), default=None)
        assert sum(r.record_type == "response" for r in group) == 1
        assert next(r for r in group if r.record_type == "response").page_id == top
        assert all(r.refers_to == top for r in group if r.record_type == "revisit")
    raw = open(manifest.filter("dictionary_bytes > 0").first().path.removeprefix("file://"), "rb").read(8)
    assert raw[:4] == b"\x5d\x2a\x4d\x18"


def test_archives_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/e")).count() == 0


def test_every_archive_leads_with_a_dictionary(spark, tmp_path):
    rows = [(i, f"http://h/{i}", prose(i, 40)) for i in range(60)] + [(None, None, None), (60, None, "x" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    noise = bytes(np.random.default_rng(1).integers(0, 256, 300_000, np.uint8))
    for name, table in (("many", pages.repartition(40)), ("one", pages.limit(1)), ("null", pages.filter("page_id is null"))):
        manifest = warc.write_archives(table, f"file://{tmp_path}/{name}")
        found = manifest.collect()
        assert found and all(struct.unpack("<II", open(r.path.removeprefix("file://"), "rb").read(8)) == (warc.DICTIONARY_MAGIC, r.dictionary_bytes) for r in found)
        got = warc.read_archives(manifest).collect()
        assert sorted(((r.page_id, r.payload.decode()) for r in got), key=str) == sorted(((r.page_id, r.html or "") for r in table.collect()), key=str)
    for records in ([], [b""], [b"x"], [b"x" * 100], [b"x" * 20_000] * 9, [noise], [noise[i : i + 99] for i in range(0, 9900, 99)], [bytes(range(256))] * 3):
        dictionary = zstandard.ZstdCompressionDict(warc.train_dictionary(records))
        assert dictionary.dict_id() > 0  # a dictionary of the format, not plain content
        for r in records:
            assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(zstandard.ZstdCompressor(level=warc.LEVEL, dict_data=dictionary).compress(r)) == r


# 3 licences


def test_licences_and_inheritance(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        (1, "p/LICENSE", mit),
        (2, "p/a.py", "code\nmore code"),
        (3, "p/sub/b.py", "# " + apache + "\ncode"),
        (4, "p/sub/deep/c.py", "plain"),
        (5, "p/sub/deep/LICENSE.txt", "intro\n" + "x " * 30 + "\n" + apache),
        (6, "q/d.py", "nothing"),
        (7, None, None),
        (8, "q/e.py", "the version of the work is under review"),
        (9, "LICENSE", ""),
        (10, "p/sub/deep/very/f.py", None),
    ]
    out = licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string"))
    got = {r.doc_id: (r.licence, r.licence_from) for r in out.collect()}
    assert got == {
        1: ("MIT", "own"),
        2: ("MIT", "p"),
        3: ("Apache-2.0", "own"),
        4: ("Apache-2.0", "p/sub/deep"),
        5: ("Apache-2.0", "own"),
        6: (None, None),
        7: (None, None),
        8: (None, None),
        9: (None, None),
        10: ("Apache-2.0", "p/sub/deep"),
    }


def test_licences_odd_rows(odd, empty):
    assert licences.licence_scan(licences.paths_of(odd).withColumn("licence", F.lit(1))).count() == odd.count()
    assert licences.licence_scan(licences.paths_of(empty)).count() == 0


def test_licences_of_notices_in_many_files(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    for notice, name in ((apache, "Apache-2.0"), (mit, "MIT")):
        for n, every in ((1, 1), (3, 1), (60, 3), (60, 1)):
            rows = [(i, f"p{i}/LICENSE", "größe\nplain text\n" + (notice if i % every == 0 else "of another kind")) for i in range(n)]
            got = licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()
            assert {(r.doc_id, r.licence, r.licence_from) for r in got} == {(i, name, "own") if i % every == 0 else (i, None, None) for i in range(n)}


def test_marked_words_miss_no_run_that_reaches_the_threshold():
    rng = np.random.default_rng(5)
    vocabulary = sorted({t for texts in licences.TEMPLATES.values() for x in texts for t in licences.terms_of(x)})
    pieces = [t for texts in licences.TEMPLATES.values() for t in texts]
    reached = 0
    for _ in range(40):
        files = int(rng.integers(1, 1000))
        model = licences.Templates(licences.TEMPLATES, {t: int(rng.integers(files + 1)) for t in vocabulary}, files)
        marked = model.marks(licences.THRESHOLD)
        for _ in range(50):
            w = words(pieces[rng.integers(len(pieces))])
            text = " ".join(x for x in w if rng.random() < 0.7)
            if model.best(text)[1] >= licences.THRESHOLD:
                reached += 1
                assert marked & set(licences.terms_of(text))
    assert reached > 200


# 4 toxicity


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(400):
        w = prose(i, int(rng.integers(20, 200))).split()
        bad = i % 5 == 0
        if bad:
            w.insert(int(rng.integers(len(w))), "dreadfulslur")
        docs.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, y).collect()}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].toxic_predicted == int(i % 5 == 0) for i in unseen]) > 0.97


def test_toxicity_of_long_texts_is_that_of_their_own_ngrams(monkeypatch):
    texts = [prose(i, 60) + (" dreadfulslur" if i % 4 == 0 else "") for i in range(400)]
    model = toxicity.fit(texts, np.array([int(i % 4 == 0) for i in range(400)]))
    rng = np.random.default_rng(9)
    clean = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 1_000_000)))  # no learned n-gram, however many others
    short, *scores = model.score([clean[:50], clean, clean + " dreadfulslur", "dreadfulslur", None])
    assert scores[0] == short == scores[3] < 0.5
    assert abs(scores[1] - scores[2]) < 1e-6 and scores[1] > short
    mixed = [prose(i, 300) + " Größe dreadfulslur" for i in range(6)] + ["", None, "a"]
    whole = model.score(mixed)
    monkeypatch.setattr(toxicity, "_PIECE", 50)
    monkeypatch.setattr(toxicity, "_HELD", 20)
    assert np.allclose(model.score(mixed), whole, rtol=0, atol=1e-12)


def test_toxicity_counts_ngrams_exactly(monkeypatch):
    texts = [prose(i, 80, 60) for i in range(50)]
    counts = collections.Counter(g for t in texts for g in {(" " + t + " ")[i : i + n] for n in toxicity.ORDERS for i in range(len(t) + 3 - n)})
    grams = toxicity._candidates(texts, 5)
    seen = np.zeros(len(grams.keys), int)
    for ids in toxicity._in_parts(texts, grams):
        seen[ids] += 1
    assert sorted(seen[seen >= 5]) == sorted(n for n in counts.values() if n >= 5)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 0, None), (None, 0, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(odd.withColumn("Toxicity_Score", F.lit("x")), labels).collect()
    assert len(got) == odd.count() and all(0 <= r.toxicity_score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).filter("toxicity_score > 0.01").count() == 0


# 5 decontamination


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    items = [(i, prose(1000 + i, n, 60)) for i, n in enumerate((1, 3, 5, 13, 14, 40, 13, 2))] + [(8, ""), (9, None), (3, "second text of three")]
    docs = []
    for i in range(60):
        w = prose(i, int(rng.integers(1, 120)), 60).split()
        if i % 3 == 0:
            k = items[int(rng.integers(8))][1].split()
            at = int(rng.integers(len(w) + 1))
            w[at:at] = k[: int(rng.integers(1, len(k) + 1))]
        docs.append((i, " ".join(w).upper() if i % 2 else "-".join(w)))
    docs += [(100, None), (101, ""), (102, "w1")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 60):  # one block, and many
        got = {r.doc_id: r.contamination for r in decontaminate.contamination(d, b, block_bytes=block).collect()}
        for i, t in docs:
            w, hit, found = words(t), set(), set()
            for item, x in items:
                v = words(x)
                n = min(13, len(v))
                for s in range(len(v) - n + 1) if n else ():
                    for p in range(len(w) - n + 1):
                        if w[p : p + n] == v[s : s + n]:
                            hit |= set(range(p, p + n))
                            found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, sorted(found)) == (len(w), len(hit), got[i]["items"])


def test_contamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(None, "w1 w2"), (1, None), (2, "word")], "item_id bigint, text string")
    assert decontaminate.contamination(odd, items).count() == odd.count()
    assert decontaminate.contamination(odd, items.limit(0)).filter("contamination.n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


# 6 language


def test_language_odd_rows(odd, empty):
    got = {(r.doc_id, r.text): r.language for r in langid.identify(odd).collect()}
    assert got[3, None].lang == "und" and got[6, "!!! ... ---"].lang == "und" and got[None, ""].lang == "und"
    assert langid.identify(empty).count() == 0
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).filter("language.lang <> 'und'").count() == 0


def test_windows_cover_every_byte_once(monkeypatch):
    texts = ["", "a" * 10, "b" * 256, "c" * 257, "d" * 1000]
    raw, offsets = string_buffers(pa.array(texts))
    monkeypatch.setattr(langid, "MOST_WINDOWS", 2)
    parts = list(langid.windows(raw, offsets))
    block, owner, covers = (np.concatenate(x) for x in zip(*parts, strict=True))
    total = np.bincount(owner, covers, len(texts))
    for t, n in zip(texts, total, strict=True):
        assert len(t) <= n + langid._SPAN - 1 and n <= max(len(t), langid._STEP)
    assert block.shape[1] == langid.LENGTH


def test_language_learns(spark):
    a, b = "abcde fgh", "vwxyz stu"
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list(b if i % 2 else a), 300)), "bb" if i % 2 else "aa") for i in range(200)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert got.filter("language.lang = lang").count() >= 198


def test_language_learns_rare_languages_and_copies_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_DOCUMENTS", 300)
    rows = [(i, "the same text again and again" if i % 3 == 0 else prose(i, 12), "common") for i in range(3000)]
    rows += [(10_000 + i, "".join(chr(0x400 + 16 * (i % 20) + j % 16) for j in range(i, i + 60)), f"rare{i % 20:02d}") for i in range(200)]
    held, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda block, labels, classes: held.append((block, labels)) or fit(block, labels, classes))
    _, names = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert names == ["common", *[f"rare{i:02d}" for i in range(20)]]
    (block, labels), = held
    assert len({(b.tobytes(), y) for b, y in zip(block, labels, strict=True)}) == len(block)
    assert langid.shares({"a": 5, "b": 10_000, "c": 400, "d": 10_000}, 4000) == {"a": 5, "c": 400, "b": 1797, "d": 1798}
    assert min(langid.shares({str(i): 50 for i in range(1000)}, 4000).values()) == langid.LEAST_EACH


# 7 shards


def check_shards(rows, shards, loose):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.hs_shard].append(r)
    for shard, part in by.items():
        assert 0 <= shard < shards
        assert sorted(r.hs_slot for r in part) == list(range(len(part)))
    total = sum(r.hs_size for r in rows)
    largest = max(r.hs_size for r in rows)
    for part in by.values():
        assert abs(sum(r.hs_size for r in part) - total / shards) <= loose * total / shards + 2 * largest


def test_shards_are_even_with_hot_text(spark):
    hot = prose(1, 30)
    rows = [(i, hot if i % 3 == 0 else prose(i, 20 + i % 50)) for i in range(3000)]
    out = sharding.histogram_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=10).collect()
    assert len(out) == 3000
    check_shards(out, 10, 0.01)
    where = collections.defaultdict(set)
    for r in out:
        where[r.text].add(r.hs_shard)
    assert sum(len(v) > 1 for v in where.values()) == 1


def test_shards_odd_rows(odd, empty):
    out = sharding.histogram_shards(odd).collect()
    assert len(out) == odd.count()
    assert sharding.histogram_shards(empty).count() == 0


# 8 urls


def test_url_filter(spark):
    rows = [
        (1, "https://Sub.Example.ORG/en/17?x"),
        (2, "http://example.org/fr/"),
        (3, "http://a.com/de/1"),
        (4, "http://b.net/bad/?utm_source=z&b=2&a=1#f"),
        (5, "https://www.b.net/bad?a=1&b=2"),
        (6, None),
        (7, "no scheme"),
        (8, "http://b.net/good"),
        (9, "http://org"),
        (10, "http://x.org"),
        (10, "http://x.org"),
        (11, "http://b.net/bad/?a=1&b=2"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit(1))
    listed = spark.createDataFrame([("ftp://b.net/bad?b=2&a=1",), (None,), ("http://a.com/de/1",)], "url string")
    want = {
        1: {("example.org/en/1", "block")},
        2: {("org/", "allow")},
        3: {("com/de/", "block")},
        4: {(None, "block")},
        5: {(None, "block")},
        6: {(None, "allow")},
        7: {(None, "allow")},
        8: {(None, "allow")},
        9: {(None, "allow")},
        10: {(None, "allow")},
        11: {(None, "block")},
    }
    for small in (urlfilter.SMALL_LIST, -1):  # both ways of the exact join
        got = collections.defaultdict(set)
        for r in urlfilter.url_filter(pages.withColumns({"UF_Rule": F.lit(1), "bf_block": F.lit(2)}), listed, small_list=small).collect():
            got[r.page_id].add((r.uf_rule, r.uf_verdict))
            assert (r.host, r.bf_block) == (1, 2)
        assert got == want
    assert urlfilter.url_filter(pages, listed.limit(0)).filter("uf_rule is null and uf_verdict = 'block'").count() == 0
    assert urlfilter.url_filter(pages.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    probe = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    found = bloom.possible_members(probe, "k", keys)
    assert found.columns == ["k", "id"]
    assert found.filter("id < 2000").count() == 2000
    assert found.filter("id >= 2000").count() < 400  # one in a hundred


def test_small_bloom_filter_still_filters(spark, monkeypatch):
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", 72 * 8)  # an eighth of what the keys want
    got = bloom.possible_members(spark.range(4000), "id", spark.range(400))
    assert got.filter("id < 400").count() == 400 and got.count() < 4000


# 9 quality


def test_quality_base_counts(spark):
    texts = [None, "", " \n ", "a b c a b c", "x\nx\n\nx y\nX", "one two three " * 30, "# * $ % & | < > a", prose(3, 100)]
    rows = [(i, t, "en", None if i % 2 else "h", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in range(3)}
        s = got[i].qr_stats
        assert tuple(s) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)), t
        assert got[i].base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_quality_frequent_lines(spark):
    common = "accept all cookies before you read this page of ours"
    rows = [(i, f"{common}\n{prose(i, 60)}", "en", "a", 0) for i in range(40)]
    rows += [(100 + i, f"{common}\n{common}\n{common}\n{common}\n{common}\n{prose(i, 45)}", "en", "a", 0) for i in range(5)]
    rows += [(200, f"{common}\n{prose(7, 60)}", "en", "b", 0)]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS), with_text="clean", max_line_share=0.5, max_repeat_percent=100).collect()}
    assert all(out[i].kept and common not in out[i].text and out[i].words_left == 60 for i in range(40))
    assert not any(out[100 + i].kept or out[100 + i].base_failed for i in range(5))
    assert common in out[200].text


def test_quality_odd_rows(odd, empty):
    assert quality.quality_rules(odd, with_text="clean").count() == odd.count()
    assert quality.quality_rules(empty).count() == 0


# 10 packing


def naive_best_fit(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice([10, 64, 100]))
    lengths = rng.integers(1, window + 1, 300).tolist()
    counts = collections.Counter(lengths)
    plan, sequences = packing.best_fit_plan(counts, window)
    used = collections.Counter()
    for i, n in enumerate(plan["length"]):
        last = plan["rank"][i + 1] if i + 1 < len(plan["length"]) and plan["length"][i + 1] == n else counts[n]
        for r in range(plan["rank"][i], last):
            k = r - plan["rank"][i]
            s, o = plan["sequence"][i] + k // plan["each"][i], plan["offset"][i] + k % plan["each"][i] * n
            for x in range(o, o + n):
                used[s, x] += 1
    assert set(used.values()) == {1}
    fill = collections.Counter(s for s, _ in used)
    assert sorted(fill) == list(range(sequences)) and max(fill.values()) <= window
    assert sorted(window - f for f in fill.values()) == naive_best_fit(lengths, window)


def test_packing_keeps_every_token(spark, odd, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    own = Tokenizer.from_file(path)
    docs = odd.filter("doc_id is not null").unionByName(odd.sparkSession.createDataFrame([(50, "a<|endoftext|>b don't  go\r\n\t x" + "é" * 300, "en", "a", 1), (51, "日本 ½   x", "en", "a", 1)], DOCS))
    rows = packing.pack(docs.withColumn("length", F.lit(1))).collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    for d, ts in texts.items():
        want = []
        for t in ts:
            ids = np.array([*own.encode(t, add_special_tokens=False).ids, 1], "<u4")
            want += [(s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
        assert sorted(want) == sorted(pieces[d])
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))]
        assert sum(n for _, n in p) <= 2048
    assert packing.pack(empty).count() == 0


def test_pieces_give_the_tokenizers_ids():
    import random

    from tessera.llm import pretokens

    path, rng = packing.tokenizer_path(), random.Random(1)
    signs = list("ab z  \n\t\r'sSt dremvl0129.,!éßªµ²½×÷£ ")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["don't we'll 'sun 's's  'tis\n'sx ''s I'ved", "", " ", "  ", "a  ", "\n\n a", "日本 x", "a<|endoftext|>b"]
    own = pretokens.encoder(path)
    for ranks in (None, packing.ranks_path()):
        for t, ids in zip(texts, pretokens.token_ids(pa.array([*texts, None]), path, ranks), strict=False):
            assert ids.tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
