"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

A window (13 consecutive item words, or a whole shorter item) is a set of 4-word shingles. A
document contains it only if it holds every shingle, so one shingle per window is a sufficient
prefix at full containment (|x| - |x| + 1). Shingles are ordered by document frequency over the
whole corpus and the rarest is joined; length and positional bounds drop placements that cannot
fit, and the rest is verified word by word on the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .words import LUT, hash_words, release_memory, shingle_hashes, slices, string_buffers

WINDOW = 13
SHINGLE = 4
#: Bytes of item text in a block. A larger benchmark is joined block after block, each exactly.
BLOCK_BYTES = 4 << 20
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,hit_starts:array<bigint>,hit_ends:array<bigint>>"
_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit_starts", pa.list_(pa.int64())), ("hit_ends", pa.list_(pa.int64()))])
_FILTER_BITS = 20


class Member:
    """Membership of 64-bit hashes in a sorted table, behind a bit table that answers most lookups."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are members, and their index in ``keys``."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        ok = self.keys[k] == hashes[at]
        return at[ok], k[ok]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] … first[0] + count[0] - 1, then the same for the next, as one array."""
    total = int(count.sum())
    return np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)


class Windows:
    """The distinct windows of a block of items, as word ranges of the items' texts."""

    def __init__(self, texts: list[str], ids: list[str | None], window: int):
        raw, offsets = string_buffers(pa.array(texts, pa.string()))
        self.words, self.starts, self.ends, at = hash_words(raw, offsets)
        self.low = LUT[raw]
        n_words = np.diff(at)
        size = np.minimum(window, n_words)
        count = np.where(n_words > 0, n_words - size + 1, 0)
        item = np.repeat(np.arange(len(texts)), count)
        first, size = _ranges(at[:-1], count), size[item]
        # equal windows become one: by hash, then word by word and byte by byte against the first of that hash
        name = np.zeros(len(first), np.uint64)
        for n in np.unique(size).tolist():
            w = np.flatnonzero(size == n)
            name[w] = shingle_hashes(self.words, n)[first[w]]
        _, one, same = np.unique(name, return_index=True, return_inverse=True)
        one = one[same]
        alone = ~self._equal(first, size, one)
        one[alone] = np.flatnonzero(alone)
        kept, number = np.unique(one, return_inverse=True)
        self.first, self.size = first[kept], size[kept]
        named = np.array([i is not None for i in ids], bool)[item] if len(item) else np.zeros(0, bool)
        self.ids = sorted({i for i in ids if i is not None})
        rank = {x: k for k, x in enumerate(self.ids)}
        who = np.array([rank.get(i, -1) for i in ids], np.int64)[item] if len(item) else np.zeros(0, np.int64)
        pairs = np.unique(number[named] * max(len(self.ids), 1) + who[named])
        self.item_at = np.searchsorted(pairs // max(len(self.ids), 1), np.arange(len(kept) + 1))
        self.items = pairs % max(len(self.ids), 1)

    def _equal(self, first: np.ndarray, size: np.ndarray, one: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        out = np.ones(len(first), bool)
        todo = np.flatnonzero(one != np.arange(len(first)))
        length = self.ends - self.starts
        for i in range(0, len(todo), step):
            t = todo[i : i + step]
            ok = size[t] == size[one[t]]
            n = np.where(ok, size[t], 1)
            here, there = _ranges(first[t], n), _ranges(first[one[t]], n)
            ok &= np.logical_and.reduceat((self.words[here] == self.words[there]) & (length[here] == length[there]), np.cumsum(n) - n)
            u = np.flatnonzero(ok)
            if len(u):
                here, there = _ranges(first[t[u]], size[t[u]]), _ranges(first[one[t[u]]], size[t[u]])
                same = self.low[_ranges(self.starts[here], length[here])] == self.low[_ranges(self.starts[there], length[there])]
                ok[u] = np.logical_and.reduceat(same, np.concatenate(([0], np.cumsum(np.add.reduceat(length[here], np.cumsum(size[t[u]]) - size[t[u]]))[:-1])))
            out[t] = ok
        return out

    def widths(self) -> list[int]:
        return np.unique(np.minimum(SHINGLE, self.size)).tolist()

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Windows of this shingle width, the hash of the shingle at every word, and the most shingles a window has."""
        which = np.flatnonzero(np.minimum(SHINGLE, self.size) == width)
        most = int(self.size[which].max()) - width + 1 if len(which) else 0
        return which, shingle_hashes(self.words, width) if len(self.words) >= width else np.zeros(0, np.uint64), most

    def vocabulary(self) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for width in self.widths():
            which, hashes, most = self.shingles(width)
            for o in range(most):
                out.append(np.unique(hashes[self.first[which[self.size[which] - width >= o]] + o]))
        return np.unique(np.concatenate(out))


def _scan(column: pa.Array):
    """Per slice of the column: its texts' row numbers, word hashes, spans and offsets."""
    for a, b in slices(column):
        raw, offsets = string_buffers(column.slice(a, b - a))
        yield (a, raw, *hash_words(raw, offsets))


def _positions(words: np.ndarray, at: np.ndarray, width: int, table: Member) -> tuple[np.ndarray, np.ndarray]:
    """Positions of member shingles of ``width`` words that stay inside one text, and their index."""
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, k = table.find(shingle_hashes(words, width))
    doc_end = at[np.searchsorted(at, pos, side="right")]
    ok = pos + width <= doc_end
    return pos[ok], k[ok]


def _frequency_udf(vocabulary: np.ndarray, widths: list[int]):
    @F.arrow_udf("array<bigint>")
    def shingles_found(text: pa.Array) -> pa.Array:
        table, out = Member(vocabulary), [[] for _ in range(len(text))]
        for row, _, words, _, _, at in _scan(text):
            for width in widths:
                pos, k = _positions(words, at, width, table)
                doc = np.searchsorted(at, pos, side="right") - 1
                for d, i in np.unique(np.stack([doc, k], 1), axis=0).tolist() if len(pos) else []:
                    out[row + d].append(i)
        return pa.array(out, pa.list_(pa.int64()))

    return shingles_found


class Prefixes:
    """Inverted index from each window's rarest shingle to (window, offset)."""

    def __init__(self, windows: Windows, vocabulary: np.ndarray, frequency: np.ndarray):
        self.w, self.widths = windows, windows.widths()
        n = len(windows.first)
        key, off = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for width in self.widths:
            which, hashes, most = windows.shingles(width)
            best = np.full(len(which), np.iinfo(np.int64).max)
            for o in range(most):
                fits = np.flatnonzero(windows.size[which] - width >= o)
                h = hashes[windows.first[which[fits]] + o]
                f = frequency[np.searchsorted(vocabulary, h)]
                less = (f < best[fits]) | ((f == best[fits]) & (h < key[which[fits]]))
                best[fits[less]], key[which[fits[less]]], off[which[fits[less]]] = f[less], h[less], o
        self.table = Member(key)
        slot = np.searchsorted(self.table.keys, key)
        order = np.argsort(slot, kind="stable")
        self.win, self.off = order, off[order]
        self.first = np.searchsorted(slot[order], np.arange(len(self.table.keys) + 1))


def _place(p: Prefixes, raw, words, starts, ends, at) -> tuple[np.ndarray, np.ndarray]:
    """Verified placements: first word position and window."""
    where, wins, w = [], [], p.w
    for width in p.widths:
        pos, k = _positions(words, at, width, p.table)
        count = p.first[k + 1] - p.first[k]
        entry = _ranges(p.first[k], count)
        win, begin = p.win[entry], np.repeat(pos, count) - p.off[entry]
        at_pos = np.repeat(pos, count)
        doc = np.searchsorted(at, at_pos, side="right") - 1
        fits = (np.minimum(SHINGLE, w.size[win]) == width) & (begin >= at[doc]) & (begin + w.size[win] <= at[doc + 1])
        where.append(begin[fits])
        wins.append(win[fits])
    begin, win = np.concatenate(where) if where else np.zeros(0, np.int64), np.concatenate(wins) if wins else np.zeros(0, np.int64)
    good = np.zeros(len(begin), bool)
    for i in range(0, len(begin), 1 << 15):  # candidates of many documents in bounded memory
        b, x = begin[i : i + (1 << 15)], win[i : i + (1 << 15)]
        here, there = _ranges(b, w.size[x]), _ranges(w.first[x], w.size[x])
        same = (words[here] == w.words[there]) & (ends[here] - starts[here] == w.ends[there] - w.starts[there])
        ok = np.logical_and.reduceat(same, np.cumsum(w.size[x]) - w.size[x])
        u = np.flatnonzero(ok)
        if len(u):
            here, there = _ranges(b[u], w.size[x[u]]), _ranges(w.first[x[u]], w.size[x[u]])
            length = ends[here] - starts[here]
            same = LUT[raw[_ranges(starts[here], length)]] == w.low[_ranges(w.starts[there], length)]
            of_window = np.add.reduceat(length, np.cumsum(w.size[x[u]]) - w.size[x[u]])
            ok[u] = np.logical_and.reduceat(same, np.cumsum(of_window) - of_window)
        good[i : i + (1 << 15)] = ok
    return begin[good], win[good]


def _match_udf(p: Prefixes):
    """Adds one block's windows to what earlier blocks found (``before``: null for the first)."""

    @F.arrow_udf(RESULT)
    def match(text: pa.Array, before: pa.Array) -> pa.Array:
        out: list[dict] = []
        earlier = before.to_pylist() if before.null_count < len(before) else [None] * len(before)
        for row, raw, words, starts, ends, at in _scan(text):
            begin, win = _place(p, raw, words, starts, ends, at)
            order = np.argsort(begin, kind="stable")
            begin, win = begin[order], win[order]
            first = np.searchsorted(begin, at)
            for d in range(len(at) - 1):
                a, b, old = first[d], first[d + 1], earlier[row + d]
                n = int(at[d + 1] - at[d])
                if a == b:
                    out.append(old or {"n_words": n, "n_hit": 0, "items": [], "hit_starts": [], "hit_ends": []})
                    continue
                s, e = begin[a:b] - at[d], begin[a:b] - at[d] + p.w.size[win[a:b]]
                items = {p.w.ids[i] for w in set(win[a:b].tolist()) for i in p.w.items[p.w.item_at[w] : p.w.item_at[w + 1]].tolist()}
                if old:
                    s, e = np.concatenate((s, old["hit_starts"])).astype(np.int64), np.concatenate((e, old["hit_ends"])).astype(np.int64)
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], e[order]
                    items |= set(old["items"])
                reach = np.maximum.accumulate(e)
                new = np.concatenate(([True], s[1:] > reach[:-1]))
                hs = s[new]
                he = reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))]
                out.append({"n_words": n, "n_hit": int((he - hs).sum()), "items": sorted(items), "hit_starts": hs.tolist(), "hit_ends": he.tolist()})
        release_memory()
        return pa.array(out, _RESULT)

    return match


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``contamination``: n_words, n_hit, items, hit_starts, hit_ends.

    Words are runs of characters other than ASCII control, space and punctuation, A-Z
    lower-cased. Spans are word positions, merged. Null or empty texts have no words and no
    hits; items without words match nothing; items with a null id hit words but are not listed;
    repeated ids count once. A column of that name is replaced. No shuffle: documents stay where
    they are, only shingle counts of the benchmark's vocabulary are gathered.
    """
    source = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out, previous = docs.drop("contamination"), F.lit(None).cast(RESULT)
    for b in range(blocks):
        part = source if blocks == 1 else source.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        rows = part.collect()  # at most about block_bytes of text
        windows = Windows([r.t for r in rows], [r.i for r in rows], window)
        vocabulary = windows.vocabulary()
        frequency = np.zeros(len(vocabulary), np.int64)
        if len(vocabulary):
            found = docs.select(F.explode(_frequency_udf(vocabulary, windows.widths())(F.col(text))).alias("k"))
            with small_batches(docs.sparkSession):
                counts = found.groupBy("k").count().collect()  # as many rows as the block has shingles at most
            for r in counts:
                frequency[r.k] = r["count"]
        match = _match_udf(Prefixes(windows, vocabulary, frequency))
        out = out.withColumn("contamination", match(F.col(text), previous))
        previous = F.col("contamination")
    return out


def verdict(result: Column) -> dict[str, Column]:
    """The digest columns of a contamination result."""
    ids = F.array_join(F.array_sort(result["items"]), ",")
    return {
        "n_words": result["n_words"],
        "n_hit": result["n_hit"],
        "n_items": F.size(result["items"]).cast("long"),
        "items_sha256": F.sha2(ids, 256),
        "contaminated": (result["n_hit"] > 0) & (result["n_hit"] * 20 >= result["n_words"]),
    }


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, items).select("doc_id", "contamination")
    return found.select("doc_id", *[c.alias(n) for n, c in verdict(F.col("contamination")).items()])


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0) t
), sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n) t
), found AS (
  SELECT p.rid, p.i, p.n, x.item_id FROM places p JOIN wins x ON p.n = x.n AND p.win = x.win
), hit AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM found) t GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM found) t GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.rid = hit.rid LEFT JOIN its ON dw.rid = its.rid
"""
