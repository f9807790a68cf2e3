"""Toxicity: a logistic classifier on binary character n-grams scaled by naive Bayes log-count ratios.

The learned n-grams are held by their 64-bit hashes and looked up exactly, so a text of any length
hits none but its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_of, in_sample
from .scratch import materialise
from .words import release_memory, slices

ORDERS = (3, 4, 5, 6)
#: Hashes are found by their first bits; n-grams that may be frequent enough, by more of them.
DIRECT_BITS, SKETCH_BITS = 20, 24
THRESHOLD = 0.3
#: Most labelled rows of each label that the classifier is fitted on (those with the least row hashes).
MOST_POSITIVE, MOST_NEGATIVE = 1500, 3500
#: Most bytes of their texts. Rows are taken by their hashes; one that would exceed this is passed over.
MOST_BYTES = 64 << 20
#: An n-gram must stand in this share of the fitted texts, but no fewer than the first and no more than the second bound.
MIN_SHARE, MIN_TEXTS = 0.003, (5, 20)
_BLOCK = 128
#: Characters hashed at a time, and hits held before repeats are dropped.
_PIECE, _HELD = 1 << 18, 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Characters of texts (lower-cased, padded with one space) in bounded blocks of segments.

    A block has its codes, and of every segment the text, the length and the n-gram starts that it
    answers for: a long text is cut into segments that overlap by an n-gram.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        low = " " + (t or "").lower() + " "
        for a in range(0, len(low), _PIECE):
            part = low[a : a + _PIECE + max(ORDERS) - 1]
            held.append((part, i, len(part), _PIECE))
            size += len(part)
            if size >= _PIECE:
                yield _block(held)
                held, size = [], 0
    if held:
        yield _block(held)


def _block(held: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, owners, lengths, starts = zip(*held, strict=True)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.array(owners), np.array(lengths), np.array(starts)


def ngrams(texts: Iterable[str | None], pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (text numbers, values) of the n-grams that ``pick`` takes from an array of hashes (their positions, their values)."""
    for codes, owners, lengths, starts in _pieces(texts):
        ends = np.cumsum(lengths)
        acc, who, what = codes, [], []
        with np.errstate(over="ignore"):
            for n in range(2, max(ORDERS) + 1):
                acc = acc[:-1] * _MUL + codes[n - 1 :] if len(acc) > 1 else acc[:0]
                if n not in ORDERS:
                    continue
                h = acc * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
                pos, value = pick((h ^ (h >> np.uint64(32))) * _MUL)
                segment = np.searchsorted(ends, pos, side="right")
                own = pos - (ends - lengths)[segment] < np.minimum(starts, lengths - n + 1)[segment]
                who.append(owners[segment[own]])
                what.append(value[own])
        yield np.concatenate(who), np.concatenate(what)


class Grams:
    """A set of n-grams by sorted 64-bit hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.count = np.bincount(_top(keys, DIRECT_BITS), minlength=1 << DIRECT_BITS)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)
        self.most = int(self.count.max())
        self.count = self.count.astype(np.int32)

    def pick(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the set's members in ``hashes``, and their numbers in the set."""
        top = _top(hashes, DIRECT_BITS)
        pos = np.flatnonzero(self.count[top])
        top, h = top[pos], hashes[pos]
        at = self.first[top]
        found = self.keys[at] == h
        for r in range(1, self.most):
            more = np.flatnonzero(~found & (self.count[top] > r))
            at[more] += 1
            found[more] = self.keys[at[more]] == h[more]
        return pos[found], at[found]

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, number in the set) of every distinct member of every text, sorted."""
        size, parts, held = max(len(self.keys), 1), [np.zeros(0, np.int64)], 0
        for who, what in ngrams(texts, self.pick):
            parts.append(_distinct(who * size + what))
            held += len(parts[-1])
            if held > _HELD:
                parts = [_distinct(np.concatenate(parts))]
                held = 0
        both = _distinct(np.concatenate(parts)) if len(parts) > 2 else np.concatenate(parts)
        return both // size, both % size


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (np.unique hashes, which takes several times as long)."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))]


def _in_parts(texts: list[str | None], grams: Grams) -> Iterator[np.ndarray]:
    """Every text's distinct members of the set."""
    for i in range(0, len(texts), _BLOCK):
        part = texts[i : i + _BLOCK]
        who, what = grams.hits(part)
        yield from np.split(what, np.searchsorted(who, np.arange(1, len(part))))


def _candidates(texts: list[str | None], least: float) -> Grams:
    """The n-grams that stand in ``least`` of the texts, and some more: none that does is left out."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    for _, top in ngrams(texts, lambda h: (np.arange(len(h)), _top(h, SKETCH_BITS))):
        np.add.at(sketch, top, np.int32(1))  # of the sketch's own type, which takes a tenth of the time

    def frequent(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = np.flatnonzero(sketch[_top(h, SKETCH_BITS)] >= least)
        return pos, h[pos]

    parts, held = [np.zeros(0, np.uint64)], 0
    for _, h in ngrams(texts, frequent):
        parts.append(_distinct(h))
        held += len(parts[-1])
        if held > _HELD:
            parts, held = [_distinct(np.concatenate(parts))], 0
    return Grams(_distinct(np.concatenate(parts)))


@dataclass
class Model:
    """score = sigmoid(sum of weights of the distinct learned n-grams + bias); ``keys`` are their sorted hashes."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.grams = Grams(self.keys)

    def score(self, texts: list[str | None]) -> np.ndarray:
        who, what = self.grams.hits(texts)
        z = np.bincount(who, self.weights[what], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str | None], labels: np.ndarray, odds_shift: float = 0.0, rounds: int = 60, decay: float = 20.0, rate: float = 0.02) -> Model:
    """Fit on binary features. ``odds_shift`` is added to the bias: log-odds lost by sampling the labels unequally."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), -40.0 if not len(y) or y.max() == 0 else 40.0)
    least = min(max(len(y) * MIN_SHARE, MIN_TEXTS[0]), MIN_TEXTS[1])
    grams = _candidates(texts, least)
    seen, positive = np.zeros(len(grams.keys), np.int32), np.zeros(len(grams.keys), np.int32)
    for ids, label in zip(_in_parts(texts, grams), y, strict=True):
        seen[ids] += 1
        if label:
            positive[ids] += 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    # log-count ratio with smoothing; n-grams as common among both labels carry no ratio
    ratio = np.log((positive + 1) / (n1 + 2)) - np.log((seen - positive + 1) / (n0 + 2))
    known = (seen >= least) & (np.abs(ratio) > 0.5)
    grams = Grams(grams.keys[known])
    index = [ids.astype(np.int32) for ids in _in_parts(texts, grams)]  # the n-grams are hashed again rather than held
    r = ratio[known].astype(np.float32)
    w = np.zeros(len(r))
    bias = float(np.log(n1 / n0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        scaled, g, gb = w * r, decay * w / len(y), 0.0
        for i in range(0, len(y), _BLOCK):
            part, truth = index[i : i + _BLOCK], y[i : i + _BLOCK]
            flat = np.concatenate(part)
            owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
            z = np.bincount(owner, scaled[flat], len(part)) + bias
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - truth) / len(y)
            g += np.bincount(flat, e[owner], len(r)) * r
            gb += float(e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return Model(grams.keys, (w * r).astype(np.float32), bias + odds_shift)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Fit on labelled documents that are not held out, a bounded sample of each label.

    Several labels of one id: the largest counts. Null labels and ids teach nothing.
    """
    truth = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("tx_label"))
    truth = truth.filter(~held_out(F.col("doc_id")))
    sizes = {r.tx_label: r.n for r in truth.groupBy("tx_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = {1: MOST_POSITIVE, 0: MOST_NEGATIVE}
    chosen = F.lit(False)
    for label, most in limit.items():
        chosen = chosen | ((F.col("tx_label") == label) & in_sample("doc_id", "toxic", most, sizes.get(label, 0)))
    picked = truth.filter(chosen).withColumn("tx_order", hash_of("doc_id", "toxic"))
    # one text for each chosen id: about MARGIN times the bounds at most. Their sizes say which texts come to the driver
    found = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "tx_label", "tx_order").agg(F.max(F.col(text)).alias("tx_text"))
    found = materialise(found.withColumn("tx_bytes", F.coalesce(F.octet_length("tx_text"), F.lit(0))), "labelled")
    chosen_ids, room = [], MOST_BYTES
    left = dict(limit)
    for r in sorted(found.select("doc_id", "tx_label", "tx_order", "tx_bytes").collect(), key=lambda r: (r.tx_order, r.doc_id)):
        if left[r.tx_label] and r.tx_bytes <= room:
            chosen_ids.append((r.doc_id,))
            left[r.tx_label] -= 1
            room -= r.tx_bytes
    wanted = docs.sparkSession.createDataFrame(chosen_ids, found.select("doc_id").schema)
    ranked, rows = sorted(found.join(F.broadcast(wanted), "doc_id", "left_semi").collect(), key=lambda r: (r.tx_order, r.doc_id)), []
    for label in limit:
        rows += [r for r in ranked if r.tx_label == label]
    rows = list({r.tx_text: r for r in rows[::-1]}.values())  # copies teach once, as toxic if any is
    y = np.array([r.tx_label for r in rows], np.int64)
    taken = {label: min(n, limit.get(label, n)) for label, n in sizes.items()}
    shift = 0.0
    if taken.get(0) and taken.get(1):
        shift = float(np.log(sizes[1] / taken[1]) - np.log(sizes[0] / taken[0]))
    return fit([r.tx_text for r in rows], y, shift)


def score_column(model: Model, text: Column) -> Column:
    """Score of every whole text, from 0 to 1; null is scored as the empty text."""
    keys, weights, bias = model.keys, model.weights, model.bias
    held: list[Model] = []  # the look-up table of a task, built once

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        own = held[0] if held else Model(keys, weights, bias)
        held[:] = [own]
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        parts = [own.score(texts.slice(a, b - a).to_pylist()) for a, b in slices(texts)]
        release_memory()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return toxic(text)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with toxicity_score (0 to 1) and toxic_predicted (1 from ``threshold``).

    Every whole text is scored from its characters alone. Repeated rows score alike. Without
    labels, or with one label only, that label's certainty is every score. Columns of those
    names are replaced.
    """
    model = train(docs.select("doc_id", text), labels)
    out = docs.drop("toxicity_score", "toxic_predicted").withColumn("toxicity_score", score_column(model, F.col(text)))
    return out.withColumn("toxic_predicted", (F.col("toxicity_score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(docs, labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
