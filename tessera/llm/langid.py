"""Language ID: a byte convolutional network trained and applied in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a fixed-length window
and classified by a softmax layer. A text is cut into overlapping windows that cover every byte;
its windows' probabilities are averaged by the bytes they cover.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_of, limit_of
from .toxicity import held_out
from .words import slices, string_buffers

LENGTH = 256
EMBED = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
#: Most labelled texts that the network is fitted on, shared out evenly among the languages, and windows of each.
MOST_DOCUMENTS, WINDOWS_EACH = 4000, 4
#: A language's share is no smaller than this, however many languages there are.
LEAST_EACH = 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SPAN = max(WIDTHS)
_STEP = LENGTH - _SPAN + 1
_BATCH = 64
#: Windows of long texts that are held at a time.
MOST_WINDOWS = 4096


def windows(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Byte windows (zero-padded) over all texts, the text of each, and the bytes each covers first; MOST_WINDOWS at a time."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-np.maximum(n - (_SPAN - 1), 0) // _STEP))
    first = np.cumsum(count) - count
    for i in range(0, int(count.sum()), MOST_WINDOWS):
        number = np.arange(i, min(i + MOST_WINDOWS, int(count.sum())))
        owner = np.searchsorted(first, number, side="right") - 1
        start = (number - first[owner]) * _STEP
        size = np.minimum(LENGTH, n[owner] - start)
        grid = (offsets[owner] + start)[:, None] + np.arange(LENGTH)
        held = np.arange(LENGTH) < size[:, None]
        block = np.where(held, raw[np.minimum(grid, len(raw) - 1)] if len(raw) else 0, 0).astype(np.uint8)
        yield block, owner, np.minimum(size, _STEP)


def _mask() -> np.ndarray:
    """Filters of width w use the first w bytes of the widest span."""
    mask = np.zeros((_SPAN, EMBED, len(WIDTHS) * FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask.reshape(_SPAN * EMBED, -1)


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, block: np.ndarray) -> np.ndarray:
        """Embedded spans: windows x positions x (span * embedding)."""
        e = self.embed[block]
        view = np.lib.stride_tricks.sliding_window_view(e, _SPAN, axis=1)  # n, positions, embed, span
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(block), _STEP, _SPAN * EMBED)

    def pooled(self, block: np.ndarray) -> np.ndarray:
        c = self.columns(block)
        return np.maximum((c.reshape(-1, _SPAN * EMBED) @ self.filters).reshape(len(block), _STEP, -1).max(1) + self.bias, 0)

    def probabilities(self, block: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(block), _BATCH):
            z = self.pooled(block[i : i + _BATCH]) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            parts.append(z / z.sum(1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.out_bias)))


def fit(block: np.ndarray, labels: np.ndarray, classes: int, epochs: int = 6, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on softmax cross-entropy, classes weighted inversely to their windows."""
    rng = np.random.default_rng(seed)
    k, mask = len(WIDTHS) * FILTERS, _mask()
    p = [
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, (_SPAN * EMBED, k)) * mask).astype(np.float32),
        np.zeros(k, np.float32),
        rng.normal(0, 0.2, (k, classes)).astype(np.float32),
        np.zeros(classes, np.float32),
    ]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    share = np.bincount(labels, minlength=classes)
    weight = (len(labels) / np.maximum(share, 1) / classes).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), _BATCH):
            b, y = block[order[i : i + _BATCH]], labels[order[i : i + _BATCH]]
            net, n = Network(*p), len(y)
            c = net.columns(b)
            conv = (c.reshape(-1, _SPAN * EMBED) @ p[1]).reshape(n, _STEP, k)
            top = conv.argmax(1)
            pre = np.take_along_axis(conv, top[:, None, :], 1)[:, 0] + p[2]
            h = np.maximum(pre, 0)
            z = h @ p[3] + p[4]
            z = np.exp(z - z.max(1, keepdims=True))
            q = z / z.sum(1, keepdims=True)
            q[np.arange(n), y] -= 1
            d = q * weight[y][:, None] / n
            dh = (d @ p[3].T) * (pre > 0)
            spans = c[np.arange(n)[:, None], top]  # n, k, span * embed: only pooled positions carry gradient
            g1 = np.einsum("nk,nkd->dk", dh, spans, optimize=True) * mask
            dspan = (dh[:, :, None] * p[1].T[None]).reshape(-1, EMBED)
            where = b[np.arange(n)[:, None, None], top[:, :, None] + np.arange(_SPAN)].reshape(-1)
            g0 = np.stack([np.bincount(where, dspan[:, j], 256) for j in range(EMBED)], 1)
            t += 1
            for x, g, a, s in zip(p, (g0, g1, dh.sum(0), h.T @ d, d.sum(0)), m, v, strict=True):
                a += 0.1 * (g - a)
                s += 0.01 * (g * g - s)
                x -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return Network(*p)


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Texts to take of each language: small languages whole, the others evenly, about ``most`` in all."""
    out, left = {}, most
    for i, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, max(LEAST_EACH, left // (len(sizes) - i)))
        left = max(0, left - out[name])
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[Network | None, list[str]]:
    """Fit on a bounded sample, for each language, of documents with a language that are not held out.

    Each language gives its distinct texts with the least hashes (``shares``), copies once; so
    every language with a usable text is learned. A text under several languages counts for each.
    """
    usable = docs.filter(F.col(lang).isNotNull() & ~held_out(F.col("doc_id")) & F.col(text).isNotNull() & (F.octet_length(text) > 0))
    sample = usable.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(text, F.lit("lang")).alias("h"), hash_of(text, "lang").alias("o"))
    sizes = {r.l: r.n for r in sample.groupBy("l").agg(F.countDistinct("h").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None, []
    most = shares(sizes, MOST_DOCUMENTS)
    limits = [(name, limit_of(n + 4 * math.isqrt(n), sizes[name])) for name, n in most.items()]
    limits = docs.sparkSession.createDataFrame(limits, "l string, below bigint")
    n = F.octet_length("t")
    pieces = [F.substring(F.col("t").cast("binary"), F.greatest(F.lit(1), (n - LENGTH) * i / max(1, WINDOWS_EACH - 1) + 1).cast("int"), F.lit(LENGTH)) for i in range(WINDOWS_EACH)]
    # windows are cut where the texts are, so that the driver gets a fixed number of bytes of each sampled text
    picked = sample.join(F.broadcast(limits), "l").filter(F.col("o") < F.col("below"))
    found: dict[str, list] = defaultdict(list)
    for r in picked.select("l", "o", "h", F.array_distinct(F.array(*pieces)).alias("w")).distinct().collect():
        found[r.l].append(r)
    rows = [r for name in sorted(found) for r in sorted(found[name], key=lambda r: (r.o, r.h))[: most[name]]]
    names = sorted(found)
    number = {name: i for i, name in enumerate(names)}
    block, y = [], []
    for r in rows:
        for w in r.w:
            block.append(np.frombuffer(bytes(w).ljust(LENGTH, b"\0"), np.uint8))
            y.append(number[r.l])
    return fit(np.stack(block), np.array(y), len(names)), names


def language_column(network: Network | None, names: list[str], text: Column) -> Column:
    """struct(lang, score) of whole texts."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def language(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        best, score = [], []
        for a, b in slices(texts, 1 << 20):
            part = texts.slice(a, b - a)
            letters = [bool(t) and _LETTER.search(t) is not None for t in part.to_pylist()]
            if network is None:
                best += [UNKNOWN] * len(letters)
                score += [0.0] * len(letters)
                continue
            total = np.zeros((len(part), len(names)))
            for block, owner, covers in windows(*string_buffers(part)):
                p = network.probabilities(block) * covers[:, None]
                total += np.stack([np.bincount(owner, p[:, j], len(part)) for j in range(len(names))], 1)
            total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
            top = total.argmax(1)
            best += [names[t] if ok else UNKNOWN for t, ok in zip(top, letters, strict=True)]
            score += [float(total[i, t]) if ok else 0.0 for i, (t, ok) in enumerate(zip(top, letters, strict=True))]
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    return language(text)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with a struct column ``language``: lang and score.

    Learns from the rows' own language column where it is set. A null text, or one without a
    letter (category L: no numerals or other signs), is 'und' with score 0, as is every text if nothing can be learned. Ties between languages
    go to the first by name. A column ``language`` is replaced.
    """
    network, names = train(docs, text, lang)
    return docs.drop("language").withColumn("language", language_column(network, names, F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
