"""Byte-level BPE by distinct pre-tokens.

A byte-level tokenizer cuts a text by one pattern (contractions, letters, numbers, other signs, each with
at most one space before it, and white space) and encodes every piece on its own. So the pieces are
found for many texts at once with numpy, and the tokenizer encodes each distinct piece once. Texts with
characters outside a plain range, whose classes numpy would need tables for, go to the tokenizer whole.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import span_hashes, string_buffers

#: Code points below this are classed here; letters, numbers and other signs of Latin scripts.
LIMIT = 0x250
SPACE, BLANK, LETTER, NUMBER, OTHER = range(5)
#: Pieces are single already: they are encoded whole.
ANYTHING = r"[\s\S]+"
#: Pieces remembered per worker, and how many are encoded at once.
MOST_PIECES, AT_ONCE = 400_000, 2048
#: Columns beside a remembered piece's key.
FIRST, COUNT, SEEN, SPELT, SIZE = range(5)
_HIGH, _TOP = np.uint64(0x8080808080808080), np.uint64(1 << 63)


def _classes() -> np.ndarray:
    out = np.full(LIMIT, OTHER, np.uint8)
    for c in range(LIMIT):
        s = chr(c)
        if s.isalpha():
            out[c] = LETTER
        elif s.isnumeric():
            out[c] = NUMBER
    out[[9, 10, 13]] = BLANK
    out[0x20] = SPACE
    return out


CLASSES = _classes()


def plain_texts(column: pa.Array) -> np.ndarray:
    """Texts of printable ASCII, tab, line ends and U+00A1 to U+024F, without '<|' (which may open a special token)."""
    raw, offsets = string_buffers(column)
    ok = np.ones(256, bool)
    ok[:0x20] = False
    ok[[9, 10, 13]] = True
    ok[0x7F] = False
    ok[0xCA:] = False
    bad = ~ok[raw]
    if len(raw) > 1:
        bad[:-1] |= (raw[:-1] == 0xC2) & (raw[1:] <= 0xA0)
        bad[:-1] |= (raw[:-1] == 0xC9) & (raw[1:] > 0x8F)
        bad[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    at = np.flatnonzero(bad)
    out = np.ones(len(column), bool)
    out[np.searchsorted(offsets, at, side="right") - 1] = False
    return out


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin, in the characters of concatenated texts that begin at ``first``."""
    kind = CLASSES[codes]
    n = len(codes)
    opens = np.zeros(n + 1, bool)
    opens[first[first < n]] = True
    opens[n] = True
    white = kind <= BLANK
    before = np.empty(n, np.uint8)
    before[0] = OTHER
    before[1:] = kind[:-1]
    white_before = before <= BLANK
    follows = np.zeros(n, bool)  # a sign that isn't white space follows in the same text
    follows[:-1] = ~white[1:] & ~opens[1:n]
    start = np.where(white, ~white_before | follows, np.where(white_before, before == BLANK, before != kind))
    start |= opens[:n]
    # contractions take one or two letters from the run of letters behind an apostrophe
    marks = np.flatnonzero((codes == 0x27) & start)
    marks = marks[marks + 1 < n]
    marks = marks[(kind[marks + 1] == LETTER) & ~opens[marks + 1]]
    if len(marks):
        padded = np.concatenate((codes, np.zeros(2, codes.dtype)))
        a, b = padded[marks + 1], np.where(opens[np.minimum(marks + 2, n)], 0, padded[marks + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        taken = np.where(one, 1, np.where(two, 2, 0))
        marks, taken = marks[taken > 0], taken[taken > 0]
        start[marks + 1] = False
        after = marks + 1 + taken
        start[after[after < n]] = True
    return np.flatnonzero(start)


def _tails() -> np.ndarray:
    """Masks of the first 0 to 8 bytes of a number."""
    rows = np.zeros((9, 8), np.uint8)
    for n in range(9):
        rows[n, :n] = 0xFF
    return rows.view(np.uint64)[:, 0]


TAILS = _tails()


def piece_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of every piece, and which pieces are hashed.

    A piece of up to eight ASCII characters is its own key, so that equal keys are equal pieces. Others are hashed, with the
    highest bit set, which no piece of ASCII characters has; the caller compares these.
    """
    low = np.minimum(codes, 0xFF).astype(np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((low, np.zeros(8, np.uint8))), 8)
    size = ends - starts
    keys = rows[starts].view(np.uint64)[:, 0] & TAILS[np.minimum(size, 8)]
    hashed = np.flatnonzero((size > 8) | (keys & _HIGH != 0))
    n = size[hashed]
    spelt = codes[_ranges(starts[hashed], n)] + np.uint16(1)
    keys[hashed] = span_hashes(spelt, np.cumsum(n) - n, np.cumsum(n)) | _TOP
    return keys, hashed


class PieceEncoder:
    """Token ids of texts, remembering the ids of pieces by their hash and characters."""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ranks = Tokenizer.from_file(json_path), None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=ANYTHING, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of single pieces: by the ranks of the same vocabulary, several times faster, or by the tokenizer."""
        if self.ranks is not None:
            return list(map(self.ranks.encode_ordinary, pieces))
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        #: Where its ids begin in ``flat`` and how many, calls that used it, and where the characters of a hashed piece begin in ``spelt`` and how many.
        self.info = np.zeros((0, 5), np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.spelt = np.zeros(0, np.uint16)

    def _make_room(self, coming: int) -> None:
        """Forget the pieces used least often, those of one call first."""
        least = 2
        while len(self.keys) and len(self.keys) + coming > MOST_PIECES:
            keep = self.info[:, SEEN] >= least
            self.keys, self.info = self.keys[keep], self.info[keep]
            n = self.info[:, COUNT]
            self.flat = self.flat[_ranges(self.info[:, FIRST], n)]
            self.info[:, FIRST] = np.cumsum(n) - n
            n = self.info[:, SIZE]
            self.spelt = self.spelt[_ranges(self.info[:, SPELT], n)]
            self.info[:, SPELT] = np.cumsum(n) - n
            least *= 2

    def _learn(self, keys: np.ndarray, pieces: list[str], codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        count, parts = [], [self.flat]
        for i in range(0, len(pieces), AT_ONCE):
            ids = self._encode(pieces[i : i + AT_ONCE])
            count += map(len, ids)
            parts.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        count, held = np.array(count, np.int64), np.where(keys >= _TOP, size, 0)
        new = np.stack([len(self.flat) + np.cumsum(count) - count, count, np.zeros(len(count), np.int64), len(self.spelt) + np.cumsum(held) - held, held], 1)
        self.flat = np.concatenate(parts)
        self.spelt = np.concatenate((self.spelt, codes[_ranges(starts, held)]))
        # both tables are sorted: every new key has a place among the old ones
        at = np.searchsorted(self.keys, keys) + np.arange(len(keys))
        old = np.ones(len(self.keys) + len(keys), bool)
        old[at] = False
        merged, info = np.empty(len(old), np.uint64), np.empty((len(old), 5), np.int64)
        merged[old], merged[at] = self.keys, keys
        info[old], info[at] = self.info, new
        self.keys, self.info = merged, info

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of plain texts in a row, where each text's begin (n + 1), and which texts must be encoded whole.

        A piece is known by its hash and its characters: where a hash meets other characters, the texts
        that hold the piece go to the tokenizer instead.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        text_at = np.concatenate(([0], np.cumsum(lengths)))
        whole = np.zeros(len(texts), bool)
        if not text_at[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), whole
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint16)
        starts = piece_starts(codes, text_at[:-1])
        ends = np.concatenate((starts[1:], [len(codes)]))
        size = ends - starts
        keys, hashed = piece_keys(codes, starts, ends)
        distinct, index, back = np.unique(keys, return_index=True, return_inverse=True)
        self._make_room(len(distinct))
        known = self._known(distinct)
        if not known.all():
            at = index[~known]
            self._learn(distinct[~known], [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], codes, starts[at], size[at])
        slot = np.searchsorted(self.keys, distinct)
        self.info[slot, SEEN] += 1
        # hashed pieces against what is remembered under their key, earlier pieces of this call included
        held = slot[back[hashed]]
        other = hashed[_differ(codes, starts[hashed], size[hashed], self.spelt, self.info[held, SPELT], self.info[held, SIZE])]
        if len(other):
            whole[np.searchsorted(text_at, starts[other], side="right") - 1] = True
        first, count = self.info[slot, FIRST][back], self.info[slot, COUNT][back]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, text_at)], whole


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] … first[0] + count[0] - 1, then the same for the next, as one array."""
    at = np.cumsum(count) - count
    return np.repeat(first - at, count) + np.arange(int(count.sum()))


def _differ(a: np.ndarray, a_first: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which spans of ``a`` are not the spans of ``b`` beside them, character by character."""
    out = a_size != b_size
    todo = np.flatnonzero(~out)
    step = 1 << 16
    for i in range(0, len(todo), step):
        t = todo[i : i + step]
        same = a[_ranges(a_first[t], a_size[t])] == b[_ranges(b_first[t], b_size[t])]
        out[t] = ~np.logical_and.reduceat(same, np.cumsum(a_size[t]) - a_size[t])
    return out


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None = None) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(json_path, ranks_path)


def token_ids(column: pa.Array, json_path: str, ranks_path: str | None = None) -> list[np.ndarray]:
    """Token ids of every text (null: none), as the tokenizer gives them without special tokens added."""
    own = encoder(json_path, ranks_path)
    texts = ["" if t is None else t for t in column.to_pylist()]
    plain = plain_texts(column)
    ids, at, whole = own.encode([t for t, ok in zip(texts, plain.tolist(), strict=True) if ok])
    out, k = [], 0
    for t, ok in zip(texts, plain.tolist(), strict=True):
        if ok:
            out.append(ids[at[k] : at[k + 1]])
            k += 1
        if not ok or whole[k - 1]:
            found = np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            out[len(out) - ok :] = [found]
    return out
