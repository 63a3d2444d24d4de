"""Periodic runs: online catching of squares over dyadic blocks of words.

A square of period p is caught by a block of 2**k words, with 2**(k+1) - 1 <= p
< 2**(k+2) - 1: its first half holds such a block whole, at a multiple of the
block's length. Each completed block is a catcher. It waits for the words that
follow: an appended word ends one suffix of 2**k words a level, and that suffix
is compared with the two catchers whose distance is a period of the level. A
suffix that equals a catcher p words before it is a catch, and catches of the
same period at neighbouring blocks are one stretch in which every word equals
the one p words on. Neither end of such a stretch can be extended by a block, so
halving steps find its ends, and a stretch of p words or more is a run.

Suffixes of a level are compared by 64-bit hashes, each made of the two halves'
hashes at the level below; words are appended in stretches, and a stretch's
suffixes are compared at once. The hashes can only propose too much: each run is
checked word by word, and found again under another seed should one not hold.
A text of n words takes O(n log n) memory and O(n log^2 n) steps, whatever it
repeats.

Defined results for odd input: a null text has no words and no run; texts of
fewer than ``least`` words have none; overlapping runs of different periods all
count, and a stretch counts once, with its smallest period; repeated rows are
rows of their own; a null doc_id leaves the text as it is in the query. Columns
other than doc_id and text are carried (``collapse``, ``with_runs``) or ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words of a run at least.
LEAST = 12
#: Words that are appended at a time.
STRETCH = 1 << 16

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    x = left * _A + right
    x ^= x >> _HALF
    x *= _B
    x ^= x >> _HALF
    return x


class Catchers:
    """Words so far, their suffix hashes by level, and what the blocks have caught."""

    def __init__(self, seed: int = 0):
        self.seed = np.uint64(seed * 2 + 1)
        self.words = np.empty(0, np.int64)
        self.suffixes = [np.empty(0, np.uint64)]
        self.caught: list[list[tuple[np.ndarray, np.ndarray]]] = [[]]

    def append(self, words: np.ndarray) -> None:
        """Append words, given as numbers; equal words have equal numbers."""
        self.words = np.concatenate([self.words, words])
        n, k = len(self.words), 0
        fresh = words.astype(np.uint64)
        self._advance(0, _join(fresh, np.full(len(fresh), self.seed)))
        while 2 * ((4 << k) - 1) <= n:  # a square of the next level's least period fits
            k += 1
            if k == len(self.suffixes):
                self.suffixes.append(np.empty(0, np.uint64))
                self.caught.append([])
            half, below = 1 << k - 1, self.suffixes[k - 1]
            at = len(self.suffixes[k])
            self._advance(k, _join(below[at : len(below) - half], below[at + half :]))

    def _advance(self, k: int, fresh: np.ndarray) -> None:
        """Compare the level's fresh suffixes with the two catchers each that wait for them."""
        old = len(self.suffixes[k])
        h = self.suffixes[k] = np.concatenate([self.suffixes[k], fresh]) if old else fresh
        size = 1 << k
        for shift in (2 * size - 1, 3 * size - 1):
            begin = max(old - shift, 0)  # suffix begin + shift is the first fresh one that a catcher waits for
            if len(h) - shift <= begin:
                continue
            first = begin // size
            waiting = np.repeat(h[first * size : len(h) - shift : size], size)[begin - first * size :][: len(h) - shift - begin]
            hit = np.flatnonzero(h[begin + shift :] == waiting) + begin
            if len(hit):
                block = hit // size * size
                self.caught[k].append((hit + shift - block, block))

    def runs(self, least: int = LEAST) -> np.ndarray:
        """Rows ``start, length, period`` of the maximal runs, by start and period."""
        n, found = len(self.words), []
        for k, caught in enumerate(self.caught):
            if not caught:
                continue
            p, block = (np.concatenate(x) for x in zip(*caught))
            order = np.lexsort((block, p))
            p, block = p[order], block[order]
            size = 1 << k
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (block[1:] != block[:-1] + size)
            firsts = np.flatnonzero(new)
            lasts = np.append(firsts[1:], len(p)) - 1
            begin, end, p = block[firsts], block[lasts] + size, p[firsts]
            # ends may still move by less than a block on either side
            some = end - begin + 2 * (size - 1) >= np.maximum(p, least - p)
            begin, end, p = begin[some], end[some], p[some]
            for j in range(k - 1, -1, -1):
                h, step = self.suffixes[j], 1 << j
                can = np.flatnonzero(begin >= step)
                can = can[h[begin[can] - step] == h[begin[can] - step + p[can]]]
                begin[can] -= step
                can = np.flatnonzero(end + p + step <= n)
                can = can[h[end[can]] == h[end[can] + p[can]]]
                end[can] += step
            run = end - begin >= np.maximum(p, least - p)
            found.append(np.stack([begin[run], (end - begin + p)[run], p[run]], axis=1))
        if not found:
            return np.empty((0, 3), np.int64)
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        # a multiple of the smallest period spans the same stretch
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[once]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]

    def holds(self, runs: np.ndarray) -> bool:
        """Whether the words of each run have its period and its neighbours end it."""
        w, n = self.words, len(self.words)
        for start, length, p in runs.tolist():
            end = start + length
            if not np.array_equal(w[start : end - p], w[start + p : end]):
                return False
            if (start and w[start - 1] == w[start - 1 + p]) or (end < n and w[end] == w[end - p]):
                return False
        return True


def find_runs(words: list[bytes], least: int = LEAST) -> np.ndarray:
    """``start, length, period`` of the runs of at least ``least`` words and two periods."""
    if len(words) < max(least, 2):
        return np.empty((0, 3), np.int64)
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    for seed in range(100):
        catchers = Catchers(seed)
        for at in range(0, len(ids), STRETCH):
            catchers.append(ids[at : at + STRETCH])
        runs = catchers.runs(least)
        if catchers.holds(runs):
            return runs
    raise RuntimeError("no seed tells all suffixes apart")


def collapsed_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    start, length, p = runs.T
    np.add.at(change, start + p, 1)
    np.add.at(change, start + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def with_runs(docs: DataFrame, least: int = LEAST, name: str = "runs") -> DataFrame:
    """Add the runs of ``text``: an array of ``start`` and ``length`` in words and ``period``, by start and period."""

    @F.pandas_udf("array<struct<start: bigint, length: bigint, period: bigint>>")
    def found(texts: pd.Series) -> pd.Series:
        keys = ("start", "length", "period")
        return pd.Series([[dict(zip(keys, r)) for r in find_runs(split_words(t), least).tolist()] for t in texts], dtype=object)

    return docs.withColumn(name, found("text"))


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with each run of ``text`` cut to its first period; what is left of a changed text is joined by blanks."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = split_words(text)
            runs = find_runs(words, least)
            out.append(b" ".join(collapsed_words(words, runs)).decode("utf-8", "surrogatepass") if len(runs) else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", rest("text"))


def planted(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The words as the query takes them: those of one id in ten repeat a part of themselves from some word on."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("_id"))
    kind = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

    @F.pandas_udf(f"struct<{kind.replace(' ', ': ').replace(',:', ',')}>")
    def digest(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(ids, texts):
            words = planted(split_words(text), doc_id)
            runs = find_runs(words)
            best = (None,) * 4
            if len(runs):
                start, length, p = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
                best = (start, length, p, 1000 * length // p)
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
            kept = b" ".join(collapsed_words(words, runs))
            rows.append((len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")], dtype=object)

    return docs.select("doc_id", digest("_id", "text").alias("d")).select("doc_id", "d.*")


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
