"""Ranked lexical search on K2-treaps over the grid of terms and documents.

The index cuts the documents into shards, as they are read, so nothing is
shuffled. A shard is a grid with a row for each of its terms and a column for
each of its documents, in the order of doc_id; a cell holds the term's impact on
the document's score. A K2-treap stores the grid: a square with anything in it
has four bits that tell which of its quarters have, level after level, and the
greatest impact in it, as the difference from that of the square around it.

A query item descends all of its terms' rows together. A range of documents
stands for one square in each row's path, and the weighted sum of their maxima
bounds every score in it. The ranges with the greatest bounds are halved first,
some hundred at a time; a range of one document has its score for a bound. A
range whose bound is below the k-th score found, here or in the shards that the
task searched before, is dropped, and so is one that could only tie with it at a
greater doc_id. Results are exact. A task gives out k documents an item, and a
window ranks them.

The weights follow from statistics over all documents: the number of those with
a term, of all their terms, and of the documents of each term. Items meet the
shards in blocks.

Defined results for odd input: a null text has no terms; such documents and items
without terms are in no result; a row of items is an item of its own, also if its
item_id is null or repeated; equal scores rank by ascending doc_id, null last,
repeated rows each have a rank. Other columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import finished, staged, table

#: Java pattern of a term.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents and terms of a shard, ranges that are halved at a time, and items of a block.
DOCUMENTS, TERMS, RANGES, ITEMS = 4096, 1 << 20, 256, 1024


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def n_terms(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("bigint")


def _spread(x: np.ndarray) -> np.ndarray:
    """Put a zero before every bit of numbers under 2**32."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def pack(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> tuple[bytes, bytes]:
    """The bits of a grid of 2**height rows and columns, level by level from the root, and its maxima as differences."""
    code = _spread(rows) << np.uint64(1) | _spread(columns)
    order = np.argsort(code)
    code, most = code[order], values[order].astype(np.int64)
    bits, less = [], []
    for _ in range(height):
        above = code >> np.uint64(2)
        firsts = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
        parent = np.zeros(len(code), np.int64)
        parent[firsts[1:]] = 1
        parent = np.cumsum(parent)
        quarters = np.zeros(4 * len(firsts), np.uint8)
        quarters[4 * parent + (code & np.uint64(3)).astype(np.int64)] = 1
        greatest = np.maximum.reduceat(most, firsts)
        bits.append(quarters)
        less.append((greatest[parent] - most).astype(np.uint32))
        code, most = above[firsts], greatest
    squeeze = zstandard.ZstdCompressor(level=3).compress
    maxima = np.concatenate([most.astype(np.uint32), *less[::-1]])
    return squeeze(np.packbits(np.concatenate(bits[::-1])).tobytes()), squeeze(maxima.tobytes())


class Treap:
    """A packed grid to search in: squares are numbered level by level, the last number stands for an empty one."""

    def __init__(self, bits: bytes, maxima: bytes, height: int):
        unpack = zstandard.ZstdDecompressor().decompress
        less = np.frombuffer(unpack(maxima), np.uint32).astype(np.int64)
        inner = len(less)
        quarters = np.unpackbits(np.frombuffer(unpack(bits), np.uint8))[: 4 * inner]
        # the root is square 0, and a square's place among the set bits gives its number
        child = np.cumsum(quarters, dtype=np.int32)
        child[quarters == 0] = -1
        self.height = height
        self.child = np.append(child, np.full(4, -1, np.int32))
        begin, end, self.maxima = 0, 1, less
        for _ in range(height):
            set_ = np.flatnonzero(quarters[4 * begin : 4 * end])
            self.maxima[end : end + len(set_)] = less[begin + set_ // 4] - less[end : end + len(set_)]
            begin, end = end, end + len(set_)
        # leaves have no quarters
        self.child = np.append(self.child[: 4 * begin], np.full(4, -1, np.int32))
        self.maxima = np.append(self.maxima, 0)

    def halves(self, squares: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The quarters of squares in their upper or ``lower`` rows, left and right."""
        at = 4 * squares + 2 * lower
        at[squares < 0] = -4
        return self.child[at], self.child[at + 1]

    def best(self, rows: np.ndarray, weights: np.ndarray, columns: int, held, later) -> None:
        """Offer to ``held`` the columns that may be among its best; ``later(column)`` tells its place in the order of ties."""
        h = self.height
        squares = np.zeros((1, len(rows)), np.int32)
        depth, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.maxima[squares] @ weights
        while len(bound):
            if len(bound) > RANGES:
                some = np.argpartition(-bound, RANGES)
                some, rest = some[:RANGES], some[RANGES:]
            else:
                some, rest = np.arange(len(bound)), np.empty(0, np.int64)
            step = h - 1 - depth[some]
            left, right = self.halves(squares[some], rows[None, :] >> step[:, None] & 1)
            new = np.concatenate([left, right])
            new_first = np.concatenate([first[some], first[some] + (np.int64(1) << step)])
            new_depth = np.tile(depth[some] + 1, 2)
            new_bound = self.maxima[new] @ weights
            good = (new_bound > 0) & (new_first < columns)
            leaf = good & (new_depth == h)
            if leaf.any():
                held.offer(new_bound[leaf], new_first[leaf])
            good &= ~leaf
            squares = np.concatenate([squares[rest], new[good]])
            first = np.concatenate([first[rest], new_first[good]])
            depth = np.concatenate([depth[rest], new_depth[good]])
            bound = np.concatenate([bound[rest], new_bound[good]])
            if held.full:
                may = bound >= held.score
                tie = np.flatnonzero(bound == held.score)
                may[tie] = [later(c) < held.place for c in first[tie].tolist()]
                squares, first, depth, bound = squares[may], first[may], depth[may], bound[may]


class Held:
    """The best documents of an item so far: scores, and places ``(no id, doc_id)`` in the order of ties."""

    def __init__(self, k: int):
        self.k, self.rows, self.full, self.score, self.place = k, [], False, 0, None
        self.ids = None

    def offer(self, scores: np.ndarray, columns: np.ndarray) -> None:
        if len(scores) > self.k:
            # columns are in the order of ties
            best = np.lexsort((columns, -scores))[: self.k]
            scores, columns = scores[best], columns[best]
        self.rows += [(-s, self.ids[c]) for s, c in zip(scores.tolist(), columns.tolist())]
        self.rows = sorted(self.rows)[: self.k]
        if len(self.rows) == self.k:
            self.full, self.score, self.place = True, -self.rows[-1][0], self.rows[-1][1]


SHARD = "height int, ids array<bigint>, unknown int, terms array<string>, held_by array<int>, bits binary, maxima binary"


def _shard(docs: list, known: dict, n_docs: int, n_all: int) -> dict:
    """A shard of ``(no id, doc_id, n, term numbers, times)``."""
    docs.sort(key=lambda d: d[:2])
    lengths = [len(d[3]) for d in docs]
    rows = np.concatenate([d[3] for d in docs])
    times = np.concatenate([d[4] for d in docs]).astype(np.int64)
    columns = np.repeat(np.arange(len(docs)), lengths)
    m = np.repeat(np.array([10 + 90 * d[2] * n_docs // n_all for d in docs], np.int64), lengths)
    impact = 1_000_000_000 * times // (1000 * times + 8 * m)
    df = np.bincount(rows, minlength=len(known))
    # frequent terms side by side share squares
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    height = max(1, int(max(len(known), len(docs)) - 1).bit_length())
    names = list(known)
    bits, maxima = pack(place[rows], columns, impact, height)
    return {
        "height": height, "ids": [d[1] for d in docs], "unknown": sum(d[0] for d in docs), "terms": [names[i].decode("utf-8", "surrogatepass") for i in order.tolist()],
        "held_by": df[order].astype(np.int32), "bits": bits, "maxima": maxima,
    }


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have."""
    n = n_terms(F.col("text"))
    found = docs.agg(F.count(F.when(n > 0, 1)), F.sum(n)).first()
    return found[0], found[1] or 0


def build_index(docs: DataFrame, n_docs: int, n_all: int) -> DataFrame:
    """The shards of ``docs(doc_id, text)``, a row each, with the statistics of all documents in their impacts."""

    def run(batches):
        docs, known, n_terms = [], defaultdict(), 0
        known.default_factory = known.__len__
        for batch in batches:
            for unknown, doc_id, text in zip(batch["unknown"].tolist(), batch["id"].tolist(), batch["text"]):
                found = terms_of(text)
                if not found:
                    continue
                numbers, times = np.unique(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), return_counts=True)
                docs.append((unknown, doc_id, len(found), numbers, times))
                n_terms += len(found)
                if len(docs) >= DOCUMENTS or n_terms >= TERMS:
                    yield pd.DataFrame([_shard(docs, known, n_docs, n_all)])
                    docs, n_terms = [], 0
                    known.clear()
        if docs:
            yield pd.DataFrame([_shard(docs, known, n_docs, n_all)])

    # without nulls the ids stay whole numbers in pandas
    read = docs.select(F.col("doc_id").isNull().cast("int").alias("unknown"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), "text")
    return read.mapInPandas(run, SHARD)


def item_terms(items: DataFrame) -> DataFrame:
    """``item``, ``item_id`` and ``term``: the distinct terms of each row of ``items(item, item_id, text)``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.array_distinct(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(TERM), F.lit(0)))
    return items.select("item", "item_id", F.explode(found).alias("term"))


def weighted(terms: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """``item`` and ``terms``, an array of each item's terms with their weights."""
    df = index.select(F.explode(F.arrays_zip("terms", "held_by")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.held_by").alias("n"))
    df = df.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)) * 1000).cast("bigint")
    return terms.join(df.select("term", weight.alias("weight")), "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """``item``, ``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of each row of ``items(item, item_id, text)``."""
    terms = staged(item_terms(items), "item_terms")
    asked = staged(weighted(terms, index, n_docs), "items")
    blocks = asked.withColumn("block", F.floor(F.col("item") / ITEMS)).groupBy("block").agg(F.collect_list(F.struct("item", "terms")).alias("asked"))

    def run(batches):
        blocks, best = {}, {}
        for batch in batches:
            for height, ids, unknown, names, bits, maxima, block, asked in zip(*[batch[c] for c in ("height", "ids", "unknown", "terms", "bits", "maxima", "block", "asked")]):
                if block not in blocks:
                    blocks[block] = [(a["item"], [t["term"] for t in a["terms"]], np.array([t["weight"] for t in a["terms"]], np.int64)) for a in asked]
                row_of = dict(zip(names, range(len(names))))
                treap = Treap(bits, maxima, height)
                known = len(ids) - unknown
                places = [(int(i >= known), x) for i, x in enumerate(ids.tolist())]
                for item, item_terms, weights in blocks[block]:
                    rows = np.array([row_of.get(t, -1) for t in item_terms], np.int64)
                    here = rows >= 0
                    if here.any():
                        held = best.setdefault(item, Held(k))
                        held.ids = places
                        treap.best(rows[here], weights[here], len(places), held, places.__getitem__)
        found = [(item, no, x, -s) for item, held in best.items() for s, (no, x) in held.rows]
        if found:
            yield pd.DataFrame(found, columns=["item", "unknown", "doc_id", "score"])

    # the query set against all shards, a block of items at a time
    met = index.select("height", "ids", "unknown", "terms", "bits", "maxima").crossJoin(blocks)
    found = met.mapInPandas(run, "item bigint, unknown int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "unknown", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    doc_id = F.when(F.col("unknown") == 0, F.col("doc_id")).alias("doc_id")
    return ranked.join(terms.select("item", "item_id").distinct(), "item").select("item", "item_id", "rank", doc_id, "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``."""
    n_docs, n_all = statistics(docs)
    index = staged(build_index(docs, n_docs, n_all), "index")
    numbered = staged(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "numbered")
    return search(index, numbered, n_docs, k)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return finished(lambda: rank(docs, items).select("item_id", "rank", "doc_id", "score"), "ranked")


QUERIES = {"op11_ranked_search": op11_ranked_search}

ORACLES = {
    "op11_ranked_search": r"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), lengths AS (
        SELECT r, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0
    ), alike AS (
        SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM lengths
    ), tf AS (
        SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term
    ), df AS (
        SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term
    ), items AS (
        SELECT row_number() OVER () AS i, item_id, list_distinct(
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
        FROM benchmark
    ), asked AS (
        SELECT i, item_id, unnest(w) AS term FROM items
    ), scored AS (
        SELECT i, item_id, r, doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all))))::BIGINT AS score
        FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (r) CROSS JOIN alike
        GROUP BY i, item_id, r, doc_id
    ), ranked AS (
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
