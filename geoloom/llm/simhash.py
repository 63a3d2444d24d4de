"""SimHash near-duplicate groups, compared as vertical bit planes.

A fingerprint has a bit set if more than half of the text's shingle hashes have
it. Fingerprints are compared in blocks: the block is stored as bit planes, 64
fingerprints a machine word; a query's distance to all of them is added up in
bitwise carry-save counters, plane by plane, and a word is abandoned as soon as
each of its 64 counters has passed the radius.

Which fingerprints meet in a block: with 64 bits and a small radius the
fingerprint is cut into radius + a pieces, and fingerprints that agree in a of
them meet, so that no link is lost (pigeonhole); a is 1 for some ten million
fingerprints and grows with the logarithm of their number, so that blocks don't
grow with the data. For a wide radius, as a
resemblance of 0.8 needs, texts meet that share one of several least shingle
hashes. A piece or shingle that very many fingerprints share is split into
parts, and each pair of parts is a block of its own. A block returns a spanning
forest of its links, and :func:`connected_components` joins the forests.

For a resemblance the fingerprints only find candidates. The shingle sets of
the texts that the candidates connect then meet in blocks of their own, where a
candidate is a link if the two sets' Jaccard similarity is high enough.

Defined results for odd input: null and empty texts have fingerprint zero and
are alike; texts of fewer words than a shingle have one shingle, the whole
sequence; equal fingerprints are always linked. Each row is returned, repeated
ones too; rows with a null doc_id are grouped but never name a component
(component_id is null where all of a group's are). Columns other than doc_id
and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASK, cells, maybe_in, noted, staged, table, temporary
from .components import connected_components

#: Rows of one part of a split block: at least, and at most.
PART, MOST_PART = 512, 16384
#: Bytes of shingle hashes of one part.
PART_BYTES = 16 << 20
#: Query words by plane words that are compared at a time.
CELLS = 1 << 15
#: Odd multipliers of the hash families.
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return np.array([digest(join(words), 42)], np.uint64)
    return np.fromiter((digest(join(s), 42) for s in zip(*[words[k:] for k in range(width)])), np.uint64, len(words) - width + 1)


def remixed(h: np.ndarray, first: int, n: int) -> np.ndarray:
    """A column of 64-bit mixes of ``h`` for each of ``n`` members of a family of mixes."""
    x = h[:, None] + np.array([k * GOLDEN % 2**64 for k in range(first, first + n)], np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprint of ``words`` 64-bit words: the bits that over half of the hashes have."""
    count = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 1 << 13):
        x = remixed(h[at : at + (1 << 13)], 0, words)
        x[:, 0] = h[at : at + (1 << 13)]  # the first word is that of the hashes themselves
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        # up to 255 rows are added in bytes
        whole = len(bits) // 255 * 255
        count += np.add.reduce(bits[:whole].reshape(-1, 255, bits.shape[1]), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        count += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)


def least_hashes(h: np.ndarray, keys: int) -> list[int]:
    """The least of each of ``keys`` mixes of the hashes; 0 where there are none."""
    return remixed(h, 100, keys).min(0).view(np.int64).tolist() if len(h) else [0] * keys


def fingerprints(docs: DataFrame, width: int, words: int = 1) -> DataFrame:
    """``doc_id`` and ``fp`` (array of 64-bit words) of every row."""

    @F.pandas_udf("array<bigint>")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, width), words).view(np.int64) for t in texts])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fp(F.col("text").cast("string")).alias("fp"))


def set_fingerprints(docs: DataFrame, width: int, words: int, keys: int) -> DataFrame:
    """``key`` and ``doc_id`` of each row of ``docs(key, doc_id, text)``; ``node``, ``fp`` and ``keys`` of its set of shingles.

    Rows with one set of shingles have one node.
    """

    @F.pandas_udf("struct<node: bigint, fp: array<bigint>, keys: array<bigint>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            h = np.unique(shingle_hashes(text, width))
            node = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 13)).astype(np.int64))
            rows.append((node, majority(h, words).view(np.int64), least_hashes(h, keys)))
        return pd.DataFrame(rows, columns=["node", "fp", "keys"])

    return docs.select("key", "doc_id", found("text").alias("found")).select("key", "doc_id", "found.*")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of ``fps`` (rows by words): planes by 64-row words."""
    m = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, -m % 64), (0, 0)))
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class _Counters:
    """Bitwise counters, one a bit position, that tell when they pass the radius.

    They begin so far below a power of two that passing the radius carries out
    of the top plane; ``over`` holds the positions where that has happened.
    """

    def __init__(self, shape, radius: int):
        self.n = max(1, (radius + 1).bit_length())
        start = (1 << self.n) - (radius + 1)
        full = np.uint64(2**64 - 1)
        self.digits = [np.full(shape, full if start >> k & 1 else 0, np.uint64) for k in range(self.n)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, carry: np.ndarray, weight: int = 0) -> None:
        for k in range(weight, self.n):
            digit = self.digits[k]
            out = digit & carry
            digit ^= carry
            carry = out
        self.over |= carry

    def add_three(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        both = a & b
        a ^= b
        both |= a & c
        a ^= c
        self.add(a)
        self.add(both, 1)

    def keep(self, at: np.ndarray) -> None:
        self.digits = [d[at] for d in self.digits]
        self.over = self.over[at]


def links(fps: np.ndarray, radius: int):
    """Pairs ``(i, j)`` with ``i < j`` within ``radius``, a pair of arrays for each chunk of queries."""
    m = len(fps)
    p = planes(fps)
    n_planes, n_words = p.shape
    full = np.uint64(2**64 - 1)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    asked = np.where(bits.T.astype(bool), full, np.uint64(0))
    step, at = max(1, CELLS // n_words), 0
    while at < m:
        first = at // 64
        rows = np.arange(at, min(m, at + step))
        at += step
        row, word = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(first, n_words), indexing="ij"))
        q = asked[:, rows]
        count = _Counters(len(row), radius)
        whole = True
        for b in range(0, n_planes, 3):

            def differ(k):
                if whole:
                    return (p[k, None, first:] ^ q[k, :, None]).ravel()
                return p[k][word] ^ q[k][row]

            if b + 3 <= n_planes:
                count.add_three(differ(b), differ(b + 1), differ(b + 2))
            else:
                for k in range(b, n_planes):
                    count.add(differ(k))
            if b > radius and b % 9 == 0 or b + 3 >= n_planes:
                alive = np.flatnonzero(count.over != full)
                if len(alive) < 0.6 * len(row) or b + 3 >= n_planes:
                    row, word, whole = row[alive], word[alive], False
                    count.keep(alive)
            if not len(row):
                break
        if len(row):
            hit = np.unpackbits((~count.over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, bit = np.nonzero(hit)
            i, j = rows[row[cell]], word[cell] * 64 + bit
            ok = (j > i) & (j < m)
            if ok.any():
                yield i[ok], j[ok]


def grouped_links(fps: np.ndarray, radius: int, group: np.ndarray | None):
    """The links between rows of one group; all rows are one where no groups are given."""
    for i, j in links(fps, radius):
        if group is not None:
            same = group[i] == group[j]
            i, j = i[same], j[same]
        if len(i):
            yield i, j


def forest(fps: np.ndarray, radius: int, group: np.ndarray | None = None) -> np.ndarray:
    """For each row the least row that it is connected to by links within its group."""
    label = np.arange(len(fps))
    for i, j in grouped_links(fps, radius, group):
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def resemblance(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of a sorted set and each of the others; none is empty."""
    size = np.array([len(x) for x in others])
    every = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(found, np.cumsum(size) - size, dtype=np.int64)
    return both / (len(one) + size - both)


def exact_forest(fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, group: np.ndarray | None = None) -> np.ndarray:
    """Like :func:`forest`, but a link also needs sets of this similarity.

    Pairs that other links connect already are not compared.
    """
    label = np.arange(len(fps))
    for i, j in grouped_links(fps, radius, group):
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(i[1:] != i[:-1]) + 1
        for a, to in zip(i[np.concatenate([[0], cuts])], np.split(j, cuts)):
            to = to[label[to] != label[a]]
            for at in range(0, len(to), 256):
                part = to[at : at + 256]
                part = part[label[part] != label[a]]
                if not len(part) or not len(sets[a]):
                    continue
                part = part[[len(sets[b]) > 0 for b in part]]
                if not len(part):
                    continue
                alike = part[resemblance(sets[a], [sets[b] for b in part]) >= similarity]
                if len(alike):
                    joined = np.unique(np.append(label[alike], label[a]))
                    label[np.isin(label, joined)] = joined[0]
    return label


def _blocks(batches, size: int):
    """Runs of whole groups of ``size`` rows or more from batches that are sorted by ``g``."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < size:
            continue
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
        g = rows["g"].to_numpy()
        cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
        start = 0
        while len(cuts) and (k := np.searchsorted(cuts, start + size)) < len(cuts):
            yield rows.iloc[start : cuts[k]]
            start = int(cuts[k])
        held, n = [rows.iloc[start:].reset_index(drop=True)], len(rows) - start
    if n:
        yield pd.concat(held, ignore_index=True)


def block_links(rows: DataFrame, radius: int, block: int = PART, similarity: float | None = None) -> DataFrame:
    """Edges ``(a, b)`` between nodes of ``rows(node, fp, key)`` that share a key and are within ``radius``.

    With a ``similarity`` the nodes' sorted shingle hashes, the column ``shingles``, must have it too.
    Only a spanning forest of each block's links is returned.
    """
    exact = similarity is not None
    weight = F.ceil(F.sum(F.octet_length("shingles")) / PART_BYTES) if exact else F.lit(1)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), weight.cast("int").alias("least_parts")).where("count > 1")
    part = F.greatest(F.lit(PART), F.least(F.lit(MOST_PART), (F.col("count") / 32).cast("int")))
    parts = F.when(F.col("count") <= 2 * PART, F.lit(1)).otherwise(F.ceil(F.col("count") / part).cast("int"))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    dealt = rows.join(sizes, "key").withColumn("parts", F.greatest(parts, "least_parts")).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = ["shingles"] if exact else []
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "node", "fp", *sets)

    def run(batches):
        for rows in _blocks(batches, block):
            node, group = rows["node"].to_numpy(), rows["g"].to_numpy()
            fps = np.array(rows["fp"].tolist(), np.int64).view(np.uint64)
            # several small groups are compared at a time, but only rows of one group are linked
            group = None if group[0] == group[-1] else group
            if exact:
                label = exact_forest(fps, [np.frombuffer(x, np.uint64) for x in rows["shingles"]], radius, similarity, group)
            else:
                label = forest(fps, radius, group)
            to = np.flatnonzero(label != np.arange(len(label)))
            if len(to):
                yield pd.DataFrame({"a": node[to], "b": node[label[to]]})

    return dealt.repartition("g").sortWithinPartitions("g").mapInPandas(run, "a bigint, b bigint")


def piece_keys(radius: int, agree: int = 1):
    """Keys of a 64-bit fingerprint ``fp[0]``: each choice of ``agree`` of its ``radius + agree`` pieces.

    Fingerprints within the radius differ in at most ``radius`` pieces, so they
    have at least one key in common.
    """
    n = radius + agree
    cuts = [round(64 * k / n) for k in range(n + 1)]
    x = F.get("fp", 0)
    pieces = [F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(k), *[pieces[p] for p in chosen]) for k, chosen in enumerate(combinations(range(n), agree))])


def pieces_to_agree(rows: int, radius: int, block: int = MOST_PART) -> int:
    """How many pieces make a key, so that random fingerprints share one with ``block`` others or fewer.

    Any number finds the same links: more pieces give smaller blocks and more keys a row.
    """
    agree = 1
    while agree < radius and rows >> 64 * agree // (radius + agree) > block:
        agree += 1
    return agree


def near_groups(docs: DataFrame, width: int = 5, radius: int = 4, agree: int | None = None) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (least doc_id of the group) of each row; complete for the radius."""
    fps = staged(fingerprints(docs, width), "simhash").withColumn("node", F.get("fp", 0))
    distinct = staged(fps.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")), "nodes")
    agree = agree or pieces_to_agree(distinct.count(), radius)
    rows = distinct.select("node", "fp", F.explode(piece_keys(radius, agree)).alias("key"))
    component = connected_components(block_links(rows, radius))
    each = distinct.join(component, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    each = staged(each, "groups")
    # a table, so that the join with a large group can be split
    least = staged(each.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = staged(each.join(least, "component").select("node", "component_id"), "named")
    return fps.join(named, "node").select("doc_id", "fp", "component_id")


def wide_radius(similarity: float, bits: int) -> int:
    """Differing bits that texts of this shingle resemblance have on average, and seven standard deviations more.

    Four would do for long texts; of a few shingles more bits differ (4 shingles and one more: 0.1875 of them).
    """
    p = float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    return round(bits * p + 7 * (bits * p * (1 - p)) ** 0.5)


#: Words of the fingerprint and least hashes, for candidates at a resemblance.
WIDE_WORDS, WIDE_KEYS = 8, 6


def resembling_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows ``(key, doc_id, node, ..)`` of ``docs(key, doc_id, text)``, and the ``component`` of each node that has links.

    Links are between texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.
    """
    radius = wide_radius(similarity, 64 * WIDE_WORDS)
    fps = staged(set_fingerprints(docs, width, WIDE_WORDS, WIDE_KEYS), "sets")
    rows = fps.select("node", "fp", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    # the forests of candidates say which texts may be linked at all, through others too
    maybe = connected_components(block_links(rows, radius)).select("node", F.col("component").alias("cluster"))
    one = fps.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"))
    asked = staged(one.join(maybe, "node"), "asked")
    some, _ = maybe_in(docs.select("key", "text"), asked, "key")
    texts = some.join(asked, "key").dropDuplicates(["key"])

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width)).tobytes() for t in texts])

    sets = staged(texts.select("node", "fp", F.col("cluster").alias("key"), shingles("text").alias("shingles")), "shingles")
    return fps, connected_components(block_links(sets, radius, similarity=similarity))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates: that with the least doc_id, nulls last, all columns kept.

    Only texts make rows alike: rows that share a doc_id, or have none, stay if their texts differ.
    Of rows of one group with the same least doc_id that with the least hash of id and text stays.
    Only rows whose key's cell can't tell whether they stay, or that repeat a row, are shuffled.
    """
    doc_id, text = F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    key = F.xxhash64(doc_id, text).alias("key")
    with temporary():
        fps, component = resembling_groups(docs.select(key, doc_id, text), width, similarity)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
        each = fps.groupBy("node").agg(first)
        each = each.join(component, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
        # rows of one key are equal in id and text
        times = fps.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
        keys = times.join(each.select("first.key", F.lit(1).alias("stays")), "key", "left")
        keys = staged(keys.select("key", "times", F.coalesce("stays", F.lit(0)).alias("stays")), "stay", kept=True)
        note = F.when((F.col("stays") == 1) & (F.col("times") > 1), F.lit(ASK)).otherwise(F.col("stays")).alias("note")
        told = cells(keys.select("key", note), "key", kept=True)
    rows = noted(docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), told, "key")
    asked = rows.where(F.col("note") == ASK).dropDuplicates(["key"]).join(keys.where("stays = 1").select("key"), "key")
    return rows.where("note = 1").select("row.*").unionByName(asked.select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_groups(table(spark, sf_dir, "documents"), width=4, radius=4)
    return near.select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", 0)), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
