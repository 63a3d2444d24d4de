"""Repeated byte strings by suffix arrays, induced shard by shard.

1. Every window of ``width`` (200) bytes belongs to its anchor, the 64 bytes in it
   with the least hash: equal windows have equal anchors at an equal distance,
   whatever surrounds them. A text is cut into pieces, each of the windows of one
   anchor. Pieces that follow themselves, in a text that repeats itself at short
   distance, are one row with a count.
2. Equal pieces are counted together, and pieces whose anchor stands nowhere else
   are dropped. One place of each different piece gives its bytes; neighbours
   there whose anchors have no other piece are joined, so that their windows'
   bytes are not repeated.
3. Anchors are dealt to shards of bounded size. A shard's pieces are put one after
   another, its suffix array is induced and the permuted common prefixes are
   computed. A window is repeated if the suffix that starts there shares ``width``
   bytes with a neighbour in the array, or its piece stands at several places.
4. An anchor with more bytes of different pieces than a shard should hold is
   split: its windows are dealt by the bytes that the windows of a range of
   distances all share, a longer string than the anchor, first for ranges of 24
   distances and, if that is still too much, of one, where it is the window itself.
5. The repeated windows go to the places of their pieces and so to the texts.

An anchor's pieces are told apart by a 64-bit hash of their bytes beside the 64-bit
hash of the anchor. Windows are judged on the input, not on what is left.

Defined results for odd input: a null text is empty; a text of fewer bytes than a
window keeps all; a window that repeats within a text, overlapping itself or not,
or because a row is repeated, counts. Columns other than text are carried; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, small, staged, table, temporary
from .substrings import least_in_window, rolling
from .suffix_array import common_prefixes, suffix_array

#: Bytes of a window and of an anchor.
WIDTH, ANCHOR = 200, 64
#: Bytes of a shard, and of an anchor's different pieces before it is split, and the ranges of distances it is split by.
SHARD, SPLIT, RANGES = 1 << 17, 1 << 16, (24, 1)
#: Windows of pieces that are joined, at most.
LONG = 1 << 14
#: Windows of a text that are cut into pieces at a time.
STRETCH = 1 << 18
#: A hash of each byte, for the rolling hash.
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 77) for b in range(256)], np.uint64)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def pieces_of(text: bytes, width: int = WIDTH, anchor: int = ANCHOR):
    """Anchor hash, content hash, first window, windows, distance of the anchor from the first window, and repetitions of each piece."""
    out = []
    digest = xxhash.xxh3_64_intdigest
    for at in range(0, len(text) - width + 1, STRETCH):
        part = text[at : at + STRETCH + width - 1]
        hashes = rolling(_BYTES[np.frombuffer(part, np.uint8)], anchor)
        place = least_in_window(hashes, width - anchor + 1)
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        n = np.diff(np.append(cut, len(place)))
        whole = memoryview(part)
        c = np.fromiter((digest(whole[a : a + k + width - 1]) for a, k in zip(cut.tolist(), n.tolist())), np.uint64, len(cut))
        m = hashes[place[cut]]
        first = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (c[1:] != c[:-1])))
        times = np.diff(np.append(first, len(cut)))
        cut, n = cut[first], n[first]
        out.append((m[first].view(np.int64), c[first].view(np.int64), at + cut, n, place[cut] - cut, times))
    return tuple(map(np.concatenate, zip(*out))) if out else None


def cut(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """The pieces of packed texts ``docs(at, copies, text)``, a row each with its place and how often it stands in all copies."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            rows = []
            for at, copies, text in zip(batch["at"].tolist(), batch["copies"].tolist(), batch["text"]):
                m, c, start, n, gap, reps = pieces_of(unpack(text), width, anchor)
                rows.append((m, c, np.full(len(m), at), start.astype(np.int32), n.astype(np.int32), gap.astype(np.int32), reps.astype(np.int32), reps * copies))
            yield pd.DataFrame(dict(zip(("m", "c", "at", "start", "n", "gap", "reps", "times"), map(np.concatenate, zip(*rows)))))

    return docs.mapInPandas(run, "m bigint, c bigint, at bigint, start int, n int, gap int, reps int, times bigint")


def repeated_windows(pieces: list[bytes], times: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each piece, which of its windows stand elsewhere: in another of the pieces, or at another place of this one."""
    ends = np.cumsum([len(p) + 1 for p in pieces])
    # no byte of UTF-8 is over 244: two more values, for the ends of pieces and of all
    text = np.zeros(int(ends[-1]) + 1, np.uint8)
    text[:-1] = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8) + np.uint8(2)
    sa = suffix_array(text)
    shared = common_prefixes(text, sa)
    alike = shared >= width
    # the suffix before one that shares a window's bytes shares them too
    before = np.flatnonzero(alike[sa[1:]])
    alike[sa[before]] = True
    out = []
    for end, piece, k in zip(ends.tolist(), pieces, times.tolist()):
        n, start = len(piece) - width + 1, end - len(piece) - 1
        out.append(np.ones(n, bool) if k > 1 else alike[start : start + n])
    return out


def spans_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each stretch of marked places."""
    change = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()))


SPANS = "array<struct<first: int, last: int>>"


def shard_spans(pieces: DataFrame, width: int) -> DataFrame:
    """``g``, ``c`` and the repeated ``spans`` of ``pieces(g, c, times, piece)``, by suffix arrays of shards of whole groups."""
    total = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "c"], ignore_index=True)
        marks = repeated_windows(pdf["piece"].tolist(), pdf["times"].to_numpy(), width)
        spans = [[{"first": a, "last": b} for a, b in spans_of(x)] for x in marks]
        return pd.DataFrame({"g": pdf["g"], "c": pdf["c"], "spans": spans})[[bool(x) for x in spans]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, f"g bigint, c bigint, spans {SPANS}")


def split(pieces: DataFrame, distances: int, width: int) -> DataFrame:
    """Parts of ``pieces(g, c, times, gap, piece)`` by ranges of their windows' distance from the anchor.

    Their ``g`` names the range and the bytes that all of its windows share, whether a piece has all of them or not.
    """

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in small(batches):
            rows = []
            for g, c, times, gap, piece in zip(*[batch[x] for x in ("g", "c", "times", "gap", "piece")]):
                least = gap - (len(piece) - width)
                for block in range(least // distances, gap // distances + 1):
                    far, near = min(gap, (block + 1) * distances - 1), max(least, block * distances)
                    last = gap - block * distances  # where the range's last window starts
                    name = digest(piece[last : last - distances + 1 + width], seed=hash((g, block)) & (1 << 64) - 1)
                    part = piece[gap - far : gap - near + width]
                    rows.append((g, c, gap - far, name, digest(part, seed=far), times, far, part))
            if rows:
                out = pd.DataFrame(rows, columns=["of_g", "of_c", "from", "g", "c", "times", "gap", "piece"])
                yield out.assign(g=out["g"].to_numpy(np.uint64).view(np.int64), c=out["c"].to_numpy(np.uint64).view(np.int64))

    return pieces.mapInPandas(run, "of_g bigint, of_c bigint, from int, g bigint, c bigint, times bigint, gap int, piece binary")


def group_spans(pieces: DataFrame, width: int, most: int = SPLIT, ranges: tuple[int, ...] = RANGES) -> DataFrame:
    """``g``, ``c`` and the repeated ``spans`` of different ``pieces(g, c, times, gap, piece)``; only pieces of a group are compared."""
    if not ranges:
        return shard_spans(pieces, width)
    sizes = pieces.groupBy("g").agg(F.sum(F.length("piece")).alias("bytes"))
    frequent = staged(sizes.where(F.col("bytes") > most).select("g"), "frequent")
    if frequent.isEmpty():
        return shard_spans(pieces, width)
    parts = staged(split(pieces.join(frequent, "g", "left_semi"), ranges[0], width), "parts")
    once = parts.groupBy("g", "c").agg(F.sum("times").alias("times"), F.first("gap").alias("gap"), F.first("piece").alias("piece"))
    inner = group_spans(staged(once, "pieces"), width, most, ranges[1:])
    back = parts.select("g", "c", "of_g", "of_c", "from").join(inner, ["g", "c"]).select(F.col("of_g").alias("g"), F.col("of_c").alias("c"), "from", F.explode("spans").alias("s"))
    moved = F.struct((F.col("s.first") + F.col("from")).alias("first"), (F.col("s.last") + F.col("from")).alias("last"))
    back = back.groupBy("g", "c").agg(F.collect_list(moved).alias("spans"))
    return shard_spans(pieces.join(frequent, "g", "left_anti"), width).unionByName(back)


def joined(asked: list[tuple]):
    """Runs of a text's ``asked(start, m, c, times, n, gap, lone)``, by start: pieces that meet no other piece go on where the last one ends."""
    run, size = [], 0
    for piece in asked:
        last = run[-1] if run else None
        if last and last[6] and piece[6] and last[0] + last[4] == piece[0] and last[3] == piece[3] and size + piece[4] <= LONG:
            run.append(piece)
            size += piece[4]
            continue
        if run:
            yield run
        run, size = [piece], piece[4]
    if run:
        yield run


def repeated_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, most: int = SPLIT) -> DataFrame:
    """``key``, ``sub`` and the repeated windows, as ``spans``, of the different texts ``docs(key, sub, text)`` that have some."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pd.Series([squeeze(as_bytes(t)) for t in texts], dtype=object)

    # equal texts are one text that stands several times
    long_enough = docs.where(F.octet_length("text") >= width).select("key", "sub", packed("text").alias("text"))
    texts = long_enough.groupBy("key", "sub").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.first("text").alias("text"))
    texts = staged(texts.withColumn("at", F.monotonically_increasing_id()), "texts")
    walk = staged(cut(texts.select("at", "copies", "text"), width, anchor), "walk")
    shared = staged(walk.groupBy("m").agg(F.sum("times").alias("n")).where("n > 1").select("m"), "anchors")
    places = staged(walk.join(shared, "m"), "places")
    discard(walk)
    discard(shared)
    first = F.min(F.struct("at", "start", "n", "gap")).alias("first")
    asked = staged(places.groupBy("m", "c").agg(F.sum("times").alias("times"), first).select("m", "c", "times", "first.*"), "asked")
    branching = asked.groupBy("m").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("m", F.lit(False).alias("lone"))
    asked = asked.join(branching, "m", "left").withColumn("lone", F.coalesce("lone", F.lit(True)))
    # an array a field: Python gets them as arrays of numbers
    fields = ("start", "m", "c", "times", "n", "gap", "lone")
    asked = asked.groupBy("at").agg(*[F.collect_list(x).alias(x) for x in fields])

    def extract(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            rows = []
            for text, *arrays in zip(batch["text"], *[batch[x] for x in fields]):
                text = unpack(text)
                for run in joined(sorted(zip(*[x.tolist() for x in arrays]))):
                    begin, m, c, times, _, gap, _ = run[0]
                    members = [{"m": r[1], "c": r[2], "from": r[0] - begin, "n": r[4]} for r in run]
                    rows.append((m, c, times, gap, text[begin : run[-1][0] + run[-1][4] + width - 1], members))
            if rows:
                yield pd.DataFrame(rows, columns=["g", "c", "times", "gap", "piece", "members"])

    kind = "g bigint, c bigint, times bigint, gap int, piece binary, members array<struct<m: bigint, c: bigint, from: int, n: int>>"
    pieces = staged(texts.select("at", "text").join(asked, "at").select("text", *fields).mapInPandas(extract, kind), "pieces")
    marks = group_spans(pieces.drop("members"), width, most).join(pieces.select("g", "c", "members"), ["g", "c"])
    marks = marks.select("spans", F.explode("members").alias("of"))
    clipped = F.transform("spans", lambda s: F.struct(F.greatest(s["first"] - F.col("of.from"), F.lit(0)).alias("first"), F.least(s["last"] - F.col("of.from"), F.col("of.n")).alias("last")))
    marks = staged(marks.select("of.m", "of.c", F.filter(clipped, lambda s: s["first"] < s["last"]).alias("spans")), "marks")
    discard(pieces)
    found = places.join(marks, ["m", "c"])
    whole = F.array(F.struct(F.col("start").cast("int").alias("first"), (F.col("start") + F.col("n") * F.col("reps")).cast("int").alias("last")))
    part = F.transform("spans", lambda s: F.struct((F.col("start") + s["first"]).cast("int").alias("first"), (F.col("start") + s["last"]).cast("int").alias("last")))
    found = found.groupBy("at").agg(F.flatten(F.collect_list(F.when(F.col("reps") > 1, whole).otherwise(part))).alias("spans"))
    found = found.join(texts.select("at", "key", "sub"), "at")
    return found.select("key", "sub", F.struct(F.col("spans.first").alias("first"), F.col("spans.last").alias("last")).alias("spans"))


def removed(n: int, firsts, lasts, width: int = WIDTH) -> np.ndarray:
    """Which of a text's ``n`` bytes a repeated window covers."""
    change = np.zeros(n + 1, np.int64)
    if firsts is not None:
        np.add.at(change, np.asarray(firsts, np.int64), 1)
        np.add.at(change, np.asarray(lasts, np.int64) + width - 1, -1)
    return np.cumsum(change[:-1]) > 0


def with_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, most: int = SPLIT) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``spans`` (first and last + 1 of stretches of repeated windows, null: none) of every row."""
    # 96 bits name a text
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.xxhash64("text").alias("key"), F.hash("text").alias("sub"), "text", row)
    with temporary():
        spans = staged(repeated_spans(keyed.select("key", "sub", "text"), width, anchor, most), "spans", kept=True)
    return keyed.select("key", "sub", "row").join(spans, ["key", "sub"], "left").select("row", "spans")


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, most: int = SPLIT) -> DataFrame:
    """``docs`` without the bytes of repeated windows in ``text``; a character of which a byte stays, stays whole."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(texts, firsts, lasts):
            if a is None:
                out.append(text)
                continue
            data = np.frombuffer(as_bytes(text), np.uint8)
            starts = np.flatnonzero(data & 0xC0 != 0x80)
            keep = np.add.reduceat(~removed(len(data), a, b, width), starts, dtype=np.int64) > 0
            out.append(data[np.repeat(keep, np.diff(np.append(starts, len(data))))].tobytes().decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    marked = with_spans(docs, width, anchor, most)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(rest("row.text", "spans.first", "spans.last"))
    return marked.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    @F.pandas_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    def digest(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, firsts, lasts):
            data = as_bytes(text)
            n_removed = n_spans = 0
            if a is not None:
                gone = removed(len(data), a, b)
                n_removed, n_spans = int(gone.sum()), len(spans_of(gone))
                data = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((n_removed + len(data), n_removed, n_spans, hashlib.sha256(data).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select(F.col("row.doc_id").alias("doc_id"), digest("row.text", "spans.first", "spans.last").alias("d")).select("doc_id", "d.*")


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}

ORACLES = {
    "op13_suffix_dedup": r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
    ), blocks AS (
        SELECT r, b, substr(x, 2 * b + 1, 2 * (1000 + 199)) AS x FROM (SELECT r, x, unnest(generate_series(0, n - 200, 1000)) AS b FROM d WHERE n >= 200)
    ), windows AS (
        SELECT r, b + i AS i, md5_number(substr(x, 2 * i + 1, 400)) AS h
        FROM (SELECT r, b, x, unnest(generate_series(0, least(999, len(x) // 2 - 200))) AS i FROM blocks)
    ), repeated AS (
        SELECT h FROM windows GROUP BY h HAVING count(*) > 1
    ), runs AS (
        SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows WHERE h IN (SELECT h FROM repeated)
    ), numbered AS (
        SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM runs
    ), spans AS (
        SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY r, k
    ), edges AS (
        SELECT r, k, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM spans
    ), kept AS (
        SELECT e.r, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS x, count(*) AS spans, sum(z - a) AS gone
        FROM edges e JOIN d ON e.r = d.r GROUP BY e.r
    )
    SELECT doc_id, d.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
    FROM d LEFT JOIN kept ON d.r = kept.r""",
}
