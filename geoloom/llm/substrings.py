"""Substring dedup on a compacted De Bruijn graph of word windows.

The graph's edges are the windows of ``window`` (35) consecutive words. Each
document is a walk; a walk is cut into short paths at the window's anchor, the
k-mer with the least hash in it, so that equal windows lie on paths with equal
anchors whatever surrounds them, and about fourteen edges make one row.

1. Anchors that occur on one path only can't hold a repeated edge; a count and
   a join drop their paths.
2. Paths with equal words are counted together. One that occurs at least twice
   is repeated as a whole.
3. Repeated paths are compacted: a join links a path to the one that follows it
   wherever it occurs, if that one occurs as often; linked paths become one
   nonbranching path, and only its first part is looked for among all
   coordinates, so that a passage is one row for each place where it stands. A
   path that follows itself, in a text that repeats a line over and over, is a
   loop and one row from the start.
4. An anchor with several different paths is a branching place: only there are
   single edges compared. One source coordinate of each such path is joined to
   the documents, and the words found there are hashed edge by edge; an edge
   that lies on two paths, or on a repeated one, is repeated.
5. The spans go to the documents. The words at all coordinates of a compacted
   path are digested and must agree; should they ever not, everything is done
   again with other hashes. The covered words are removed.

Paths are proposed by two 64-bit hashes and verified by a 128-bit digest of
their words; single edges are equal if a 64-bit hash of their words is, under an
equal 64-bit anchor hash. Windows are judged on the input, not on what is left.

Defined results for odd input: a null text has no words; a text with fewer
words than a window keeps all of them; a window that repeats within one
document, or because a row is repeated, counts. Columns other than doc_id and
text are ignored by the digest; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, maybe_in, small, staged, table, temporary

WINDOW = 35
#: Fields of spans: first window, and either windows of a run and its name, or a bit mask of windows.
SPAN = ("start", "n", "mask", "name")
#: Words of an anchor.
ANCHOR = 6
#: Windows of a document that are cut into paths at a time, and words that a task remembers.
STRETCH, REMEMBERED = 1 << 19, 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1
FULL = (1 << 64) - 1


class _Words(dict):
    """64-bit hashes of words."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return x


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes], known: _Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo two to the 64th, at least ``n`` of each."""
    if base not in _powers or len(_powers[base][0]) < n:
        n = max(1024, 1 << n.bit_length())
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base]


def rolling(h: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of each run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power(base, len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((total[width:] - total[:-width]) * down[:n])


def least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbours (by the upper 44 bits, the first of equals); under 2**20 entries."""
    y = x >> np.uint64(20) << np.uint64(20) | np.arange(len(x), dtype=np.uint64)
    size, m = 1, y
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    return (m & np.uint64((1 << 20) - 1)).astype(np.int64)


def paths(h: np.ndarray, window: int, anchor: int):
    """Anchor hash, content hash, first window and number of windows of each path of a document."""
    whole, small = rolling(h, window), rolling(h, anchor)
    out = []
    for at in range(0, len(whole), STRETCH):
        n = min(STRETCH, len(whole) - at)
        place = least_in_window(small[at : at + n + window - anchor], window - anchor + 1) + at
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        size = np.diff(np.append(cut, n))
        first, last = whole[at + cut], whole[at + cut + size - 1]
        out.append((small[place[cut]], mix(first * np.uint64(3) ^ mix(last + size.astype(np.uint64))), at + cut, size))
    if not out:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    return tuple(map(np.concatenate, zip(*out)))


def looped(m: np.ndarray, c: np.ndarray, start: np.ndarray, size: np.ndarray):
    """A document's paths with ``after``, the name of the next other one (0: none), and ``reps``, how often a path follows itself.

    Where a text repeats a short line over and over its walk goes round a loop: that is one row.
    """
    if not len(m):
        return m, c, m, start, size, start
    first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])]))
    m, c = m[first], c[first]
    return m, c, np.append((m ^ c)[1:], np.uint64(0)), start[first], size[first], np.diff(np.append(first, len(start)))


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver has dropped their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_paths(docs: DataFrame, window: int, anchor: int, seed: int) -> DataFrame:
    """The paths of ``docs(key, sub, text)``: anchor and content hash, the next path's name, first window, windows, and rounds."""

    def run(batches):
        known = _Words(seed)
        for batch in batches:
            rows = []
            for key, sub, text in zip(batch["key"].to_numpy(), batch["sub"].to_numpy(), batch["text"]):
                words = split_words(text)
                if len(words) >= window:
                    m, c, after, start, size, reps = looped(*paths(word_hashes(words, known), window, anchor))
                    hashes = [x.view(np.int64) for x in (m, c, after)]
                    rows.append((*hashes, np.full(len(m), key), np.full(len(m), sub), *[x.astype(np.int32) for x in (start, size, reps)]))
            if rows:
                yield pd.DataFrame(dict(zip(("m", "c", "after", "key", "sub", "start", "n", "reps"), map(np.concatenate, zip(*rows)))))

    return docs.mapInPandas(run, "m bigint, c bigint, after bigint, key bigint, sub int, start int, n int, reps int")


def compacted(repeated: DataFrame) -> DataFrame:
    """``m``, ``c`` of the first part and ``total`` windows of each nonbranching run of ``repeated(m, c, places, most, after, key, sub, start, n)``.

    A path is linked to its successor if that follows at all of its places and
    has as many; loops (``most`` rounds over 1) stay by themselves. The places of
    linked paths lie side by side, so their first ones, the source coordinates
    given, do too and put the run in order.
    """
    at = ["name", "places", "most", "key", "sub", "start"]
    ends = repeated.where("most = 1 and after is not null")
    ends = ends.select(F.col("after").alias("name"), "places", "most", "key", "sub", (F.col("start") + F.col("n")).alias("start"))
    named = repeated.withColumn("name", F.col("m").bitwiseXOR(F.col("c")))
    linked = named.join(ends.withColumn("linked", F.lit(1)), at, "left")
    walk = Window.partitionBy("key", "sub").orderBy("start")
    runs = linked.withColumn("run", F.sum(F.when(F.col("linked").isNull(), 1).otherwise(0)).over(walk))
    return runs.groupBy("key", "sub", "run").agg(F.min_by(F.struct("m", "c"), "start").alias("first"), F.sum("n").cast("int").alias("total")).select("first.*", "total")


def edge_hashes(words: list[bytes], start: int, n: int, window: int) -> np.ndarray:
    """Hashes of the words of ``n`` windows from ``start`` on."""
    part = words[start : start + n + window - 1]
    text = memoryview(b" ".join(part))
    ends = np.cumsum([len(w) + 1 for w in part]).tolist()
    begins = [0, *ends]
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(text[begins[k] : ends[k + window - 1] - 1]) for k in range(n)), np.uint64, n)


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, seed: int = 11) -> DataFrame:
    """``key``, ``sub`` and ``spans`` of the rows ``docs(key, sub, text)`` that have repeated windows.

    Spans are a struct of arrays, the fields ``SPAN``.
    """
    if not 0 <= window - anchor < 63:
        raise ValueError("a path's windows must fit into a bit mask")
    spark = docs.sparkSession
    walk = staged(cut_paths(docs, window, anchor, seed), "walk")
    shared = staged(walk.groupBy("m").agg(F.sum("reps").alias("times")).where("times > 1").select("m"), "anchors")
    _release(spark)
    places = staged(walk.join(shared, "m"), "paths")
    discard(walk)
    discard(shared)
    _release(spark)
    after = F.when(F.min("after") == F.max("after"), F.min("after")).alias("after")
    counts = F.sum("reps").alias("times"), F.count(F.lit(1)).alias("places"), F.max("reps").alias("most")
    joined = places.groupBy("m", "c").agg(*counts, after, F.min(F.struct("key", "sub", "start", "n")).alias("at"))
    joined = staged(joined.select("m", "c", "times", "places", "most", "after", "at.*"), "joined")
    _release(spark)
    # tables, so that a join with a frequent anchor or path can be split
    runs = staged(compacted(joined.where("times > 1")), "runs")
    branching = staged(joined.groupBy("m").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("m"), "branching")
    path = F.struct("m", "start", "n", F.least("times", F.lit(2)).cast("int").alias("times")).alias("path")
    asked = joined.join(branching, "m").select("key", "sub", path).groupBy("key", "sub").agg(F.collect_list("path").alias("paths"))
    # an array a field: Python gets them as arrays of numbers
    asked = staged(asked.select("key", "sub", F.struct(*[F.col(f"paths.{c}").alias(c) for c in ("m", "start", "n", "times")]).alias("paths")), "asked")
    discard(joined)
    _release(spark)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pd.Series([squeeze((t or "").encode("utf-8", "surrogatepass")) for t in texts])

    def edges(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            rows = []
            for key, sub, text, *asked_ in zip(*[batch[c] for c in ("key", "sub", "text", "m", "start", "n", "times")]):
                words = unpack(text).split()
                for m, start, n, times in zip(*[x.tolist() for x in asked_]):
                    h = edge_hashes(words, start, n, window)
                    rows.append((np.full(n, m), h.view(np.int64), np.full(n, key), np.full(n, sub), np.full(n, start, np.int32), np.arange(n, dtype=np.int32), np.full(n, times, np.int32)))
            if rows:
                yield pd.DataFrame(dict(zip(("m", "h", "key", "sub", "start", "off", "times"), map(np.concatenate, zip(*rows)))))

    # the texts with such places travel once more here: packed they take less than half of the room
    some, _ = maybe_in(docs.select("key", "sub", "text"), asked, "key", "sub")
    found = some.select("key", "sub", packed("text").alias("text")).join(asked, ["key", "sub"])
    edge = staged(found.select("key", "sub", "text", "paths.*").mapInPandas(edges, "m bigint, h bigint, key bigint, sub int, start int, off int, times int"), "edges")
    _release(spark)
    often = staged(edge.groupBy("m", "h").agg(F.sum("times").alias("total")).where("total > 1").select("m", "h"), "often")
    partly = edge.where("times = 1").join(often, ["m", "h"]).groupBy("key", "sub", "start").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))
    partly = partly.select("key", "sub", F.struct("start", F.lit(0).alias("n"), "mask", F.lit(0).cast("bigint").alias("name")).alias("span"))
    name = F.xxhash64("m", "c", "reps").alias("name")
    # a table of its own, so that Spark can split the places of a frequent run
    wholly = places.join(runs, ["m", "c"]).select("key", "sub", F.struct("start", (F.col("total") * F.col("reps")).alias("n"), F.lit(0).cast("bigint").alias("mask"), name).alias("span"))
    wholly = staged(wholly, "wholly")
    spans = wholly.unionByName(partly).groupBy("key", "sub").agg(F.collect_set("span").alias("spans"))
    return spans.select("key", "sub", F.struct(*[F.col(f"spans.{c}").alias(c) for c in SPAN]).alias("spans"))


def kept_words(words: list[bytes], spans, window: int) -> list[bytes]:
    """The words that no marked window covers; ``spans`` are ``(start, n, mask)``."""
    if not spans:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for at, n, mask in spans:
        if n:
            change[at] += 1
            change[at + n - 1 + window] -= 1
        while mask:
            low = (mask & -mask).bit_length() - 1
            change[at + low] += 1
            change[at + low + window] -= 1
            mask &= mask - 1
    covered = np.cumsum(change[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist()) if not c]


def spans_of(*fields) -> list[tuple]:
    """Spans of a row from its arrays, which are None where it has none."""
    return list(zip(*[x.tolist() for x in fields])) if fields[0] is not None else []


def words_at(docs: DataFrame, window: int) -> DataFrame:
    """Add ``found`` to ``docs(text, spans)``: ``name`` and the digest of the words of each span of a run."""

    @F.pandas_udf("array<struct<name: bigint, digest: binary>>")
    def digests(texts: pd.Series, starts: pd.Series, ns: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for text, *fields in zip(texts, starts, ns, names):
            runs = [(name, start, start + n + window - 1) for start, n, name in spans_of(*fields) if n]
            words = split_words(text) if runs else []
            out.append([{"name": name, "digest": xxhash.xxh3_128_digest(b" ".join(words[a:b]))} for name, a, b in runs])
        return pd.Series(out)

    return docs.withColumn("found", digests("text", "spans.start", "spans.n", "spans.name"))


def differing(marked: DataFrame) -> DataFrame:
    """Runs of ``marked(found)`` whose places hold different words."""
    each = marked.select(F.explode("found").alias("f")).groupBy("f.name").agg(F.min("f.digest").alias("least"), F.max("f.digest").alias("most"))
    return each.where("least != most").select("name")


def with_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` and ``spans`` (null: none) of every row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # 96 bits name a row's id and text
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.hash("text", "doc_id").alias("sub"), "text", row)
    for seed in range(11, 100):
        with temporary():
            spans = staged(repeated_spans(keyed.select("key", "sub", "text"), window, anchor, seed), "spans", kept=True)
        _release(docs.sparkSession)
        # texts without spans are neither shuffled nor written
        some, others = maybe_in(keyed.select("key", "sub", "row"), spans, "key", "sub", kept=True)
        marked = some.join(spans, ["key", "sub"], "left").select("row", F.col("row.text").alias("text"), "spans")
        marked = staged(words_at(marked, window).drop("text"), "marked")
        discard(spans)
        if differing(marked).isEmpty():
            none = F.lit(None).cast(marked.schema["spans"].dataType).alias("spans")
            marked = marked.select("row", F.col("row.text").alias("text"), "spans")
            return marked.unionByName(others.select("row", F.col("row.text").alias("text"), none))
        discard(marked)
    raise RuntimeError("no seed tells all paths apart")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the words of repeated windows cut out of ``text``; what is left of a changed text is joined by blanks.

    Texts without repeats are unchanged.
    """

    @F.pandas_udf("string")
    def rest(texts: pd.Series, starts: pd.Series, ns: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for text, *fields in zip(texts, starts, ns, masks):
            spans = spans_of(*fields)
            out.append(b" ".join(kept_words(split_words(text), spans, window)).decode("utf-8", "surrogatepass") if spans else text)
        return pd.Series(out)

    marked = with_spans(docs, window, anchor)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest("text", "spans.start", "spans.n", "spans.mask"))
    return marked.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    @F.pandas_udf("struct<n_words: bigint, n_removed: bigint, kept_sha256: string>")
    def digest(texts: pd.Series, starts: pd.Series, ns: pd.Series, masks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, *fields in zip(texts, starts, ns, masks):
            words = split_words(text)
            kept = kept_words(words, spans_of(*fields), WINDOW)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    return marked.select(F.col("row.doc_id").alias("doc_id"), digest("text", "spans.start", "spans.n", "spans.mask").alias("d")).select("doc_id", "d.*")


QUERIES = {"op10_substrings": op10_substrings}

ORACLES = {
    "op10_substrings": r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), windows AS (
        SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
    ), repeated AS (
        SELECT h FROM windows GROUP BY h HAVING count(*) > 1
    ), gone AS (
        SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS i FROM windows WHERE h IN (SELECT h FROM repeated)
    ), kept AS (
        SELECT p.r, string_agg(p.word, ' ' ORDER BY p.i) AS text, count(*) AS n
        FROM (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d) p
        ANTI JOIN gone g ON p.r = g.r AND p.i = g.i GROUP BY p.r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept k ON d.r = k.r""",
}
