"""Document fingerprints: threshold-scaled sketches of word shingles.

Every text becomes the hashes of its five-word shingles. The sketch keeps each
hash below a fixed fraction of the hash range, and, so that short texts have
one too, the ``LEAST`` least hashes in any case. The rule is the same for all
texts and needs nothing but the hashes: the sketch of a union is the same rule
applied to the union of sketches (:func:`merged`), and a sketch tells up to
which hash it is complete (:func:`reach`). Containment and resemblance of two
documents of very unequal length are estimated from the hashes up to the
smaller of their reaches.

All work is done by DataFrame functions.

Defined results for odd input: a null text counts as empty; an empty text has
an empty sketch; a text of fewer than five words has one shingle, the whole
word sequence; equal texts have equal sketches and likeness 1; two sketches
that share no comparable hash have likeness 0. Repeated rows are kept, rows
with a null doc_id come first in the order, ties are ordered by a hash of the
text. Columns other than doc_id and text are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, let, staged, table

SHINGLE = 5
#: The fraction is one in two to this power.
SCALE_BITS = 3
#: So many least hashes are kept in any case.
LEAST = 128


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of the text's word shingles, in order, repeats included."""

    def of(words: Column) -> Column:
        return let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.when(
                F.size(h) >= width,
                F.transform(
                    F.sequence(F.lit(0), F.size(h) - width),
                    lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]),
                ),
            ).otherwise(F.array(F.xxhash64(h))),
        )

    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(let(F.split(trimmed, SPACE), of))


def _below(scale_bits: int) -> int:
    """The first hash that is not within the fraction."""
    return -(2**63) + 2 ** (64 - scale_bits) if scale_bits else 2**63 - 1


def kept(hashes: Column, scale_bits: int = SCALE_BITS, least: int = LEAST) -> Column:
    """What a sketch keeps of a set of hashes, in ascending order."""
    below = F.lit(_below(scale_bits))
    return let(F.sort_array(F.array_distinct(hashes)), lambda h: F.slice(h, F.lit(1), F.greatest(F.lit(least), F.size(F.filter(h, lambda x: x < below)))))


def sketch(text: Column, scale_bits: int = SCALE_BITS, least: int = LEAST) -> Column:
    """The text's sketch: an ascending array of hashes."""
    return kept(shingle_hashes(text), scale_bits, least)


def merged(a: Column, b: Column, scale_bits: int = SCALE_BITS, least: int = LEAST) -> Column:
    """The sketch of the union of the sets that two sketches stand for."""
    return kept(F.concat(a, b), scale_bits, least)


def sketch_text(s: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def reach(s: Column, scale_bits: int = SCALE_BITS, least: int = LEAST) -> Column:
    """The hash up to which a sketch holds all of its set's hashes."""
    return F.when(F.size(s) < least, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(_below(scale_bits) - 1), F.get(s, F.size(s) - 1)))


def likeness(a: Column, b: Column, scale_bits: int = SCALE_BITS, least: int = LEAST) -> tuple[Column, Column]:
    """Estimated resemblance, and containment of the smaller in the larger (both 0 to 1)."""
    upto = F.least(reach(a, scale_bits, least), reach(b, scale_bits, least))

    def share(n: Column, of: Column) -> Column:
        return F.when(of == 0, F.lit(0.0)).otherwise(n.cast("double") / of.cast("double"))

    comparable = let(upto, lambda t: F.struct(F.filter(a, lambda h: h <= t).alias("x"), F.filter(b, lambda h: h <= t).alias("y")))
    sizes = let(comparable, lambda p: F.struct(F.size(F.array_intersect(p["x"], p["y"])).alias("both"), F.size(p["x"]).alias("x"), F.size(p["y"]).alias("y")))
    found = let(
        sizes,
        lambda p: F.struct(share(p["both"], p["x"] + p["y"] - p["both"]).alias("near"), share(p["both"], F.least(p["x"], p["y"])).alias("within")),
    )
    whole = F.struct(F.lit(1.0).alias("near"), F.lit(1.0).alias("within"))
    both = F.when(a == b, whole).otherwise(found)
    return both["near"], both["within"]


def with_next(df: DataFrame, key: str, columns: list[str], tie: str) -> DataFrame:
    """``df(key, tie, columns..)`` with ``next``: a struct of ``columns`` from the next row by ``key`` (the first row after the last).

    Spark deals the rows to ranges of the order, written as a table; each range
    is then a window partition of its own, to which the first row of the range
    after it is added. Ties are ordered by the hash of ``tie`` and then by their
    place, so equal keys and even equal rows are spread over ranges.
    """
    order = [F.col(key).asc_nulls_first(), F.col("_tie").asc(), F.col("_place").asc()]
    placed = df.select(key, *columns, F.xxhash64(tie).alias("_tie"), F.monotonically_increasing_id().alias("_place"))
    ranges = staged(placed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    place = F.struct(F.col(key).isNotNull(), key, "_tie", "_place")
    firsts = staged(ranges.groupBy("_range").agg(F.min_by(F.struct(key, *columns, "_tie", "_place"), place).alias("row")), "firsts")
    # a row a range: where the first row of each range goes
    before = F.lag("_range").over(Window.orderBy("_range"))
    to = firsts.select("_range", F.coalesce(before, F.max("_range").over(Window.partitionBy())).alias("to"))
    more = firsts.join(to, "_range").select("row.*", F.col("to").alias("_range"), F.lit(1).alias("_late"))
    rows = ranges.withColumn("_late", F.lit(0)).unionByName(more).repartition("_range")
    following = F.lead(F.struct(*columns)).over(Window.partitionBy("_range").orderBy("_late", *order))
    return rows.withColumn("next", following).where("_late = 0").select(key, *columns, "next")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text, and compare it with both the edit and the next text.

    The edited text keeps the first half and takes as many code points as
    the second half has (or all there are) from the next document's beginning.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    paired = with_next(base, "doc_id", ["text"], "text").select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        sketch(F.col("text")).alias("sketch"),
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"),
        sketch(F.col("next.text")).alias("next_sketch"),
    )
    done = paired.withColumn("edited_sketch", sketch(F.col("edited")))
    near_edited, within_edited = likeness(F.col("sketch"), F.col("edited_sketch"))
    near_next, within_next = likeness(F.col("sketch"), F.col("next_sketch"))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        near_edited.alias("near_edited"),
        near_next.alias("near_next"),
        within_edited.alias("within_edited"),
        within_next.alias("within_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
