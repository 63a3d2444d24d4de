"""Mixing sources to target weights by pivotal rounding.

A source's target is its share of all words by weight, at most ``most`` times
what it has; what a capped source can't take is shared among the others by
weight. Each document is then wanted target / source size times: the whole
copies are certain, the rest is a fractional copy probability. Pairs of
documents transfer word mass at random until one probability is 0 or 1, which
keeps the source's expected words exact and every document's probability as it
was. Pairs that remain undecided meet at the next level of a reduction tree:
first within buckets of a source, then among the buckets' residuals, and so on
until a source has one residual; that document gives the mix the words that
are still missing, as a cut copy.

Equal rows are counted before they are dealt, and each copy is dealt by its
number, so that a doc_id that very many rows share, or none, is spread.

Defined results for odd input: a null text has no words; documents without
words are never taken and a source without words has target 0; a null source
is a source of its own, the last. Randomness comes from the seed, the source
and the rows' ids and texts, so reruns agree; repeated rows count as documents
of their own (equal rows are interchangeable). Columns other than doc_id, text and
source are carried or ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .common import ASK, SPACE, WORD, cells, finished, noted, staged, table, temporary

#: Rows that one task rounds at a time.
BUCKET = 1024
#: Copies of a row that are made from one array.
MANY = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source; the sources by code point, null last, take ``weights`` in turn.

    Sources are capped in the order of cap to weight, so the capped ones are a
    prefix of it; running sums give each source the level it would see. The
    windows see one row a source, which one task holds for millions of sources.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    each = each.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn.cast("int")).cast("bigint"))
    each = each.withColumn("cap", F.col("source_size") * most)
    filled = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    each = each.withColumn("left", left).withColumn("weight_left", weight_left)
    free = F.col("left") * F.col("weight") < F.col("cap") * F.col("weight_left")
    each = each.withColumn("free", free)
    level = F.first(F.when(F.col("free"), F.struct("left", "weight_left")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.weight_left"))
    return each.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def pivot(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``p`` by random transfers of mass ``p * w`` between pairs; returns the result and the row left undecided (-1: none)."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > 1:
        a, b = open_[0 : len(open_) // 2 * 2 : 2], open_[1::2]
        pa, pb, wa, wb = p[a], p[b], w[a], w[b]
        up = np.minimum((1 - pa) * wa, pb * wb)  # mass that can go to a
        down = np.minimum(pa * wa, (1 - pb) * wb)
        to_a = rng.random(len(a)) * (up + down) < down
        mass = np.where(to_a, up, -down)
        na, nb = pa + mass / wa, pb - mass / wb
        # the one that reached its end gets it exactly
        na = np.where(to_a & ((1 - pa) * wa <= pb * wb), 1.0, np.where(~to_a & (pa * wa <= (1 - pb) * wb), 0.0, na))
        nb = np.where(to_a & (pb * wb <= (1 - pa) * wa), 0.0, np.where(~to_a & ((1 - pb) * wb <= pa * wa), 1.0, nb))
        p[a], p[b] = np.clip(na, 0, 1), np.clip(nb, 0, 1)
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p, int(open_[0]) if len(open_) else -1


UNIT = "unit bigint, number bigint, doc_id string, size bigint, mark bigint, p double"


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """Round each group's rows; the undecided row of a group stays open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "mark", "doc_id", "number"], ascending=[False, True, True, True], ignore_index=True)
        name = f"{seed}|{level}|{pdf['source'].iloc[0]}|{pdf['group'].iloc[0]}".encode()
        rng = np.random.Generator(np.random.Philox(int.from_bytes(hashlib.sha256(name).digest()[:16], "big")))
        # neighbours of like size transfer little
        p, left = pivot(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), rng)
        pdf["p"] = p
        pdf["open"] = np.arange(len(pdf)) == left
        return pdf

    return rows.groupBy("source", "group").applyInPandas(run, f"source string, group bigint, {UNIT}, open boolean")


def _numbers(units: DataFrame) -> DataFrame:
    """A row for each ``number`` from 0 up to ``times``; those of a unit with very many are dealt to tasks in stretches."""
    last, zero = F.col("times") - 1, F.lit(0).cast("bigint")
    few = units.where(F.col("times") <= MANY).withColumn("number", F.explode(F.sequence(zero, last)))
    many = units.where(F.col("times") > MANY).withColumn("_from", F.explode(F.sequence(zero, last, F.lit(MANY).cast("bigint")))).repartition("unit", "_from")
    many = many.withColumn("number", F.explode(F.sequence("_from", F.least(F.col("_from") + MANY - 1, last))))
    return few.unionByName(many.drop("_from"))


def copies(units: DataFrame, targets: DataFrame, seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """``unit``, ``number`` and ``share``: how many times the mix takes each of the ``times`` copies of a unit.

    ``units(unit, doc_id, source, size, mark, times)`` are distinct rows; a share is not whole for one copy a source at most.
    """
    wanted = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = _numbers(wanted.withColumn("rate", rate))
    whole = F.floor(F.col("rate") + 1e-9).cast("double")
    each = each.withColumn("whole", whole).withColumn("p", F.greatest(F.col("rate") - whole, F.lit(0.0)))
    # ids go to Python as text: beside a null a number would lose digits
    each = staged(each.select("unit", "number", F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "mark", "whole", "p"), "wanted")
    open_ = each.where("p > 0")
    counts = staged(open_.groupBy("source").count(), "open")
    groups = F.ceil(F.col("count") / bucket).cast("bigint")
    dealt = open_.join(counts, open_["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    columns = ["unit", "number", "doc_id", "size", "mark", "p"]
    rows = dealt.select("source", F.pmod(F.xxhash64("doc_id", "size", "mark", "number", F.lit(seed)), groups).alias("group"), *columns)
    most = counts.agg(F.max("count")).first()[0] or 0
    decided, level, width = None, 0, -(-most // bucket)
    while True:
        done = staged(_level(rows, level, seed), "rounded")
        decided = done if decided is None else decided.unionByName(done)
        if width <= 1:
            break
        decided = decided.where("not open")
        width = -(-width // bucket)
        rows = done.where("open").select("source", F.floor(F.col("group") / bucket).alias("group"), *columns)
        level += 1
    rounded = decided.select("unit", "number", F.col("p").alias("rounded"))
    return each.join(rounded, ["unit", "number"], "left").select("unit", "number", (F.col("whole") + F.coalesce("rounded", F.lit(0.0))).alias("share"))


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``number``, from 0 on, to the rows of each unit of ``rows(at, unit, times)``, without a window over all rows of a unit.

    The upper bits of ``at`` are the partition that a row was written by: rows
    are numbered within it, from where the partitions before it end.
    """
    once = rows.where("times = 1").withColumn("number", F.lit(0).cast("bigint"))
    again = rows.where("times > 1").withColumn("_part", F.shiftright("at", 33))
    counts = again.groupBy("unit", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ends = F.sum("_n").over(Window.partitionBy("unit").orderBy("_part"))
    starts = staged(counts.select("unit", "_part", (ends - F.col("_n")).alias("_start")), "starts")
    place = F.row_number().over(Window.partitionBy("unit", "_part").orderBy("at")) - 1
    again = again.withColumn("_place", place).join(starts, ["unit", "_part"]).withColumn("number", F.col("_start") + F.col("_place"))
    return once.unionByName(again.select(once.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``share`` and ``taken`` of every row, and the columns to keep."""
    sizes = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), *keep)
    sizes = staged(sizes, "sizes")
    targets = staged(source_targets(sizes, weights, most), "targets")
    names = ["doc_id", "source", "size", "mark"]
    units = sizes.groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    units = staged(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    same = F.lit(True)
    for c in names:
        same = same & sizes[c].eqNullSafe(units[c])
    rows = staged(sizes.join(units, same).select(*[sizes[c] for c in sizes.columns], "unit", "times"), "rows")
    share = copies(units, targets, seed)
    out = numbered(rows).join(share, ["unit", "number"])
    out = out.join(targets, out["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    taken = F.least(F.round(F.col("size") * F.col("share")), F.col("size") * most).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", "share", taken.alias("taken"), *keep)


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, (MapType, VariantType)) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The rows of the mix: ``docs`` as often as the mix takes them, all columns kept.

    A cut copy holds the first words of its text, joined by blanks. Equal rows
    are drawn separately and given out together. Only rows that are equal, cut or
    taken very often, or whose key's cell can't tell how often, are shuffled.
    """
    # a row is known by all of its columns; those that have no hash count as JSON
    whole = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema]
    key = F.struct(F.xxhash64(*whole), F.hash(*whole[::-1])).alias("key")
    keyed = docs.select(key, "doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    with temporary():
        drawn = mix(keyed, weights, most, seed, keep=("key",))
        taken = F.col("taken") > 0
        shares = drawn.groupBy("key").agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.when(taken, F.floor("share"))), F.lit(0)).cast("int").alias("whole"),
            F.coalesce(F.sum(F.when(taken, F.round((F.col("share") - F.floor("share")) * F.col("size")))), F.lit(0)).cast("int").alias("words"),
        )
        shares = staged(shares, "shares", kept=True)
        simple = (F.col("words") == 0) & ((F.col("whole") == 0) | (F.col("rows") == 1) & (F.col("whole") <= 100))
        told = cells(shares.select("key", F.when(simple, F.col("whole")).otherwise(F.lit(ASK)).alias("note")), "key", kept=True)
    rows = noted(keyed.select("key", "row"), told, "key")
    # copies of very many equal rows are made in stretches
    parts = shares.where("whole > 0 or words > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.col("whole") - 1, F.lit(0)), F.lit(MANY))))
    parts = parts.withColumn("words", F.when(F.col("at") == 0, F.col("words")).otherwise(0)).withColumn("whole", F.least(F.col("whole") - F.col("at"), F.lit(MANY)))
    asked = rows.where(F.col("note") == ASK).dropDuplicates(["key"]).join(parts, "key").select("row", "whole", "words")
    rows = rows.where("note > 0").select("row", F.col("note").cast("int").alias("whole"), F.lit(0).alias("words")).unionByName(asked)
    words = F.array_join(F.slice(F.filter(F.split("row.text", SPACE), lambda w: w != ""), F.lit(1), F.col("words")), " ")
    copy = F.concat(F.array_repeat(F.lit(True), F.col("whole")), F.array_repeat(F.lit(False), (F.col("words") > 0).cast("int")))
    rows = rows.withColumn("full", F.explode(copy))
    return rows.select(*[F.when(F.col("full"), F.col("row.text")).otherwise(words).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return finished(lambda: mix(docs).select("doc_id", "size", "source_size", "target", "taken", "share"), "mix")


QUERIES = {"op8_mixing": op8_mixing}
