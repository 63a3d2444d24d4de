"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Java pattern of a word.
WORD = "[^\\x20\\x09-\\x0D]+"

_local_root: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The session's ``spark.checkpoint.dir``; where it is unset, a temporary
    folder, and that in local mode only, since a cluster's machines would not
    see one another's files.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _local_root = _local_root or tempfile.mkdtemp(prefix="spark-geoloom-")
    return _local_root


#: The scopes around the code that runs, innermost last; each thread has its own.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary():
    """Delete the tables that are staged within, at the end; nothing that still reads them may run after it."""
    own: list[DataFrame] = []
    outer = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(outer)
        for df in own:
            discard(df)


def staged(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    A table that is not ``kept`` belongs to the :func:`temporary` scope around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    scopes = _scopes.get()
    if scopes and not kept:
        scopes[-1].append(back)
    return back


def finished(result, label: str) -> DataFrame:
    """The table that ``result()`` gives, written; what was staged for it is deleted."""
    with temporary():
        return staged(result(), label, kept=True)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`staged` wrote, once nothing that is still to run reads it."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Cells for each key, cells of one row of their table (a power of two), and cells at most.
CELLS_A_KEY, CELLS_A_ROW, MOST_CELLS = 4, 256, 1 << 24
#: Note of a key that only a join can tell.
ASK = -1


def cells(notes: DataFrame, *key: str, kept: bool = False) -> tuple[DataFrame, int]:
    """The ``notes(*key, note)``, from 0 to 100 or ``ASK``, in cells for :func:`noted`, and the number of cells.

    A cell is a byte that keys share by their hash: their note, or ``ASK`` if they
    differ. There are 16 MB of cells at most; with very many keys more must be asked.
    """
    n = min(MOST_CELLS, max(1, CELLS_A_KEY * notes.count()))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        least, most = np.full(CELLS_A_ROW, 127, np.int8), np.full(CELLS_A_ROW, -128, np.int8)
        np.minimum.at(least, pdf["_in"].to_numpy(), pdf["note"].to_numpy())
        np.maximum.at(most, pdf["_in"].to_numpy(), pdf["note"].to_numpy())
        told = np.where(least == most, least, np.where(least > most, 0, ASK)).astype(np.int8)
        return pd.DataFrame({"_row": pdf["_row"].iloc[:1], "_cells": [told]})

    dealt = notes.select(*_cell(n, *key), F.col("note").cast("tinyint").alias("note"))
    return staged(dealt.groupBy("_row").applyInPandas(fill, "_row bigint, _cells array<tinyint>"), "cells", kept), n


def _cell(n: int, *key: str) -> list[Column]:
    """Row and place of a key's cell."""
    cell = F.pmod(F.xxhash64(*key, F.lit(29)), F.lit(n))
    return [F.shiftright(cell, CELLS_A_ROW.bit_length() - 1).alias("_row"), cell.bitwiseAND(CELLS_A_ROW - 1).cast("int").alias("_in")]


def noted(rows: DataFrame, told: tuple[DataFrame, int], *key: str) -> DataFrame:
    """Add ``note`` to ``rows`` without moving them: that of the row's key, or ``ASK`` if its cell can't tell.

    A key that isn't among the notes has 0 or ``ASK``, provided that they hold nothing else.
    """
    table, n = told
    found = rows.select("*", *_cell(n, *key)).join(F.broadcast(table), "_row", "left")
    return found.withColumn("note", F.coalesce(F.get("_cells", "_in"), F.lit(0))).select(*[F.col(f"`{c}`") for c in rows.columns], "note")


def maybe_in(rows: DataFrame, wanted: DataFrame, *key: str, kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose key may be in ``wanted``, with all those whose key is, and the others; none moves."""
    found = noted(rows, cells(wanted.select(*key, F.lit(ASK).alias("note")), *key, kept=kept), *key)
    return found.where(F.col("note") == ASK).drop("note"), found.where(F.col("note") != ASK).drop("note")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(batches, rows: int = 256):
    """The batches in parts of few rows, where what a part becomes is large."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]
