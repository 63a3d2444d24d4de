"""Language identification by a byte convolutional network.

A network of filters of several widths is trained in numpy on a bounded sample
of labelled texts and applied to windows that cover every text; a text's
scores are the length-weighted means of its windows' log probabilities.

The sample: of each language the texts whose hashed doc_id falls below a
threshold at which ``SAMPLE`` texts are expected (fewer where there are so many
languages that they would be over ``TEXTS`` together, but ``FEW`` at least), one
text a doc_id, and ``WINDOWS`` windows of each, at hashed places. Every language
that has a text is learned. Prediction sees the text only.

Defined results for odd input: null texts and texts without a letter are
``und`` with score 0; where no labelled text exists every text is ``und``. A
null doc_id counts as held out. Repeated rows are kept, ties go to the first
language by code point, columns other than doc_id, text and lang are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN, text_groups, windows_of
from .common import staged, table

#: Bounds of the training sample: expected texts a language, windows a text, texts in all, and the fewest texts a language.
SAMPLE, WINDOWS, TEXTS, FEW = 500, 6, 50_000, 10
LENGTH, STRIDE = 192, 188


def unit_hash(key, seed: int):
    """Uniform in [0, 1) from a column's hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def sampled(docs: DataFrame, label: str, per_label: int, seed: int = 5) -> DataFrame:
    """A bounded, reproducible sample of ``docs(doc_id, text, label)``: one text for each doc_id that is drawn."""
    counts = staged(docs.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "labels")
    each = max(FEW, min(per_label, TEXTS // max(1, counts.count())))
    rates = counts.select(label, (F.lit(float(each)) / F.col("_n")).alias("_rate"))
    drawn = docs.join(rates, label).where(unit_hash("doc_id", seed) < F.col("_rate"))
    return drawn.groupBy("doc_id", label).agg(F.min("text").alias("text"))


def cut_windows(sample: DataFrame, label: str, windows: int, length: int, stride: int, seed: int = 5) -> pd.DataFrame:
    """``label`` and ``window`` (bytes) of up to ``windows`` windows of each text of a bounded sample."""

    def cut(batches):
        for batch in batches:
            names, parts = [], []
            for doc_id, text, name in zip(batch["doc_id"], batch["text"], batch[label]):
                w = windows_of((text or "").encode("utf-8", "surrogatepass"), length, stride)
                rng = np.random.default_rng([seed, int(doc_id) & (2**63 - 1)])
                for k in np.sort(rng.permutation(len(w))[:windows]):
                    names.append(name)
                    parts.append(w[k].tobytes())
            yield pd.DataFrame({label: names, "window": parts})

    kind = sample.schema[label].dataType.simpleString()
    found = sample.select("doc_id", "text", label).mapInPandas(cut, f"{label} {kind}, window binary").toPandas()
    return found.sort_values([label, "window"], ignore_index=True)


def as_windows(parts: pd.Series, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, length)


def train(labelled: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], ByteCNN | None]:
    """Languages and network from ``labelled(doc_id, text, lang)``."""
    usable = labelled.where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    found = cut_windows(sampled(usable.select("doc_id", "text", "lang"), "lang", per_language), "lang", WINDOWS, LENGTH, STRIDE)
    names = sorted(set(found["lang"]))
    if not names:
        return [], None
    classes = found["lang"].map({k: i for i, k in enumerate(names)}).to_numpy()
    share = 1 / np.bincount(classes, minlength=len(names))
    net = ByteCNN(len(names), LENGTH).fit(as_windows(found["window"], LENGTH), classes, share[classes] * len(classes) / len(names), epochs=max(4, min(40, 60_000 // max(1, len(found)))))
    return names, net


def predict(docs: DataFrame, names: list[str], net: ByteCNN | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs`` (or replace them); only the column ``text`` is looked at."""

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def classify(texts: pd.Series) -> pd.DataFrame:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        total = np.zeros((len(raw), len(names)))
        for windows, owner in text_groups(raw, LENGTH, STRIDE):
            z = net.logits(windows).astype(float)
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            filled = (windows > 0).sum(1)
            np.add.at(total, owner, z * filled[:, None])
        total /= np.array([max(1, len(t)) for t in raw])[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return pd.DataFrame({"lang_pred": [names[k] for k in best], "score": p[np.arange(len(p)), best]})

    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    if net is None:
        return rows.select("row.*", nothing["lang_pred"].alias("lang_pred"), nothing["score"].alias("score"))
    spoken = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = rows.withColumn("found", classify("text")).withColumn("found", F.when(spoken, F.col("found")).otherwise(nothing))
    return found.select("row.*", "found.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    names, net = train(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), names, net).drop("text")


QUERIES = {"op5_language_id": op5_language_id}
