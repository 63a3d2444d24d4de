"""Quality classification by a byte-level convolutional network.

Overlapping chunks cover the whole document; the network's filters are
max-pooled over each chunk and give the chunk's score. A document's probability
combines its chunks' scores (their mean by length, their least and greatest)
and its length in a logistic model. Network and logistic model are trained in numpy on a bounded
sample: the ``SAMPLE`` labelled documents of each class with the least hashed
doc_id, one text a document, and ``CHUNKS`` chunks of each at hashed places for
the network.

Defined results for odd input: a null text counts as empty; an empty text is
scored like any other (one chunk of padding). Where the training rows lack one
of the classes every score is the training share of class 1 (0.5 where there
are none). Labels whose document is missing, and null labels, are skipped; a
document with several labels counts with each. A null doc_id counts as held
out. Repeated rows are kept, columns other than doc_id and text are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN, text_groups
from .common import staged, table
from .language_id import as_windows, cut_windows, unit_hash

#: Bounds of the training sample: documents a class, chunks a document.
SAMPLE, CHUNKS = 3000, 6
LENGTH, STRIDE = 256, 224
FEATURES = ("mean", "least", "greatest", "short", "short_mean", "log_length")


@dataclass
class QualityModel:
    """A chunk network, and the weights of the document's combination."""

    net: ByteCNN | None
    weights: np.ndarray
    prior: float = 0.5

    def features(self, raw: list[bytes]) -> np.ndarray:
        """Length-weighted mean, least and greatest chunk score of each text, and how short it is."""
        total, size = np.zeros(len(raw)), np.zeros(len(raw))
        least, greatest = np.full(len(raw), np.inf), np.full(len(raw), -np.inf)
        for chunks, owner in text_groups(raw, LENGTH, STRIDE):
            z = self.net.logits(chunks).astype(float)
            score = np.clip(z[:, 1] - z[:, 0], -30, 30)
            filled = np.maximum((chunks > 0).sum(1), 1)
            np.add.at(total, owner, score * filled)
            np.add.at(size, owner, filled)
            np.minimum.at(least, owner, score)
            np.maximum.at(greatest, owner, score)
        mean = total / np.maximum(size, 1)
        n = np.array([len(t) for t in raw])
        short = 1 / (1 + n / 60)  # one chunk of few bytes tells little
        return np.column_stack([mean, least, greatest, short, short * mean, np.log1p(n) / 10])

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the first is the intercept) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def raw_texts(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> QualityModel:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, label)``; reads no other column."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    order = [unit_hash("doc_id", 7), "doc_id"]
    sample = known.where("label = 0").orderBy(*order).limit(per_class).unionAll(known.where("label = 1").orderBy(*order).limit(per_class))
    # the sample has 2 * per_class rows at most, so it can be broadcast; rows that repeat a doc_id count once
    found = docs.select("doc_id", "text").join(F.broadcast(sample.distinct()), "doc_id")
    chosen = staged(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
    found = cut_windows(chosen, "label", CHUNKS, LENGTH, STRIDE, seed=11)
    classes = found["label"].to_numpy(int)
    if len(set(classes)) < 2:
        return QualityModel(None, np.zeros(len(FEATURES) + 1), float(classes.mean()) if len(classes) else 0.5)
    share = 1 / np.bincount(classes, minlength=2)
    net = ByteCNN(2, LENGTH, seed=1).fit(as_windows(found["window"], LENGTH), classes, share[classes] * len(classes) / 2, epochs=max(4, min(40, 60_000 // len(found))), seed=1)
    model = QualityModel(net, np.zeros(len(FEATURES) + 1))

    def features(batches):
        for batch in batches:
            out = pd.DataFrame(model.features(raw_texts(batch["text"])), columns=list(FEATURES))
            out["label"] = batch["label"].to_numpy()
            yield out

    rows = chosen.select("text", "label").mapInPandas(features, ", ".join(f"{f} double" for f in FEATURES) + ", label int").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    model.weights = _logistic(rows[list(FEATURES)].to_numpy(), rows["label"].to_numpy(float))
    # the sample's share of class 1 is not that of all labels
    all_rows = known.agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).first()
    odds = [g / max(1, n - g) for g, n in ((all_rows["good"], all_rows["n"]), (rows["label"].sum(), len(rows)))]
    model.weights[0] += np.log(odds[0] / odds[1])
    return model


def with_score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """Add the probability of class 1; only the column ``text`` is looked at."""
    if model.net is None:
        return docs.withColumn(name, F.lit(model.prior))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(model.features(raw_texts(texts))))

    return docs.withColumn(name, score("text"))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that score 0.5 or more."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return with_score(rows, model).where("score >= 0.5").select("row.*")


def training_rows(df: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return df.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def fitted(spark: SparkSession, sf_dir: str) -> QualityModel:
    return train(training_rows(table(spark, sf_dir, "documents")), training_rows(table(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    scored = with_score(docs, fitted(spark, sf_dir)).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op7_quality": op7_quality}
