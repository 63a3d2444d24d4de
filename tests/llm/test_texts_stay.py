"""Steps that choose or cut texts move only those that they must, and are exact where cells can't tell."""

import collections
import random

import pytest

from geoloom.llm import common, mixing, simhash, substrings

STEPS = {"near_duplicates": simhash.drop_near_duplicates, "substrings": substrings.remove_repeats, "mixing": mixing.take}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Long texts; a few are repeated as a row, as a text or nearly, or share a passage."""
    rng = random.Random(5)
    word = lambda: rng.randbytes(200).hex()
    texts = [" ".join(word() for _ in range(50)) for _ in range(300)]
    passage = " ".join(word() for _ in range(40))
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[7]] * 3 + [(400 + i, t, "s0") for i, t in enumerate([texts[9], texts[11] + " more", f"a {passage}", f"b {passage}", "", None])]
    path = str(tmp_path_factory.mktemp("texts") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    found = context.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


@pytest.mark.parametrize("step", STEPS)
def test_few_texts_are_shuffled(spark, docs, no_broadcasts, monkeypatch, step):
    size = sum(len(r["text"] or "") for r in docs.collect())
    before = shuffled(spark)
    rows = STEPS[step](docs).collect()
    assert shuffled(spark) - before < 0.4 * size
    monkeypatch.setattr(common, "MOST_CELLS", 2)  # nearly no cell can tell
    assert collections.Counter(STEPS[step](docs).collect()) == collections.Counter(rows)
