"""The pipeline's stages on a small planted corpus."""

import collections
import random

import corpus_pipeline
import pytest

from geoloom.llm import bpe
from geoloom.llm.common import staged

VOCABULARY = ["river", "stone", "window", "garden", "letter", "market", "bridge", "summer", "winter", "paper"]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean, junk, copied, nearly copied documents and a shared passage."""
    rng = random.Random(12)
    passage = prose(rng, 60)
    clean = [prose(rng, rng.randint(80, 200)) for _ in range(120)]
    junk = [prose(rng, rng.randint(40, 150)).upper().replace(" ", "!! ") for _ in range(60)]
    texts = clean + junk + [clean[0], clean[0], clean[1] + " again"] + [f"{prose(rng, 90)} {passage} {prose(rng, 90)}" for _ in range(4)] + [None, ""]
    rows = [(i, t, "en", f"s{i % 3}" if i % 10 else None, len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(180)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, passage


def test_stages(spark, tables):
    path, rows, passage = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, path), name)
        if name != "bpe":
            assert out.columns == columns
        seen[name] = out.collect()
        docs = out
    good = {r["doc_id"] for r in seen["quality"]}
    assert good >= {*range(120), *range(180, 187)} and not good & set(range(120, 180))
    unique = {r["doc_id"] for r in seen["near_duplicates"]}
    assert unique >= set(range(120)) and not unique & {180, 181, 182} and unique >= {183, 184, 185, 186}
    assert all(passage not in (r["text"] or "") for r in seen["substrings"])
    assert {r["doc_id"] for r in seen["substrings"]} == unique
    texts = {r["doc_id"]: r["text"] for r in seen["substrings"]}
    assert all(texts[i] == rows[i][1] for i in range(120))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in seen["substrings"]:
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in seen["mixing"]:
        taken[r["source"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"])
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)
    v = bpe.vocabulary(bpe.default_path())
    want = collections.Counter((r["doc_id"], tuple(v.encode(r["text"]))) for r in seen["mixing"])
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in seen["bpe"]) == want


def test_run_gives_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert "ids" in out.columns and out.count() > 100
