"""The registered queries on small written tables: columns, types, held-out rules, and ids that a float would change."""

import collections
import hashlib
import random
import zlib

import pytest

from geoloom.llm import bpe, registry, simhash, substrings

BIG = 2**60
COLUMNS = {
    "op1": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2": "doc_id bigint, fingerprint string, component_id bigint",
    "op3": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4": "page_id bigint, url string, text string, n_chars bigint",
    "op5": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op12": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op10": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
}


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "window", "garden", "letter", "market"]) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Ids beyond 2**53 side by side, beside rows without one; columns named like the operators' own."""
    rng = random.Random(71)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(5, 90)) for _ in range(60)] + [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(3)] + [None, "", "under the MIT license " * 3, "x" * 60_000, prose(rng, 9000)]
    rows = [(BIG + i, t, "en", ["a", "b", None][i % 3], len(t or ""), int(i % 2), 0.5, "k") for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, "a", 3, 1, 0.5, "k"), (None, None, None, None, 0, 1, 0.5, "k"), rows[5], rows[5]]
    path = str(tmp_path_factory.mktemp("tables"))
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, score double, found string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(BIG + i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (BIG, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(BIG + i, t) for i, t in enumerate(texts[:5])] + [(None, texts[6]), (BIG, None), (BIG, "")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(BIG + i, f"https://h/{i}" if i else None, f"<article><p>{t}</p></article>" if t else t) for i, t in enumerate(texts)] + [(None, "x", "<p>y")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path, rows, pages


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name.split("_")[0]: (q(spark, tables[0]).dtypes, q(spark, tables[0]).collect()) for name, q in registry.queries().items() if name != "pipeline"}


@pytest.mark.parametrize("op", list(COLUMNS))
def test_columns_and_ids(results, tables, op):
    kinds, rows = results[op]
    want = [tuple(c.split()) for c in COLUMNS[op].split(", ")]
    assert kinds[: len(want)] == want
    if op == "op11":  # items, and those documents that rank
        assert len(rows) == len({(r[0], r["rank"]) for r in rows})
        return
    ids = collections.Counter(r[0] for r in rows)
    assert ids == collections.Counter(r[0] for r in tables[2 if op == "op4" else 1])


def test_rules_of_the_queries(results, tables):
    texts = collections.defaultdict(set)
    for r in tables[1]:
        texts[r[0]].add(r[1] or "")
    crc = lambda d: zlib.crc32(str(d).encode())
    for r in results["op5"][1]:
        assert r["held_out"] == (r["doc_id"] is None or crc(r["doc_id"]) % 5 == 0)
        assert r["lang_pred"] in ("en", "und") and (r["lang_pred"] == "und") <= (r["score"] == 0)
    for r in results["op7"][1]:
        assert r["held_out"] == (r["doc_id"] is None or crc(r["doc_id"]) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.5)
    for r in results["op3"][1]:
        assert r["n_bytes"] in {len(t.encode()) for t in texts[r["doc_id"]]} and r["payload_bytes"] % 192 == 0
    v = bpe.vocabulary(bpe.default_path())
    for r in results["op9"][1]:
        assert r["ids_sha256"] in {hashlib.sha256(" ".join(map(str, v.encode(t))).encode()).hexdigest() for t in texts[r["doc_id"]]}
    for r in results["op2"][1]:
        assert r["component_id"] >= BIG


def test_every_op_is_registered_once():
    names = [n for n in registry.queries() if n != "pipeline"]
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14))


def test_substrings_against_their_sql(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables[0]}/documents.parquet/*.parquet'")
    want = con.execute(substrings.ORACLES["op10_substrings"]).fetchall()
    got = [tuple(r) for r in substrings.op10_substrings(spark, tables[0]).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_near_duplicates_beside_rows_without_an_id(spark):
    rng = random.Random(73)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(BIG + 1, a), (BIG + 2, b), (None, c), (BIG + 3, a + " more")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == set(map(tuple, rows[:3]))
