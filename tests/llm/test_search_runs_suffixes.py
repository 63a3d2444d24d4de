"""Ranked search, periodic runs and suffix dedup against plain versions, and the odd cases of each."""

import collections
import hashlib
import math
import random
import re
import threading
import zlib

import duckdb
import numpy as np
import pytest

from geoloom.llm import common, html_consensus, mixing, periodic_runs, ranked_search, simhash, substrings, suffix_array, suffix_dedup


def plain_runs(w, least=12):
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                best.setdefault((i, j + p), p)
            i = j
    return sorted(((a, b - a, p) for (a, b), p in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("stretch", [1, 7, 1 << 16])
def test_runs_against_a_plain_version(monkeypatch, stretch):
    monkeypatch.setattr(periodic_runs, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(300):
        n, letters = rng.randint(0, 110), rng.choice([1, 2, 2, 3, 5, 20])
        w = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 5, 12])
        assert [tuple(r) for r in periodic_runs.find_runs(w, least).tolist()] == plain_runs(w, least)


def test_runs_of_texts_that_repeat_a_lot():
    assert periodic_runs.find_runs([b"a"] * 100_000).tolist() == [[0, 100_000, 1]]
    turns = [0]
    while len(turns) < 2000:
        turns += [1 - x for x in turns]
    words = [b"%d" % x for x in turns]
    assert [tuple(r) for r in periodic_runs.find_runs(words[:600]).tolist()] == plain_runs(words[:600])
    assert len(periodic_runs.find_runs([b"%d" % (i % 5000) for i in range(10_003)])) == 1


def test_a_wrong_seed_is_noticed(monkeypatch):
    good = periodic_runs._join
    calls = []

    def bad(left, right):
        calls.append(1)
        return good(left, right) if len(calls) > 40 else np.zeros(len(left), np.uint64)

    monkeypatch.setattr(periodic_runs, "_join", bad)
    words = [b"%d" % (i * i % 17) for i in range(60)]
    assert [tuple(r) for r in periodic_runs.find_runs(words).tolist()] == plain_runs(words)


def test_op12_against_a_plain_version(spark, tmp_path):
    rng = random.Random(12)
    texts = [None, "", " \t\n", "a " * 30, "x y " * 4, " ".join(rng.choice("ab") for _ in range(200)), "é ü " * 20]
    texts += [" ".join(rng.choice(["river", "stone", "light"]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(5, texts[5], "k", 1), (None, texts[3], "k", 2), (2**60 + 1, texts[4], None, 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()))
    want = collections.Counter()
    for doc_id, text, _, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
        n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for a, k, p in runs for i in range(a + p, a + k)}
        best = (None,) * 4
        if runs:
            a, k, p = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            best = (a, k, p, 1000 * k // p)
        listed = "".join(f"{a},{k},{p}\n" for a, k, p in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_collapse_keeps_columns_and_texts_without_runs(spark):
    docs = spark.createDataFrame([(1, "a b " * 10, "r"), (2, "no  runs", "s"), (3, None, "t")], "doc_id int, text string, runs string")
    assert sorted(map(tuple, periodic_runs.collapse(docs).collect())) == [(1, "a b", "r"), (2, "no  runs", "s"), (3, None, "t")]
    assert periodic_runs.collapse(docs.where("false")).collect() == []
    runs = {r["doc_id"]: r["found"] for r in periodic_runs.with_runs(docs, name="found").collect()}
    assert [tuple(x) for x in runs[1]] == [(0, 20, 2)] and runs[2] == runs[3] == []


def plain_ranks(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(d, term.findall((t or "").translate(lower))) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n_docs, n_all = len(held), sum(len(w) for _, w in held)
    df = collections.Counter(t for _, w in held for t in set(w))
    out = collections.Counter()
    for item_id, text in items:
        scored = []
        for d, w in held:
            tf, m = collections.Counter(w), 10 + 90 * len(w) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(term.findall((text or "").translate(lower))) if tf[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        for rank, (s, no, d) in enumerate(sorted(scored)[:k], 1):
            out[item_id, rank, None if no else d, -s] += 1
    return out


@pytest.mark.parametrize("documents, ranges", [(4096, 256), (5, 2), (1, 1)])
def test_search_against_a_plain_version(spark, tmp_path, monkeypatch, documents, ranges):
    monkeypatch.setattr(ranked_search, "DOCUMENTS", documents)
    monkeypatch.setattr(ranked_search, "RANGES", ranges)
    monkeypatch.setattr(ranked_search, "ITEMS", 3)
    rng = random.Random(documents)
    word = lambda: rng.choice(["River", "stone", "éclair", "ÉCLAIR", "x1", "日本"]) + str(rng.randrange(12))
    texts = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(70)]
    texts += [None, "", "... --", "stone3 " * 3000] + [texts[0]] * 25  # ties beyond the tenth
    docs = list(enumerate(texts)) + [(None, texts[1]), (3, texts[3]), (2**60 + 1, texts[2])]
    rng.shuffle(docs)
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(8)] + [(8, None), (9, "unheard"), (9, texts[0]), (None, texts[2] + " " + texts[2])]
    spark.createDataFrame([(d, t, 1, "b") for d, t in docs], "doc_id bigint, text string, item int, term string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, score int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = ranked_search.op11_ranked_search(spark, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, got)) == plain_ranks(docs, items)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert collections.Counter(con.execute(ranked_search.ORACLES["op11_ranked_search"]).fetchall()) == collections.Counter(map(tuple, got))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked_search.rank(docs, items).collect() == []
    assert ranked_search.rank(items.withColumnRenamed("item_id", "doc_id"), items.where("false")).collect() == []


def test_treap_holds_its_grid():
    rng = np.random.default_rng(3)
    for height in (1, 3, 6):
        side = 1 << height
        cells = np.unique(rng.integers(0, side * side, rng.integers(1, side * side)))
        rows, columns, values = cells // side, cells % side, rng.integers(1, 1_000_000, len(cells))
        treap = ranked_search.Treap(*ranked_search.pack(rows, columns, values, height), height)
        grid = dict(zip(zip(rows.tolist(), columns.tolist()), values.tolist()))
        for r in range(side):
            held = ranked_search.Held(side)
            held.ids = [(0, c) for c in range(side)]
            treap.best(np.array([r]), np.array([1]), side, held, held.ids.__getitem__)
            assert sorted((c, -s) for s, (_, c) in held.rows) == sorted((c, v) for (q, c), v in grid.items() if q == r)


@pytest.mark.parametrize("bucket", [0, 16, 10**9])
def test_suffix_arrays_and_common_prefixes(monkeypatch, bucket):
    monkeypatch.setattr(suffix_array, "BUCKET", bucket)
    rng = random.Random(bucket)
    for _ in range(300):
        letters = rng.choice([1, 2, 3, 10, 200])
        t = bytes(rng.randint(1, letters) for _ in range(rng.randint(0, 70))) + b"\0"
        a = np.frombuffer(t, np.uint8)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_array.suffix_array(a).tolist() == want
        shared = suffix_array.common_prefixes(a, np.array(want))
        for x, y in zip(want, want[1:]):
            n = 0
            while t[x + n] == t[y + n]:
                n += 1
            assert shared[y] == n


def plain_removed(texts, width):
    seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [1 << 16, 600, 0])
def test_suffix_dedup_against_a_plain_version(spark, tmp_path, most):
    rng = random.Random(most)
    letters = lambda n, k=26: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é日"[:k]) for _ in range(n))
    passages = [letters(60), letters(45), letters(300, 29)]
    texts = [letters(rng.randint(0, 200), 29) + rng.choice(passages) + letters(rng.randint(0, 90), 29) for _ in range(60)]
    texts += [None, "", "a" * 500, "ab" * 300, "日本" * 90, passages[2], passages[2], letters(39), letters(40) * 2]
    rows = [(i, t, "k", [1]) for i, t in enumerate(texts)] + [(3, texts[3], "k", [2]), (None, texts[5], None, None), (2**60 + 1, letters(3000), "k", [])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, spans array<int>").repartition(3)
    marked = suffix_dedup.with_spans(docs, 40, 8, most).collect()
    data = [(r["row"]["text"] or "").encode() for r in marked]
    assert collections.Counter(data) == collections.Counter((r[1] or "").encode() for r in rows)
    for r, t, want in zip(marked, data, plain_removed(data, 40)):
        spans = r["spans"]
        got = suffix_dedup.removed(len(t), *([None, None] if spans is None else [spans["first"], spans["last"]]), 40)
        assert (got == want).all(), r["row"]["doc_id"]
    kept = suffix_dedup.remove_repeats(docs, 40, 8, most)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert (r["text"] is None) == (r["doc_id"] == 60) and "�" not in (r["text"] or "")
    assert suffix_dedup.remove_repeats(docs.where("false"), 40, 8).collect() == []


def test_op13_against_its_sql(spark, tmp_path):
    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefgh ü") for _ in range(260))
    texts = ["".join(rng.choice("abcdefgh ü") for _ in range(rng.randint(0, 900))) + rng.choice(["", passage]) for _ in range(40)] + [None, "", "z" * 1500, "é" * 150, passage, "word " * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(suffix_dedup.ORACLES["op13_suffix_dedup"]).fetchall()
    assert collections.Counter(map(tuple, suffix_dedup.op13_suffix_dedup(spark, str(tmp_path)).collect())) == collections.Counter(want)
    gone = plain_removed([(t or "").encode() for _, t in rows], 200)
    assert sorted(r[2] for r in want) == sorted(int(g.sum()) for g in gone)


def test_mixed_rows_keep_their_own_columns(spark):
    rows = [(1, "one two three", "a", lang, {"k": lang}) for lang in ("en", "de", "fr", "es")] + [(2, "four five", "b", None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string, more map<string, string>")
    drawn = mixing.mix(docs.drop("more"))
    words = sum(r["taken"] for r in drawn.collect() if r["source"] == "a") if "source" in drawn.columns else None
    taken = mixing.take(docs).collect()
    full = collections.Counter(r["lang"] for r in taken if r["source"] == "a")
    assert set(full) == {"en", "de", "fr", "es"} or sum(full.values()) < 4
    assert all(r["more"] == ({"k": r["lang"]} if r["lang"] else None) for r in taken)
    assert words is None or sum(len(r["text"].split()) for r in taken if r["source"] == "a") == words


def test_copies_of_a_row_are_dealt_in_stretches(spark, monkeypatch):
    rows = [(1, "w w", "a")] * 40 + [(i, "w w", "b") for i in range(2, 20)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    key = lambda rs: collections.Counter((r["doc_id"], r["text"]) for r in rs)
    want = key(mixing.take(docs).collect())
    monkeypatch.setattr(mixing, "MANY", 7)
    assert key(mixing.take(docs).collect()) == want


def test_queries_in_threads_keep_their_tables(spark, tmp_path):
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(40)}" for _ in range(50))
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(60)) + " " + passage) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    failed, sizes = [], {}

    def run(name, f):
        try:
            sizes[name] = len(f(docs).collect())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(n, f)) for n, f in (("a", substrings.remove_repeats), ("b", simhash.drop_near_duplicates), ("c", suffix_dedup.remove_repeats))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sizes["a"] == sizes["c"] == 40


def test_finished_leaves_one_table(spark):
    inside = []

    def result():
        inside.append(common.staged(spark.range(5).toDF("x"), "inner"))
        return inside[0].where("x > 1")

    out = common.finished(result, "outer")
    assert out.count() == 3
    with pytest.raises(Exception, match="not exist|NOT_FOUND"):
        spark.read.parquet(inside[0].staged_at).count()


MAIN = "Main story about the river and the old bridge that was built by hand. " * 3
SECOND = "Second paragraph of the same story goes on for a while about the bridge. " * 2


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<div class="content"><div class="related-story"><p>{MAIN}</p></div><p>{SECOND}</p></div>', MAIN + SECOND),
        (f'<article><p>{MAIN}</p><p class="note social-history">{SECOND}</p></article>', MAIN + SECOND),
        (f'<article><p>{MAIN}</p><div class="discussion-paper"><p>{SECOND}</p></div></article>', MAIN + SECOND),
        (f'<article><p>{MAIN}</p><div class="related-story"><a href="/x">{SECOND}</a></div></article>', MAIN),
        (f'<article><p>{MAIN}</p><div class="site-footer links">{SECOND}</div></article>', MAIN),
        (f'<article><p>{MAIN}</p><div class="comment-list">{SECOND}</div></article>', MAIN),
    ],
)
def test_one_word_of_a_name_does_not_decide(html, want):
    assert html_consensus.extract(html, None) == " ".join(want.split())


def test_texts_that_a_host_repeats_are_left_out_of_marked_blocks(spark):
    box = "Join our readers and get the weekly letter with all of the news in it."
    page = lambda i: f'<article><p>{MAIN} {i}</p><div class="reader-signup"><p>{box}</p></div><div class="social-history"><p>{SECOND}{i}</p></div></article>'
    rows = [(i, f"https://h.org/{i}", page(i)) for i in range(5)] + [(9, "https://other.org/1", page(9))]
    got = {r["page_id"]: r["text"] for r in html_consensus.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(5):
        assert box not in got[i] and f"{SECOND}{i}" in got[i]
    assert box in got[9]  # one page alone tells nothing


def test_votes_against_a_plain_count(spark):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        host, wrap = rng.choice([("a.org", "main-1"), ("b.org", "story")]), rng.choice(["div", "section"])
        rows.append((i, f"https://{host[0]}/{i}", f'<div class="{host[1]}"><{wrap} class="t{i % 3}"><p>{MAIN}</p></{wrap}></div><p>{SECOND if i % 4 else ""}</p>'))
    votes = collections.Counter()
    for _, url, html in rows:
        for path, depth, score in html_consensus.Page(html).votes():
            votes[url.split("/")[2], path, depth] += round(score * 1e6)
    want = {}
    for (h, path, depth), score in votes.items():
        want[h] = max(want.get(h, (0, 0, "")), (score, depth, path))
    got = {r["host"]: r["path"] for r in html_consensus.host_paths(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {h: w[2] for h, w in want.items()}
