"""Every operator against a plain version, on odd input: nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import bpe, bytecnn, fingerprints, html_consensus, language_id, license_rules, license_scan, mixing, quality, simhash, substrings, transport_stream

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double, row int, spans int, size int, next int, node int, stay int"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "io", "kappa"]) + str(rng.randint(0, 40)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage = words(rng, 60)
    base = [words(rng, rng.randint(1, 200)) for _ in range(40)]
    texts = [None, "", " \t\n", "one", "a b", "a b", *base, base[3], base[3], base[4] + " tail", "x " + base[5]]
    texts += [f"{words(rng, 50)} {passage} {words(rng, 30)}" for _ in range(5)] + [passage, words(rng, 34), words(rng, 35), "w " * 100, words(rng, 9000)]
    texts += ["Ünï cödé ΣΑΣ 日本語 \x0b tab\x0csep", "released Under THE MIT license, yes. CC-BY-NC 4.0"]
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[8], None, "a", 3)]
    return [(*r, "k", 0.5, 1, 2, 3, 4, 5, 6) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return df.collect()


def split(text):
    return (text or "").encode().split()


def test_fingerprints(docs, empty):
    got = rows_of(fingerprints.fingerprint_edits(docs))
    order = sorted([(r[0], r[1] or "") for r in corpus()], key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1].encode())))
    want = collections.Counter()
    for i, (d, t) in enumerate(order):
        follow, half = order[(i + 1) % len(order)][1], len(t) // 2
        want[d, len(t), hashlib.sha256((t[: len(t) - half] + follow[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = collections.defaultdict(set)
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            by_text[texts[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())
    assert rows_of(fingerprints.fingerprint_edits(empty)) == []


def spark_hash(data, seed=42):
    """XXH64 as Spark gives it: signed."""
    import xxhash

    return (xxhash.xxh64_intdigest(data, seed % 2**64) + 2**63) % 2**64 - 2**63


def plain_sketch(text):
    """The sketch rule on a set of shingles, word by word."""
    h = [spark_hash(w) for w in (text or "").encode().split()]

    def chained(values):
        seed = 42
        for v in values:
            seed = spark_hash(v.to_bytes(8, "little", signed=True), seed)
        return seed

    every = sorted({chained(h[i : i + 5]) for i in range(len(h) - 4)} or ({chained(h)} if h else set()))
    return [x for i, x in enumerate(every) if i < 128 or x < -(2**63) + 2**61]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    reach = min(2**63 - 1 if len(s) < 128 else max(-(2**63) + 2**61 - 1, s[-1]) for s in (a, b))
    x, y = ({h for h in s if h <= reach} for s in (a, b))
    return len(x & y) / len(x | y) if x | y and x and y else 0.0


def test_sketches_and_likeness_against_plain_ones(docs, spark):
    rng = random.Random(23)
    long = words(rng, 4000)
    more = [(None, long), (900, long), (901, long + " " + words(rng, 500)), (902, " ".join(long.split()[:150])), (903, "a b c d e f g"), (904, "")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = [(r["doc_id"], r["text"] or "") for r in rows_of(df)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1].encode())))
    want = collections.Counter()
    for i, (d, t) in enumerate(order):
        follow, half = order[(i + 1) % len(order)][1], len(t) // 2
        s, e, n = plain_sketch(t), plain_sketch(t[: len(t) - half] + follow[:half]), plain_sketch(follow)
        text = lambda x: "".join(f"{h % 2**64:016x}" for h in x)
        want[d, text(s), text(e), round(plain_likeness(s, e), 9), round(plain_likeness(s, n), 9)] += 1
    got = rows_of(fingerprints.fingerprint_edits(df))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want


def test_merged_sketches_are_the_sketch_of_the_union(spark):
    rng = random.Random(29)
    sizes = [0, 1, 50, 128, 129, 700, 5000]
    sets = [[rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in sizes]
    rows = [(i, j, a, b + a[: len(a) // 3]) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, j int, a array<bigint>, b array<bigint>")
    whole = fingerprints.kept(F.concat("a", "b"))
    parts = fingerprints.merged(fingerprints.kept(F.col("a")), fingerprints.kept(F.col("b")))
    assert df.where(whole != parts).count() == 0 and df.where(F.size(whole) < F.least(F.lit(128), F.size(F.array_distinct(F.concat("a", "b"))))).count() == 0


def test_fingerprint_likeness_is_near_the_true_one(spark):
    rng = random.Random(1)
    a = words(rng, 3000).split()
    b = a[:2000] + words(rng, 1000).split()
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    within = len(shingles(a) & shingles(a[:300])) / len(shingles(a[:300]))
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[:300]))], "a string, b string, c string")
    s = {c: fingerprints.sketch(F.col(c)) for c in "abc"}
    near, _ = fingerprints.likeness(s["a"], s["b"])
    _, held = fingerprints.likeness(s["a"], s["c"])
    got = df.select(near.alias("near"), held.alias("held")).first()
    assert abs(got["near"] - true) < 0.08 and abs(got["held"] - within) < 0.1


def test_long_texts_of_few_shingles_keep_them_all(spark):
    rng = random.Random(17)
    texts = [f"w{i} " * 300 for i in range(4)] + [(words(rng, 9) + " ") * 40 for _ in range(4)] + [""]
    df = spark.createDataFrame([(i, j, texts[i], texts[j]) for i in range(9) for j in range(9)], "i int, j int, a string, b string")
    near, within = fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))
    size = F.size(fingerprints.sketch(F.col("a")))
    for r in rows_of(df.select("i", "j", near.alias("near"), within.alias("within"), size.alias("size"))):
        assert r["near"] == r["within"] == float(r["i"] == r["j"])
        w = texts[r["i"]].split()
        assert r["size"] == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})


def test_next_row_over_many_ranges(spark):
    ids = [7 * i % 1009 for i in range(1000)] + [5] * 900
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(5)
    got = rows_of(fingerprints.with_next(df, "doc_id", ["text"], "text"))
    order = sorted(ids)
    want = collections.Counter((a, f"t{b}") for a, b in zip(order, order[1:] + order[:1]))
    assert collections.Counter((r["doc_id"], r["next"]["text"]) for r in got) == want


def plain_fingerprint(text, width):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)) if h else 0


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(docs, empty):
    got = rows_of(simhash.near_groups(docs, width=4, radius=4))
    rows = corpus()
    fps = [plain_fingerprint(r[1], 4) for r in rows]
    part = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for r, p in zip(rows, part):
        if r[0] is not None:
            least[p] = min(least.get(p, r[0]), r[0])
    want = collections.Counter((r[0], f, least.get(p)) for r, f, p in zip(rows, fps, part))
    assert collections.Counter((r["doc_id"], r["fp"][0] & (2**64 - 1), r["component_id"]) for r in got) == want
    assert rows_of(simhash.near_groups(empty, 4, 4)) == []


def test_any_number_of_agreeing_pieces_finds_the_same_groups(spark):
    rng = random.Random(53)
    base = [words(rng, 40) for _ in range(12)]
    texts = base + [t + f" more{i}" for t in base for i in range(3)] + [" ".join(t.split()[1:]) for t in base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = [sorted((r["doc_id"], r["component_id"]) for r in rows_of(simhash.near_groups(df, 4, 4, agree=a))) for a in (1, 2, 3, 4)]
    assert groups[0] == groups[1] == groups[2] == groups[3]
    assert simhash.pieces_to_agree(10**6, 4) == 1 and simhash.pieces_to_agree(10**9, 4) == 2 and simhash.pieces_to_agree(5 * 10**10, 4) == 3


def test_groups_in_one_block_are_not_linked():
    fps = np.array([[1], [1], [3], [1 << 40], [3]], np.uint64)
    assert simhash.forest(fps, 1).tolist() == [0, 0, 0, 3, 0]
    assert simhash.forest(fps, 1, np.array([0, 0, 1, 1, 1])).tolist() == [0, 0, 2, 3, 2]


def test_bit_planes_find_every_link():
    rng = np.random.default_rng(1)
    for k, radius in ((1, 4), (1, 0), (2, 9), (4, 38)):
        base = rng.integers(0, 2**63, (3, k)).astype(np.uint64)
        noise = np.uint64(1) << rng.integers(0, 64, (300, k)).astype(np.uint64)
        fps = np.concatenate([base[rng.integers(0, 3, 300)] ^ noise, rng.integers(0, 2**63, (101, k)).astype(np.uint64)])
        got = {(i, j) for a, b in simhash.links(fps, radius) for i, j in zip(a.tolist(), b.tolist())}
        far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
        assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(far <= radius, 1)))}


def test_split_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    rng = random.Random(2)
    fps = list({sum(1 << rng.randrange(20) for _ in range(1)) | 1 << 40 | i % 7 << 50 for i in range(400)})
    df = spark.createDataFrame([(f, [f], 1) for f in fps], "node bigint, fp array<bigint>, key bigint")
    edges = rows_of(simhash.block_links(df, 2, block=8))
    at = {f: i for i, f in enumerate(fps)}
    got = components(len(fps), [(at[e["a"]], at[e["b"]]) for e in edges])
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert got == want


def test_connected_components_of_a_long_chain(spark):
    from geoloom.llm.components import connected_components

    ids = list(range(1, 120))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in rows_of(connected_components(edges))}
    assert got == {**{i: 1 for i in ids}, 500: 500, 501: 500}
    assert rows_of(connected_components(edges.where("a < 0"))) == []


def test_drop_near_duplicates(docs, empty, spark):
    rng = random.Random(4)
    far = [words(rng, 400) for _ in range(6)]
    near = [f"{t} one more" for t in far[:3]]
    rows = [(i, t) for i, t in enumerate(far + near)] + [(0, far[0]), (20, far[0])]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in rows_of(got)) == [0, 1, 2, 3, 4, 5]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in rows_of(kept)]
    assert len(ids) == len(set(ids)) and 3 in ids
    assert rows_of(simhash.drop_near_duplicates(empty)) == []


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_duplicates_have_exact_resemblance(spark):
    """Pairs just over and just under 0.8 in sizes from a few shingles to some hundred, and repeated sentences."""
    rng = random.Random(15)
    pairs = [("r0 r1 r2 r3 r4 r5 r6 r7", "r0 r1 r2 r3 r4 r5 r6 r7 r8")]
    for n in range(60):
        over = words(rng, 100 + 4 * n).split()
        m = len(over) - 4  # shingles; a new end takes m' of them and adds as many
        cut = m // 9  # (m - cut) / (m + cut) = 0.8 at m / 9
        for k in (cut, cut + 2):
            name = [f"p{n}k{k}x{i}" for i in range(len(over))]
            pairs.append((" ".join(name), " ".join(name[: len(name) - k] + [f"y{x}" for x in name[len(name) - k :]])))
    once = words(rng, 90)
    pairs.append((once + " " + words(rng, 30), once + " " + words(rng, 200)))
    rows = [(2 * i + side, t) for i, pair in enumerate(pairs) for side, t in enumerate(pair)]
    got = {r["doc_id"] for r in rows_of(simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))}
    assert got >= {2 * i for i in range(len(pairs))}
    like = [jaccard(*p) for p in pairs]
    assert [2 * i + 1 in got for i in range(len(pairs))] == [x < 0.8 for x in like]
    assert sum(0.8 <= x < 0.83 for x in like) > 40 and sum(0.75 < x < 0.8 for x in like) > 40


def test_near_duplicates_go_by_text_not_by_doc_id(spark):
    rng = random.Random(16)
    a, b, c, d, e, f = (words(rng, 60) for _ in range(6))
    rows = [(None, a), (None, b), (None, a + " more"), (7, c), (7, d), (8, d + " more"), (7, e), (3, e + " more"), (None, f), (9, f), (9, f), (None, None), (11, "")]
    got = rows_of(simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    ids = collections.Counter(r["doc_id"] for r in got)
    assert ids == {None: 2, 7: 2, 3: 1, 9: 1, 11: 1}
    texts = [r["text"] for r in got]
    assert sorted(t.removesuffix(" more") for t in texts) == sorted([a, b, c, d, e, f, ""])
    assert {r["text"] for r in got if r["doc_id"] == 7} == {c, d} and len({r["text"] for r in got if r["doc_id"] is None}) == 2


def test_exact_forest_is_that_of_the_exact_links(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.append(rng.choice(base, 52, replace=False), rng.integers(0, 2**63, k % 4).astype(np.uint64))) for k in range(150)]
    fps = np.stack([simhash.majority(s, 8) for s in sets])
    like = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets]
    for least in (0.7, 0.8, 0.83, 0.86):
        got = simhash.exact_forest(fps, sets, 512, least)
        assert got.tolist() == components(150, [(i, j) for i in range(150) for j in range(i) if like[i][j] >= least])


@pytest.mark.parametrize("n", [1, 169, 170, 171, 192, 3072, 3073, 3072 * 9 + 5])
def test_transport_stream_round_trip(n):
    payload = random.Random(n).randbytes(n)
    stream = transport_stream.mux(payload)
    found = transport_stream.demux(stream)
    assert b"".join(u[3] for u in found["units"]) == payload and len(stream) % 188 == 0
    assert transport_stream.describe(found).endswith("errors=0")
    assert [u[2] for u in found["units"]] == [k % 8 == 0 for k in range(len(found["units"]))]


def test_transport_stream_damage(docs, empty):
    stream = transport_stream.mux(random.Random(1).randbytes(5000))
    lost = transport_stream.demux(stream[: 188 * 5] + stream[188 * 6 :])
    assert lost["continuity_errors"] == 1
    table = bytearray(stream)
    table[20] ^= 1
    assert transport_stream.demux(bytes(table))["table_errors"] == 1
    assert transport_stream.demux(b"\x00" * 400)["sync_errors"] == 3 and transport_stream.demux(None)["units"] == []
    raw = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    units = transport_stream.access_units(transport_stream.transport_streams(raw, "doc_id", "raw"), "doc_id")
    back = collections.defaultdict(list)
    for r in rows_of(units.orderBy("unit")):
        back[r["doc_id"]].append(bytes(r["data"]))
    assert b"".join(back[10][: len(back[10]) // 3 or 1])[:20] == (corpus()[10][1] or "").encode()[:20]
    assert rows_of(transport_stream.transport_streams(empty.select("doc_id", F.col("text").cast("binary").alias("raw")), "doc_id", "raw")) == []


def packet(pid, counter, payload, starts=False, adapt=b""):
    body = (bytes([len(adapt)]) + adapt if adapt else b"") + payload
    return bytes([0x47]) + ((0x4000 if starts else 0) | pid).to_bytes(2, "big") + bytes([(0x30 if adapt else 0x10) | counter]) + body.ljust(184, b"\xff")


def test_tables_over_several_packets():
    streams = b"".join(bytes([6]) + (0xE000 | 0x200 + i).to_bytes(2, "big") + b"\xf0\x00" for i in range(90))
    pat = transport_stream._section(b"\x00\x01" + (0xE000 | 0x100).to_bytes(2, "big"), 0, 1)
    pmt = transport_stream._section((0xE101).to_bytes(2, "big") + b"\xf0\x00" + streams, 2, 1)
    assert len(pmt) > 184 * 2
    parts = [pmt[:183], pmt[183:367], pmt[367:]]
    out = packet(0, 0, b"\x00" + pat, True) + packet(0x100, 0, b"\x00" + parts[0], True) + packet(0x100, 1, parts[1]) + packet(0x100, 2, parts[2])
    found = transport_stream.demux(out)
    assert found["programs"] == {1: 0x100} and sorted(found["streams"]) == [0x200 + i for i in range(90)] and found["table_errors"] == 0
    # the rest of a section may stand before the pointer of the next one
    k = 183 - len(parts[2])
    second = packet(0x100, 2, bytes([len(parts[2])]) + parts[2] + pmt[:k], True)
    found = transport_stream.demux(out[: 188 * 3] + second + packet(0x100, 3, pmt[k : k + 184]) + packet(0x100, 4, pmt[k + 184 : k + 368]) + packet(0x100, 5, pmt[k + 368 :]))
    assert len(found["streams"]) == 90 and found["table_errors"] == 0
    cut = transport_stream.demux(out[: 188 * 2] + packet(0x100, 1, b"\x00" + pat, True))
    assert cut["table_errors"] == 1


def test_repeats_and_announced_jumps_are_no_errors():
    stream = transport_stream.mux(random.Random(2).randbytes(5000))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    once = transport_stream.demux(b"".join(packets[:5] + packets[4:]))
    assert once["continuity_errors"] == 0 and [u[3] for u in once["units"]] == [u[3] for u in transport_stream.demux(stream)["units"]]
    assert transport_stream.demux(b"".join(packets[:5] + [packets[4]] + packets[4:]))["continuity_errors"] == 1
    told = transport_stream.demux(packet(0x101, 3, b"a", adapt=b"\x00") + packet(0x101, 9, b"b", adapt=b"\x80"))
    assert told["continuity_errors"] == 0 and transport_stream.demux(packet(0x101, 3, b"a") + packet(0x101, 9, b"b"))["continuity_errors"] == 1


def test_feature_against_plain_counting():
    for n in (192, 30000, 99840):
        stream = transport_stream.mux(random.Random(n).randbytes(n))
        feature = dict(x.split("=") for x in transport_stream.describe(transport_stream.demux(stream)).split(";"))
        packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
        es = [p for p in packets if (p[1] & 0x1F) << 8 | p[2] == 0x101]
        heads = [p for p in es if p[1] & 0x40]
        stamps = []
        for p in heads:
            at = 4 + (1 + p[4] if p[3] & 0x20 else 0) + 9
            x = int.from_bytes(p[at : at + 5], "big")
            stamps.append((x >> 33 & 7) << 30 | (x >> 17 & 0x7FFF) << 15 | x >> 1 & 0x7FFF)
        entries = [t for p, t in zip(heads, stamps) if p[3] & 0x20 and p[5] & 0x40]
        want = {"programs": "1", "streams": "257:6", "packets": str(len(packets)), "units": str(len(heads)), "random_access": ",".join(map(str, entries)), "first_pts": str(stamps[0]), "last_pts": str(stamps[-1]), "errors": "0"}
        assert feature == want


def test_transport_stream_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", "x" * 192, "é" * 5000, "tail"])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in rows_of(transport_stream.op3_transport_stream(spark, str(tmp_path))):
        raw = (rows[r["doc_id"]][1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><div id="menu"><a href="/">Home</a></div>
<div class="cookie-notice">We use cookies</div><main><div class="post-{n} content"><h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp;text<p>Second<br>line
<form><input value="a>b">Send</form><script>if (a < b) document.write("<p>no</p>")</script></div><aside>Side</aside></main>
<section class="comments"><p>I disagree with all of this, at length, and more than once, to be sure of being heard.</p></section><footer>Foot</footer></body></html>"""


def test_html_consensus(spark):
    empty_article = "<html><body><div class='other'><p>Only this long enough text stands here.</p></div></body></html>"
    rows = [(n, f"https://h.example/{n}", PAGE.format(n=n)) for n in range(4)]
    rows += [(10, "https://h.example/x", empty_article), (11, None, None), (12, "nonsense", ""), (13, "http://u:p@H.example:80/", "plain words"), (13, "http://u:p@H.example:80/", "plain words")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit(2))
    got = collections.defaultdict(list)
    for r in rows_of(html_consensus.main_text(df)):
        got[r["page_id"]].append(r["text"])
    for n in range(4):
        assert got[n] == ["Head & line First bold text Second line"]
    assert got[10] == ["Only this long enough text stands here."]
    assert got[11] == [""] and got[12] == [""] and got[13] == ["plain words"] * 2
    assert rows_of(html_consensus.main_text(df.where("page_id < 0"))) == []


def test_html_consensus_keeps_the_whole_article(spark):
    body = "Many words of the story stand in this long paragraph. " * 60
    nested = "<html><body><nav>Home</nav><article><h1>The heading</h1><div class='body'><p>{}</p></div></article></body></html>"
    other = "<html><body><article><div class='body'><p>A small box.</p></div></article><div class='story'><p>{}</p></div></body></html>"
    rows = [(n, "https://h.example/a", nested.format(body)) for n in range(5)]
    got = [r["text"] for r in rows_of(html_consensus.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")))]
    assert got == ["The heading " + body.strip()] * 5
    assert body.strip() in html_consensus.extract(other.format(body), ">html>body>article>div.body")


def test_pages_that_are_damaged_or_very_deep():
    import time

    began = time.perf_counter()
    for html in ("<a " * 350_000, '<div class="x">' * 50_000, "<b>" * 50_000 + "<p>x" * 20_000, "<a \"> '" * 100_000, "<ul>" + "<div>" * 30_000 + "<li>" * 30_000, "<!--" * 50_000):
        html_consensus.extract(html, None)
    assert time.perf_counter() - began < 30
    assert html_consensus.extract("<p>x &lt<i>;b</i> a &am<b>p;</b>", None) == "x <;b a &amp;"
    assert html_consensus.extract('<p>The <span class="social">share</span> price <b hidden>no</b>.', None) == "The share price ."
    assert html_consensus.extract('<div class="side"><p>Only text here</p></div>', None) == "Only text here"
    wrapped = '<div class="header"><h1>Site</h1></div><div class="has-sidebar"><article><h1>T</h1><p>{}</p></article><div class="sidebar">x</div></div><section class="comments"><article>{}</article></section>'
    assert html_consensus.extract(wrapped.format("Text of the article, long enough.", "no " * 60), None) == "T Text of the article, long enough."
    assert html_consensus.extract("a < b <3 &amp; <x", None) == "a < b <3 & <x"


def test_generated_pages(spark):
    """Random articles in three templates among menus, adverts, forms, scripts and comments."""
    rng = random.Random(59)
    frames = [
        '<html><body><nav>{m}</nav><main><article><h1>{h}</h1><div class="body-{n}">{b}</div></article><aside>{m}</aside></main><section class="comments">{c}</section><footer>{m}</footer></body></html>',
        '<body><div id="header"><a href="/">{m}</a></div><div class="layout no-sidebar"><div class="story s{n}"><h2>{h}</h2>{b}</div></div><div class="ad-box">{m}</div><form><p>{m}</p></form></body>',
        '<div class="wrap"><ul class="menu"><li>{m}<li>{m}</ul><div class="post" id="p{n}">{h}<script>var x = "<p>{m}</p>"</script>{b}</div><div class="cookie-notice">{m}</div></div>',
    ]
    rows, want = [], {}
    for n in range(60):
        host = n % 3
        head, blocks = words(rng, 5), [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
        body = "".join(rng.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote> {}\n</blockquote>")).format(b.replace(" ", "  ", 1).replace("io", "&#105;o", 1)) for b in blocks)
        html = frames[host].format(m=words(rng, 6), h=head, b=body, c="".join(f"<p>{words(rng, 40)}</p>" for _ in range(rng.randint(0, 9))), n=n)
        rows.append((n, f"https://h{host}.example/{n}", html))
        want[n] = " ".join([head, *blocks])
    got = {r["page_id"]: r["text"] for r in rows_of(html_consensus.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)))}
    assert got == want


def plain_logits(net, window):
    """The network's scores of one window, filter by filter."""
    x = net.embedding[window]
    kernel = net.kernel.reshape(net.reach, x.shape[1], -1)
    pooled = np.array([max(sum(float(x[i + k] @ kernel[k, :, f]) for k in range(net.reach)) for i in range(len(x) - net.reach + 1)) for f in range(kernel.shape[2])])
    return np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias


def test_scores_of_texts_against_a_plain_loop(spark):
    rng = random.Random(61)
    texts = ["a", words(rng, 10), words(rng, 120), "é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    net = bytecnn.ByteCNN(3, language_id.LENGTH, embed=3, filters=2, seed=4)
    got = {r["doc_id"]: r for r in rows_of(language_id.predict(df, ["de", "en", "fr"], net))}
    for i, t in enumerate(texts):
        total = np.zeros(3)
        for w in bytecnn.windows_of(t.encode(), language_id.LENGTH, language_id.STRIDE):
            z = plain_logits(net, w)
            total += (z - np.log(np.exp(z).sum())) * (w > 0).sum()
        p = np.exp(total / len(t.encode()))
        p /= p.sum()
        assert got[i]["lang_pred"] == ["de", "en", "fr"][int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-4
    model = quality.QualityModel(bytecnn.ByteCNN(2, quality.LENGTH, embed=3, filters=2, seed=5), np.array([0.1, 0.5, -0.2, 0.3, 1.0, -1.0, 0.7]))
    got = {r["doc_id"]: r["score"] for r in rows_of(quality.with_score(df, model))}
    for i, t in enumerate(texts):
        n, chunks = len(t.encode()), bytecnn.windows_of(t.encode(), quality.LENGTH, quality.STRIDE)
        score = [float(np.clip(np.diff(plain_logits(model.net, w))[0], -30, 30)) for w in chunks]
        filled = [(w > 0).sum() for w in chunks]
        mean, short = np.dot(score, filled) / sum(filled), 1 / (1 + n / 60)
        x = np.dot([1, mean, min(score), max(score), short, short * mean, np.log1p(n) / 10], model.weights)
        assert abs(got[i] - 1 / (1 + np.exp(-x))) < 1e-4


def labelled(spark, n=240):
    rng = random.Random(8)
    en, de = "the of and that with then there".split(), "der die und nicht über schön für".split()
    rows = []
    for i in range(n):
        lang, vocabulary = ("en", en) if i % 2 else ("de", de)
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 120))), lang, int(i % 3 > 0), 1.5, "clash"))
    rows += [(1000, None, "en", 1, 0.0, ""), (1001, "123 !!", "de", 0, 0.0, ""), (1002, "the and of", None, None, 0.0, ""), (None, "der und", "de", 1, 0.0, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int, score double, found string")


def test_language_id(spark):
    docs = labelled(spark)
    names, net = language_id.train(docs.where("doc_id % 5 > 0"))
    got = {r["doc_id"]: r for r in rows_of(language_id.predict(docs, names, net))}
    assert names == ["de", "en"]
    held = [r for d, r in got.items() if d is not None and d < 1000 and d % 5 == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1001]["score"] == 0 and got[1002]["lang_pred"] == "en"
    none, net = language_id.train(docs.where("lang is null"))
    assert {r["lang_pred"] for r in rows_of(language_id.predict(docs, none, net))} == {"und"}
    assert rows_of(language_id.predict(docs.where("doc_id < 0"), names, language_id.train(docs)[1])) == []


def test_windows_cover_the_text():
    rng = random.Random(3)
    for n in (0, 1, 9, 10, 11, 25, 1000):
        text = bytes(rng.randrange(1, 256) for _ in range(n))
        w = bytecnn.windows_of(text, 10, 7)
        joined = b"".join(bytes(x[:7]) for x in w[:-1]) + bytes(w[-1])
        assert joined[:n] == text and not any(joined[n:])
    texts = [b"", b"a" * 100, b"b" * 5]
    found = list(bytecnn.text_groups(texts, 10, 7, most=4))
    assert sum(len(w) for w, _ in found) == 1 + 14 + 1 and all(len(w) <= 8 for w, _ in found)


def test_gradients():
    rng = np.random.default_rng(0)
    net = bytecnn.ByteCNN(3, 12, embed=3, filters=2, seed=1)
    for name in ("embedding", "kernel", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    w, c, weight = rng.integers(1, 50, (4, 12)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones(4)

    def loss():
        columns = net._columns(w)
        y = (np.ascontiguousarray(columns).reshape(-1, columns.shape[2]) @ net.kernel).reshape(4, columns.shape[1], -1).max(1) + net.bias
        z = np.maximum(y, 0) @ net.out + net.out_bias
        return -np.mean(z[np.arange(4), c] - np.log(np.exp(z).sum(1)))

    g = net._gradients(w, c, weight)
    for name in ("kernel", "bias", "out", "out_bias", "embedding"):
        array = getattr(net, name)
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in array.shape)
            if name == "embedding":
                at = (int(w[0, 3]), at[1])
            if name == "kernel" and not net.mask[at]:
                continue
            old = array[at]
            array[at] = old + 1e-6
            up = loss()
            array[at] = old - 1e-6
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-5


def test_quality(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(200):
        good = i % 3 > 0
        text = words(rng, rng.randint(5, 150))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "x", 1.0, 2))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (900, None, None, 1.0, 2), (900, None, None, 1.0, 2)], "doc_id bigint, text string, label string, score double, row int")
    marks = spark.createDataFrame([*labels, (5000, 1, 0), (900, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(quality.training_rows(docs), quality.training_rows(marks))
    got = {r["doc_id"]: r["score"] for r in rows_of(quality.with_score(docs, model))}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(200)) and 0 <= got[900] <= 1
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows_of(kept)} >= {i for i in range(200) if i % 3}
    one_class = quality.train(docs, marks.where("quality = 1"))
    assert {r["score"] for r in rows_of(quality.with_score(docs, one_class))} == {1.0}
    assert quality.train(docs.where("false"), marks).prior == 0.5


def test_license_scan(docs, empty, spark):
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows_of(license_scan.scan(docs)))
    import re

    want = collections.Counter()
    for r in corpus():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        at = [(i, label) for phrase, label in license_rules.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        want[r[0], len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
    assert got == want
    assert rows_of(license_scan.scan(empty)) == []
    s = license_scan.scanner()
    assert len({pattern.pattern for _, _, pattern in s.rules}) == len(s.rules) > 200
    cases = {
        "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2",
        "under the MIT license and under the MIT license": "mit",
        "SPDX-License-Identifier: GPL-3.0": "gpl-3",
        "released under the terms of the Mozilla Public License 2.0 license": "mpl-2",
        "cc by nc": "cc-by-nc",
        "CC BY-NC-SA 4.0 License": "cc-by-nc,cc-by-nc-sa",
        "mit dem Zug": "",
        "licensed under the Apache License": "apache",
        "is this ruby license ok": "",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2-or-later",
        "GNU General Public License, version 2, June 1991": "gpl-2",
    }
    for text, labels in cases.items():
        assert s.scan(text)[5] == labels, text
    assert s.scan("under the MIT license and under the MIT license")[1:4] == (2, 0, 5)
    found = rows_of(license_scan.detections(docs.where("text like '%MIT%'")))
    assert {r["label"] for r in found} >= {"mit", "cc-by-nc"}


def test_suppression_against_all_pairs():
    rng = random.Random(31)
    for _ in range(300):
        found = [(rng.randint(0, 9), rng.randint(1, 6), rng.choice("abc"), rng.choice((30, 50, 60))) for _ in range(rng.randint(0, 9))]
        kept = []
        for f in dict.fromkeys(found):
            def over(g):
                inside = g[0] <= f[0] and g[0] + g[1] >= f[0] + f[1]
                if g[:2] == f[:2]:
                    return (g[3], -found.index(g)) > (f[3], -found.index(f))
                return inside and g[3] >= f[3]

            # whatever is over f stays itself, or has one over it that is over f too
            if not any(over(g) for g in found):
                kept.append(f)
        assert sorted(license_scan.suppress(found)) == sorted(kept)


def sample(tree, rng):
    """A text that a parsed pattern matches (looks ahead left aside)."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "IN":
            kind, x = rng.choice(value)
            out += chr(x) if str(kind) == "LITERAL" else chr(rng.randint(*x)) if str(kind) == "RANGE" else "7" if "DIGIT" in str(x) else "w"
        elif op == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        elif op == "SUBPATTERN":
            out += sample(value[3], rng)
        elif op == "MAX_REPEAT":
            out += "".join(sample(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], 3))))
        else:
            assert op == "ASSERT_NOT"
    return out


def test_every_rule_passes_its_own_keyword_gate():
    import re._parser as parser

    rng, s = random.Random(37), license_scan.scanner()
    for k, (label, priority, pattern, keywords) in enumerate(license_rules.rules()):
        for _ in range(15):
            text = sample(parser.parse(pattern), rng).split()
            assert keywords & set(text), pattern
        assert all(k in s.by_word[w] for w in keywords)


def test_targets_by_water_filling(spark):
    sizes = {"a": 10, "b": 500, "c": 1, "d": 100, None: 50, "e": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in rows_of(mixing.source_targets(df))}
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: 1 + i % 3 for i, k in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while True:  # the excess is shared again until none is above
        left = total - sum(target.values())
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        capped = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not capped:
            target |= share
            break
        target |= {k: 3 * sizes[k] for k in capped}
        open_ -= capped
    assert all(abs(got[k] - target[k]) < 1e-9 for k in names)


def test_mix(docs, empty, spark):
    got = rows_of(mixing.mix(docs))
    again = rows_of(mixing.mix(docs.repartition(7)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    rows = mixing.take(docs)
    assert rows.columns == docs.columns
    words_ = collections.Counter()
    for r in rows_of(rows):
        words_[r["source"]] += len(split(r["text"]))
    assert words_ == +taken
    assert rows_of(mixing.mix(empty)) == [] and rows_of(mixing.take(empty)) == []


def test_a_hot_document_is_spread_and_mixed(spark):
    rng = random.Random(67)
    rows = [(None, "hot words here", "a")] * 3000 + [(5, "a b c d", "b")] * 500 + [(2**60 + 1, "x y", "b"), (2**60 + 2, "x y", None)] + [(i, words(rng, rng.randint(1, 50)), "abc"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got, again = (rows_of(mixing.mix(d)) for d in (df.repartition(3), df.repartition(8)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    words_ = collections.Counter()
    for r in rows_of(mixing.take(df)):
        words_[r["source"]] += len(split(r["text"]))
    assert words_ == +taken


def test_pivot_keeps_mass_and_probabilities():
    rng = np.random.default_rng(4)
    p, w = rng.random(101), rng.integers(1, 50, 101).astype(float)
    hits = np.zeros(101)
    for k in range(400):
        q, left = mixing.pivot(p, w, np.random.default_rng(k))
        assert abs((q * w).sum() - (p * w).sum()) < 1e-6
        assert sum((q > 0) & (q < 1)) == (left >= 0)
        hits += q
    assert np.abs(hits / 400 - p).max() < 0.12


def test_bpe_matches_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz'’  \n\t.,!?0123ÀÉßÇñΣς中文한😀ǅİﬁ²Ⅷ́\x85\xa0​ <|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["hello<|endoftext|>world <|startoftext|> x's don't WE'LL", "</w>", "a</w>b", *[r[1] or "" for r in corpus()]]
    tokens = [t.replace("</w>", "") for t in own.ids]
    texts += [" ".join("".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))) for _ in range(20)) for _ in range(100)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    want = collections.Counter()
    for r in corpus():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows_of(bpe.digests(docs, path)))) == want
    both = rows_of(bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path))
    assert all(r["decoded"] == own.decode(r["ids"]) for r in both)
    assert rows_of(bpe.encoded(empty, path)) == []


def test_bpe_ids_leave_a_batch_in_parts(spark):
    """A task holds the ids of some texts, not those of all of its batch."""
    import pyarrow as pa

    path = bpe.default_path()
    own = bpe.vocabulary(path)
    rng = random.Random(43)
    long = " ".join(rng.choice(["river", "stone", "window"]) for _ in range(bpe.HELD // 4))
    texts = [long, None, *[long] * 8, "", "a b"]
    parts = list(bpe._parts(pa.array(texts), path))
    assert len(parts) == 3 and all(sum(map(len, ids[:-1])) < bpe.HELD for _, ids in parts)
    assert [list(i) for _, ids in parts for i in ids] == [own.encode(t) for t in texts]
    assert [len(rows) for rows, _ in bpe._parts(pa.array(["", None] * 1500, pa.string()), path)] == [1024, 1024, 952]
    assert list(bpe._parts(pa.array([], pa.string()), path)) == []
    rows = [(i, None if i % 7 == 0 else " ".join(rng.choice(["river", "Stones", "<|endoftext|>", "中"]) for _ in range(i % 5))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = {i: own.encode(t) for i, t in rows}
    digests = {r["doc_id"]: tuple(r) for r in bpe.digests(docs, path).collect()}
    got = bpe.encoded(docs, path).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and all(tuple(r)[:4] == digests[r["doc_id"]] for r in got)
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs, path).collect()} == want


def test_long_words_merge_as_the_library_does():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path())
    library.no_truncation()
    rng = random.Random(41)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 49), ("ab", 300), ("theandi", 3000), ("a", 2000), ("etaoinshrdlu", 20000), ("日本語é", 500)):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids
    for _ in range(200):
        start = own.start(own.symbols("".join(rng.choice("thesanio") for _ in range(rng.randint(2, 60)))))
        long, bpe_short = own._merge_long(list(start)), bpe.SHORT
        try:
            bpe.SHORT = 10**9
            assert own.merge(list(start)) == long
        finally:
            bpe.SHORT = bpe_short


def plain_removal(texts, window):
    count = collections.Counter()
    for w in texts:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] += 1
    out = []
    for w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize(("window", "anchor"), [(35, 6), (8, 3), (6, 6)])
def test_substrings(docs, empty, window, anchor):
    rows = corpus()
    kept = plain_removal([split(r[1]) for r in rows], window)
    want = collections.Counter((r[0], (r[1] if len(k) == len(split(r[1])) else b" ".join(k).decode())) for r, k in zip(rows, kept))
    got = substrings.remove_repeats(docs, window, anchor)
    assert got.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows_of(got)) == want
    assert rows_of(substrings.remove_repeats(empty, window, anchor)) == []


def test_substrings_of_a_thousand_equal_rows(spark):
    rng = random.Random(43)
    hot, passage = words(rng, 90), words(rng, 70)
    rows = [(7, hot)] * 1000 + [(None, hot)] * 200 + [(2**60 + 1 + i, f"{words(rng, 40)} {passage} {words(rng, 40)}") for i in range(40)] + [(2**60, words(rng, 100))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = collections.Counter((r["doc_id"], r["text"]) for r in rows_of(substrings.remove_repeats(df)))
    kept = plain_removal([split(t) for _, t in rows], 35)
    assert got == collections.Counter((d, t if len(k) == len(split(t)) else b" ".join(k).decode()) for (d, t), k in zip(rows, kept))


def test_a_passage_is_one_run_and_false_runs_are_found(spark):
    rng = random.Random(47)
    passage = words(rng, 400)
    rows = [(i, i, f"{words(rng, 50)} {passage} {words(rng, 50)}") for i in range(6)]
    df = spark.createDataFrame(rows, "key bigint, sub int, text string")
    spans = [list(zip(*[r["spans"][c] for c in substrings.SPAN])) for r in rows_of(substrings.repeated_spans(df))]
    assert len(spans) == 6
    for row in spans:
        runs = [s for s in row if s[1]]
        assert len(runs) == 1 and runs[0][1] > 300  # all but the paths that begin or end outside of the passage
    assert len({s[3] for row in spans for s in row if s[1]}) == 1
    found = [(1, [(5, b"x"), (6, b"y")]), (2, [(5, b"x")]), (3, [(6, b"z")]), (4, None)]
    marked = spark.createDataFrame(found, "row int, found array<struct<name: bigint, digest: binary>>")
    assert [r["name"] for r in rows_of(substrings.differing(marked))] == [6]


def test_lines_that_a_text_repeats_are_loops(spark):
    rng = random.Random(79)
    line, other = words(rng, 3), words(rng, 45)
    texts = [f"{words(rng, 20)} {' '.join([line] * k)} {words(rng, 20)}" for k in (1, 9, 12, 13, 40, 41, 300)] + [" ".join([other] * 3), other, " ".join([line] * 60), words(rng, 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = plain_removal([split(t) for t in texts], 35)
    got = {r["doc_id"]: split(r["text"]) for r in rows_of(substrings.remove_repeats(df))}
    assert [got[i] for i in range(len(texts))] == kept
    m, c, start, n = substrings.paths(substrings.word_hashes(split(texts[6]), substrings._Words(11)), 35, 6)
    assert len(m) > 250 and len(substrings.looped(m, c, start, n)[0]) < 30


def test_substrings_with_few_words(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = plain_removal([split(t) for t in texts], 10)
    got = {r["doc_id"]: split(r["text"]) for r in rows_of(substrings.remove_repeats(df, 10, 4))}
    assert [got[i] for i in range(60)] == kept
