import random

import pytest
import xxhash
from contigua.llm import simhash
from pyspark.sql import functions as F
from texts import rows


def brute_fp(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, d):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= d:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_against_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    fps = {(-1 if r[0] is None else r[0], r[1]): brute_fp(r[1]) for r in rows()}
    comp = brute_components(set(fps.values()), 2)
    low = {}
    for (i, _), f in fps.items():
        if i >= 0:
            low[comp[f]] = min(low.get(comp[f], i), i)
    want = sorted((-1 if r[0] is None else r[0], f"{brute_fp(r[1]):016x}", low[comp[brute_fp(r[1])]]) for r in rows())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("limit", [3, 64])
@pytest.mark.parametrize("d", [0, 1, 2])
def test_links_have_the_closure_of_all_links(spark, limit, d):
    rng = random.Random(limit + d)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.choice([0, 1, 5, 31, 32, 33, 62, 63, rng.randrange(64)])
            fps.add(x)
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    edges = simhash.links(df, d, limit)
    assert all((r.a ^ r.b & (1 << 64) - 1).bit_count() <= 64 for r in edges.collect())
    assert edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > d).isEmpty()
    got = {}
    labels = {r.node: r.label for r in simhash.connect(edges).collect()}
    comp = brute_components(fps, d)
    for f in fps:
        s = f - (f >> 63 << 64)
        got.setdefault(labels.get(s, s), set()).add(f)
    want = {}
    for f, r in comp.items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty_and_kept(docs, none):
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.filter("doc_id is not null").collect())
    assert ids == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})


def test_kept_rows_of_one_id_and_clashing_names(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, "x", 1), (5, b, "x", 2), (5, a, "x", 3), (7, a, "x", 4), (None, a, "x", 5), (8, None, "x", 6), (9, "", "x", 7), (8, None, "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, label long").repartition(3)
    kept = sorted(tuple(-1 if v is None else v for v in r) for r in simhash.keep_one(docs).collect())
    assert kept == [(-1, a, "x", 5), (5, a, "x", 1), (5, b, "x", 2), (8, -1, "x", 6)]


def test_one_large_component_and_hot_keys(spark, monkeypatch):
    from contigua import runtime
    from contigua.operators.graph import connect

    monkeypatch.setattr(runtime, "HOT_ROWS", 1000)
    n = 100_000
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    tail = spark.range(n, n + 64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = connect(star.unionByName(tail))
    assert {(r.label, r["count"]) for r in labels.groupBy("label").count().collect()} == {(0, n), (n, 65)}
    docs = spark.createDataFrame([(i, "one two three four" if i % 3 else f"w{i} x{i} y{i} z{i}") for i in range(3000)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 3000 and {got[i] for i in range(3000) if i % 3} == {1}
