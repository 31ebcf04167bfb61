import random

import pytest
from contigua.operators import bubbles, graph
from pyspark.sql import functions as F

rng = random.Random(11)
TURN = str.maketrans("ACGT", "TGCA")


def dna(n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def rc(s):
    return s.translate(TURN)[::-1]


def walk_graph(spark, paths, overlap=20):
    """A graph whose vertices are pieces along the given texts, equal pieces being one; pieces overlap by ``overlap`` bases."""
    ids, edges = {}, set()
    for text in paths:
        pieces = [text[i : i + 50] for i in range(0, len(text) - 50 + 1, 30)]
        nodes = [(ids.setdefault(p, len(ids)), 0) for p in pieces]
        for (a, p), (b, q) in zip(zip(nodes, pieces), list(zip(nodes, pieces))[1:]):
            edges.add((a[0], 0, b[0], 0, len(q) - overlap))
            edges.add((b[0], 1, a[0], 1, len(p) - overlap))
    v = spark.createDataFrame([(i, s) for s, i in ids.items()], "id long, seq string")
    return v, spark.createDataFrame(sorted(edges), "x long, xs int, y long, ys int, lab int"), ids


def changed(text, at, n=1):
    return text[:at] + "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] for c in text[at : at + n]) + text[at + n :]


@pytest.fixture(scope="module")
def text():
    return dna(50 + 30 * 13)


def test_chains_become_vertices(spark, text):
    v, e, _ = walk_graph(spark, [text, changed(text, 200)])
    v2, e2 = graph.compact(v, e)
    rows = v2.collect()
    assert len(rows) == 4 and sum(r.coverage for r in rows) == v.count()
    assert all(r.seq in text or r.seq in changed(text, 200) for r in rows)
    found = e2.collect()
    twins = {(r.x, r.xs, r.y, r.ys) for r in found}
    assert len(found) == 8 and all((y, 1 - ys, x, 1 - xs) in twins for x, xs, y, ys in twins)
    size = {r.id: len(r.seq) for r in rows}
    assert all(size[r.y] - r.lab == 20 for r in found)
    again = graph.compact(*graph.compact(v2, e2))
    assert again[0].count() == 4 and again[1].count() == 8


def test_a_ring_is_one_vertex_with_an_edge_to_itself(spark):
    ring = dna(300)
    v, e, _ = walk_graph(spark, [ring + ring[:20]])
    first, last = v.filter("id = 0").first().seq, v.agg(F.max("id")).first()[0]
    close = spark.createDataFrame([(last, 0, 0, 0, 30), (0, 1, last, 1, 30)], e.schema)
    v2, e2 = graph.compact(v, e.unionByName(close))
    assert v2.count() == 1 and {(r.x, r.xs, r.y, r.ys) for r in e2.collect()} <= {(r.x, s, r.y, s) for r in e2.collect() for s in (0, 1)}
    assert first


def test_walks_meet_and_the_better_covered_is_kept(spark, text):
    other = changed(text, 200)
    v, e, ids = walk_graph(spark, [text, other])
    w = bubbles.variant_strings(bubbles.variant_walks(e, 2000), v.withColumn("coverage", F.when(F.col("id") >= 14, 5).otherwise(1).cast("long"))).collect()
    assert {r.bubble for r in w} and len(w) == 4  # from both ends
    forward = {r["rank"]: r for r in w if r.seq in text or r.seq in other}
    assert forward[0].seq in other and forward[1].seq in text and forward[0].coverage > forward[1].coverage
    assert len(forward[0].region) == len(forward[1].region) and sum(a != b for a, b in zip(forward[0].region, forward[1].region)) == 1
    assert {r.seq for r in w if r not in forward.values()} == {rc(r.seq) for r in forward.values()}


def test_smoothing_removes_one_side_once(spark, text):
    v, e, _ = walk_graph(spark, [text, changed(text, 200)])
    v2, e2, variants = bubbles.smooth_round(v, e)
    assert v.count() - v2.count() == 1 and {r["rank"] for r in variants.collect()} == {0, 1} and variants.count() == 2
    v3, _ = graph.compact(v2, e2)
    assert [r.seq for r in v3.collect()][0] in {text, changed(text, 200), rc(text), rc(changed(text, 200))}
    again = bubbles.smooth_round(v2, e2)
    assert again[2].count() == 0 and again[0].count() == v2.count()


def test_what_differs_too_much_or_leaks_stays(spark, text):
    far = text[:150] + dna(100) + text[250:]
    v, e, _ = walk_graph(spark, [text, far])
    assert bubbles.smooth_round(v, e)[0].count() == v.count()
    assert bubbles.variant_walks(e, 2000).count() > 0
    # a third text leaves the bubble from one of its inner vertices
    side = changed(text, 200)
    leak = side[:230] + dna(90)
    v, e, _ = walk_graph(spark, [text, side, leak])
    assert bubbles.variant_walks(e, 2000).count() == 0


def test_bubbles_in_conflict_are_collapsed_one_a_round(spark, text):
    one, two = changed(text, 140), changed(text, 290)
    v, e, _ = walk_graph(spark, [text, one, two])
    v2, e2, variants = bubbles.smooth(v, e, rounds=3)
    assert graph.compact(v2, e2)[0].count() == 1
    assert variants.filter("rank > 0").count() == 2


def test_divergence_counts_columns(spark):
    pairs = spark.createDataFrame([("ACGTACGTAC", "ACGTACGTAC"), ("ACGTACGTACGGT", "ACGTAAGTACGGT"), ("", "ACG"), ("AAAACCCCGGGGTTTTAACC", "AAAACCCCGGTTTTAACC")], "a string, b string")
    got = bubbles.divergence(pairs).collect()
    assert [(round(r.differ, 4), round(r.gaps, 4), r.gap_bases) for r in got] == [(0.0, 0.0, 0), (round(1 / 13, 4), 0.0, 0), (1.0, 1.0, 0), (0.1, 0.1, 2)]


def test_assembly_trims_and_smooths(spark, text):
    long = dna(50 + 30 * 20)
    tip = long[:260] + dna(60)
    v, e, _ = walk_graph(spark, [long, changed(long, 400), tip])
    out, edges, variants = bubbles.assemble(v, e, trim_rounds=2, min_length=120, bubble_rounds=1)
    assert [r.seq for r in out.collect()][0] in {long, rc(long), changed(long, 400), rc(changed(long, 400))} and out.count() == 1
    assert edges.count() == 0 and variants.filter("rank > 0").count() == 1
