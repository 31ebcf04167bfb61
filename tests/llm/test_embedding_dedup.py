import math

import numpy as np
import pytest
from contigua.llm import embedding_dedup, flat_graph

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, node int, n_links string"


def table(seed, n=600, dim=24, ball=60):
    """Random vectors with near copies of some, one dense ball, exact and scaled copies, and the awkward rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n // 5, 2):
        x[i + 1] = x[i] + rng.normal(size=dim) * rng.uniform(0.02, 0.25)
    x[n // 2 : n // 2 + ball] = x[0] + rng.normal(size=(ball, dim)) * 0.1
    x[n - 20 : n - 10] = x[n - 21]
    x[n - 10] = x[n - 22] * 1e18
    rows = [(int(i), [float(c) for c in np.float32(v)], int(i % 2 if i < n // 5 - 60 else 0), None, 1, "x") for i, v in enumerate(x)]
    odd = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * dim, 0), (9004, [math.nan] * dim, 0), (9005, [math.inf] + [1.0] * (dim - 1), 0), (9006, rows[0][1], None), (9007, rows[0][1][:-1], 0), (None, rows[7][1], rows[7][2]),
           (None, None, 0), (5, rows[5][1], rows[5][2]), (5, rows[n - 1][1], 0), (9008, [None, *rows[0][1][1:]], 0), (9009, [1.0, 0.0], 0), (9010, [3.0, 0.1], 0)]
    return rows + [(*r, "d", None, None) for r in odd]


def brute(rows, least=0.98):
    units = []
    for r in rows:
        v = None
        if r[1] and r[2] is not None and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1]):
            v = np.array(r[1], np.float64) / max(abs(c) for c in r[1])
            v = v / np.linalg.norm(v)
        units.append(v)
    near = {i: [j for j, w in enumerate(units) if j != i and w is not None and rows[i][2] == rows[j][2] and len(w) == len(v) and v @ w >= least] if v is not None else [] for i, v in enumerate(units)}
    out, comp = [], {}
    for i in near:
        if i not in comp:
            seen, todo = {i}, [i]
            while todo:
                todo += [k for k in near[todo.pop()] if k not in seen and not seen.add(k)]
            low = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
            comp |= dict.fromkeys(seen, low)
        out.append((rows[i][0], len(near[i]), comp[i], rows[i][0] == comp[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("limit", "overlap"), [(4000, 2), (150, 2)])
def test_against_brute_force(spark, limit, overlap):
    rows = table(limit)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), limit=limit, overlap=overlap)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    have, want = sorted(map(tuple, got.collect()), key=str), brute(rows)
    assert len(have) == len(want)
    if limit == 4000:
        assert have == want
    else:  # shards lose links: few
        missed = sum(w[1] for w in want) - sum(h[1] for h in have)
        assert 0 <= missed <= 0.05 * sum(w[1] for w in want)


def test_shards_hold_every_node_and_are_bounded(spark):
    rng = np.random.default_rng(0)
    data = [(i, "a:8", rng.normal(size=8).astype("<f8").tobytes()) for i in range(900)] + [(2000 + i, "b:8", rng.normal(size=8).astype("<f8").tobytes()) for i in range(40)]
    nodes = embedding_dedup.materialize(spark.createDataFrame(data, "node long, grp string, vec binary"), "nodes")
    got = embedding_dedup.shards(nodes, 2, 200).collect()
    homes = [r.node for r in got if r.home]
    assert sorted(homes) == sorted(d[0] for d in data)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert max(sizes.values()) <= 200 and len(sizes) > 4
    # equal directions that no centroid tells apart are cut by number in the end
    same = [(i, "a:2", np.array([1.0, 1e-12 * i], "<f8").tobytes()) for i in range(300)]
    flat = embedding_dedup.shards(embedding_dedup.materialize(spark.createDataFrame(same, "node long, grp string, vec binary"), "nodes"), 2, 100, rounds=1).collect()
    assert {r.node for r in flat} == set(range(300)) and any("#" in r.shard for r in flat)


def test_recall_is_of_all_links(spark):
    rows = [r for r in table(3, 300) if r[0] is not None and r[0] < 300]
    df = spark.createDataFrame(rows, SCHEMA)
    all_rows = embedding_dedup._rows(df, "vec_id", "embedding", "label").selectExpr("_id as node", "digest", "grp", "vec")
    nodes = embedding_dedup.materialize(all_rows, "nodes")
    links, found = embedding_dedup.audited_links(nodes)
    assert found >= 0.99
    half = embedding_dedup.materialize(links.filter("a % 2 = 0"), "half")
    share = embedding_dedup.recall(nodes, half, 0.98, queries=300)
    assert abs(share - half.count() / links.count()) < 0.02
    assert embedding_dedup.recall(nodes, links.limit(0), 0.98, queries=300) == 0.0


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    none = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None, 1, None, None, None)] * 2, SCHEMA)).collect()
    assert [tuple(r) for r in none] == [(1, 0, 1, True)] * 2


def test_graph_finds_isolated_pairs_and_a_ball_wider_than_the_beam():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 48))
    x[::30] = x[1::30] + 0.1 * rng.normal(size=(50, 48))
    x[700:900] = x[699] + 0.08 * rng.normal(size=(200, 48))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    adj = flat_graph.build(x, degree=24, beam=48)
    assert adj.shape == (1500, 24) and all(len(set(a[a >= 0])) == (a >= 0).sum() and i not in a for i, a in enumerate(adj))
    found = {(int(a), int(b)) for q, v in flat_graph.range_search(x, adj, 0.98, beam=48) for a, b in zip(q, v)}
    found |= {(b, a) for a, b in found}
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.98)) if a != b}
    assert len(found & true) >= 0.99 * len(true) and all(x[a] @ x[b] >= 0.9799 for a, b in found)


def test_prune_keeps_the_nearest_and_passes_over_what_it_covers():
    x = np.array([[1, 0], [0.99, 0.1], [0.98, 0.11], [0, 1], [-1, 0]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = flat_graph.robust_prune(x, np.array([0]), np.array([[0, 1, 2, 3, 4, -1, 2]]), 3, 1.2)
    assert out.tolist() == [[1, 3, -1]] or out.tolist() == [[1, 3, 4]]


def test_a_dense_shard_is_pruned_once_and_keeps_its_links(monkeypatch):
    import numpy as np

    from contigua.llm import flat_graph

    monkeypatch.setattr(flat_graph, "beam_search", None)  # searches a vector at a time took most of the time
    rng = np.random.default_rng(2)
    c = rng.normal(size=(6, 32))
    x = np.concatenate([c[rng.integers(0, 6, 240)] + 0.1 * rng.normal(size=(240, 32)), rng.normal(size=(160, 32))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    adj = flat_graph.build(x, degree=16)
    got = {(int(a), int(b)) for q, v in flat_graph.range_search(x, adj, 0.97) for a, b in zip(q, v, strict=True)}
    true = set(zip(*[i.tolist() for i in np.nonzero((x @ x.T >= 0.97) & ~np.eye(len(x), dtype=bool))], strict=True))
    assert (adj >= 0).sum(1).max() <= 16 and len(got & true) >= 0.99 * len(true) > 0
