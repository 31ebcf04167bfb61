import itertools
import random

import pytest
from contigua.operators import layout, scaffold

LINKS = "x long, xs int, y long, ys int, dist double, sd double, n_pairs long"


def links_of(spark, rows):
    """Links (oriented contig, oriented contig, distance) with twins."""
    return scaffold.twins(spark.createDataFrame([(p // 2, p % 2, q // 2, q % 2, float(d), 10.0, 5) for p, q, d in rows], LINKS))


def contigs_of(spark, lengths):
    return spark.createDataFrame(sorted(lengths.items()), "id long, len long")


def both(rows):
    best = {}
    for p, q, d in rows:
        for a, b in ((p, q), (q ^ 1, p ^ 1)):
            best[a, b] = min(d, best.get((a, b), d))
    return best


def all_walks(arcs, lengths):
    """Walks by brute force: (start, end) -> (gaps, -bases, contigs) of the best one."""
    nxt = {}
    for (a, b), d in arcs.items():
        nxt.setdefault(a, []).append((b, d))
    heads = {a for a, _ in arcs} - {b for _, b in arcs}
    out = {}

    def walk(path, gaps):
        if path[-1] not in nxt:
            key = (gaps, -sum(lengths[v // 2] for v in path))
            out.setdefault((path[0], path[-1]), []).append((*key, list(path)))
        for b, d in nxt.get(path[-1], []):
            walk([*path, b], gaps + d)

    for h in heads:
        walk([h], 0)
    return {k: min(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [3])
def test_layout_is_the_walk_of_most_bases(spark, seed):
    rng = random.Random(seed)
    lengths, rows = {}, []
    for block in range(6):
        ids = [block * 10 + i for i in range(7)]
        lengths.update({i: rng.randrange(100, 10_000) for i in ids})
        turned = {i: rng.randrange(2) for i in ids}
        rows += [(a * 2 + turned[a], b * 2 + turned[b], rng.randrange(-50, 500)) for a, b in itertools.combinations(ids, 2) if rng.random() < 0.45]
    found = {(r.x * 2 + r.xs, r.y * 2 + r.ys) for r in layout.layout_links(contigs_of(spark, lengths), links_of(spark, rows)).collect()}
    comp = {i: i for i in lengths}
    for p, q, _ in rows:
        a, b = comp[p // 2], comp[q // 2]
        comp = {k: min(a, b) if v in (a, b) else v for k, v in comp.items()}
    best = {}
    for (s, _), (_, neg, path) in all_walks(both(rows), lengths).items():
        best[comp[s // 2]] = min(best.get(comp[s // 2], (1, [])), (neg, path), key=lambda x: x[0])
    # the walk and its twin have equal bases; where two walks tie in bases any of them is right
    assert sum(len(p) - 1 for _, p in best.values()) * 2 == len(found)
    for _, path in best.values():
        assert all((a, b) in found and (b ^ 1, a ^ 1) in found for a, b in zip(path, path[1:]))


def test_long_chains_and_empty_tables(spark):
    n = 20
    rows = [(2 * i, 2 * i + 2, 10) for i in range(n - 1)]
    got = scaffold.chains(contigs_of(spark, {i: 100 for i in range(n)}), layout.layout_links(contigs_of(spark, {i: 100 for i in range(n)}), links_of(spark, rows))).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.ord)] == list(range(n)) and len({r.scaffold for r in got}) == 1
    empty = layout.layout_links(contigs_of(spark, {1: 5, 2: 5}), links_of(spark, rows).limit(0))
    assert empty.count() == 0


def cyclic(arcs):
    left = dict(arcs)
    while True:
        ins, outs = {b for _, b in left}, {a for a, _ in left}
        new = {k: d for k, d in left.items() if k[0] in ins and k[1] in outs}
        if len(new) == len(left):
            return bool(left)
        left = new


@pytest.mark.parametrize("seed", [4])
def test_cycles_are_opened(spark, seed):
    rng = random.Random(seed)
    rows = [(2 * i, 2 * i + 2, 10) for i in range(0, 30) if i % 10 != 9] + [(2 * 16, 2 * 12, 5), (2 * 8, 2 * 1, 5), (2 * 5, 2 * 4 + 1, 7)]
    rows += [(2 * rng.randrange(30) + rng.randrange(2), 2 * rng.randrange(30) + rng.randrange(2), 3) for _ in range(4)]
    rows += [(80, 82, 1), (82, 84, 1), (84, 80, 1)]  # a ring without an end
    lengths = {i: 100 for i in [*range(30), 40, 41, 42]}
    assert cyclic(both(rows))
    left, gone = layout.open_cycles(contigs_of(spark, lengths), links_of(spark, rows))
    kept = {(r.x * 2 + r.xs, r.y * 2 + r.ys): 1 for r in left.collect()}
    ids = {r.id for r in gone.collect()}
    assert ids and not cyclic(kept)
    assert set(kept) == {(a, b) for a, b in both(rows) if a // 2 not in ids and b // 2 not in ids}
    assert ids & {40, 41, 42}
    none, nothing = layout.open_cycles(contigs_of(spark, {0: 1, 1: 1}), links_of(spark, [(0, 2, 1)]))
    assert none.count() == 2 and nothing.count() == 0


def test_rings_go_in_strict_mode(spark):
    rows = [(0, 2, 1), (2, 4, 1), (0, 4, 9), (4, 6, 1), (6, 8, 1)]
    left = layout.without_rings(links_of(spark, rows)).collect()
    assert {(r.x, r.y) for r in left} == {(3, 4), (4, 3)}


def test_build_orders_contigs_and_leaves_repeats_out(spark):
    lengths = {i: 1000 for i in range(8)}
    at = {i: 1100 * i for i in range(8)}
    est = [(i, 0, j, 0, float(at[j] - at[i] - 1000), 5.0, 9) for i, j in itertools.combinations(range(8), 2) if j - i < 4]
    est += [(j, 1, i, 1, d, sd, n) for i, _, j, _, d, sd, n in est]
    copies = spark.createDataFrame([(i, 3.0 if i == 3 else 1.0, -5.0 if i == 3 else 50.0) for i in range(8)], "id long, copy_number double, a_stat double")
    for strict in (False, True):
        got = sorted(layout.build(contigs_of(spark, lengths), spark.createDataFrame(est, LINKS), copies, strict).collect(), key=lambda r: (r.scaffold, r.ord))
        assert [r.id for r in got if r.scaffold != 3] == ([0, 1, 2, 4, 5, 6, 7]) and len({r.scaffold for r in got}) == 2
