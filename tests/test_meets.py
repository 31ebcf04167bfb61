"""Reads that meet packed, against plain recomputation."""

import random
from collections import Counter

import pytest

from contigua.operators import correct, dedup, kmers, meets, overlap, preqc

SWAP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(SWAP)[::-1]


def canon(s):
    return min(s, rc(s))


def table(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_idx long, seq string").repartition(3)


def moved(df):
    """The plan, if it spreads windows or joins them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in ("Generate", "Join") if x in plan]


@pytest.fixture(scope="module")
def seqs():
    r = random.Random(6)
    g = "".join(r.choice("ACGT") for _ in range(400))
    out = [g[i : i + r.randrange(30, 100)] for i in range(0, 300, 7)]
    out += [rc(s) for s in out[:9]] + ["A" * 60, "AT" * 40, "ACGT" * 20, "", "ACG", g[:25], out[3], out[3][4:-5], rc(out[8])[3:-3]]
    return out


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(meets, "PAIRS", 40)
    monkeypatch.setattr(meets.K, "ROWS", 30)


@pytest.mark.parametrize("k", [8, 21, 33])
def test_windows_are_counted_where_they_meet(spark, seqs, k):
    windows = [(i, p + 1, s[p : p + k]) for i, s in enumerate(seqs) for p in range(len(s) - k + 1)]
    n = lambda some: Counter(c for _, _, w in some for c in ([canon(w)] if w != rc(w) else [w, w]))
    every, half = n(windows), n([w for w in windows if w[0] < 20])
    r = table(spark, seqs)
    got = kmers.position_counts(r, {"all": r, "half": r.filter("read_idx < 20")}, k)
    assert sorted(map(tuple, got.collect())) == sorted((i, p, w, every[canon(w)], half[canon(w)]) for i, p, w in windows) and not moved(got)
    profile = kmers.own_profile(r, k, 4)
    want = {i: [min(4, every[canon(s[p : p + k])]) for p in range(len(s) - k + 1)] for i, s in enumerate(seqs) if len(s) >= k}
    assert {x.read_idx: x.profile for x in profile.collect()} == want and not moved(profile)
    old = preqc.first_error_position(r, kmers.both_strands(r, k), k, 3, 4)
    new = preqc.own_first_error(r, k, 3, 4)
    assert {tuple(x) for x in new.collect()} == {tuple(x) for x in old.collect()} and not moved(new)
    other = table(spark, [*seqs, "ACGTNACGT" * 9])
    got = kmers.position_counts(other, {"all": other}, k).filter("kmer like '%N%'")
    assert got.count() and got.filter("n_all = 0").count() == 0


@pytest.mark.parametrize("k", [8, 9, 25])
def test_bases_that_go_on(spark, seqs, k):
    r = table(spark, seqs)
    counts = kmers.both_strands(r, k)
    want, new = {tuple(x) for x in kmers.extensions(counts, k).collect()}, kmers.next_bases(r, k)
    assert sorted(map(tuple, new.collect())) == sorted(want) and not moved(new)
    for depth in (1, 3):
        old = {tuple(x) for x in kmers.branch_count(r, counts, k, depth).collect()}
        assert {tuple(x) for x in kmers.own_branches(r, k, depth).collect()} == old
    assert not moved(meets.branches(r, k, 1))


def test_thresholds_need_no_row_a_window(spark, seqs):
    r = table(spark, seqs)
    for k in (8, 21):
        plan = correct.learned_threshold(r, k)
        assert "Generate" not in moved(plan)
        hist = kmers.histogram(kmers.lookup(r, kmers.both_strands(r, k), k).select("n"))
        assert plan.first().threshold == kmers.distribution_summary(hist).first().boundary_by_ratio


@pytest.mark.parametrize("k", [8, 21])
def test_pairs_that_share(spark, seqs, k):
    held = [{canon(s[p : p + k]) for p in range(len(s) - k + 1)} for s in seqs]
    many = Counter(c for h in held for c in h)
    for most in (5, 200):
        cold = [{c for c in h if many[c] <= most} for h in held]
        want = {(x, y, len(cold[x] & cold[y])) for x in range(len(seqs)) for y in range(x + 1, len(seqs)) if cold[x] & cold[y]}
        got = overlap.shared_kmer_pairs(table(spark, seqs), k, 1, most)
        assert {tuple(x) for x in got.collect()} == want and got.count() == len(want) and not moved(got)


def test_contained_reads(spark, seqs):
    for seed in (8, 12, 25):
        want = {i for i, s in enumerate(seqs) if len(s) >= seed and any(len(t) > len(s) and (s in t or rc(s) in t) for t in seqs)}
        r = table(spark, seqs)
        assert {x.read_idx for x in dedup.contained(r, seed).collect()} == want and len(want) > 3
        assert "Generate" not in moved(dedup.contained(r, seed))


def test_kmers_of_one_side_only(spark, seqs):
    a, b = seqs[:15], seqs[15:]
    n = Counter(c for s in a for p in range(len(s) - 11) for w in [s[p : p + 12]] for c in ([canon(w)] if w != rc(w) else [w, w]))
    other = {canon(s[p : p + 12]) for s in b for p in range(len(s) - 11)}
    assert {x.kmer: x.n for x in kmers.only_in(table(spark, a), table(spark, b), 12).collect()} == {c: m for c, m in n.items() if c not in other}
