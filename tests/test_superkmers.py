"""k-mers counted from packed pieces of reads against plain recomputation."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contigua.operators import index, kmers, preqc, superkmers

SWAP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(SWAP)[::-1]


def canon(s):
    return min(s, rc(s))


def windows(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def strands(seqs, k):
    out = {}
    for s in seqs:
        for w in windows(s or "", k):
            out.setdefault(canon(w), Counter())[w == canon(w)] += 1
    return {c: (n[True], n[False]) for c, n in out.items()}


@pytest.fixture(scope="module")
def seqs():
    r = random.Random(5)
    out = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 3, 30, 31, 32, 70, 100, 100, 1500)]
    out += ["A" * 700, "ACGT" * 40, "ACGTNACGTacgtACGTAé日CCGTACGATCGATCGTAGCTAGCTAGCATCGACTACTACGAGCTACGACTAGC"]
    return out + [rc(s) for s in out[5:8]] + out[6:] + [None]


def table(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_idx long, seq string")


@pytest.mark.parametrize("k", [2, 11, 27, 31, 32, 33, 41, 64, 91])
def test_counts(spark, seqs, k):
    want = strands(seqs, k)
    assert {r.kmer: (r.n_fwd, r.n_rc) for r in kmers.strand_counts(table(spark, seqs), k).collect()} == want
    levels = Counter((*n, c == rc(c)) for c, n in want.items())
    assert {(r.n_fwd, r.n_rc, r.same): r.kmers for r in superkmers.levels(table(spark, seqs), k).collect()} == levels
    both = Counter(sum(n) * (1 + (c == rc(c))) for c, n in want.items())
    assert {r.n: r.kmers for r in kmers.count_levels(table(spark, seqs), k).collect()} == both


@pytest.mark.parametrize("k", [4, 27, 40])
def test_sets_of_reads(spark, seqs, k):
    a, b = seqs[::2], seqs[1::2]
    na, nb = strands(a, k), strands(b, k)
    both = {c: tuple(x + y for x, y in zip(na.get(c, (0, 0)), nb.get(c, (0, 0)), strict=True)) for c in {*na, *nb}}
    ta, tb = table(spark, a), table(spark, b)
    assert {r.kmer: (r.n_fwd, r.n_rc) for r in kmers.merge_counts(ta, tb, k).collect()} == both
    want = {c: (*n, *nb.get(c, (0, 0))) for c, n in na.items() if c != rc(c)}
    assert {r.kmer: (r.n_fwd, r.n_rc, r.n_fwd_b, r.n_rc_b) for r in kmers.kmer_count(ta, k, {"b": tb}).collect()} == want
    alone = {c: n for c, n in na.items() if c not in nb and min(n) > 0 and 2 <= sum(n) < 9}
    assert {r.kmer: (r.n_fwd, r.n_rc) for r in kmers.unique_to(ta, tb, k, 2, 9).collect()} == alone


@pytest.mark.parametrize(("k", "both"), [(4, False), (4, True), (31, False), (31, True), (36, False)])
def test_solid_reads(spark, seqs, k, both):
    n = strands(seqs, k)
    level = lambda w: min(n[canon(w)]) if both else sum(n[canon(w)]) * (1 + (w == rc(w)))
    want = [i for i, s in enumerate(seqs) if len(s or "") >= k and min(level(w) for w in windows(s, k)) > 1]
    assert sorted(r.read_idx for r in kmers.solid_reads(table(spark, seqs), k, 1, both).collect()) == want


def test_counts_of_words(spark, seqs):
    k, n = 30, strands(seqs, 30)
    asked = [(i, s[-k:]) for i, s in enumerate(seqs) if len(s or "") >= k] + [(900, "C" * k), (901, "N" * k), (902, "ACGT")]
    got = superkmers.counts_of(spark.createDataFrame(asked, "id long, word string"), table(spark, seqs), k)
    want = {i: (n.get(canon(w), (0, 0)) if w == canon(w) else n.get(canon(w), (0, 0))[::-1]) for i, w in asked if len(w) == k}
    assert {r.id: (r.n_same, r.n_other) for r in got.collect()} == want


def test_gc_of_even_words(spark):
    got = {r.bin: (r.reads, r.mean_coverage) for r in preqc.gc_distribution(table(spark, ["ACGTAA", "ACGTCC", "TTTTTT"]), 4).collect()}
    assert got == {6: (1, 4.0), 13: (1, 4.0), 0: (1, 3.0)}


def test_windows_travel_together(spark):
    """A row a window would be 40 bytes each; pieces take two at most."""
    r = random.Random(8)
    reads = table(spark, ["".join(r.choice("ACGT") for _ in range(100)) for _ in range(5000)])
    held = superkmers.pieces(reads, 27).agg(F.sum(F.length("blob"))).first()[0]
    assert held < 2 * 5000 * 74


def test_reads_holding(spark, seqs):
    k = 30
    words = [seqs[4][1:31], rc(seqs[6][:30]), "ACGT", seqs[10][:30], "G" * 30]
    held = {canon(w) for w in words}
    want = [i for i, s in enumerate(seqs) if any(canon(w) in held for w in windows(s or "", k))]
    got = superkmers.reads_holding(table(spark, seqs), spark.createDataFrame([(w,) for w in words], "word string"), k)
    assert sorted(r.read_idx for r in got.collect()) == want


def test_best_neighbour(spark, seqs):
    k, n = 4, strands(seqs[:6], 4)
    words = ["ACGA", "TTTT", "ACGT", "ACG", seqs[5][:4]]
    level = lambda w: sum(n.get(canon(w), (0, 0))) * (1 + (w == rc(w)))
    want = {w: max(level(w[:i] + b + w[i + 1 :]) for i in range(k) for b in "ACGT" if b != w[i]) if len(w) == k else 0 for w in words}
    got = index.best_neighbour(spark.createDataFrame([(w,) for w in words], "word string"), table(spark, seqs[:6]), k)
    assert {r.word: r.most for r in got.collect()} == want
