"""Correction by overlaps, branches, genotypes, strand bias and segregation against plain recomputation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contigua.operators import correct, haplotypes, kmers, variants


def _reads(spark, rows):
    return spark.createDataFrame(rows, "read_idx long, seq string")


def test_by_overlaps_mends_what_others_have(spark):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(200))
    rows = [(i, genome[i * 10 : i * 10 + 100]) for i in range(8)]
    true = rows[3][1]
    wrong = true[:50] + ("A" if true[50] != "A" else "C") + true[51:]
    rows[3] = (3, wrong)
    # one read of the other strand, one without a k-mer, an empty one
    rows += [(8, true.translate(str.maketrans("ACGT", "TGCA"))[::-1]), (9, "ACGT"), (10, "")]
    out = {r.read_idx: (r.seq, r.n_changed) for r in correct.by_overlaps(_reads(spark, rows), 21).collect()}
    assert out[3] == (true, 1)
    assert all(out[i] == (s, 0) for i, s in rows if i not in (3, 10)) and 10 not in out


def test_conflicting_reads_do_not_vote(spark):
    roots = spark.createDataFrame([(0, "ACGT")], "root long, seq string")
    placed = spark.createDataFrame([(0, i, 0, 0, "ACGT" if i < 4 else "ACTT") for i in range(7)], "root long, read long, st int, offset int, seq string")
    kept = {r.read for r in correct.without_conflicts(roots, placed, 2).collect()}
    assert kept == {0, 1, 2, 3}
    assert correct.without_conflicts(roots, placed, 3).count() == 7


def test_branches(spark):
    r = _reads(spark, [(0, "AAACC"), (1, "AAACG"), (2, "AA")])
    counts = kmers.both_strands(r, 5)
    out = {x.read_idx: x.branches for x in kmers.branch_count(r, counts, 5, 1).collect()}
    assert out[2] == 0
    have = {r_.kmer: r_.n for r_ in counts.collect()}

    def n(w):
        rc = w.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        return have.get(min(w, rc), 0)

    for i, s in [(0, "AAACC"), (1, "AAACG")]:
        assert out[i] == max(0, sum(n(s[1:] + b) >= 1 for b in "ACGT") - 1)


def test_genotypes_match_the_one_locus_form(spark):
    rng = random.Random(5)
    per = {i: [(-rng.random() * 9, -rng.random() * 9) for _ in range(rng.randint(1, 12))] for i in range(30)}
    per[30] = [(-1.0, -1.0)]
    df = spark.createDataFrame([(i, a, b) for i, rows in per.items() for a, b in rows], "locus long, ll_ref double, ll_alt double")
    out = {r.locus: r for r in haplotypes.genotypes(df).collect()}
    for i, rows in per.items():
        gt, gq, gl = haplotypes.genotype(rows)
        assert (out[i].gt, out[i].gq) == (gt, gq)
        assert [out[i].gl_00, out[i].gl_01, out[i].gl_11] == pytest.approx(gl)
    assert haplotypes.genotypes(df.limit(0)).count() == 0


def test_ungapped_log_likelihood(spark):
    rows = [("ACGT", "TTACGTT"), ("ACGT", "TTACCTT"), ("ACGT", "AC")]
    df = spark.createDataFrame(rows, "r string, h string")
    got = [x.v for x in df.select(haplotypes.ungapped_log_likelihood(F.col("r"), F.col("h")).alias("v")).collect()]
    assert got == pytest.approx([haplotypes.read_likelihood(r, h) for r, h in rows])


def test_strand_bias(spark):
    pairs = [(0, 0), (10, 0), (0, 10), (5, 5), (30, 28), (4000, 4001)]
    df = spark.createDataFrame(pairs, "f long, r long")
    got = [x.v for x in df.select(variants.strand_bias(F.col("f"), F.col("r")).alias("v")).collect()]
    assert got[0] == 0 and got[1] > 0 and got[2] > 0 and got[3] < 0 and got[4] < 0 and got[5] < -100


def test_segregation(spark):
    depths = [10.0, 12.0, 8.0]
    rows = [([9, 0, 0],), ([3, 3, 3],), ([0, 0, 0],)]
    out = [r for r in variants.segregation_scores(spark.createDataFrame(rows, "counts array<bigint>"), depths, 10.0).collect()]
    # nine reads, one sample expected to carry them: against three a sample
    m, n, p, q = 1, 3, 3.0, 9.0
    want = math.log(m / n) + 9 * math.log(q / p) + p - q + 2 * (math.log(m / n * math.exp(-q) + (n - m) / n) + p)
    assert out[0].lm_haploid == pytest.approx(want)
    assert out[0].lm_haploid > out[1].lm_haploid
    assert out[2].lm_haploid is None and out[2].lm_diploid_depths is None
