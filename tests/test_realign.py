import math
import random

import numpy as np
import pytest
from contigua.operators import realign

rng = random.Random(4)


def dna(n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def brute(read, qual, hap, place):
    """The recursion cell by cell, in plain probabilities: what reaches state s at place x when base l is taken."""
    runs, w = realign.run_lengths(hap), realign.BAND
    first = place - w // 2
    gap = lambda h: realign.indel_chance(runs[h]) / 2 if 0 <= h < len(hap) else realign.INDEL[0] / 2
    p = {("m", x): 1.0 for x in range(w)} | {("i", x): 1.0 for x in range(w)}
    log = 0.0
    for l, (b, q) in enumerate(zip(read, qual)):
        c = 1 - math.exp(-2.3026 / 10 * q)
        good, bad = 0.25 + 0.75 * c, 0.75 + 1e-10 - 0.75 * c
        if first + l <= -w and l < len(read) - 1:
            log += math.log(good)
            continue
        new = {k: 0.0 for k in p}
        for x in range(w):
            h = first + l + x
            e = good if not 0 <= h < len(hap) or hap[h] == b else bad
            if l == len(read) - 1:
                new["m", x] = p["m", x] * e * (1 - 2 * gap(h)) / w
                new["i", x] = p["i", x] * good * gap(h) / w
                continue
            if x:
                new["i", x - 1] += 0.5 * p["i", x] * good
                new["m", x - 1] += gap(h) * p["i", x] * good
            new["i", x] += 0.5 * p["m", x] * e
            new["m", x] += (1 - 2 * gap(h)) * p["m", x] * e
            for d, share in enumerate(realign.DELETIONS, 1):
                if x + d < w:
                    new["m", x + d] += share * gap(h) * p["m", x] * e
        total = sum(new.values())
        log += math.log(total)
        p = {k: v / total for k, v in new.items()}
    return log


def test_forward_equals_the_recursion_cell_by_cell():
    reads, quals, haps, places = [], [], [], []
    for i in range(60):
        hap = dna(rng.randint(12, 90)) if i % 4 else "ACGT" * 3 + "A" * rng.randint(2, 14) + dna(30)
        at = rng.randint(-12, len(hap))
        read = list((dna(20) + hap + dna(60))[at + 20 : at + 20 + rng.randint(1, 60)])
        for j in range(len(read)):
            if rng.random() < 0.05:
                read[j] = rng.choice("ACGTN")
        reads.append("".join(read))
        quals.append([rng.randint(0, 40) for _ in read])
        haps.append(hap)
        places.append(at)
    want = [brute(*x) for x in zip(reads, quals, haps, places)]
    assert np.allclose(realign.forward(reads, quals, haps, places), want, atol=1e-9)


def test_diagonals_are_the_most_voted_places():
    hap = dna(80)
    assert realign.diagonals(hap[30:60], realign.seeds(hap))[0] == 30
    assert realign.diagonals("A" * 5, realign.seeds(hap)) == []
    assert realign.log_likelihoods([("ACGT", None, hap)]) == [realign.NO_PLACE]


def test_the_right_haplotype_wins():
    ref = dna(140)
    snp = ref[:70] + {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[70]] + ref[71:]
    gone = ref[:69] + ref[72:]
    more = ref[:70] + "GATC" + ref[70:]
    for i, h in enumerate((ref, snp, gone, more)):
        ll = realign.log_likelihoods([(h[25:115], None, x) for x in (ref, snp, gone, more)])
        assert max(range(4), key=lambda j: ll[j]) == i


def test_frequencies_and_selection():
    ll = np.log(np.array([[0.9, 0.1, 0.001]] * 6 + [[0.1, 0.9, 0.001]] * 2) ** 20)
    f = realign.frequencies(ll)
    assert abs(f[0] - 0.75) < 1e-3 and f[2] < 1e-3
    assert [h for h, _ in realign.select_haplotypes(ll)] == [0, 1]
    assert realign.select_haplotypes(ll[:, :1]) == [(0, 0.0)]


@pytest.fixture(scope="module")
def windows():
    refs = [dna(200) for _ in range(4)]
    alts = [r[:100] + {"A": "C", "C": "G", "G": "T", "T": "A"}[r[100]] + r[101:] for r in refs[:2]] + [r[:100] + r[103:] for r in refs[2:]]
    return refs, alts


def rows(spark, windows):
    refs, alts = windows
    return spark.createDataFrame([(i, h, s) for i, pair in enumerate(zip(refs, alts)) for h, s in enumerate(pair)], "window long, hap int, seq string")


def test_calls(spark, windows):
    refs, alts = windows
    turn = str.maketrans("ACGT", "TGCA")
    base, variant = [], []
    for i in range(24):
        at = 20 + 4 * (i % 12)
        for w in range(4):
            base.append(refs[w][at : at + 100])
            variant.append((alts if w != 1 and i % 2 else refs)[w][at : at + 100])
    base += [refs[3][10:110]] * 200
    variant = [v if i % 3 else v.translate(turn)[::-1] for i, v in enumerate(variant)]
    b, v = (spark.createDataFrame([(i, s) for i, s in enumerate(x)], "read_idx long, seq string").repartition(3) for x in (base, variant))
    got = {(r.window, r.hap): r for r in realign.comparative_calls(rows(spark, windows), b, v, max_reads=100).collect()}
    assert {k: r.call for k, r in got.items()} == {(0, 1): True, (1, 1): False, (2, 1): True, (3, 1): False}
    assert got[3, 1].in_base == "over depth" and got[1, 1].in_variant == "not called"
    assert abs(got[0, 1].frequency - 0.5) < 0.1


def test_reads_of_a_window_are_turned_and_counted(spark, windows):
    refs, _ = windows
    turn = str.maketrans("ACGT", "TGCA")
    reads = spark.createDataFrame([(1, refs[0][5:80], "I" * 75), (2, refs[0][5:80].translate(turn)[::-1], "".join(chr(40 + i % 30) for i in range(75))), (3, dna(80), "I" * 80), (4, "ACGT", "IIII"), (5, None, None)], "read_idx long, seq string, qual string")
    placed, deep = realign.window_reads(rows(spark, windows), reads)
    found = {r.read_idx: r for r in placed.collect()}
    assert set(found) == {1, 2} and found[2].turned and found[2].seq == found[1].seq and found[2].qual == "".join(chr(40 + i % 30) for i in range(75))[::-1]
    assert deep.count() == 0
    none = realign.realign(rows(spark, windows), reads.limit(0))
    assert {r.status for r in none.collect()} == {"no reads"}
