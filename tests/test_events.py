import random

from contigua.operators import align, events

rng = random.Random(9)


def dna(n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def applied(reference, found):
    out, at = "", 0
    for pos, ref, alt in found:
        assert reference[pos : pos + len(ref)] == ref
        out, at = out + reference[at:pos] + alt, pos + len(ref)
    return out + reference[at:]


def test_events_rebuild_the_haplotype_and_lie_leftmost():
    for _ in range(300):
        ref = "".join(rng.choice(["A", "C", "AT", "GGG"]) for _ in range(40))
        hap, shift = ref, 10
        while shift < len(hap) - 10:
            kind = rng.choice("....sdi")
            if kind == "s":
                hap = hap[:shift] + dna(1) + hap[shift + 1 :]
            elif kind == "d":
                hap = hap[:shift] + hap[shift + rng.randint(1, 4) :]
            elif kind == "i":
                hap = hap[:shift] + dna(rng.randint(1, 4)) + hap[shift:]
            shift += 15
        _, ops = align.affine_batch([(ref, hap)])[0]
        gaps = [(p, r, a) for p, r, a in events.events_of(ref, hap, ops) if len(r) != len(a)]
        for p, r, a in gaps:
            if p > 0 or r[0] == a[0]:
                long = r if len(r) > len(a) else a
                assert ref[p] != long[-1] or p == 0  # one more step to the left would change the text
        found = events.events_of(ref, hap, ops)
        if all(x[0] + len(x[1]) <= y[0] for x, y in zip(found, found[1:])):
            assert applied(ref, found) == hap


def test_left_align():
    assert events.left_align("GATTTTC", 5, "T", "") == (2, "T", "")
    assert events.left_align("GACACACT", 5, "CA"[::-1], "") == (1, "AC", "")
    assert events.left_align("AAAA", 3, "", "A") == (0, "", "A")


def test_places_and_calls(spark):
    turn = str.maketrans("ACGT", "TGCA")
    refs = [dna(300), dna(250)]
    refs.append(refs[0][50:250])  # ends that come twice
    unique = refs[1][40:200]
    snp = unique[:80] + {"A": "C", "C": "G", "G": "T", "T": "A"}[unique[80]] + unique[81:]
    gone = unique[:60] + unique[63:]
    haps = [(1, unique), (2, snp), (3, gone.translate(turn)[::-1]), (4, refs[0][100:220]), (5, unique[:40] + dna(60) + unique[100:]), (6, dna(100)), (7, "ACGT"), (8, None)]
    h = spark.createDataFrame(haps, "hap long, seq string").repartition(3)
    r = spark.createDataFrame(list(enumerate(refs)), "ref_id long, seq string")
    placed = events.places(h, r)
    assert {(x.hap, x.ref_id, x.turned, x.start, x.end) for x in placed.collect()} == {(1, 1, False, 41, 200), (2, 1, False, 41, 200), (3, 1, True, 41, 200), (5, 1, False, 41, 200)}
    got = {}
    for x in events.call_events(placed).collect():
        got.setdefault(x.hap, []).append((x.pos, x.ref, x.alt))
    assert set(got) == {2, 3}
    assert got[2] == [(121, unique[80], snp[80])]
    (pos, ref, alt), = got[3]
    assert len(ref) - len(alt) == 3 and applied(refs[1], [(pos - 1, ref, alt)])[40:197] == gone
    assert events.call_events(events.places(h.limit(0), r)).count() == 0
