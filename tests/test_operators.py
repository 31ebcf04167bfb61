import random

import pytest
from contigua.functions import sequence as S
from contigua.operators import align, correct, dedup, graph, haplotypes, kmers, overlap, scaffold, variants, walks
from contigua.operators import reads as R
from contigua.sources import graphs, population, sequences
from pyspark.sql import functions as F


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def reads_df(spark, seqs, qual=None):
    return spark.createDataFrame([(i, s, qual) for i, s in enumerate(seqs)], "read_idx long, seq string, qual string")


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(11)
    g = dna(rng, 700)
    reads = [g[i : i + 60] if rng.random() < 0.5 else rc(g[i : i + 60]) for i in range(0, 641, 5)]
    return g, reads


def brute_overlaps(reads, m):
    out = {}
    o = [(i, s, r if s == 0 else rc(r)) for i, r in enumerate(reads) for s in (0, 1)]
    for i, xs, a in o:
        for j, ys, b in o:
            if i != j:
                best = max((n for n in range(m, min(len(a), len(b))) if a[-n:] == b[:n]), default=0)
                if best:
                    out[i, xs, j, ys] = best
    return out


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTACGT", "IIII#I##", "AAAAA", "r/1"), ("NRYK", "IIII", "ACG", "xA")], "s string, q string, d string, id string")
    r = df.select(S.soft_clip_end(F.col("q"), 20).alias("keep"), S.dust(F.col("d")).alias("dust"), S.pair_id(F.col("id")).alias("p"), S.reverse_complement_iupac(F.col("s")).alias("rc"), S.pair_basename(F.col("id")).alias("b")).collect()
    assert [x.keep for x in r] == [6, 4] and r[0].dust == pytest.approx(1 / 3) and r[1].dust == 0
    assert [x.p for x in r] == ["r/2", "xB"] and r[1].rc == "MRYN" and r[0].b == "r"
    d = spark.createDataFrame([("ACGT", "AGGA")], "a string, b string").select(S.hamming(F.col("a"), F.col("b")).alias("h"), S.diff_string(F.col("a"), F.col("b")).alias("d")).first()
    assert (d.h, d.d) == (2, ".G.A")


def test_preprocess(spark):
    rows = [(0, "GATCGGAAGAGCGG" + "ACGT" * 10, "I" * 54), (1, "A" * 50, "I" * 50), (2, "ACGTTGCA" * 6, "I" * 48), (3, "ACGN" * 12, "I" * 48), (4, "ACGTTGCA" * 6, None), (5, "ACGT" * 5, "I" * 20)]
    kept = R.preprocess(spark.createDataFrame(rows, "read_idx long, seq string, qual string"), quality_trim=20, quality_filter=5).collect()
    assert sorted(r.read_idx for r in kept) == [2, 4]


def test_kmer_count_palindromes_and_strands(spark):
    df = reads_df(spark, ["ACGTT", "AACGT"])
    got = {(r.kmer, r.n_fwd, r.n_rc) for r in kmers.kmer_count(df, 4).collect()}
    assert got == {("AACG", 1, 1)}
    assert {(r.kmer, r.n) for r in kmers.both_strands(df, 4).collect()} == {("AACG", 2), ("ACGT", 4)}


def test_overlaps_equal_brute_force(spark, genome):
    _, reads = genome
    got = {(r.x, r.xs, r.y, r.ys): r.ov for r in overlap.exact_overlaps(reads_df(spark, reads), 40).collect()}
    assert got == brute_overlaps(reads, 40)
    near = {(r.x, r.xs, r.y, r.ys): r.ov for r in overlap.inexact_overlaps(reads_df(spark, reads), 40, 0.0).collect()}
    assert near == got


@pytest.mark.parametrize("least", [8, 13, 32, 45, 70])
def test_packed_overlaps_equal_brute_force(spark, monkeypatch, least):
    from contigua.operators import meets

    rng = random.Random(least)
    line = dna(rng, 90)
    reads = [line[rng.randrange(40) :][: rng.randrange(30, 80)] for _ in range(25)] + [rc(line)[i : i + 75] for i in range(0, 15, 3)]
    half = dna(rng, 40)
    reads += [half + rc(half), "ACGT" * 25, "CGTA" * 20 + "C", "A" * 90, "A" * 81, "T" * 60 + dna(rng, 30), dna(rng, 500), "", line[:least], line[:least] + "A", rc(line)]
    want = brute_overlaps(reads, least)
    assert len(want) > 20
    monkeypatch.setattr(meets, "PAIRS", 50)
    e = overlap.exact_overlaps(reads_df(spark, reads).repartition(3), least)
    assert {(r.x, r.xs, r.y, r.ys): r.ov for r in e.collect()} == want and e.count() == len(want)
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no row a window
    other = [*reads, line[:60] + "N" + dna(rng, 20), dna(rng, 10) + "N" + line[:75]]
    assert {(r.x, r.xs, r.y, r.ys): r.ov for r in overlap.exact_overlaps(reads_df(spark, other), least).collect()} == brute_overlaps(other, least)


def test_inexact_overlaps_of_hot_seeds_are_all_found(spark):
    rng = random.Random(9)
    shared = dna(rng, 24)
    reads = [dna(rng, 10) + shared + dna(rng, 6) for _ in range(12)] + [shared + dna(rng, 16) for _ in range(12)]
    reads += [shared[:5] + "ACGT"["TGCA".index(shared[5])] + shared[6:] + dna(rng, 16) for _ in range(8)]
    reads += [dna(rng, 16) + shared for _ in range(12)]
    both = {(i, st): rc(s) if st else s for i, s in enumerate(reads) for st in (0, 1)}
    want = {}
    for (x, xs), s in both.items():
        for (y, ys), t in both.items():
            for ov in range(20, min(len(s) - 1, len(t) - 1) + 1) if x != y else ():
                diff = sum(c != d for c, d in zip(s[-ov:], t, strict=False))
                if diff <= int(0.05 * ov + 1e-9):
                    want[x, xs, y, ys] = (ov, diff)
    for most in (3, 200):
        got = {(r.x, r.xs, r.y, r.ys): (r.ov, r.diff) for r in overlap.inexact_overlaps(reads_df(spark, reads), 20, 0.05, most).collect()}
        assert got == want and len(want) > 200


def test_assembly_gives_the_genome_back(spark, genome):
    g, reads = genome
    r = dedup.remove_duplicates(reads_df(spark, reads)).select("read_idx", "seq")
    e = overlap.irreducible(overlap.exact_overlaps(r, 40), 60)
    v = r.select(F.col("read_idx").alias("id"), "seq")
    contigs = [x.seq for x in graph.rename_contigs(graph.unitigs(v, e)).collect()]
    assert contigs == [g] or contigs == [rc(g)]
    comp = {x.component for x in graph.components(v, e).collect()}
    assert len(comp) == 1
    assert graph.stats(v, e).first().n_terminal == 2


def test_rings_are_cut_once(spark):
    rng = random.Random(4)
    g = dna(rng, 300)
    ring = g + g[:60]
    r = reads_df(spark, [ring[i : i + 60] for i in range(0, 300, 10)])
    e = overlap.irreducible(overlap.exact_overlaps(r, 40), 60)
    out = graph.unitigs(r.select(F.col("read_idx").alias("id"), "seq"), e).collect()
    assert len(out) == 1 and out[0].n_vertices == 30 and len(out[0].seq) == 350


def test_containment_and_duplicates(spark):
    rng = random.Random(9)
    a = dna(rng, 80)
    seqs = [a, rc(a), a[10:60], rc(a[5:70]), dna(rng, 70)]
    assert {r.read_idx for r in dedup.contained(reads_df(spark, seqs)).collect()} == {2, 3}
    assert {(r.read_idx, r.copies) for r in dedup.remove_duplicates(reads_df(spark, seqs)).collect()} == {(0, 2), (4, 1)}
    many = reads_df(spark, [dna(rng, 50) for _ in range(9)] + [a, a])
    assert 10 in {r.read_idx for r in dedup.remove_duplicates(many, by_decimal_string=True).collect()}


def test_correction_repairs_planted_errors(spark):
    rng = random.Random(21)
    g = dna(rng, 400)
    true = [g[i : i + 80] for i in range(0, 321, 4)]
    seqs = list(true)
    for i in range(5, 75, 7):
        p = rng.randrange(80)
        seqs[i] = seqs[i][:p] + rng.choice([b for b in "ACGT" if b != seqs[i][p]]) + seqs[i][p + 1 :]
    out = {r.read_idx: r for r in correct.correct(reads_df(spark, seqs, "I" * 80), 21, support=3).collect()}
    assert len(out) == len(seqs)
    assert sum(out[i].seq == t for i, t in enumerate(true)) >= len(true) - 1
    m = correct.metrics(reads_df(spark, seqs, "I" * 80), spark.createDataFrame([(i, r.seq) for i, r in out.items()], "read_idx long, seq string")).collect()
    assert sum(r.errors for r in m if r["by"] == "position") == sum(a != b for i, s in enumerate(seqs) for a, b in zip(s, out[i].seq))


def test_alignment_kernels():
    rng = random.Random(2)

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i, *[0] * len(b)], d
            for j, y in enumerate(b, 1):
                d[j] = min(last[j - 1] + (x != y), last[j] + 1, d[j - 1] + 1)
        return d[-1]

    for _ in range(60):
        a, b = dna(rng, rng.randint(0, 15)), dna(rng, rng.randint(0, 15))
        assert align.edit_distance(a, b) == slow(a, b) == align.edit_distance(a, b, band=15)
        ops = align.expand_cigar(align.global_affine(a, b)[1])
        assert ops.count("M") + ops.count("D") == len(a) and ops.count("M") + ops.count("I") == len(b)
    score, cigar = align.global_affine("ACGTACGT", "ACGTTTACGT")
    assert score == 8 - 5 - 4 and align.expand_cigar(cigar).count("I") == 2
    s = dna(rng, 30)
    assert align.best_overlap(dna(rng, 40) + s, s + dna(rng, 40), 20)[:2] == (30, 30)


def test_walks(spark):
    edges = spark.createDataFrame([(0, 0, 1, 0, 5), (1, 0, 3, 0, 5), (0, 0, 2, 0, 4), (2, 0, 3, 0, 9), (3, 0, 0, 0, 1)], "x long, xs int, y long, ys int, lab int")
    v = spark.createDataFrame([(i, c * 10) for i, c in enumerate("ACGT")], "id long, seq string")
    starts = spark.createDataFrame([(1, 0, 0, 3)], "pair long, x long, xs int, y long")
    w = walks.walk_strings(walks.find_walks(edges, starts, 20), v)
    assert sorted(r.seq for r in w.collect()) == ["AAAAAAAAAACCCCCTTTTT", "AAAAAAAAAAGGGGTTTTTTTTT"]
    assert walks.unique_walks(w).count() == 0 and len(walks.longest_walks(w, 1).collect()[0].seq) == 23
    assert walks.find_walks(edges, starts, 11).count() == 1


def test_haplotypes(spark):
    rng = random.Random(7)
    g = dna(rng, 120)
    k, table = 15, {}
    for i in range(len(g) - k + 1):
        w = min(g[i : i + k], rc(g[i : i + k]))
        table[w] = table.get(w, 0) + 5
    assert haplotypes.build(table, g[:k], g[-k:], 3) == [g]
    gaps = spark.createDataFrame([(1, g[:40], g[80:], 38)], "gap_id long, left string, right string, size int")
    counts = spark.createDataFrame([(1, w, n) for w, n in table.items()], "gap_id long, kmer string, n long")
    assert haplotypes.fill_gaps(gaps, counts, k).first().filled == g[40:80]
    f = haplotypes.frequencies([[0.0, -9.0]] * 30 + [[-9.0, 0.0]] * 10)
    assert f[0] == pytest.approx(0.75, abs=0.01)
    assert haplotypes.genotype([[0.0, -7.0]] * 5 + [[-7.0, 0.0]] * 5)[0] == "0/1" and haplotypes.genotype([])[0] == "./."


def test_scaffold_rules(spark):
    x = spark.createDataFrame([(z,) for z in (-3.0, -1.0, 0.0, 0.5, 2.0)], "z double").select("z", scaffold.normal_cdf(F.col("z")).alias("p")).collect()
    from statistics import NormalDist

    assert all(abs(r.p - NormalDist().cdf(r.z)) < 1e-6 for r in x)
    s = spark.createDataFrame([("s", 1, "A" * 40, -30.0), ("s", 2, "C" * 40, None)], "scaffold string, ord int, seq string, dist double")
    assert scaffold.layout(s).first().seq == "A" * 40 + "N" * 25 + "C" * 10
    lens = spark.createDataFrame([(2,), (1,), (1,)], "len int")
    assert scaffold.n50(lens).first().n50 == 1 and scaffold.n50(lens, strict=False).first().n50 == 2
    cut = scaffold.split_gaps(spark.createDataFrame([("s", "ACGTNNNNACC")], "scaffold string, seq string")).collect()
    assert [(r.ord, r.seq, r.gap) for r in cut] == [(0, "ACGT", 4), (1, "ACC", 0)]


def test_variant_rules(spark):
    v = spark.createDataFrame([("AT", "A"), ("A", "AT"), ("A", "C"), ("AT", "CA"), ("AT", "C")], "ref string, alt string")
    assert [r.c for r in v.select(variants.variant_class(F.col("ref"), F.col("alt")).alias("c")).collect()] == ["DEL", "INS", "SUB", "SUB", "COMPLEX"]
    a = spark.createDataFrame([(1, 9999), (1, 50)], "chrom int, pos int")
    b = spark.createDataFrame([(1, 10004), (1, 55), (1, 54)], "chrom int, pos int")
    assert {(r.pos_a, r.pos_b) for r in variants.near_variants(a, b, 5).collect()} == {(50, 54)}
    h = spark.createDataFrame([("CAAAAG", 3), ("CAAAAG", 1)], "s string, p int").select(variants.homopolymer_at(F.col("s"), F.col("p")).alias("h"), variants.three_mer_context(F.col("s"), F.col("p")).alias("c")).collect()
    assert [(r.h, r.c) for r in h] == [(4, "AAA"), (1, "NCA")]


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r/1 x y\nACGT\n+\nIIII\n@r/2\nGG\n+\n#I")
    (tmp_path / "b.fa").write_text(">s one two\nACG\nTT\n>t\nGGG")
    fq = sequences.numbered(sequences.read_fastq(spark, str(tmp_path / "a.fq")))
    assert [(r.read_idx, r.id, r.meta, r.seq, r.qual) for r in fq.orderBy("read_idx").collect()] == [(0, "r/1", "x y", "ACGT", "IIII"), (1, "r/2", "", "GG", "#I")]
    assert [(r.id, r.seq) for r in sequences.read_fasta(spark, str(tmp_path / "b.fa")).orderBy("record").collect()] == [("s", "ACGTT"), ("t", "GGG")]
    sequences.write(fq, str(tmp_path / "out"), compress=True)
    assert sequences.read_fastq(spark, str(tmp_path / "out")).filter("length(seq) > 0").count() >= 1
    joined = sequences.join_pairs(fq)
    assert joined.first().seq == "ACGTGG" and {(r.id, r.seq) for r in sequences.unjoin_pairs(joined).collect()} == {("r/1", "ACGT"), ("r/2", "GG")}
    e = spark.createDataFrame([(1, 0, 2, 1, 45)], "x long, xs int, y long, ys int, ov int")
    v = spark.createDataFrame([(1, "A" * 60), (2, "C" * 60)], "id long, seq string")
    graphs.write_asqg(v, graphs.match_columns(e, 60), str(tmp_path / "g"), 40)
    rv, re_ = graphs.read_asqg(spark, str(tmp_path / "g"), 40)
    assert rv.count() == 2 and tuple(re_.first()) == ("1", "2", 15, 59, 60, 15, 59, 60, 1, 0)
    assert graphs.read_asqg(spark, str(tmp_path / "g"), 46)[1].count() == 0
    (tmp_path / "d.de").write_text("c1 c2+,100,5,10.5 c3-,-20,4,3.0 ; c4+,7,3,1.5\n")
    assert {tuple(r) for r in graphs.read_distance_estimates(spark, str(tmp_path / "d.de")).collect()} == {("c1", 0, "c2", 0, 100.0, 10.5, 5), ("c1", 0, "c3", 1, -20.0, 3.0, 4), ("c1", 1, "c4", 1, 7.0, 1.5, 3)}
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\n1\t5\t.\tA\tC\t.\tPASS\tDP=3;DB\tGT\t0/1\n")
    r = graphs.read_vcf(spark, str(tmp_path / "v.vcf"))
    assert r.first().qual == 255 and r.first().info["DP"] == "3"
    assert r.select(graphs.vcf_line().alias("l")).first().l == "1\t5\t.\tA\tC\t.\tPASS\tDB;DP=3\tGT\t0/1"
    line = spark.createDataFrame([("c1\tc2,100,1.5,0,1,D\tc3,5,2.0,1,0,N",)], "value string")
    p = graphs.parse_scaf(line)
    assert p.select(graphs.scaf_line().alias("l")).first().l == line.first().value
    idx = population.ranges(spark.createDataFrame([("b",), ("a",), ("b",)], "s string"), "s")
    assert {tuple(x) for x in population.merge(idx, idx).collect()} == {("a", 0, 0), ("b", 1, 2), ("a", 3, 3), ("b", 4, 5)}
    got = population.sample_of(spark.createDataFrame([(0,), (2,), (9,)], "read_idx long"), idx)
    assert {tuple(x) for x in got.collect()} == {(0, "a"), (2, "b"), (9, None)}


def test_streaming_counts_equal_batch(spark, tmp_path):
    from contigua.streaming import counts

    rng = random.Random(1)
    df = reads_df(spark, [dna(rng, 60) for _ in range(30)]).select("read_idx", "seq")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts.stream_counts(stream, 9, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got, want = counts.totals(spark, str(tmp_path / "out")), kmers.strand_counts(df, 9)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_concordance(spark):
    rng = random.Random(5)
    g = dna(rng, 100)
    alt = "ACGT"[("ACGT".index(g[49]) + 1) % 4]
    mutant = g[:49] + alt + g[50:]
    near = [{"pos": 20, "ref": g[19], "alt": "ACGT"[("ACGT".index(g[19]) + 1) % 4]}]
    w = spark.createDataFrame([(1, g, 1, 50, g[49], alt, near), (2, g, 1, 50, g[49], alt, near * 5)], "row_no long, seq string, start int, pos int, ref string, alt string, nearby array<struct<pos:int,ref:string,alt:string>>")
    h = variants.germline_haplotypes(w)
    assert {r.haplotype for r in h.collect()} >= {mutant} and h.count() == 2
    v, b = kmers.both_strands(reads_df(spark, [mutant]), 21), kmers.both_strands(reads_df(spark, [g]), 21)
    assert tuple(variants.concordance(h, v, b, 21).first()) == (1, 21, "SOMATIC")
    assert tuple(variants.concordance(h, b, b, 21).first()) == (1, 0, "GERMLINE")


def test_evidence_reads(spark):
    from contigua.operators import alignments

    e = spark.createDataFrame([("idx-1", "N", "#"), ("other", "A", "I")], "name string, seq string, qual string")
    r = spark.createDataFrame([(1, "read/1", "ACGT", "IIII")], "read_idx long, id string, seq string, qual string")
    assert {tuple(x) for x in alignments.restore_reads(e, r).select("name", "seq", "qual").collect()} == {("read/1", "ACGT", "IIII"), ("other", "A", "I")}
