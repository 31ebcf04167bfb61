import collections
import itertools
import random

import pytest
from contigua import runtime
from contigua.functions import sequence as S
from contigua.operators import graph, index, pileup, preqc, qc, scaffold, variants
from contigua.sources import alignments, graphs, population, sequences
from pyspark.sql import functions as F


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(400)] + [(None, 7)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 400, 2)] + [(1, 5)], "k long, w long")
    for how in ("inner", "left"):
        got = sorted(map(str, runtime.join_unique(left, right, "k", how).collect()))
        assert got == sorted(map(str, left.join(right, "k", how).collect()))


def test_scratch_tables_are_deleted(spark):
    t = runtime.materialize(spark.range(5), "gone")
    assert t.count() == 5
    runtime.forget(t)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist"):
        spark.read.parquet(t._scratch).count()


def test_ranks_and_runs(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(12))) for i in range(40)]
    r = spark.createDataFrame(rows, "read_idx long, seq string").repartition(5)
    want = [i for _, i in sorted((s, i) for i, s in rows)]
    assert [x.read_idx for x in index.lexicographic_index(r).orderBy("rank").collect()] == want
    suffixes = sorted((s[p:], i, "$" if p == 0 else s[p - 1]) for i, s in rows for p in range(12))
    ranked = index.suffix_order(r)
    assert [x.before for x in ranked.orderBy("rank").collect()] == [b for *_, b in suffixes]
    runs, last = {}, None
    for *_, b in suffixes:
        if b == last:
            n += 1
        else:
            if last is not None:
                runs[n] = runs.get(n, 0) + 1
            last, n = b, 1
    runs[n] = runs.get(n, 0) + 1
    assert {x.length: x.runs for x in index.run_lengths(ranked).collect()} == runs
    assert index.run_lengths(index.suffix_order(r.limit(0))).count() == 0


def test_homopolymer_filter(spark):
    """A run that is one too long in one read and right in twenty others."""
    rng = random.Random(2)
    head, tail = ("".join(rng.choice("ACG") for _ in range(39)) + "C", "G" + "".join(rng.choice("ACG") for _ in range(39)))
    right, wrong = head + "T" * 8 + tail, head + "T" * 9 + tail
    rows = [(i, right if i % 2 else rc(right)) for i in range(20)] + [(99, wrong), (100, "ACGT" * 20), (101, "TTTTTTTT")]
    r = spark.createDataFrame(rows, "read_idx long, seq string")
    assert [x.read_idx for x in qc.homopolymer_failures(r, r).collect()] == [99]
    run = {x.read_idx: (x.run_start, x.run_length, x.run_base) for x in qc.longest_run(r).collect()}
    assert run[99] == (40, 9, "T") and run[100] == (0, 1, "A") and run[101] == (0, 8, "T")


def test_sources_split_anywhere(spark, tmp_path):
    """Small splits: records keep their order and are whole."""
    rows = [(f"r{i}", "ACGT" * (i % 9 + 1), "@" * (4 * (i % 9 + 1))) for i in range(200)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} note\n{s}\n+\n{q}\n" for n, s, q in rows))
    (tmp_path / "a.fa").write_text("".join(f">{n}\n{s[:5]}\n{s[5:]}\n" if len(s) > 5 else f">{n}\n{s}\n" for n, s, _ in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        q = sequences.read_fastq(spark, f"{tmp_path}/a.fq")
        assert [(x.id, x.seq, x.qual) for x in q.orderBy("record").collect()] == rows
        a = sequences.read_fasta(spark, f"{tmp_path}/a.fa")
        assert a.rdd.getNumPartitions() > 3
        assert [(x.id, x.seq) for x in a.orderBy("record").collect()] == [r[:2] for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@SQ\tSN:c\tLN:9\nq\t16\tc\t3\t60\t4M1D2M3S\t*\t0\t0\tACGTACGTA\t*\tNM:i:2\nq\t2304\tc\t1\t0\t9M\t*\t0\t0\tA\t*\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    got = {(r.name, r.is_primary): (r.is_mapped, r.is_reverse, r.pos, r.end_pos, r.nm) for r in alignments.read_sam(spark, f"{tmp_path}/x.sam").collect()}
    assert got == {("q", True): (True, True, 2, 9, 2), ("q", False): (True, False, 0, 9, None), ("u", True): (False, False, -1, -1, None)}


def test_chains_and_rings(spark):
    c = spark.range(8).select("id")
    links = [(0, 0, 1, 1, 5.0), (1, 1, 2, 0, 6.0), (4, 0, 5, 0, 1.0), (5, 0, 6, 0, 2.0), (6, 0, 4, 0, 3.0)]
    both = links + [(y, 1 - ys, x, 1 - xs, d) for x, xs, y, ys, d in links]
    got = scaffold.chains(c, spark.createDataFrame(both, "x long, xs int, y long, ys int, dist double")).collect()
    chains = {}
    for r in sorted(got, key=lambda r: (r.scaffold, r.ord)):
        chains.setdefault(r.scaffold, []).append((r.id, r.st))
    assert sorted(chains.values()) == [[(0, 0), (1, 1), (2, 0)], [(3, 0)], [(4, 0), (5, 0), (6, 0)], [(7, 0)]]
    assert len(got) == 8


def test_graph_clean_up(spark):
    e = spark.createDataFrame([(1, 0, 2, 0, 5), (2, 1, 1, 1, 5), (1, 0, 3, 0, 4), (3, 1, 1, 1, 4), (1, 1, 4, 0, 3)], "x long, xs int, y long, ys int, lab int")
    assert {(r.x, r.y, r.error) for r in graph.structure_errors(e, e.limit(5)).collect()} == {(1, 4, "no twin")}
    assert graph.without_super_repeats(e, 2).count() == 0 and graph.without_super_repeats(e, 3).count() == 5
    top = {(r.x, r.xs): (r.longest, r.ahead) for r in graph.longest_overlaps(e.withColumnRenamed("lab", "ov")).collect()}
    assert top[(1, 0)] == (5, 1) and top[(1, 1)] == (3, 3)


def test_pileup(spark):
    roots = spark.createDataFrame([(1, "ACGT"), (2, "")], "root long, seq string")
    reads = spark.createDataFrame([(1, 0, "AGG"), (1, 1, "GGT"), (1, 1, "GG"), (1, 3, "TTT")], "root long, offset int, seq string")
    c = pileup.counts(roots, reads)
    assert [(r.n_a, r.n_c, r.n_g, r.n_t) for r in c.orderBy("pos").collect()] == [(2, 0, 0, 0), (0, 1, 3, 0), (0, 0, 4, 0), (0, 0, 0, 3)]
    assert pileup.consensus(c).first().seq == "AGGT"
    s = pileup.summary(c, 3, 0).first()
    assert (s.wrong, s.covered, s.supported, s.conflicted) == (1, 4, False, True)


def test_small_functions(spark):
    assert variants.parameters("a:1,b:x") == {"a": 1.0, "b": "x"}
    one = spark.range(1)
    unit, n = variants.repeat_units(F.lit("GGACACACTT"), F.lit(1), F.lit("GAC"), F.lit("G"))
    assert tuple(one.select(unit, n).first()) == ("AC", 3)
    assert one.select(S.random_base(F.lit("x"))).first()[0] in "ACGT"
    h = spark.createDataFrame([(1, 50), (2, 10), (3, 20), (4, 60), (8, 40)], "n long, kmers long")
    assert tuple(preqc.single_copy_peak(h).first()) == (4, 8)
    assert preqc.genome_size(100, 100.0, 31, [(20, 7000)]) == pytest.approx(350, rel=0.2)
    ranges = spark.createDataFrame([("a", 0, 4), ("b", 5, 2_500_000)], "sample string, start long, end long")
    got = {r.read_idx: r.sample for r in population.sample_of(spark.createDataFrame([(0,), (4,), (5,), (1_999_999,), (9_000_000,)], "read_idx long"), ranges).collect()}
    assert got == {0: "a", 4: "a", 5: "b", 1_999_999: "b", 9_000_000: None}
    lines = spark.createDataFrame([(0, "HT\tx"), (1, "VT\ta\tA"), (2, "ED\tq"), (3, "VT\tb\tA"), (4, "HT\ty"), (5, "?")], "no long, value string")
    assert sorted(r.no for r in graphs.asqg_order_errors(lines).collect()) == [3, 4, 5]


def test_walks_are_complete_or_absent(spark):
    from contigua.operators import walks

    e = spark.createDataFrame([(0, 0, 9, 0, 1), (0, 0, 1, 0, 1), (1, 0, 2, 0, 1), (2, 0, 3, 0, 1), (3, 0, 9, 0, 1)], "x long, xs int, y long, ys int, lab int")
    starts = spark.createDataFrame([(1, 0, 0, 9)], "pair long, x long, xs int, y long")
    assert [walks.find_walks(e, starts, 20, n).count() for n in (2, 3, 4, 5)] == [0, 0, 2, 2]


def test_run_lengths_query_takes_all_suffixes(spark, tmp_path):
    from contigua.operators import reads as R
    from contigua.plans import catalog

    rng = random.Random(8)
    docs = [(i, "s", "".join(rng.choice("acgt") for _ in range(rng.choice([99, 100, 150, 190])))) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.seq, r.read_idx) for r in R.derive(spark, str(tmp_path)).collect()]
    order = sorted((s[p:], i, "$" if p == 0 else s[p - 1]) for s, i in rows for p in range(len(s)))
    lengths = [len(list(g)) for _, g in itertools.groupby(b for *_, b in order)]
    got = {r.length: r.runs for r in catalog.queries()["suffix_run_lengths"](spark, str(tmp_path)).collect()}
    assert got == collections.Counter(lengths) and sum(n * c for n, c in got.items()) == 100 * len(rows)


@pytest.mark.parametrize("most", [150, 1_000_000])
def test_runs_of_suffixes_in_turns(spark, monkeypatch, most):
    monkeypatch.setattr(index, "AT_ONCE", most)
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 5, 20]))) for _ in range(60)] + ["A" * 30] * 9 + ["AC" * 9]
    r = spark.createDataFrame(list(enumerate(seqs)), "read_idx long, seq string").repartition(3)
    for shortest in (1, 4):
        order = sorted((s[p:], i, "$" if p == 0 else s[p - 1]) for i, s in enumerate(seqs) for p in range(len(s) - shortest + 1))
        want = collections.Counter(len(list(g)) for _, g in itertools.groupby(b for *_, b in order))
        assert {x.length: x.runs for x in index.suffix_runs(r, shortest).collect()} == want
    plan = index.suffix_runs(r)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and index.suffix_runs(r.limit(0)).count() == 0
