"""Reads, their scores and formats in whole batches: the same rows as row by row, without the plans that grew too fast."""

import os
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from contigua.functions import batches as B
from contigua.functions import sequence as S
from contigua.operators import dedup, index, preqc, qc
from contigua.operators import reads as R
from contigua.sources import alignments, graphs, sequences


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    rows = [(1, "a", "The quick brown fox, " * 40), (2, "b", None), (3, "b", "é Ab" * 60), (4, None, "x" * 99), (5, "c", "Q" * 140)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_tiles_are_cut_without_a_row_of_the_sequence_each(spark):
    d = R.doc_sequences(docs(spark))
    whole = {r.doc_id: r.seq for r in d.collect()}
    assert whole[2] is None and whole[3] == "AC" * 0 + whole[3] and set(whole[3]) == {"A", "C"}
    tiles = R.tile_reads(d)
    got = {(r.read_idx, r.doc_id, r.source, r.seq) for r in tiles.collect()}
    source = {1: "a", 3: "b", 5: "c"}
    want = {(i * R.TILES + t, i, source[i], s[40 * t : 40 * t + 100]) for i, s in whole.items() if s for t in range((len(s) - 100) // 40 + 1) if len(s) >= 100}
    assert got == want
    assert "Generate" not in plan(tiles)


def test_errors_and_qualities_are_those_of_the_formula(spark):
    rows = [(i, 1, "s", "ACGTN"[: 1 + i % 5] * (i % 40)) for i in range(0, 90, 3)] + [(7, 1, "s", None), (8, 1, "s", "ACé" * 9)]
    df = R.with_errors(spark.createDataFrame(rows, "read_idx long, doc_id long, source string, seq string"), 5)
    assert "ransform" not in plan(df)
    swap = dict(zip("ACGT", "CGTA", strict=True))
    for r in df.collect():
        if r.true_seq is None:
            assert r.seq is None and r.qual is None
            continue
        want = "".join(swap.get(c, c) if (r.read_idx * 7919 + p * 104729) % 5 == 0 else c for p, c in enumerate(r.true_seq, 1))
        assert (r.seq, r.qual) == (want, "".join(chr(33 + (r.read_idx * 31 + p * 17) % 41) for p in range(1, len(want) + 1)))


def test_kernels_agree_with_expressions(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 3, 4, 30, 70, 100]))) for _ in range(80)] + ["AAAACCCC", "ACGT"]
    rows = [(s, "".join(chr(33 + rng.randrange(41)) for _ in s)) for s in seqs]
    df = spark.createDataFrame(rows, "s string, q string")
    native = df.select(S.canonical(F.col("s")), S.max_base_share(F.col("s")), S.homopolymer_run(F.col("s")), S.dust(F.col("s")), S.soft_clip_end(F.col("q"), 20), S.hamming(F.col("s"), F.col("q"))).collect()
    s, q = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])
    kernels = [B.canonical(s).to_pylist(), B.max_share(s).to_pylist(), B.longest_runs(s)[1].tolist(), B.dust(s).tolist(), B.soft_clip(q, 20).tolist(), B.differing(s, q).tolist()]
    assert [tuple(r) for r in native] == list(zip(*kernels, strict=True))
    mixed = [None, "", "N", "NNAANAAA", "é" * 3 + "AA", "ACGTé"]
    starts = [next(((m.start(), m.end() - m.start()) for m in sorted(re.finditer("A+|C+|G+|T+", t or ""), key=lambda m: m.start() - m.end())), (0, 0)) for t in mixed]
    assert list(zip(*[x.tolist() for x in B.longest_runs(pa.array(mixed))], strict=True)) == starts


def test_statistics_of_qualities_are_summed_in_batches(spark):
    df = spark.createDataFrame([("I!",), ("5",), (None,), ("",)], "qual string")
    got = preqc.quality_by_position(df)
    assert "Generate" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 30.0, 0.5), (2, 1, 0.0, 0.0)}


def test_anchored_words_and_runs_need_no_row_a_window(spark, monkeypatch):
    def spread(*_):
        raise AssertionError("windows as rows")

    reads = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACGTA"), (3, "TTACGTA")], "read_idx long, seq string")
    words = spark.createDataFrame([("ACGTA",), ("$ACGTA",), ("ACGTA$",), ("$ACGTA$",), ("GGGGG",), ("ACGTA",), ("ACG",)], "word string")
    monkeypatch.setattr(index.kmers, "occurrences", spread)
    assert {(r.word, r.n) for r in index.anchored_counts(reads, words, 5).collect()} == {("ACGTA", 4), ("$ACGTA", 2), ("ACGTA$", 2), ("$ACGTA$", 1), ("GGGGG", 0), ("ACG", 0)}
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(90))
    asked, r = [base[10:60], base[20:71]], spark.createDataFrame([(1, base), (2, base.translate(str.maketrans("ACGT", "TGCA"))[::-1]), (3, base[:80])], "read_idx long, seq string")
    got = qc.word_counts(r, spark.createDataFrame([(w,) for w in asked], "word string"), range(50, 52))
    assert {(x.word, x.n) for x in got.collect()} == {(w, 3) for w in asked}


def test_prefixes_spread_windows_of_reads_with_a_hit_only(spark, monkeypatch):
    seen, before = [], index.kmers.occurrences
    monkeypatch.setattr(index.kmers, "occurrences", lambda reads, k: seen.append(reads.count()) or before(reads, k))
    reads = spark.createDataFrame([(i, "ACGTTGCA"[i % 3 :] + "CCATGG" * 3) for i in range(3)] + [(9, "TTTTTTTTTT")], "read_idx long, seq string")
    got = index.around_hits(reads, spark.createDataFrame([("ACGTTG",)], "word string"), 6).collect()
    assert [(r.read_idx, r.pos, r.prefix) for r in got] == [(0, 1, "")] and seen == [1]


def test_lines_of_files_are_not_all_one_tasks(spark, tmp_path):
    a = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit(True).alias("is_primary"), F.lit(True).alias("is_mapped"), F.lit(False).alias("is_reverse"), F.lit("d1").alias("ref"), F.col("id").cast("int").alias("pos"), F.lit(9).alias("mapq"), F.lit("4M").alias("cigar"), F.lit("ACGT").alias("seq"), F.lit("*").alias("qual"), F.lit(1).alias("nm"))
    refs = spark.createDataFrame([("d1", 9000)], "ref string, ref_length int")
    alignments.write_sam(a, refs, str(tmp_path / "sam"))
    files = sorted(f for f in os.listdir(tmp_path / "sam") if f.startswith("part-"))
    texts = [(tmp_path / "sam" / f).read_text() for f in files]
    assert sum(t.startswith("n") for t in texts) == 8 and "".join(texts).startswith("@SQ") and alignments.read_sam(spark, str(tmp_path / "sam")).count() == 4000
    u = spark.range(0, 400, 1, 4).select("id", F.lit("ACGT").alias("seq"))
    e = spark.range(0, 400, 1, 4).select((F.col("id") % 2).alias("x"), F.lit(0).alias("xs"), (F.col("id") + 5).alias("y"), F.lit(0).alias("ys"), F.lit(3).alias("ov"))
    graphs.write_asqg(u, graphs.match_columns(e, 4), str(tmp_path / "asqg"), 3)
    lines = [(tmp_path / "asqg" / f).read_text() for f in sorted(f for f in os.listdir(tmp_path / "asqg") if f.startswith("part-"))]
    assert sum("VT\t" in t for t in lines) == 4 and re.fullmatch("(HT)+(VT)+(ED)+", "".join(x[:2] for x in "".join(lines).splitlines()))


def test_ranks_move_rows_once_and_pairs_are_one_pass(spark):
    df = spark.range(0, 3000, 1, 6).select((F.col("id") * 37 % 3001).alias("v"))
    ranked = index.global_rank(df, "v")
    assert "Window [row_number" not in plan(ranked) and [r["rank"] for r in ranked.orderBy("v").collect()] == list(range(3000))
    r = spark.createDataFrame([("a/1", "AC", "II"), ("a/2", "G", "I"), ("b", "T", "I")], "id string, seq string, qual string")
    assert {(x.id, x.file) for x in sequences.numbered_pairs(r).collect()} == {("a/1", 0), ("a/2", 1)}
    assert "Union" not in plan(sequences.unjoin_pairs(sequences.join_pairs(r)))
    reads = spark.createDataFrame([(1, "ACGG"), (2, "CCGT"), (3, "TTTT")], "read_idx long, seq string")
    assert {tuple(x) for x in dedup.firsts(reads).collect()} == {(1, 2), (3, 1)}


def test_suffixes_travel_packed_in_the_order_of_their_texts(spark, monkeypatch):
    kept, before = [], index.materialize
    monkeypatch.setattr(index, "materialize", lambda df, *a, **k: kept.append(df.columns) or before(df, *a, **k))
    rng = random.Random(8)
    for letters in ("ACGT", "ACGTN"):
        rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(12)))) for i in range(60)] + [(90, "AAAAAAAAA"), (91, "AAAA"), (92, "CAAAA" + letters[-1])]
        got = index.suffix_order(spark.createDataFrame(rows, "read_idx long, seq string"), 1).orderBy("rank").collect()
        want = sorted((s[p:], i, p + 1, s[p - 1] if p else "$") for i, s in rows for p in range(len(s)))
        text = dict(rows)
        assert [(text[r.read_idx][r.pos - 1 :], r.read_idx, r.pos, r.before) for r in got] == want and [r["rank"] for r in got] == list(range(len(want)))
    assert all("suffix" not in c and "key" not in c for c in kept)
