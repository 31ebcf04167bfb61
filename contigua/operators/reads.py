"""Reads: derived from documents, cleaned, filtered, paired."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.functions import batches as B
from contigua.functions import sequence as S
from contigua.runtime import ship

#: Primers whose first bases reject a read.
PRIMERS = ("AATGATACGGCGACCACCGAGATCTACA", "GATCGGAAGAGCGGTTCAGCAGGAATGC")
#: Phred score up to which a base counts as of low quality.
LOW_PHRED = 3
#: Tiles that a document can have at most in a read number.
TILES = 1_000_000
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


_TO_BASE = bytes.maketrans((LETTERS + LETTERS.upper()).encode(), (BASES * 2).encode())
_NO_LETTER = bytes(sorted(set(range(256)) - set((LETTERS + LETTERS.upper()).encode())))
#: Reads of one Arrow batch, about.
ROWS = 10_000
Batches = Iterator[pa.RecordBatch]


def _bases(batches: Batches) -> Batches:
    """The letters A to Z of every text, of either case, as bases."""
    for b in batches:
        seqs = [None if x is None else x.translate(_TO_BASE, _NO_LETTER) for x in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seqs, pa.binary()).cast(pa.string())], names=["doc_id", "source", "seq"])


def doc_sequences(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``seq``: the letters of each whole text as bases."""
    ship(docs.sparkSession)
    slim = docs.select("doc_id", "source", "text")
    return slim.mapInArrow(_bases, _schema(slim, "seq string"))


def _schema(df: DataFrame, *more: str) -> str:
    """Columns ``doc_id`` and ``source`` as a table has them, between others."""
    return ", ".join([*more[:-1], *[f"{c} {df.schema[c].dataType.simpleString()}" for c in ("doc_id", "source")], more[-1]])


def _tiled(length: int, stride: int):
    """A body that cuts the sequences of a batch into windows: a sequence is gone through once, however long it is."""

    def windows(seq: str) -> list:
        if not seq.isascii():
            return [seq[i : i + length].encode() for i in range(0, len(seq) - length + 1, stride)]
        return np.lib.stride_tricks.sliding_window_view(np.frombuffer(seq.encode(), np.uint8), length)[::stride]

    def given(b: pa.RecordBatch, rows: list[int], tiles: list[np.ndarray], parts: list) -> pa.RecordBatch:
        at, tile = pa.array(rows), np.concatenate(tiles)
        if all(isinstance(x, np.ndarray) for x in parts):
            seq = B.text_column(np.concatenate(parts).ravel(), np.arange(0, len(tile) * length + 1, length))
        else:
            seq = pa.array([bytes(w) for x in parts for w in x], pa.binary()).cast(pa.string())
        doc = b.column(0).take(at).take(pa.array(np.repeat(np.arange(len(rows)), [len(t) for t in tiles])))
        source = b.column(1).take(at).take(pa.array(np.repeat(np.arange(len(rows)), [len(t) for t in tiles])))
        number = pc.add(pc.multiply(doc.cast(pa.int64()), pa.scalar(TILES, pa.int64())), pa.array(tile))
        return pa.RecordBatch.from_arrays([number, doc, source, seq], names=["read_idx", "doc_id", "source", "seq"])

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows, tiles, parts, n = [], [], [], 0
            for i, seq in enumerate(b.column(2)):
                seq = seq.as_py()
                if seq is None or len(seq) < length:
                    continue
                w = windows(seq)
                for at in range(0, len(w), ROWS):
                    some = w[at : at + ROWS]
                    rows.append(i)
                    tiles.append(np.arange(at, at + len(some)))
                    parts.append(some)
                    n += len(some)
                    if n >= ROWS:
                        yield given(b, rows, tiles, parts)
                        rows, tiles, parts, n = [], [], [], 0
            if n:
                yield given(b, rows, tiles, parts)

    return run


def tile_reads(seqs: DataFrame, length: int = 100, stride: int = 40) -> DataFrame:
    """``read_idx``, ``doc_id``, ``source``, ``seq``: windows over whole sequences, the last one where it still fits."""
    ship(seqs.sparkSession)
    slim = seqs.select("doc_id", "source", "seq")
    return slim.mapInArrow(_tiled(length, stride), _schema(slim, "read_idx long", "seq string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to all cores where the files give fewer partitions (small inputs only)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the documents, from text to windows in one pass."""
    ship(spark)
    docs, tiled = documents(spark, sf_dir), _tiled(100, 40)
    return docs.mapInArrow(lambda batches: tiled(_bases(batches)), _schema(docs, "read_idx long", "seq string"))


def _changed(one_in: int):
    """A body that changes bases and gives qualities by the number of a read and the place in it."""
    other = np.arange(256, dtype=np.uint8)
    other[list(b"ACGT")] = list(b"CGTA")
    score = np.arange(33, 33 + 41, dtype=np.uint8)

    def run(batches: Batches) -> Batches:
        for b in batches:
            seqs, known = b.column(3).cast(pa.string()), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            i = b.column(0).fill_null(0).to_numpy()
            assert not len(i) or (i.min() >= 0 and i.max() < 1 << 49), "a read number out of range"
            valid = seqs.is_valid().to_numpy(zero_copy_only=False)
            seq, qual, sizes = [], [], np.zeros(len(i), np.int64)
            for rows, m, n in B.blocks(seqs):
                p = np.arange(1, m.shape[1] + 1, dtype=np.int64)
                real = p <= n[:, None]
                left, right = (i[rows] * 7919 % one_in).astype(np.int32), (p * 104729 % one_in).astype(np.int32)
                total = left[:, None] + right
                bad = ((total == 0) | (total == one_in)) & known[rows, None]
                small = m.dtype == np.uint8
                new = np.where(bad, other[m] if small else np.where(m < 256, other[m & 255], m), m)
                text = new[real]
                seq.append(text if small else np.frombuffer(text.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8))
                q = score[((i[rows] * 31 % 41)[:, None] + p * 17 % 41) % 41]
                real &= known[rows, None]
                qual.append(q[real])
                sizes[rows] = real.sum(1)
            at = np.concatenate([[0], np.cumsum(sizes)])
            there = np.frombuffer(seqs.buffers()[1], np.int32, len(seqs) + 1, seqs.offset * 4).astype(np.int64) if len(seqs) else np.zeros(1, np.int64)
            none = np.zeros(0, np.uint8)
            seq, qual = np.concatenate([none, *seq]), np.concatenate([none, *qual])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), B.text_column(seq, there - there[0], valid), B.text_column(qual, at, valid), seqs], names=["read_idx", "doc_id", "source", "seq", "qual", "true_seq"])

    return run


def with_errors(reads: DataFrame, one_in: int = 500) -> DataFrame:
    """Reads with arithmetic substitutions and qualities, for correction and trimming."""
    ship(reads.sparkSession)
    slim = reads.select(F.col("read_idx").cast("long").alias("read_idx"), "doc_id", "source", "seq")
    return slim.mapInArrow(_changed(one_in), _schema(slim, "read_idx long", "seq string, qual string, true_seq string"))


def _cut(c: str, n: Column) -> Column:
    return F.substring(F.col(c), F.lit(1), n)


def remove_adapter(reads: DataFrame, forward: str, reverse: str) -> DataFrame:
    """Erase the first hit of the forward adapter, or else of the reverse one, from sequence and quality."""
    at_f, at_r = F.instr("seq", forward), F.instr("seq", reverse)
    at = F.when(at_f > 0, at_f).otherwise(at_r)
    n = F.when(at_f > 0, len(forward)).otherwise(len(reverse))
    erase = lambda c: F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + n, F.length(c)))).otherwise(F.col(c))
    return reads.withColumns({"seq": erase("seq"), "qual": erase("qual")})


def contains_primer(seq: Column) -> Column:
    """Whether the first 14 bases lie in a primer (a shorter read: all of it)."""
    head = F.substring(seq, 1, 14)
    hit = F.lit(False)
    for p in PRIMERS:
        hit = hit | (F.instr(F.lit(p), head) > 0)
    return hit


def preprocess(
    reads: DataFrame, hard_clip: int = 0, quality_trim: int = 0, quality_filter: int = -1, dust_threshold: float | None = 4.0, min_gc: float | None = None,
    max_gc: float | None = None, primer_check: bool = True, min_length: int = 40, phred64: bool = False, permute_ambiguous: bool = False, sample: float | None = None, seed: int = 0,
) -> DataFrame:
    """Clean and filter reads in the fixed order: ambiguity, alphabet, quality scale, hard clip, trim, quality, dust, GC,
    primer, length. Reads without a quality (null) pass the quality steps unchanged.

    All steps belong to one scan; scores of whole batches are taken at once.
    """
    ship(reads.sparkSession)
    out = reads if sample is None else reads.sample(fraction=sample, seed=seed)
    if permute_ambiguous:
        out = out.withColumn("seq", S.resolve_ambiguous(F.col("seq"), F.col("read_idx")))
    out = out.filter(F.col("seq").rlike("^[ACGT]*$"))
    if phred64:
        out = out.withColumn("qual", S.phred64_to_phred33(F.col("qual")))
    if hard_clip > 0:
        out = out.withColumns({c: F.substring(c, 1, hard_clip) for c in ("seq", "qual")})
    if quality_trim > 0:
        out = out.withColumn("_keep", F.coalesce(B.soft_clip_udf("qual", F.lit(quality_trim)), F.length("seq")))
        out = out.withColumns({c: _cut(c, F.col("_keep")) for c in ("seq", "qual")}).drop("_keep")
    if quality_filter >= 0:
        low = B.count_up_to_udf("qual", F.lit(LOW_PHRED))
        out = out.filter(F.col("qual").isNull() | (low <= quality_filter))
    if dust_threshold is not None:
        out = out.filter(B.dust_udf("seq") < dust_threshold)
    if min_gc is not None or max_gc is not None:
        share = F.col("_gc")
        low, high = (F.lit(True) if x is None else y for x, y in ((min_gc, share >= min_gc), (max_gc, share <= max_gc)))
        out = out.withColumn("_gc", B.gc_udf("seq")).filter(share.isNotNull() & low & high).drop("_gc")
    if primer_check:
        out = out.filter(~contains_primer(F.col("seq")))
    return out.filter((F.length("seq") > 0) & (F.length("seq") >= min_length))


def pair_rule(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """``read_idx``, ``status`` of every read of ``pairs`` (``read_idx``, ``pair_id``): ``pair`` if both mates were kept,
    ``orphan`` if only this one was, ``lost`` otherwise."""
    marked = pairs.join(kept.select("read_idx", F.lit(1).alias("_kept")), "read_idx", "left")
    both = marked.groupBy("pair_id").agg(F.sum(F.coalesce("_kept", F.lit(0))).alias("_n"), F.count("*").alias("_of"))
    return marked.join(both, "pair_id").select("read_idx", F.when((F.col("_n") == 2) & (F.col("_of") == 2), "pair").when(F.col("_kept") == 1, "orphan").otherwise("lost").alias("status"))


def degenerate(reads: DataFrame, share: float = 0.9) -> DataFrame:
    """Reads of which one base has more than ``share``."""
    ship(reads.sparkSession)
    return reads.filter(B.max_share_udf("seq") > share)
