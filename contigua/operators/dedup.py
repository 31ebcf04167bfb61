"""Duplicate and containment removal; set operations on read sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.functions import batches as B
from contigua.functions import sequence as S
from contigua.operators import kmers, meets
from contigua.runtime import materialize, ship


def duplicates(reads: DataFrame) -> DataFrame:
    """``read_idx``, ``keep_idx``, ``copies``: reads of equal sequence on either strand, and which one stands for them.

    Groups are reduced before the shuffle, so a sequence that most reads have costs one row a task.
    """
    ship(reads.sparkSession)
    c = reads.select("read_idx", B.canonical_udf("seq").alias("c"))
    return c.join(_firsts(c), "c").select("read_idx", "keep_idx", "copies")


def _firsts(c: DataFrame) -> DataFrame:
    return c.groupBy("c").agg(F.min("read_idx").alias("keep_idx"), F.count("*").alias("copies"))


def firsts(reads: DataFrame) -> DataFrame:
    """``keep_idx``, ``copies``: the first of every group of reads of equal sequence on either strand, and how many there are."""
    ship(reads.sparkSession)
    return _firsts(reads.select("read_idx", B.canonical_udf("seq").alias("c"))).select("keep_idx", "copies")


def contained(reads: DataFrame, seed: int = 31) -> DataFrame:
    """``read_idx`` of reads that are a proper part of a longer one, on either strand.

    The first ``seed`` bases of each distinct sequence, by hash, are joined to all windows of distinct longer ones and
    verified; equal windows are reduced first. Distinct sequences of bases meet packed.
    """
    ship(reads.sparkSession)
    one = materialize(reads.groupBy(B.canonical_udf("seq").alias("seq")).agg(F.min("read_idx").alias("read_idx")), "distinct-reads", tidy=True)
    if meets.all_bases(one):
        found = one.join(meets.contained(one, seed), "read_idx", "left_semi").select("seq")
        return reads.select("read_idx", B.canonical_udf("seq").alias("seq")).join(found, "seq", "left_semi").select("read_idx")
    small = one.select("seq", F.length("seq").alias("n"))
    both = small.select("seq", "n", F.col("seq").alias("o")).unionByName(small.select("seq", "n", S.reverse_complement(F.col("seq")).alias("o")))
    heads = both.filter(F.col("n") >= seed).select("seq", "n", "o", F.substring("o", 1, seed).alias("kmer"))
    windows = kmers.occurrences(one, seed).select("read_idx", "pos", "kmer")
    hits = heads.join(windows, "kmer").join(one.select("read_idx", F.col("seq").alias("long")), "read_idx")
    found = hits.filter((F.length("long") > F.col("n")) & (F.substring("long", F.col("pos"), F.col("n")) == F.col("o"))).select("seq").distinct()
    return reads.select("read_idx", S.canonical(F.col("seq")).alias("seq")).join(found, "seq", "left_semi").select("read_idx")


def remove_duplicates(reads: DataFrame, seed: int = 31, by_decimal_string: bool = False) -> DataFrame:
    """Reads without copies and contained ones, with ``copies``. Of equal reads the one of the smallest number stays, or
    with ``by_decimal_string`` of the number that is smallest as text."""
    ship(reads.sparkSession)
    key = F.col("read_idx").cast("string") if by_decimal_string else F.col("read_idx")
    first = reads.groupBy(B.canonical_udf("seq").alias("c")).agg(F.min_by("read_idx", key).alias("read_idx"), F.count("*").alias("copies"))
    kept = reads.join(first.select("read_idx", "copies"), "read_idx")
    lengths = reads.agg(F.min(F.length("seq")) != F.max(F.length("seq"))).first()[0]
    return kept.join(contained(reads, seed), "read_idx", "left_anti") if lengths else kept


def without(reads: DataFrame, discard: DataFrame) -> DataFrame:
    """Reads whose number isn't in ``discard``."""
    return reads.join(discard.select("read_idx"), "read_idx", "left_anti")


def concatenate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two read sets as one; numbers of the second follow those of the first."""
    top = a.agg(F.coalesce(F.max("read_idx"), F.lit(-1))).first()[0] + 1
    return a.unionByName(b.withColumn("read_idx", F.col("read_idx") + top), allowMissingColumns=True)
