"""Population index: which range of read numbers belongs to which sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranges(reads: DataFrame, sample_col: str) -> DataFrame:
    """``sample``, ``start``, ``end`` of reads numbered sample by sample, samples in order of name; windows over samples."""
    n = reads.groupBy(F.col(sample_col).alias("sample")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(W.orderBy("sample"))
    return n.select("sample", (run - F.col("n")).alias("start"), (run - 1).alias("end"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two indices as one; ranges of the second follow those of the first."""
    shift = a.agg(F.coalesce(F.max("end"), F.lit(-1))).first()[0] + 1
    return a.unionByName(b.select("sample", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end")))


#: Read numbers to a bucket of the range join.
BUCKET = 1_000_000


def sample_of(reads: DataFrame, index: DataFrame) -> DataFrame:
    """Reads with the sample whose range holds their number (null: none): an equi-join on buckets of numbers, each range
    in all that it meets."""
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    r = index.select("sample", "start", "end", F.explode(F.sequence(bucket("start"), bucket("end"))).alias("_bucket"))
    hit = reads.withColumn("_bucket", bucket("read_idx")).join(r, "_bucket", "left")
    inside = (F.col("read_idx") >= F.col("start")) & (F.col("read_idx") <= F.col("end"))
    found = hit.groupBy(*reads.columns).agg(F.max(F.when(inside, F.col("sample"))).alias("sample"))
    return found
