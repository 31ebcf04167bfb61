"""k-mer counts of reads that arrive as files: an extension, batch by batch into a table of partial counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contigua.operators import kmers


def stream_counts(reads: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes the counts of every micro-batch below ``path``, one folder a batch, so that a batch that is
    run again replaces its own counts."""

    def write(batch: DataFrame, number: int) -> None:
        kmers.strand_counts(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts over all batches so far."""
    return spark.read.parquet(path).groupBy("kmer").agg(F.sum("n_fwd").alias("n_fwd"), F.sum("n_rc").alias("n_rc"))
