"""FASTA and FASTQ sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _numbered_rows(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``path``, ``no`` (from 0), ``value``: rows of text files, in order within each file.

    Files are split as any text is. A split is read in order, so its rows are numbered by a count of the rows of the
    splits before it, one table row a split, which is all that is broadcast; rows themselves don't move.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = rows.groupBy("path", "_block").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("path").orderBy("_block")) - F.col("_n")
    splits = splits.select("path", "_block", (before - F.col("_least")).alias("_shift"))
    return rows.join(F.broadcast(splits), ["path", "_block"]).select("path", (F.col("_id") + F.col("_shift")).alias("no"), "value")


def read_fastq(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """``path``, ``record``, ``id``, ``meta``, ``seq``, ``qual`` of records of four lines."""
    line = F.when(F.endswith("value", F.lit("\r")), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    r = _numbered_rows(spark, path).select("path", "no", line.alias("line"), F.floor(F.col("no") / 4).alias("record"))
    part = lambda i: F.max(F.when(F.col("no") % 4 == i, F.col("line")))
    g = r.groupBy("path", "record").agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual")).filter(F.startswith("head", F.lit("@")))
    return _named(g, upper).select("path", "record", "id", "meta", "seq", "qual")


def read_fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """``path``, ``record``, ``id``, ``meta``, ``seq``, ``qual`` (null); sequences may span lines. A record is a row from the
    start, as text is split where a line begins with ``>``."""
    r = _numbered_rows(spark, path, "\n>").select("path", F.col("no").alias("record"), F.split(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", ""), "\n").alias("lines"))
    g = r.select("path", "record", F.concat(F.lit(">"), F.col("lines")[0]).alias("head"), F.array_join(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), "").alias("seq"))
    return _named(g, upper).select("path", "record", "id", "meta", "seq", F.lit(None).cast("string").alias("qual"))


def lengths(records: DataFrame) -> DataFrame:
    """``id``, ``length`` of records."""
    return records.select("id", F.length("seq").alias("length"))


def as_vertices(records: DataFrame, min_length: int = 0) -> DataFrame:
    """Records of ``min_length`` bases at least as graph vertices (``id``, ``seq``), without edges."""
    return records.filter(F.length("seq") >= min_length).select("id", "seq")


def _named(g: DataFrame, upper: bool) -> DataFrame:
    rest = F.substring("head", F.lit(2), F.length("head"))
    g = g.withColumn("seq", F.upper("seq")) if upper else g
    return g.withColumn("id", F.regexp_extract(rest, "^([^ \t]*)", 1)).withColumn("meta", F.regexp_extract(rest, "^[^ \t]*[ \t](.*)$", 1))


def numbered(records: DataFrame) -> DataFrame:
    """Adds ``read_idx``: files by path, records in order; window per file, offsets by file."""
    sizes = records.groupBy("path").agg(F.max("record").alias("top"))
    first = sizes.select("path", (F.sum(F.col("top") + 1).over(W.orderBy("path")) - F.col("top") - 1).alias("_first"))
    return records.join(first, "path").withColumn("read_idx", F.col("_first") + F.col("record")).drop("_first")


def record_text(id_: str = "id", seq: str = "seq", qual: str = "qual", wrap: int | None = None):
    """One record as text: FASTQ where there is a quality, else FASTA (wrapped at ``wrap`` bases)."""
    body = F.col(seq) if wrap is None else F.regexp_replace(seq, f"(.{{{wrap}}})(?=.)", "$1\n")
    fasta = F.concat(F.lit(">"), F.col(id_).cast("string"), F.lit("\n"), body)
    fastq = F.concat(F.lit("@"), F.col(id_).cast("string"), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual))
    return F.when(F.col(qual).isNotNull() & (F.length(qual) > 0), fastq).otherwise(fasta)


def write(reads: DataFrame, path: str, compress: bool = False, wrap: int | None = None) -> None:
    """Write records with Spark's text writer, gzip if asked for."""
    out = reads.select(record_text(wrap=wrap).alias("value")).write.mode("overwrite")
    (out.option("compression", "gzip") if compress else out).text(path)


def split_pairs(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and second reads of pairs by the end of their names."""
    from contigua.functions import sequence as S

    i = S.pair_index(F.col("id"))
    return reads.filter(i == 0), reads.filter(i == 1)


def numbered_pairs(reads: DataFrame) -> DataFrame:
    """Both of ``split_pairs`` in one pass: the reads of pairs with their ``file``, 0 or 1."""
    from contigua.functions import sequence as S

    return reads.withColumn("file", S.pair_index(F.col("id"))).filter("file is not null")


def join_pairs(reads: DataFrame) -> DataFrame:
    """``id``, ``seq``, ``qual``, ``join_pos``: both reads of a pair as one record."""
    from contigua.functions import sequence as S

    named = reads.withColumn("_base", S.pair_basename(F.col("id"))).withColumn("_i", S.pair_index(F.col("id")))
    pick = lambda c, i: F.max(F.when(F.col("_i") == i, F.col(c)))
    g = named.groupBy("_base").agg(*[pick(c, i).alias(f"{c}{i}") for c in ("seq", "qual") for i in (0, 1)])
    return g.select(F.col("_base").alias("id"), F.concat("seq0", "seq1").alias("seq"), F.concat("qual0", "qual1").alias("qual"), F.length("seq0").alias("join_pos"))


def unjoin_pairs(joined: DataFrame) -> DataFrame:
    """Records of ``join_pairs`` as reads ``/1`` and ``/2`` again."""
    a = F.struct(F.concat("id", F.lit("/1")).alias("id"), *[F.substring(c, F.lit(1), F.col("join_pos")).alias(c) for c in ("seq", "qual")])
    b = F.struct(F.concat("id", F.lit("/2")).alias("id"), *[F.substring(c, F.col("join_pos") + 1, F.length(c)).alias(c) for c in ("seq", "qual")])
    return joined.select(F.inline(F.array(a, b)))  # both of one pass
