"""Alignments as SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.runtime import write_in_order

#: Flag bits of the format.
UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 4, 16, 256, 2048


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment columns (name, is_primary, is_mapped, is_reverse, ref, pos from 0, end_pos, mapq, cigar, seq, qual, nm); ends
    come from the CIGAR, header lines are passed over. A narrow scan of splittable text."""
    f = F.split("value", "\t")
    flag = f[1].cast("int")
    on = lambda bit: flag.bitwiseAND(bit) != 0
    runs = F.regexp_extract_all(f[5], F.lit("(\\d+)[MDN=X]"), 1)
    span = F.aggregate(runs, F.lit(0), lambda n, r: n + r.cast("int"))
    nm = F.regexp_extract("value", "\tNM:i:(\\d+)", 1)
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("@")) & (F.length("value") > 0))
    return lines.select(
        f[0].alias("name"), (~on(SECONDARY) & ~on(SUPPLEMENTARY)).alias("is_primary"), (~on(UNMAPPED)).alias("is_mapped"), on(REVERSE).alias("is_reverse"), f[2].alias("ref"), (f[3].cast("int") - 1).alias("pos"),
        (f[3].cast("int") - 1 + span).alias("end_pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"), F.when(nm != "", nm.cast("int")).alias("nm"),
    )


def sam_lines(alignments: DataFrame) -> DataFrame:
    """``value``: a line an alignment, mates left out."""
    flag = F.when(F.col("is_mapped"), 0).otherwise(UNMAPPED) + F.when(F.col("is_reverse"), REVERSE).otherwise(0) + F.when(F.col("is_primary"), 0).otherwise(SECONDARY)
    text = lambda c: F.col(c).cast("string")
    nm = F.when(F.col("nm").isNotNull(), F.concat(F.lit("NM:i:"), text("nm")))
    return alignments.select(F.concat_ws("\t", "name", flag.cast("string"), "ref", (F.col("pos") + 1).cast("string"), text("mapq"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.coalesce("qual", F.lit("*")), nm).alias("value"))


def write_sam(alignments: DataFrame, references: DataFrame, path: str) -> None:
    """Header (``references``: ref, ref_length) and alignments as files whose names sort in that order."""
    head = references.select(F.concat(F.lit("@SQ\tSN:"), "ref", F.lit("\tLN:"), F.col("ref_length").cast("string")).alias("value"))
    write_in_order([head, sam_lines(alignments)], path)
