"""Tables of read alignments: pairs, their filters, evidence.

Columns: name, is_primary, is_mapped, is_reverse, ref, pos (from 0), end_pos, mapq, nm (null: none), seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.operators import kmers

_FIELDS = ("is_mapped", "is_reverse", "ref", "pos", "end_pos", "mapq", "nm", "seq")


def pairs(alignments: DataFrame, order: str = "rec") -> DataFrame:
    """``name`` and both primary records of it (``_1``, ``_2``), in the order of column ``order``; names without exactly two
    are left out."""
    rows = F.sort_array(F.collect_list(F.struct(order, *_FIELDS)))
    g = alignments.filter("is_primary").groupBy("name").agg(rows.alias("r")).filter(F.size("r") == 2)
    return g.select("name", *[F.col("r")[i][c].alias(f"{c}_{i + 1}") for i in (0, 1) for c in _FIELDS])


def filter_pairs(p: DataFrame, lengths: DataFrame, max_error: float | None = None, min_quality: int = 0, forward_reverse: bool = True, min_to_end: int = 0, reads: DataFrame | None = None, k: int = 31, max_depth: int | None = None) -> DataFrame:
    """``name``, ``reason``: pass, or the first filter that a mapped pair fails.

    Error rate (edits over length), mapping quality, k-mer depth of either read where they lie on different references
    (``reads`` is the set that depth is looked up in), forward-reverse orientation on one reference, and distance to the
    ends of two. ``lengths``: ref, ref_length.
    """
    mapped = p.filter("is_mapped_1 and is_mapped_2")
    for i in (1, 2):
        mapped = mapped.join(lengths.select(F.col("ref").alias(f"ref_{i}"), F.col("ref_length").alias(f"len_{i}")), f"ref_{i}", "left")
    rate = lambda i: F.coalesce(F.col(f"nm_{i}") / F.length(f"seq_{i}"), F.lit(0.0))
    apart = F.col("ref_1") != F.col("ref_2")
    first = F.col("pos_1") < F.col("pos_2")
    facing = ~F.when(first, F.col("is_reverse_1")).otherwise(F.col("is_reverse_2")) & F.when(first, F.col("is_reverse_2")).otherwise(F.col("is_reverse_1"))
    to_end = lambda i: F.least(F.col(f"pos_{i}"), F.col(f"len_{i}") - F.col(f"end_pos_{i}"))
    deep = F.lit(False)
    if reads is not None and max_depth is not None:
        both = mapped.filter(apart).select("name", F.explode(F.array("seq_1", "seq_2")).alias("seq")).withColumn("read_idx", F.xxhash64("name", "seq"))
        top = kmers.lookup(both.filter(F.col("seq").rlike("^[ACGT]*$")).select("read_idx", "seq"), kmers.both_strands(reads, k), k).groupBy("read_idx").agg(F.max("n").alias("depth"))
        depth = both.join(top, "read_idx").groupBy("name").agg(F.max("depth").alias("depth"))
        mapped = mapped.join(depth, "name", "left")
        deep = apart & (F.coalesce("depth", F.lit(0)) > max_depth)
    reason = F.lit("pass")
    if forward_reverse:
        reason = F.when(apart & ((to_end(1) < min_to_end) | (to_end(2) < min_to_end)), "near_end").otherwise(reason)
        reason = F.when(~apart & facing, "forward_reverse").otherwise(reason)
    reason = F.when(deep, "depth").otherwise(reason)
    reason = F.when((F.col("mapq_1") < min_quality) | (F.col("mapq_2") < min_quality), "quality").otherwise(reason)
    if max_error is not None:
        reason = F.when((rate(1) > max_error) | (rate(2) > max_error), "error_rate").otherwise(reason)
    return mapped.select("name", reason.alias("reason"))


def restore_reads(evidence: DataFrame, reads: DataFrame) -> DataFrame:
    """Evidence records named ``idx-N`` with id, sequence and quality of read number N; records of other names stay as they
    are."""
    n = F.regexp_extract("name", r"^idx-(\d+)$", 1)
    numbered = evidence.withColumn("_n", F.when(n != "", n.cast("long")))
    source = reads.select(F.col("read_idx").alias("_n"), F.col("id").alias("_id"), F.col("seq").alias("_seq"), F.col("qual").alias("_qual"))
    j = numbered.join(source, "_n", "left")
    return j.withColumns({"name": F.coalesce("_id", "name"), "seq": F.coalesce("_seq", "seq"), "qual": F.coalesce("_qual", "qual")}).drop("_n", "_id", "_seq", "_qual")
