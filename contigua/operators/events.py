"""Haplotypes against the reference: unique places by their ends, alignment, and the events that tell them apart."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.functions import sequence as S
from contigua.runtime import ship

#: Events and share of differing columns beyond which an alignment isn't believed, places of an end that are looked at.
MOST_EVENTS, MOST_DIFFER, MOST_HITS = 8, 0.05, 3


def left_align(reference: str, at: int, ref: str, alt: str) -> tuple[int, str, str]:
    """An insertion or deletion (one of ``ref`` and ``alt`` is empty) moved to its leftmost place, 0-based, without an anchor base."""
    moved = ref or alt
    while at > 0 and reference[at - 1] == moved[-1]:
        moved = reference[at - 1] + moved[:-1]
        at -= 1
    return (at, moved, "") if ref else (at, "", moved)


def events_of(reference: str, haplotype: str, ops: str) -> list[tuple[int, str, str]]:
    """(position from 0, reference bases, haplotype bases) of an alignment: runs of mismatches as one, gaps left-aligned with the base
    before them (after them, at the very start), in order."""
    out, i, j, k = [], 0, 0, 0
    while k < len(ops):
        if ops[k] == "M":
            if reference[i] == haplotype[j]:
                i, j, k = i + 1, j + 1, k + 1
                continue
            n = 1
            while k + n < len(ops) and ops[k + n] == "M" and reference[i + n] != haplotype[j + n]:
                n += 1
            out.append((i, reference[i : i + n], haplotype[j : j + n]))
            i, j, k = i + n, j + n, k + n
            continue
        n = 1
        while k + n < len(ops) and ops[k + n] == ops[k]:
            n += 1
        gone = ops[k] == "D"
        at, ref, alt = left_align(reference, i, reference[i : i + n] if gone else "", "" if gone else haplotype[j : j + n])
        if at > 0:
            out.append((at - 1, reference[at - 1] + ref, reference[at - 1] + alt))
        else:
            after = reference[len(ref) : len(ref) + 1]
            out.append((0, ref + after, alt + after))
        i, j, k = i + n * gone, j + n * (not gone), k + n
    return sorted(out)


def places(haplotypes: DataFrame, references: DataFrame, k: int = 31) -> DataFrame:
    """``hap``, ``ref_id``, ``turned``, ``start``, ``end`` (from 1, inclusive), ``seq`` (on the reference's strand), ``piece``: where the first
    and the last k-mer of a haplotype lie on one reference, in order and on one strand.

    ``haplotypes``: hap, seq; ``references``: ref_id, seq. Ends that come more than ``MOST_HITS`` times in the references, and
    haplotypes with more than one place, give none. Reference k-mers are met in an equi-join with the ends alone.
    """
    long = haplotypes.filter(F.length("seq") >= k)
    both = long.select("hap", F.lit(False).alias("turned"), "seq").unionByName(long.select("hap", F.lit(True).alias("turned"), S.reverse_complement(F.col("seq")).alias("seq")))
    ends = both.select("hap", "turned", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.left("seq", F.lit(k)).alias("kmer")), F.struct(F.lit(1).alias("side"), F.right("seq", F.lit(k)).alias("kmer")))).alias("e")).select("hap", "turned", "e.*")
    spread = references.filter(F.length("seq") >= k).select("ref_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("pos"))
    windows = spread.select("ref_id", "pos", F.substring("seq", F.col("pos"), F.lit(k)).alias("kmer"))
    hits = windows.join(ends.select("kmer").distinct(), "kmer", "left_semi")
    few = hits.groupBy("kmer").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_HITS).select("kmer")
    at = ends.join(hits.join(few, "kmer"), "kmer")
    first = at.filter("side = 0").select("hap", "turned", "ref_id", F.col("pos").alias("start"))
    last = at.filter("side = 1").select("hap", "turned", "ref_id", (F.col("pos") + k - 1).alias("end"))
    pairs = first.join(last, ["hap", "turned", "ref_id"]).filter(F.col("end") - F.col("start") >= k - 1)
    one = pairs.groupBy("hap").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("turned", "ref_id", "start", "end")]).filter("n = 1").drop("n")
    placed = one.join(both, ["hap", "turned"]).join(references.select("ref_id", F.col("seq").alias("_ref")), "ref_id")
    return placed.select("hap", "ref_id", "turned", "start", "end", "seq", F.substring("_ref", F.col("start"), F.col("end") - F.col("start") + 1).alias("piece"))


def call_events(placed: DataFrame) -> DataFrame:
    """``hap``, ``ref_id``, ``pos`` (from 1), ``ref``, ``alt`` of the events of every placed haplotype. Alignments of more than
    ``MOST_EVENTS`` events or ``MOST_DIFFER`` of differing columns give none; nor do equal texts."""
    from contigua.operators import align

    ship(placed.sparkSession)
    slim = placed.select("hap", "ref_id", "start", "piece", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hap, ref_id, start, piece, seq = (b.column(i).to_pylist() for i in range(5))
            pairs = list(zip(piece, seq, strict=True))
            rows = []
            for i, ((r, h), (_, ops)) in enumerate(zip(pairs, align.affine_batch(pairs), strict=True)):
                found = events_of(r, h, ops)
                differ = sum(max(len(x), len(y)) for _, x, y in found)
                if len(found) <= MOST_EVENTS and differ <= MOST_DIFFER * max(len(ops), 1):
                    rows += [(hap[i], ref_id[i], start[i] + at, x, y) for at, x, y in found]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [b.schema.field(0).type, b.schema.field(1).type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["hap", "ref_id", "pos", "ref", "alt"])

    return slim.mapInArrow(run, f"hap {slim.schema['hap'].dataType.simpleString()}, ref_id {slim.schema['ref_id'].dataType.simpleString()}, pos long, ref string, alt string")
