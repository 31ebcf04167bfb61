"""Variant tables: contrasts of k-mers, classes, filters, neighbourhoods, segregation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from contigua.functions import sequence as S
from contigua.runtime import ship

#: Width of the position buckets of a range join.
BUCKET = 10_000


def variant_class(ref: Column, alt: Column) -> Column:
    """SUB, DEL, INS or COMPLEX: equal lengths, one the beginning of the other, or neither."""
    return (
        F.when(F.length(ref) == F.length(alt), "SUB")
        .when((F.length(ref) > F.length(alt)) & F.startswith(ref, alt), "DEL")
        .when((F.length(ref) < F.length(alt)) & F.startswith(alt, ref), "INS")
        .otherwise("COMPLEX")
    )


def first_of_each(variants: DataFrame, order: str) -> DataFrame:
    """One row a chrom, pos, ref, alt: the first by ``order``."""
    w = W.partitionBy("chrom", "pos", "ref", "alt").orderBy(order)
    return variants.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def near_variants(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """``chrom``, ``pos_a``, ``pos_b``: variants of ``b`` less than ``distance`` away; a join on position buckets, each row
    of ``a`` in the buckets that its range meets."""
    lo, hi = F.floor((F.col("pos") - distance) / BUCKET), F.floor((F.col("pos") + distance) / BUCKET)
    x = a.select("chrom", F.col("pos").alias("pos_a"), F.explode(F.sequence(lo, hi)).alias("bucket"))
    y = b.select("chrom", F.col("pos").alias("pos_b"), F.floor(F.col("pos") / BUCKET).alias("bucket"))
    return x.join(y, ["chrom", "bucket"]).filter(F.abs(F.col("pos_a") - F.col("pos_b")) < distance).select("chrom", "pos_a", "pos_b")


def contrast_calls(variant: DataFrame, base: DataFrame) -> DataFrame:
    """Calls that pass in the variant set and were not called in the base set at the same place, with the base's quality."""
    b = base.filter(F.col("filter") == "NoCall").select("chrom", "pos", F.col("qual").alias("base_qual"))
    return variant.filter(F.col("filter") == "PASS").join(b, ["chrom", "pos"])


def with_base_quality(calls: DataFrame) -> DataFrame:
    """Contrasted calls with the base set's quality as tag ``BQ`` at the end of ``info``."""
    return calls.withColumn("info", F.concat_ws(";", F.when(F.length("info") > 0, F.col("info")), F.concat(F.lit("BQ="), F.col("base_qual").cast("string"))))


def repeat_units(seq: Column, start: Column, ref: Column, alt: Column) -> tuple[Column, Column]:
    """The repeated unit of an event (the bases put in or taken out, or the new ones of a substitution), and how many of it
    stand in a row in the reference around the first that begins within the event; ``start`` (from 0) is its first base."""
    indel = F.left(ref, F.lit(1)) == F.left(alt, F.lit(1))
    more = F.when(F.length(alt) > F.length(ref), alt).otherwise(ref)
    unit = F.when(indel, F.substring(more, F.lit(2), F.length(more))).otherwise(alt)
    first = F.call_function("locate", unit, seq, start + 1) - 1
    found = (first >= 0) & (first <= start + F.length(ref)) & (F.length(unit) > 0)
    run = lambda s, u: (F.length(s) - F.length(F.regexp_replace(s, F.concat(F.lit("^("), u, F.lit(")+")), F.lit("")))) / F.length(u)
    after, before = F.substring(seq, first + 1, F.length(seq)), F.reverse(F.substring(seq, F.lit(1), first))
    return unit, F.when(found, run(after, unit) + run(before, F.reverse(unit))).otherwise(0).cast("int")


def parameters(text: str) -> dict[str, float | str]:
    """``key:value,key:value`` as a dictionary; values that are numbers as such."""
    out: dict[str, float | str] = {}
    for pair in filter(None, text.split(",")):
        key, found, value = pair.partition(":")
        if not found:
            raise ValueError(f"no value: {pair}")
        try:
            out[key] = float(value)
        except ValueError:
            out[key] = value
    return out


def info_map(info: Column) -> Column:
    """``key=value;...`` as a map."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def somatic_filters(
    v: DataFrame, max_homopolymer: int = 7, max_dust: float = 2.0, min_af: float = 0.0, min_var_dp: int = 0, min_haplotype: int = 0, max_strand_bias: float = 2.0,
    max_normal_reads: int = 0, min_normal_depth: int = 5, min_median_quality: float = 15.0, max_median_quality_zero: float = 0.5, min_mapping_quality: float = 0.0, depth_limit: int = 10**9,
) -> DataFrame:
    """Adds ``filter``: the names of all filters that a call fails, joined by semicolons, or PASS."""
    rules = [
        ("Homopolymer", F.col("homopolymer") > max_homopolymer), ("LowComplexity", F.col("dust") >= max_dust), ("LowAlleleFrequency", F.col("af") < min_af),
        ("LowVarDP", F.col("var_dp") < min_var_dp), ("ShortHaplotype", F.col("hap_len") < min_haplotype), ("StrandBias", F.col("strand_bias") >= max_strand_bias),
        ("NormalEvidence", F.col("normal_var_reads") > max_normal_reads), ("LowNormalDepth", F.col("normal_depth") < min_normal_depth),
        ("LowQuality", F.col("median_quality") < min_median_quality), ("PossibleError", F.col("zero_quality_share") > max_median_quality_zero),
        ("LowMappingQuality", F.col("mapping_quality") < min_mapping_quality), ("DepthLimitReached", F.col("depth") >= depth_limit),
    ]
    failed = F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))
    return v.withColumn("filter", F.when(F.size(failed) == 0, "PASS").otherwise(F.concat_ws(";", failed)))


def homopolymer_at(seq: Column, pos: Column) -> Column:
    """Length of the run of the base at a place (from 1)."""
    base = F.substring(seq, pos, F.lit(1))
    after = F.substring(seq, pos, F.length(seq))
    before = F.reverse(F.substring(seq, F.lit(1), pos))
    run = lambda s: F.length(s) - F.length(F.ltrim(s, base))
    return run(after) + run(before) - 1


def three_mer_context(seq: Column, pos: Column) -> Column:
    """The bases around a place, N beyond the ends."""
    padded = F.concat(F.lit("N"), seq, F.lit("N"))
    return F.substring(padded, pos, F.lit(3))


def haploid_ratio(counts: DataFrame, error: float = 0.01) -> DataFrame:
    """``variant``, ``lm``: log-likelihood of segregation among samples (each has the variant in all its reads or none)
    over that of errors alone; ``counts``: variant, sample, depth, alt."""
    n, a = F.col("depth"), F.col("alt")
    shared = a * math.log(error) + (n - a) * math.log(1 - error)
    carrier = a * math.log(1 - error) + (n - a) * math.log(error)
    freq = F.col("carriers") / F.col("samples")
    per = counts.groupBy("variant").agg(F.count_if(a * 2 >= n).alias("carriers"), F.count("*").alias("samples"))
    rows = counts.join(per, "variant")
    mixed = S.log_sum_exp(F.log(F.greatest(freq, F.lit(1e-3))) + carrier, F.log(F.greatest(1 - freq, F.lit(1e-3))) + shared)
    return rows.groupBy("variant").agg(F.sum(mixed - shared).alias("lm"))


def population_counts(reads_with_kmer: DataFrame, samples: DataFrame) -> DataFrame:
    """``kmer``, ``sample``, ``n``: occurrences by sample; ``samples`` (start, end, sample) has one range a sample and is
    the size of the sample list."""
    j = reads_with_kmer.join(samples, (F.col("read_idx") >= F.col("start")) & (F.col("read_idx") <= F.col("end")))
    return j.groupBy("kmer", "sample").agg(F.count("*").alias("n"))


def detectability(reads: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """``doc_id``, ``mutations``, ``novel``: of all single-base changes of a sequence how many make some covering k-mer that
    the reads don't have. Changes are written out per covering window and anti-joined."""
    from contigua.operators import kmers

    have = kmers.both_strands(reads, k).select("kmer")
    s = seqs.filter(F.length("seq") >= k).select("doc_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("at"))
    m = s.withColumn("base", F.explode(F.array(*[F.lit(b) for b in "ACGT"]))).filter(F.col("base") != F.substring("seq", F.col("at"), F.lit(1)))
    w = m.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - k + 1), F.least(F.col("at"), F.length("seq") - k + 1))))
    inner = F.col("at") - F.col("start")
    km = F.concat(F.substring("seq", F.col("start"), inner), F.col("base"), F.substring("seq", F.col("at") + 1, k - 1 - inner))
    novel = w.select("doc_id", "at", "base", S.canonical(km).alias("kmer")).join(have, "kmer", "left_anti").select("doc_id", "at", "base").distinct().groupBy("doc_id").agg(F.count("*").alias("novel"))
    total = seqs.filter(F.length("seq") >= k).select("doc_id", (F.length("seq") * 3).cast("long").alias("mutations"))
    return total.join(novel, "doc_id", "left").select("doc_id", "mutations", F.coalesce("novel", F.lit(0)).alias("novel"))


def germline_haplotypes(windows: DataFrame, most_nearby: int = 4) -> DataFrame:
    """``row_no``, ``haplotype``: a variant applied to its reference window together with every combination of the nearby
    germline variants, where there are ``most_nearby`` at most (else none).

    ``windows``: row_no, seq, start (place of its first base, from 1), pos, ref, alt, nearby (array of pos, ref, alt).
    Combinations that overlap, or whose reference bases differ from the window, are left out.
    """
    from collections.abc import Iterator
    from itertools import combinations

    import pandas as pd

    def apply(seq: str, start: int, edits: list[tuple[int, str, str]]) -> str | None:
        out, last = [], 0
        for pos, ref, alt in sorted(edits):
            at = pos - start
            if at < last or seq[at : at + len(ref)] != ref:
                return None
            out += [seq[last:at], alt]
            last = at + len(ref)
        return "".join([*out, seq[last:]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                near = [(x["pos"], x["ref"], x["alt"]) for x in (r.nearby if r.nearby is not None else [])]
                if len(near) <= most_nearby:
                    made = {apply(r.seq, r.start, [(r.pos, r.ref, r.alt), *c]) for n in range(len(near) + 1) for c in combinations(near, n)}
                    rows += [(r.row_no, h) for h in sorted(made - {None})]
            yield pd.DataFrame(rows, columns=["row_no", "haplotype"])

    return windows.select("row_no", "seq", "start", "pos", "ref", "alt", "nearby").mapInPandas(run, "row_no long, haplotype string")


def concordance(haplotypes: DataFrame, variant_counts: DataFrame, base_counts: DataFrame, k: int, beyond: int = 5) -> DataFrame:
    """``row_no``, ``unique_kmers``, ``class``: windows of a variant's haplotypes that the variant reads have and the base
    reads don't, the most of any haplotype; SOMATIC if more than ``beyond``, else GERMLINE."""
    from contigua.operators import kmers

    h = haplotypes.select("row_no", F.xxhash64("row_no", "haplotype").alias("read_idx"), F.col("haplotype").alias("seq"))
    occ = kmers.occurrences(h, k).select("read_idx", "pos", F.col("c").alias("kmer"))
    only = occ.join(variant_counts.select("kmer"), "kmer", "left_semi").join(base_counts.select("kmer"), "kmer", "left_anti")
    per = h.select("row_no", "read_idx").join(only.groupBy("read_idx").agg(F.count("*").alias("n")), "read_idx", "left")
    top = per.groupBy("row_no").agg(F.coalesce(F.max("n"), F.lit(0)).alias("unique_kmers"))
    return top.select("row_no", "unique_kmers", F.when(F.col("unique_kmers") > beyond, "SOMATIC").otherwise("GERMLINE").alias("class"))


def segregation_scores(haps: DataFrame, depths: list[float], allele_depth: float) -> DataFrame:
    """Adds ``lm_haploid``, ``lm_diploid`` (all samples of ``allele_depth`` an allele), ``lm_haploid_depths`` and
    ``lm_diploid_depths`` (samples of these ``depths``): log-likelihood of carriers and others over that of reads spread
    evenly, from ``counts`` (reads of the haplotype by sample, in the order of ``depths``).

    Counts of a batch are scored once, however many haplotypes have them. Null where no carrier is expected (no reads, or
    too few for half an allele), or without counts. Carriers are at most the samples; an allele's share stays between 1e-9
    and 1 - 1e-9.
    """
    ship(haps.sparkSession)
    n, names = len(depths), ["lm_haploid", "lm_diploid", "lm_haploid_depths", "lm_diploid_depths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("counts"))
            whole = lists.is_valid().to_numpy(zero_copy_only=False)
            rows = lists.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            kinds, which = np.unique(rows, axis=0, return_inverse=True)
            scores, at = _segregation(kinds, np.array(depths, float), allele_depth), np.full(len(lists), len(kinds))
            at[whole] = which.reshape(-1)
            at = pa.array(at)
            more = [pa.array(np.append(s, np.nan), from_pandas=True).take(at) for s in scores]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    schema = T.StructType([*haps.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    return haps.mapInArrow(run, schema)


def _segregation(counts: np.ndarray, depths: np.ndarray, allele_depth: float) -> list[np.ndarray]:
    """The four scores of every row of ``counts``, a column a sample; NaN where there is none."""
    n, mean, total = counts.shape[1], depths.sum() / len(depths), counts.sum(1)

    def score(carriers: np.ndarray, share: np.ndarray, scale: np.ndarray, diploid: bool) -> np.ndarray:
        share, out = np.clip(share, 1e-9, 1 - 1e-9), np.zeros(len(counts))
        for c, s in zip(counts.T, scale, strict=True):
            p, q = s * total / n, s * total / carriers
            # in logarithms: likelihoods of many reads are no doubles; only a sample without any has a chance of no carrier
            if diploid:
                het, hom = np.log(2 * share * (1 - share)) + c * np.log(q) - q, 2 * np.log(share) + c * np.log(2 * q) - 2 * q
                carried, none = np.logaddexp(het, hom), 2 * np.log(1 - share)
            else:
                carried, none = np.log(share) + c * np.log(q) - q, np.log(1 - share)
            out += np.where(c == 0, np.logaddexp(carried, none), carried) - c * np.log(p) + p
        return np.where((total > 0) & (carriers > 0), out, np.nan)

    with np.errstate(all="ignore"):
        whole = np.floor(total / allele_depth + 0.5)
        by_depth, alleles, few, even = total / mean, 2 * (counts / depths).sum(1), np.minimum(whole, n), np.ones(n)
        return [score(few, few / n, even, False), score(few, whole / (2 * n), even, True), score(by_depth, by_depth / n, depths / mean, False), score(alleles, alleles / (2 * n), depths / mean, True)]


def strand_bias(forward: Column, reverse: Column, points: int = 50, limit: float = 0.35) -> Column:
    """Log Bayes factor of strand bias: forward shares on a grid beyond ``limit`` from a half against a grid within it.

    The upper side of the biased grid goes from 1 down by a quarter of the lower side's steps. No reads: 0.
    """
    half = range(1, points // 2 + 1)
    step = 2 / (points + 1)
    biased = [q for i in half for q in (i * limit * step, 1 - i * limit * step / 4)]
    fair = [q for i in half for q in (0.5 + (0.5 - limit) * i * step, 0.5 - (0.5 - limit) * i * step)]

    def evidence(grid: list[float]) -> Column:
        terms = F.transform(F.array(*[F.lit(q) for q in grid]), lambda q: F.log(q) * forward + F.log(1 - q) * reverse)
        top = F.array_max(terms)
        return top + F.log(F.aggregate(terms, F.lit(0.0), lambda s, x: s + F.exp(x - top)))

    return F.when(forward + reverse == 0, 0.0).otherwise(evidence(biased) - evidence(fair))
