"""Haplotype builders on de Bruijn adjacency, gap filling, and haplotype frequencies."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.functions import sequence as S

_RC = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s.translate(_RC)[::-1]


def build(counts: dict[str, int], start: str, end: str, least: int, max_rounds: int = 2000, max_live: int = 20, max_found: int = 50) -> list[str]:
    """Strings from one anchor k-mer to another whose k-mers all come ``least`` times (canonical counts); none if a bound on
    live branches or rounds is passed."""
    k, live, found = len(start), [start], []
    for _ in range(max_rounds):
        new = []
        for s in live:
            for b in "ACGT":
                w = s[-k + 1 :] + b if k > 1 else b
                if counts.get(min(w, rc(w)), 0) >= least:
                    if w == end:
                        found.append(s + b)
                    else:
                        new.append(s + b)
        if len(new) > max_live or len(found) > max_found:
            return []
        live = new
        if not live:
            break
    else:
        return []
    return sorted(found)


def fill_gaps(gaps: DataFrame, counts: DataFrame, k: int, least: int = 3, max_off: int = 100) -> DataFrame:
    """``gap_id``, ``filled``: the path between the flanks of each gap whose size is nearest to the estimate, or null.

    ``gaps``: gap_id, left, right (flanks), size; ``counts``: gap_id, kmer, n of the k-mers that may lie in each gap, found
    by the caller's joins. An anchor needs more than ``least`` occurrences, a step ``least``. A group is one gap.
    """

    def one(key: tuple, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        table = dict(zip(c["kmer"], c["n"], strict=True))
        a, b, out = r["left"][-k:], r["right"][:k], None
        if len(a) == k == len(b) and table.get(min(a, rc(a)), 0) > least and table.get(min(b, rc(b)), 0) > least:
            inner = [(abs(len(s) - 2 * k - int(r["size"])), s[k:-k]) for s in build(table, a, b, least)]
            if inner and min(inner)[0] <= max_off:
                out = min(inner)[1]
        return pd.DataFrame({"gap_id": [key[0]], "filled": [out]})

    return gaps.groupBy("gap_id").cogroup(counts.groupBy("gap_id")).applyInPandas(lambda key, g, c: one(key, g, c) if len(g) else pd.DataFrame({"gap_id": [], "filled": []}), "gap_id long, filled string")


def frequencies(likelihoods: list[list[float]], tolerance: float = 1e-4, rounds: int = 200) -> list[float]:
    """Haplotype frequencies from log-likelihoods of reads (rows) under haplotypes (columns), by expectation maximisation."""
    if not likelihoods:
        return []
    n = len(likelihoods[0])
    f = [1 / n] * n
    for _ in range(rounds):
        share = [0.0] * n
        for row in likelihoods:
            top = max(row)
            w = [p * math.exp(x - top) for p, x in zip(f, row, strict=True)]
            z = sum(w)
            for i in range(n):
                share[i] += w[i] / z
        new = [s / len(likelihoods) for s in share]
        if max(abs(a - b) for a, b in zip(f, new, strict=True)) < tolerance:
            return new
        f = new
    return f


def genotype(likelihoods: list[list[float]]) -> tuple[str, int, list[float]]:
    """Diploid genotype of two haplotypes (columns), its quality, and log10 likelihoods of 0/0, 0/1 and 1/1; ``./.`` up to 5."""
    gl = [0.0, 0.0, 0.0]
    for a, b in likelihoods:
        top = max(a, b)
        gl[0] += a
        gl[1] += top + math.log(0.5 * (math.exp(a - top) + math.exp(b - top)))
        gl[2] += b
    best = sorted(range(3), key=lambda i: -gl[i])
    quality = int(min(99, 10 * (gl[best[0]] - gl[best[1]]) / math.log(10)))
    return ("./." if quality <= 5 else ("0/0", "0/1", "1/1")[best[0]]), quality, [x / math.log(10) for x in gl]


def read_likelihood(read: str, haplotype: str, error: float = 0.01) -> float:
    """Log-likelihood of a read at its best ungapped place in a haplotype."""
    best = -math.inf
    for at in range(len(haplotype) - len(read) + 1):
        bad = sum(x != y for x, y in zip(read, haplotype[at : at + len(read)], strict=True))
        best = max(best, bad * math.log(error / 3) + (len(read) - bad) * math.log(1 - error))
    return best if best > -math.inf else len(read) * math.log(error / 3)


def novel_components(kmers: DataFrame, k: int) -> DataFrame:
    """``kmer``, ``component``: k-mers of a contrast grouped by shared (k-1)-mers, so that each event is built once."""
    from contigua.operators import graph

    ids = kmers.select("kmer", F.xxhash64("kmer").alias("id"))
    ends = ids.select("id", F.explode(F.array(*[F.least(x, F.reverse(F.translate(x, "ACGT", "TGCA"))) for x in (F.substring("kmer", 1, k - 1), F.right("kmer", F.lit(k - 1)))])).alias("end"))
    first = ends.groupBy("end").agg(F.min("id").alias("x"))
    links = ends.join(first, "end").filter("x != id").select("x", F.col("id").alias("y"))
    return ids.join(graph.components(ids.select("id"), links), "id").select("kmer", "component")


def genotypes(likelihoods: DataFrame) -> DataFrame:
    """``locus``, ``gt``, ``gq``, ``gl_00``, ``gl_01``, ``gl_11``: diploid genotypes of all loci in one aggregation.

    ``likelihoods``: locus, ll_ref, ll_alt, the log-likelihoods of a read under both haplotypes. Ties go to the one with
    fewer alternative alleles; ``./.`` up to quality 5.
    """
    a, b, scale = F.col("ll_ref"), F.col("ll_alt"), math.log(10)
    top = F.greatest(a, b)
    g = likelihoods.groupBy("locus").agg((F.sum(a) / scale).alias("gl_00"), (F.sum(top + F.log(0.5 * (F.exp(a - top) + F.exp(b - top)))) / scale).alias("gl_01"), (F.sum(b) / scale).alias("gl_11"))
    order = F.sort_array(F.array("gl_00", "gl_01", "gl_11"), asc=False)
    quality = F.least(F.lit(99), F.floor(10 * (order[0] - order[1]))).cast("int")
    best = F.when(F.col("gl_00") == order[0], "0/0").when(F.col("gl_01") == order[0], "0/1").otherwise("1/1")
    return g.select("locus", F.when(quality <= 5, "./.").otherwise(best).alias("gt"), quality.alias("gq"), "gl_00", "gl_01", "gl_11")


def ungapped_log_likelihood(read: Column, haplotype: Column, error: float = 0.01) -> Column:
    """Log-likelihood of a read at its best ungapped place in a haplotype; all bases wrong where it is longer."""
    n = F.length(read)
    places = F.transform(F.sequence(F.lit(1), F.length(haplotype) - n + 1), lambda p: S.hamming(F.substring(haplotype, p, n), read))
    bad = F.when(n > F.length(haplotype), n).otherwise(F.array_min(places))
    return bad * math.log(error / 3) + (n - bad) * math.log(1 - error)
