"""Contig scaffolding: links as a table (x, xs, y, ys, dist, sd, n_pairs), twins included."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from contigua.runtime import forget, join_unique, materialize


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, native (series of the error function by a rational approximation, 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def a_statistic(contigs: DataFrame, unique_from: float = 30.0, first: int = 20, rounds: int = 3) -> DataFrame:
    """``id``, ``len``, ``n``, ``copy_number``, ``a_stat``: arrival-rate statistic; the rate is learned from the ``first``
    longest contigs, then from those found unique, ``rounds`` times. Each round is one aggregate of one row."""
    c = contigs.select("id", "len", "n")
    top = c.orderBy(F.desc("len"), "id").limit(first).agg((F.sum("n") / F.sum("len")).alias("rate")).first()["rate"] or 0.0
    stat = lambda rate: F.lit(rate) * F.col("len") - F.col("n") * math.log(2)
    for _ in range(rounds):
        r = c.filter(stat(top) > unique_from).agg((F.sum("n") / F.sum("len")).alias("rate")).first()["rate"]
        top = r or top
    return c.select("id", "len", "n", (F.col("n") / (F.lit(top) * F.col("len"))).alias("copy_number"), stat(top).alias("a_stat"))


def classify(astat: DataFrame, unique_from: float = 20.0, min_copy: float = 0.3) -> DataFrame:
    """``id``, ``class``: unique, repeat or low_copy."""
    return astat.select("id", F.when(F.col("copy_number") < min_copy, "low_copy").when(F.col("a_stat") > unique_from, "unique").otherwise("repeat").alias("class"))


def n50(lengths: DataFrame, strict: bool = True, col: str = "len") -> DataFrame:
    """One row ``n50``: the length at which the running sum, longest first, passes half of all (``strict``: goes beyond it).

    Lengths are counted first, so the window runs over distinct lengths only.
    """
    by = lengths.groupBy(F.col(col).alias("len")).agg(F.sum(col).alias("bases"))
    w = W.orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, 0)
    x = by.select("len", F.sum("bases").over(w).alias("run"), F.sum("bases").over(W.partitionBy()).alias("total"))
    beyond = F.col("run") * 2 > F.col("total") if strict else F.col("run") * 2 >= F.col("total")
    return x.filter(beyond).agg(F.max("len").alias("n50"))


def symmetric_links(estimates: DataFrame, conflict_from: int = 100) -> DataFrame:
    """Distance estimates of both roots as one row an unordered pair: mean of the distances weighed by pairs, least sd, and
    ``conflict`` if they differ by more than ``conflict_from``."""
    flip = (F.col("x") > F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("xs") > 1 - F.col("ys")))
    norm = estimates.select(
        F.when(flip, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(flip, 1 - F.col("ys")).otherwise(F.col("xs")).alias("xs"),
        F.when(flip, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(flip, 1 - F.col("xs")).otherwise(F.col("ys")).alias("ys"), "dist", "sd", "n_pairs",
    )
    g = norm.groupBy("x", "xs", "y", "ys").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.min_by("dist", F.struct("sd", "dist")).alias("dist"), F.min("sd").alias("sd"), F.sum("n_pairs").alias("n_pairs"))
    return g.select("x", "xs", "y", "ys", "dist", "sd", "n_pairs", (F.col("hi") - F.col("lo") > conflict_from).alias("conflict"))


def twins(links: DataFrame) -> DataFrame:
    """Links in both directions."""
    back = links.select(F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"), F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"), "dist", "sd", "n_pairs")
    return links.select("x", "xs", "y", "ys", "dist", "sd", "n_pairs").unionByName(back)


def ambiguous_pairs(links: DataFrame, p: float = 0.01) -> DataFrame:
    """``x``, ``xs``, ``a``, ``b``: contigs linked to the same side whose order is wrong with probability over ``p``.

    Sides have few links, and pairs are formed within a side only.
    """
    a = links.select("x", "xs", F.col("y").alias("a"), F.col("dist").alias("da"), F.col("sd").alias("sa"))
    b = links.select("x", "xs", F.col("y").alias("b"), F.col("dist").alias("db"), F.col("sd").alias("sb"))
    j = a.join(b, ["x", "xs"]).filter((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))))
    wrong = 1 - normal_cdf((F.col("db") - F.col("da")) / F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")))
    return j.withColumn("p_wrong", wrong).filter(F.col("p_wrong") > p).select("x", "xs", "a", "b", "p_wrong")


def polymorphic(links: DataFrame, copies: DataFrame, p: float = 0.01, most_copies: float = 1.5) -> DataFrame:
    """``id`` of the contig of lower copy number in ambiguous pairs that together have fewer than ``most_copies``."""
    pairs = ambiguous_pairs(links, p)
    ca, cb = copies.select(F.col("id").alias("a"), F.col("copy_number").alias("ca")), copies.select(F.col("id").alias("b"), F.col("copy_number").alias("cb"))
    j = pairs.join(ca, "a").join(cb, "b").filter(F.col("ca") + F.col("cb") < most_copies)
    return j.select(F.when((F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a") > F.col("b"))), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()


def overlapping_sides(links: DataFrame, lengths: DataFrame, least: int = 400) -> DataFrame:
    """``x``, ``xs``, ``overlap``: sides two of whose contigs would overlap by ``least`` bases or more."""
    placed = links.join(lengths.select(F.col("id").alias("y"), "len"), "y").select("x", "xs", "y", F.col("dist").alias("s"), (F.col("dist") + F.col("len") - 1).alias("e"))
    o = placed.select("x", "xs", F.col("y").alias("y2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = placed.join(o, ["x", "xs"]).filter(F.col("y") < F.col("y2"))
    ov = F.least("e", "e2") - F.greatest("s", "s2") + 1
    return both.groupBy("x", "xs").agg(F.max(ov).alias("overlap")).filter(F.col("overlap") >= least)


def best_next(links: DataFrame) -> DataFrame:
    """The nearest link of each side (ties: more pairs, then id) that is so for both its ends."""
    w = W.partitionBy("x", "xs").orderBy("dist", F.desc("n_pairs"), "y", "ys")
    first = links.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    back = first.select(F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"), F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"))
    return first.join(back, ["x", "xs", "y", "ys"], "left_semi")


def gap_sequence(dist: Column, min_gap: int = 25) -> Column:
    """Ns for a gap of an estimated distance, ``min_gap`` at least."""
    return F.repeat(F.lit("N"), F.greatest(F.round(dist).cast("int"), F.lit(min_gap)))


def layout(scaffolds: DataFrame, min_gap: int = 25) -> DataFrame:
    """``scaffold``, ``seq``: contigs of a scaffold in order (``scaffold``, ``ord``, ``seq``, ``dist`` to the next) joined by
    gaps; a negative distance beyond the least gap skips as many bases of the next contig as it overlaps."""
    pieces = scaffolds.groupBy("scaffold").agg(F.array_sort(F.collect_list(F.struct("ord", "seq", "dist"))).alias("p"))
    before = lambda i: F.coalesce(F.when(i > 0, F.get(F.col("p"), i - 1)["dist"]), F.lit(0.0))
    cut = lambda x, i: F.substring(x["seq"], F.greatest(-F.round(before(i)).cast("int"), F.lit(0)) + 1, F.length(x["seq"]))
    gap = lambda x, i: F.when(x["dist"].isNull() | F.isnan(x["dist"]) | (i == F.size("p") - 1), "").otherwise(gap_sequence(x["dist"], min_gap))
    return pieces.select("scaffold", F.array_join(F.transform("p", lambda x, i: F.concat(cut(x, i), gap(x, i))), "").alias("seq"))


def without_conflicts(links: DataFrame) -> DataFrame:
    """Links whose estimates agree."""
    return links.filter(~F.col("conflict")).drop("conflict")


def single_sided(links: DataFrame) -> DataFrame:
    """Strict mode: links of sides that have no other, at both ends."""
    one = links.groupBy("x", "xs").agg(F.count("*").alias("_n")).filter("_n = 1").select("x", "xs")
    back = one.select(F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"))
    return links.join(one, ["x", "xs"], "left_semi").join(back, ["y", "ys"], "left_semi").select(*links.columns)


def transitive_links(links: DataFrame, most_apart: float = 3.0) -> DataFrame:
    """``x``, ``xs``, ``y``, ``ys`` of links that two others make up: x to m to y, with a sum of distances and the length of m
    within ``most_apart`` joint standard deviations. Sides have few links; pairs are formed through a contig only.

    ``links`` must have ``len_y``, the length of the contig that they lead to.
    """
    a = links.select("x", "xs", F.col("y").alias("m"), F.col("ys").alias("ms"), F.col("dist").alias("d1"), F.col("sd").alias("s1"), F.col("len_y").alias("len_m"))
    b = links.select(F.col("x").alias("m"), F.col("xs").alias("ms"), "y", "ys", F.col("dist").alias("d2"), F.col("sd").alias("s2"))
    paths = a.join(b, ["m", "ms"]).filter("x <> y").select("x", "xs", "y", "ys", (F.col("d1") + F.col("d2") + F.col("len_m")).alias("_d"), (F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")).alias("_v"))
    hit = links.join(paths, ["x", "xs", "y", "ys"]).filter(F.abs(F.col("dist") - F.col("_d")) <= most_apart * F.sqrt(F.col("sd") * F.col("sd") + F.col("_v")))
    return hit.select("x", "xs", "y", "ys").distinct()


def chains(contigs: DataFrame, links: DataFrame) -> DataFrame:
    """``scaffold``, ``ord`` (from 0), ``id``, ``st``, ``dist`` (to the next, null at the end): contigs in the order of
    unambiguous links (``best_next`` or ``single_sided``), each once; a chain and its turned twin give one scaffold.

    Rings are cut at their smallest oriented contig. Walking doubles its stride every round, over written tables.
    """
    both = contigs.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("st")).select((F.col("id") * 2 + F.col("st")).alias("v"))
    arcs = materialize(links.select((F.col("x") * 2 + F.col("xs")).alias("a"), (F.col("y") * 2 + F.col("ys")).alias("b"), "dist").dropDuplicates(["a", "b"]), "scaffold-arcs")
    for cut_rings in (False, True):
        back = arcs.select(F.col("b").alias("v"), F.col("a").alias("up"))
        j = both.join(back, "v", "left")
        state = materialize(j.select("v", F.coalesce("up", "v").alias("up"), F.col("up").isNotNull().cast("long").alias("steps"), F.least("v", F.coalesce("up", "v")).alias("low")), "scaffold-walk")
        total, span = both.count(), 1
        while span < 2 * total:
            far = state.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
            new = join_unique(state, far, "up").select("v", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("low", "low2").alias("low"), (F.col("steps2") > 0).alias("moved"))
            new = materialize(new, "scaffold-walk")
            forget(state)
            state, span = new, 2 * span
            if state.filter("moved").isEmpty():
                break
        inner = state.join(back.select(F.col("v").alias("up")), "up", "left_semi")
        if cut_rings or inner.isEmpty():
            break
        cut = inner.filter("low % 2 = 0").select("low").distinct()
        arcs = materialize(arcs.join(cut.select(F.col("low").alias("b")), "b", "left_anti").join(cut.select((F.col("low") + 1).alias("a")), "a", "left_anti"), "scaffold-arcs")
    placed = state.select("v", F.col("up").alias("head"), "steps")
    ends = placed.groupBy("head").agg(F.max_by("v", "steps").alias("last"))
    turned = F.when(F.col("last") % 2 == 0, F.col("last") + 1).otherwise(F.col("last") - 1)
    kept = ends.filter(F.col("head") <= turned).select("head")
    out = placed.join(kept, "head").join(arcs.select(F.col("a").alias("v"), "dist"), "v", "left")
    return out.select(F.shiftright("head", 1).alias("scaffold"), F.col("steps").alias("ord"), F.shiftright("v", 1).alias("id"), (F.col("v") % 2).cast("int").alias("st"), "dist")


def unplaced(contigs: DataFrame, placed: DataFrame, min_length: int = 0) -> DataFrame:
    """Contigs (id, seq) of ``min_length`` bases at least that no scaffold holds."""
    return contigs.filter(F.length("seq") >= min_length).join(placed.select("id"), "id", "left_anti")


def split_gaps(scaffolds: DataFrame) -> DataFrame:
    """``scaffold``, ``ord``, ``seq``, ``gap``: pieces between runs of N and the length of the run after each."""
    parts = F.regexp_extract_all("seq", F.lit("([ACGT]+)(N*)"), 1)
    gaps = F.regexp_extract_all("seq", F.lit("([ACGT]+)(N*)"), 2)
    return scaffolds.select("scaffold", F.posexplode(F.arrays_zip(parts.alias("seq"), gaps.alias("gap"))).alias("ord", "p")).select("scaffold", "ord", "p.seq", F.length("p.gap").alias("gap"))
