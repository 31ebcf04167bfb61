"""String-overlap joins on oriented reads.

Every read stands twice: as it is (``st`` 0) and reverse-complemented (``st`` 1). A suffix of one oriented read equal to a
prefix of another is an edge; this gives the four strand cases at once, and each edge has a twin on the other strands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.functions import sequence as S
from contigua.operators import meets
from contigua.operators.kmers import occurrences
from contigua.runtime import materialize


def oriented(reads: DataFrame) -> DataFrame:
    """``id``, ``st``, ``seq`` of both orientations."""
    one = reads.select(F.col("read_idx").alias("id"), F.lit(0).alias("st"), "seq")
    return one.unionByName(reads.select(F.col("read_idx").alias("id"), F.lit(1).alias("st"), S.reverse_complement(F.col("seq")).alias("seq")))


def exact_overlaps(reads: DataFrame, min_overlap: int = 45) -> DataFrame:
    """``x``, ``xs``, ``y``, ``ys``, ``ov``: the longest proper suffix of x that is a prefix of y, ``min_overlap`` at least.

    Reads of bases meet packed, in buckets of their windows (``meets.overlaps``); ``reads`` should be a written table. With
    other letters the first ``min_overlap`` bases of y are equi-joined to the windows of x and the rest is verified there.
    """
    if meets.all_bases(reads):
        return meets.overlaps(reads, min_overlap)
    o = oriented(reads)
    heads = o.select(F.col("id").alias("y"), F.col("st").alias("ys"), F.col("seq").alias("t"), F.substring("seq", 1, min_overlap).alias("w"))
    at = F.sequence(F.lit(2), F.length("seq") - min_overlap + 1)
    tails = o.filter(F.length("seq") > min_overlap).select(F.col("id").alias("x"), F.col("st").alias("xs"), "seq", F.explode(at).alias("p"))
    tails = tails.select("x", "xs", F.substring("seq", F.col("p"), F.length("seq")).alias("tail"), F.substring("seq", F.col("p"), F.lit(min_overlap)).alias("w"))
    ov = F.length("tail")
    hits = tails.join(heads, "w").filter((F.col("x") != F.col("y")) & (F.length("t") > ov) & F.startswith("t", "tail"))
    return hits.groupBy("x", "xs", "y", "ys").agg(F.max(ov).alias("ov"))


def one_way(edges: DataFrame) -> DataFrame:
    """One of each edge and its twin: the one with the lesser first end."""
    return edges.filter((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("xs") <= 1 - F.col("ys"))))


def irreducible(edges: DataFrame, lengths: int | DataFrame) -> DataFrame:
    """Edges that no two others make up: x to z goes if there is a y with label(xy) + label(yz) = label(xz).

    ``lengths``: length of the reads, or a table ``id``, ``n`` of their lengths; a label is what the second read adds to the
    first. Paths that lead farther than the longest label of their start are no rows of the shuffle.
    """
    if isinstance(lengths, int):
        e = edges.select("x", "xs", "y", "ys", (lengths - F.col("ov")).alias("lab"))
    else:
        e = edges.join(lengths.select(F.col("id").alias("y"), F.col("n").cast("int").alias("_n")), "y").select("x", "xs", "y", "ys", (F.col("_n") - F.col("ov")).alias("lab"))
    far = e.groupBy("x", "xs").agg(F.max("lab").alias("far"))
    first = e.join(far, ["x", "xs"])
    second = e.select(F.col("x").alias("y"), F.col("xs").alias("ys"), F.col("y").alias("z"), F.col("ys").alias("zs"), F.col("lab").alias("lab2"))
    paths = first.join(second, ["y", "ys"]).filter(F.col("lab") + F.col("lab2") <= F.col("far"))
    composed = paths.select("x", "xs", F.col("z").alias("y"), F.col("zs").alias("ys"), (F.col("lab") + F.col("lab2")).alias("lab")).distinct()
    return e.join(composed, ["x", "xs", "y", "ys", "lab"], "left_anti")


def inexact_overlaps(reads: DataFrame, min_overlap: int = 45, error_rate: float = 0.04, most_seed_hits: int = 200) -> DataFrame:
    """``x``, ``xs``, ``y``, ``ys``, ``ov``, ``diff``: suffix and prefix with up to ``error_rate`` mismatches, no gaps.

    Prefixes of the least overlap are cut into so many seeds that one of them is free of errors; a seed of y found in x
    fixes the overlap, which is then counted out. A longer overlap may hold more errors than seeds in its first part, so
    it is found only if one seed is clean. Seeds that more than ``most_seed_hits`` prefixes share are dealt out: their
    prefixes and their windows in so many parts, and every part of the one meets every part of the other.
    """
    pieces = int(error_rate * min_overlap) + 1
    size = min_overlap // pieces
    o = oriented(reads)
    heads = o.filter(F.length("seq") >= min_overlap).select(F.col("id").alias("y"), F.col("st").alias("ys"), F.col("seq").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("j"))
    heads = heads.withColumn("w", F.substring("t", F.col("j") * size + 1, F.lit(size)))
    tails = o.select(F.col("id").alias("x"), F.col("st").alias("xs"), "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - size + 1)).alias("p"))
    tails = tails.withColumn("w", F.substring("seq", F.col("p"), F.lit(size)))
    start = F.col("p") - F.col("j") * size
    # few by nature, and tables, so that their size is known and windows aren't moved to meet them
    hot = materialize(heads.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") > most_seed_hits), "hot-seeds")
    hot = tails.select("w").join(hot, "w").groupBy("w").agg(F.first("n").alias("n_head"), F.count("*").alias("n_tail"))
    parts = lambda n: F.ceil(n / F.lit(most_seed_hits)).cast("int")
    hot = materialize(hot.select("w", parts(F.col("n_head")).alias("of_head"), parts(F.col("n_tail")).alias("of_tail")), "hot-parts")

    def deal(side: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        """The part of each row, and the row once for every part of the other side."""
        of = lambda part: F.coalesce(f"of_{part}", F.lit(1))
        dealt = side.join(hot, "w", "left").withColumn(own, F.pmod(F.xxhash64(*by), of(own)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), of(other) - 1))).drop("of_head", "of_tail")

    heads, tails = deal(heads, "head", "tail", "y", "ys", "j"), deal(tails, "tail", "head", "x", "xs", "p")
    hits = tails.join(heads, ["w", "head", "tail"]).withColumn("start", start).filter((F.col("x") != F.col("y")) & (F.col("start") >= 2))
    hits = hits.withColumn("ov", F.length("seq") - F.col("start") + 1).filter((F.col("ov") >= min_overlap) & (F.col("ov") < F.length("t")))
    # placements are verified where they are found, before anything is dealt out by pairs; the group takes repeats together
    a, b = F.substring("seq", F.col("start"), F.length("seq")), F.substring("t", F.lit(1), F.col("ov"))
    pairs = hits.select("x", "xs", "y", "ys", "ov", S.hamming(a, b).alias("diff"))
    good = pairs.filter(F.col("diff") <= F.floor(F.lit(error_rate) * F.col("ov") + 1e-9))
    return good.groupBy("x", "xs", "y", "ys").agg(F.max(F.struct("ov", "diff")).alias("m")).select("x", "xs", "y", "ys", "m.ov", "m.diff")


def shared_kmer_pairs(reads: DataFrame, k: int = 31, least: int = 1, most_hits: int = 200) -> DataFrame:
    """``x``, ``y`` (x < y), ``shared``: how many canonical k-mers two reads share, k-mers of many reads passed over. Reads of
    bases meet packed; ``reads`` should be a written table."""
    if meets.all_bases(reads):
        return meets.shared_pairs(reads, k, most_hits).groupBy("x", "y").agg(F.sum("shared").alias("shared")).filter(F.col("shared") >= least)
    occ = occurrences(reads, k).select("read_idx", "c").distinct()
    cold = occ.groupBy("c").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most_hits)).select("c")
    occ = occ.join(cold, "c", "left_semi")
    pairs = occ.withColumnRenamed("read_idx", "x").join(occ.withColumnRenamed("read_idx", "y"), "c").filter("x < y")
    return pairs.groupBy("x", "y").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def place(queries: DataFrame, targets: DataFrame, seed: int = 31) -> DataFrame:
    """``read_idx``, ``placed``: the target that holds the query on either strand; ``MM`` if several do, ``-`` if none.

    ``targets``: ``target``, ``seq``.
    """
    o = oriented(queries).select("id", "seq", F.substring("seq", 1, seed).alias("w"))
    at = F.sequence(F.lit(1), F.length("seq") - seed + 1)
    win = targets.filter(F.length("seq") >= seed).select("target", "seq", F.explode(at).alias("p"))
    win = win.select("target", "p", F.substring("seq", F.col("p"), F.lit(seed)).alias("w"))
    # whole targets are fetched for seeds that hit, not carried along with every window
    seeds = o.join(win, "w").join(targets.select("target", F.col("seq").alias("long")), "target")
    hit = seeds.filter(F.substring("long", F.col("p"), F.length("seq")) == F.col("seq")).groupBy("id").agg(F.min("target").alias("a"), F.max("target").alias("b"))
    out = queries.select(F.col("read_idx").alias("id")).join(hit, "id", "left")
    return out.select(F.col("id").alias("read_idx"), F.when(F.col("a").isNull(), "-").when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise("MM").alias("placed"))
