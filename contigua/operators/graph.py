"""Assembly graphs as tables: ``vertices`` (id, seq) and oriented ``edges`` (x, xs, y, ys, lab), twins included.

An edge leaves vertex x in sense direction if ``xs`` is 0, in antisense otherwise. Marks of one pass take effect at once,
ties go by id; long chains take a logarithmic number of rounds, each of them a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from contigua.functions import sequence as S
from contigua.runtime import forget, join_unique, materialize


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``n_sense``, ``n_anti`` of every vertex."""
    d = edges.groupBy(F.col("x").alias("id")).agg(F.count_if(F.col("xs") == 0).alias("n_sense"), F.count_if(F.col("xs") == 1).alias("n_anti"))
    return vertices.select("id").join(d, "id", "left").fillna(0, ["n_sense", "n_anti"])


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: vertices, edges, islands, tips, branching on one or both sides, simple."""
    d, s, a = degrees(vertices, edges), F.col("n_sense"), F.col("n_anti")
    return d.agg(
        F.count("*").alias("n_vertex"), F.coalesce(F.sum(s + a), F.lit(0)).alias("n_edges"), F.count_if((s == 0) & (a == 0)).alias("n_island"),
        F.count_if(((s == 0) | (a == 0)) & (s + a > 0)).alias("n_terminal"), F.count_if(((s > 1) | (a > 1)) & ~((s > 1) & (a > 1))).alias("n_monobranch"),
        F.count_if((s > 1) & (a > 1)).alias("n_dibranch"), F.count_if((s == 1) | (a == 1)).alias("n_simple"),
    )


def drop_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without vertices ``gone`` (id) and their edges."""
    g = gone.select("id")
    left = edges.join(g.withColumnRenamed("id", "x"), "x", "left_anti").join(g.withColumnRenamed("id", "y"), "y", "left_anti")
    return vertices.join(g, "id", "left_anti"), left


def tips(vertices: DataFrame, edges: DataFrame, min_length: int = 300) -> DataFrame:
    """``id`` of islands and dead ends shorter than ``min_length``."""
    d = degrees(vertices, edges).join(vertices.select("id", F.length("seq").alias("n")), "id")
    return d.filter(((F.col("n_sense") == 0) | (F.col("n_anti") == 0)) & (F.col("n") < min_length)).select("id")


def trim(vertices: DataFrame, edges: DataFrame, min_length: int = 300, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Remove tips round by round until none is left or ``rounds`` are over."""
    for _ in range(rounds):
        gone = materialize(tips(vertices, edges, min_length), "tips")
        if gone.isEmpty():
            break
        vertices, edges = (materialize(t, "trimmed") for t in drop_vertices(vertices, edges, gone))
    return vertices, edges


def transitive_edges(edges: DataFrame, fuzz: int = 10) -> DataFrame:
    """Edges x to z such that some y lies between with lab(xy) + lab(yz) within the longest label of x and ``fuzz``.

    All edges are judged by the graph as it is.
    """
    longest = edges.groupBy("x", "xs").agg((F.max("lab") + fuzz).alias("bound"))
    first = edges.select("x", "xs", F.col("y").alias("m"), F.col("ys").alias("ms"), F.col("lab").alias("l1"))
    second = edges.select(F.col("x").alias("m"), F.col("xs").alias("ms"), "y", "ys", F.col("lab").alias("l2"))
    paths = first.join(second, ["m", "ms"]).join(longest, ["x", "xs"]).filter(F.col("l1") + F.col("l2") <= F.col("bound"))
    found = paths.select("x", "xs", "y", "ys").distinct()
    return edges.join(found, ["x", "xs", "y", "ys"], "left_semi")


def transitive_reduction(edges: DataFrame, fuzz: int = 10) -> DataFrame:
    """Edges without the transitive ones and their twins."""
    t = transitive_edges(edges, fuzz).select("x", "xs", "y", "ys")
    both = t.unionByName(t.select(F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"), F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"))).distinct()
    return edges.join(both, ["x", "xs", "y", "ys"], "left_anti")


def first_of_duplicates(edges: DataFrame) -> DataFrame:
    """One edge of those with equal ends and direction: the one of the shortest label."""
    w = W.partitionBy("x", "xs", "y").orderBy("lab", "ys")
    return edges.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def super_repeats(edges: DataFrame, max_edges: int = 128) -> DataFrame:
    """``id`` of vertices with more than ``max_edges`` edges on a side."""
    return edges.groupBy(F.col("x").alias("id"), "xs").agg(F.count("*").alias("n")).filter(F.col("n") > max_edges).select("id").distinct()


def without_super_repeats(edges: DataFrame, max_edges: int = 128) -> DataFrame:
    """Edges of no vertex with more than ``max_edges`` of them, nor of their neighbours: dense places are cut out whole."""
    dense = edges.groupBy(F.col("x").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") > max_edges).select("id")
    near = edges.join(dense.withColumnRenamed("id", "x"), "x", "left_semi").select(F.col("y").alias("id"))
    gone = dense.unionByName(near).distinct()
    return edges.join(gone.withColumnRenamed("id", "x"), "x", "left_anti").join(gone.withColumnRenamed("id", "y"), "y", "left_anti")


def longest_overlaps(overlaps: DataFrame) -> DataFrame:
    """``x``, ``xs``, ``longest``, ``ahead``: the longest overlap of each side, and by how much it beats the second."""
    w = W.partitionBy("x", "xs").orderBy(F.desc("ov"), "y", "ys")
    two = overlaps.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").groupBy("x", "xs").agg(F.max("ov").alias("longest"), F.min(F.when(F.col("_r") == 2, F.col("ov"))).alias("_second"))
    return two.select("x", "xs", "longest", (F.col("longest") - F.coalesce("_second", F.lit(0))).alias("ahead"))


def structure_errors(edges: DataFrame, irreducible: DataFrame) -> DataFrame:
    """``x``, ``xs``, ``y``, ``ys``, ``error``: edges without a twin, irreducible edges that are missing, and edges that are not
    irreducible."""
    key = ["x", "xs", "y", "ys"]
    e, i = edges.select(*key), irreducible.select(*key)
    twin = e.select(F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"), F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"))
    kinds = ((e.join(twin, key, "left_anti"), "no twin"), (i.join(e, key, "left_anti"), "missing"), (e.join(i, key, "left_anti"), "extra"))
    out = None
    for rows, name in kinds:
        part = rows.withColumn("error", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def small_repeat_edges(edges: DataFrame, seq_length: int | DataFrame, min_diff: int = 20) -> DataFrame:
    """Edges that are the shortest overlap of both their ends where each has one longer by more than ``min_diff``.

    ``seq_length``: of all vertices, or the table of them (``id``, ``seq``)."""
    if isinstance(seq_length, int):
        e = edges.withColumn("ov", seq_length - F.col("lab"))
    else:
        e = edges.join(seq_length.select(F.col("id").alias("y"), F.length("seq").alias("_n")), "y").withColumn("ov", F.col("_n") - F.col("lab")).drop("_n")
    per = e.groupBy("x", "xs").agg(F.max("ov").alias("best"), F.min("ov").alias("worst"))
    here = e.join(per, ["x", "xs"])
    there = per.select(F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"), F.col("best").alias("best2"), F.col("worst").alias("worst2"))
    both = here.join(there, ["y", "ys"])
    weak = (F.col("ov") == F.col("worst")) & (F.col("ov") == F.col("worst2")) & (F.col("best") - F.col("ov") > min_diff) & (F.col("best2") - F.col("ov") > min_diff)
    return both.filter(weak).select("x", "xs", "y", "ys", "lab")


def connect(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node that it reaches) for every node of ``links`` (``a``, ``b``).

    Rounds of neighbour minimum and pointer jumping; each round is a written table and the one before it is deleted.
    A node with very many links, or a label with very many members, is a hot key of ``join_unique``, never one task's.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        at = labels.select(F.col("node").alias("b"), F.col("label").alias("l"))
        low = join_unique(both, at, "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("low"))
        step = materialize(labels.join(low.hint("merge"), "node").select("node", "label", F.least("label", "low").alias("low")), "labels-step")
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        least = F.least("low", "jump")
        new = materialize(join_unique(step, jump, "low").select("node", least.alias("label"), (least != F.col("label")).alias("moved")), "labels")
        done = new.filter("moved").isEmpty()
        forget(step)
        forget(labels)
        labels = new.select("node", "label")
        labels._scratch = new._scratch
        if done:
            forget(both)
            return labels


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id reachable); a vertex without edges is its own."""
    labels = connect(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return vertices.select("id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def neighbourhood(edges: DataFrame, root: int, hops: int) -> DataFrame:
    """``id``, ``hop`` of the vertices within ``hops`` edges of a root."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(root, 0)], "id long, hop int")
    front = seen
    links = edges.select("x", "y").distinct()
    for h in range(1, hops + 1):
        new = links.join(front.select(F.col("id").alias("x")), "x").select(F.col("y").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").select("id", F.lit(h).alias("hop"))
        front = materialize(new, "front")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def simple_arcs(edges: DataFrame) -> DataFrame:
    """Edges that are the only way out of x and the only way into y."""
    out = edges.groupBy("x", "xs").agg(F.count("*").alias("n")).filter("n = 1").select("x", "xs")
    into = edges.groupBy("y", "ys").agg(F.count("*").alias("n")).filter("n = 1").select("y", "ys")
    return edges.join(out, ["x", "xs"], "left_semi").join(into, ["y", "ys"], "left_semi").filter("x != y")


def unitigs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``head``, ``head_st``, ``n_vertices``, ``seq``: maximal chains without branches, one of each pair of strands."""
    return chains(vertices, edges).select(F.shiftright("head", 1).alias("head"), (F.col("head") % 2).cast("int").alias("head_st"), "n_vertices", "seq")


def chains(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``head`` and ``last`` (oriented: id * 2 + st), ``n_vertices``, ``coverage``, ``seq`` of the maximal chains without branches, one
    of each pair of strands. The coverage is the sum of that of the vertices (1 each, where they have none).

    Pointer jumping finds for every oriented vertex its chain's head and the bases in between; a head that very many
    vertices point to is a hot key of ``join_unique``. Rings have no head; they are cut at their smallest oriented vertex.
    """
    cover = F.col("coverage") if "coverage" in vertices.columns else F.lit(1).cast("long")
    own = vertices.select("id", "seq", cover.alias("coverage"))
    both = own.withColumn("st", F.lit(0)).unionByName(own.select("id", S.reverse_complement(F.col("seq")).alias("seq"), "coverage", F.lit(1).alias("st")))
    node = lambda i, s: (F.col(i) * 2 + F.col(s)).alias
    arcs = materialize(simple_arcs(edges).select(node("x", "xs")("a"), node("y", "ys")("b"), "lab"), "arcs")
    back = arcs.select(F.col("b").alias("v"), F.col("a").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("a").alias("low"))
    nodes = both.select((F.col("id") * 2 + F.col("st")).alias("v"))
    state = materialize(nodes.join(back, "v", "left").select("v", F.coalesce("up", "v").alias("up"), F.coalesce("steps", F.lit(0)).alias("steps"), F.least("v", F.coalesce("low", "v")).alias("low")), "chain")
    total = state.count()
    span = 1
    while span < 2 * total:
        far = state.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        new = join_unique(state, far, "up").select("v", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("low", "low2").alias("low"), (F.col("steps2") > 0).alias("moved"))
        state = materialize(new, "chain")
        span *= 2
        if state.filter("moved").isEmpty():
            break
    heads = arcs.select(F.col("b").alias("v"))
    inner = state.join(heads.withColumnRenamed("v", "up"), "up", "left_semi")  # its walk has not ended: on a ring
    if inner.isEmpty():
        placed = state.select("v", F.col("up").alias("head"), "steps")
    else:
        # the ring of the other strand has the turned vertices: cut the arc into the smallest one, and that arc's twin
        cut = inner.filter("low % 2 = 0").select("low").distinct()
        open_arcs = arcs.join(cut.select(F.col("low").alias("b")), "b", "left_anti").join(cut.select((F.col("low") + 1).alias("a")), "a", "left_anti").select(F.shiftright("a", 1).alias("x"), (F.col("a") % 2).cast("int").alias("xs"), F.shiftright("b", 1).alias("y"), (F.col("b") % 2).cast("int").alias("ys"), "lab")
        return chains(vertices, materialize(open_arcs, "open-arcs"))
    labelled = placed.join(arcs.select(F.col("b").alias("v"), "lab"), "v", "left").join(both.select((F.col("id") * 2 + F.col("st")).alias("v"), "seq", "coverage"), "v")
    piece = F.when(F.col("steps") == 0, F.col("seq")).otherwise(F.right("seq", F.col("lab").cast("int")))
    found = labelled.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("steps", piece.alias("piece")))).alias("p"), F.count("*").alias("n_vertices"), F.sum("coverage").alias("coverage"), F.max_by("v", "steps").alias("last"))
    # the other strand's chain starts where this one ends, turned round
    turned = F.when(F.col("last") % 2 == 0, F.col("last") + 1).otherwise(F.col("last") - 1)
    return found.filter(F.col("head") <= turned).select("head", "last", "n_vertices", "coverage", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))


def compact(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with every chain as one vertex (``id`` of its head, ``seq``, ``coverage``) and the edges between chains.

    A chain lies in the orientation of its head; the ring that a chain closes is an edge of it to itself.
    """
    found = materialize(chains(vertices, edges), "chains")
    turn = lambda c: F.when(F.col(c) % 2 == 0, F.col(c) + 1).otherwise(F.col(c) - 1)
    name, length = F.shiftright("head", 1), F.length("seq").alias("n")
    # oriented vertices that a chain ends or starts with, on either strand, with the chain and its strand there
    ends = found.select(F.col("last").alias("a"), name.alias("x2"), F.lit(0).alias("xs2")).unionByName(found.select(turn("head").alias("a"), name.alias("x2"), F.lit(1).alias("xs2")))
    starts = found.select(F.col("head").alias("b"), name.alias("y2"), F.lit(0).alias("ys2"), length).unionByName(found.select(turn("last").alias("b"), name.alias("y2"), F.lit(1).alias("ys2"), length))
    sized = edges.join(vertices.select(F.col("id").alias("y"), F.length("seq").alias("own")), "y")
    cut = sized.select((F.col("x") * 2 + F.col("xs")).alias("a"), (F.col("y") * 2 + F.col("ys")).alias("b"), (F.col("own") - F.col("lab")).alias("ov"))
    between = cut.join(ends, "a").join(starts, "b").select(F.col("x2").alias("x"), F.col("xs2").alias("xs"), F.col("y2").alias("y"), F.col("ys2").alias("ys"), (F.col("n") - F.col("ov")).alias("lab"))
    return found.select(name.alias("id"), "seq", "coverage"), materialize(between.distinct(), "chain-edges")


def rename_contigs(unitigs_: DataFrame, name: str = "contig") -> DataFrame:
    """Numbered names, longest first, then by sequence; ranks come from range partitions, not from one task."""
    ordered = unitigs_.withColumn("n", F.length("seq")).repartitionByRange(F.desc("n"), F.asc("seq")).sortWithinPartitions(F.desc("n"), "seq")
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id()), "contigs")
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("size"))  # a row a partition
    first = sizes.select("_part", (F.sum("size").over(W.orderBy("_part")) - F.col("size")).alias("first"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(F.desc("n"), "seq")) - 1 + F.col("first")
    return ordered.join(F.broadcast(first), "_part").select(F.concat(F.lit(f"{name}-"), rank.cast("string")).alias("id"), "seq", "n_vertices")


def clusters(vertices: DataFrame, edges: DataFrame, min_size: int = 2, max_size: int | None = None) -> DataFrame:
    """``cluster_id``, ``size``, ``id``: components of at least ``min_size`` vertices (at most ``max_size``)."""
    comp = components(vertices, edges)
    sizes = comp.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    sizes = sizes if max_size is None else sizes.filter(F.col("size") <= max_size)
    return comp.join(sizes, "component").select(F.col("component").alias("cluster_id"), "size", "id")
