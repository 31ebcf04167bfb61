"""Scaffold layout: cycles opened, shortest-gap walks between the ends of a component, the whole way from links to scaffolds.

Links are ``x, xs, y, ys, dist, sd, n_pairs`` with twins (``scaffold.twins``). An oriented contig is ``id * 2 + st``; a link
leads from one to another. What has no branch is one node from the start (``compact``, logarithmic rounds), so the rounds
of all else are as many as a walk has branching places, not contigs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.operators import graph, scaffold
from contigua.runtime import forget, materialize


def _turn(c: str) -> Column:
    return F.when(F.col(c) % 2 == 0, F.col(c) + 1).otherwise(F.col(c) - 1)


def compact(contigs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` (node, ord, v: oriented contigs of a node as it lies), ``nodes`` (v: node * 2 + st, bases, inner: sum of
    the gaps in it) and ``arcs`` (a, b: oriented nodes; p, q: the oriented contigs there; dist).

    A node is a maximal chain of links that are the only ones of both sides. A ring's closing link is an arc of its node
    to itself. Of links that repeat the shortest counts.
    """
    oriented = links.select((F.col("x") * 2 + F.col("xs")).alias("p"), (F.col("y") * 2 + F.col("ys")).alias("q"), "dist").groupBy("p", "q").agg(F.min("dist").alias("dist"))
    every = materialize(oriented, "layout-links")
    as_links = every.select(F.shiftright("p", 1).alias("x"), (F.col("p") % 2).cast("int").alias("xs"), F.shiftright("q", 1).alias("y"), (F.col("q") % 2).cast("int").alias("ys"), "dist")
    found = scaffold.chains(contigs.select("id"), graph.simple_arcs(as_links))
    members = materialize(found.select(F.col("scaffold").alias("node"), "ord", (F.col("id") * 2 + F.col("st")).alias("v"), "dist"), "layout-members")
    sized = members.join(contigs.select((F.col("id") * 2).alias("v"), "len").unionByName(contigs.select((F.col("id") * 2 + 1).alias("v"), "len")), "v")
    whole = materialize(
        sized.groupBy("node").agg(
            F.sum("len").alias("bases"), F.count("*").alias("n"), F.sum(F.when(F.col("dist").isNotNull(), F.col("dist"))).alias("gaps"),
            F.min_by("v", "ord").alias("head"), F.max_by("v", "ord").alias("last"), F.max_by("dist", "ord").alias("closing"),
        ).select("node", "bases", "head", "last", (F.coalesce("gaps", F.lit(0.0)) - F.coalesce("closing", F.lit(0.0))).alias("inner")),
        "layout-nodes",
    )
    ways = F.array(F.lit(0), F.lit(1))
    nodes = whole.select((F.col("node") * 2).alias("v"), "bases", "inner", F.explode(ways).alias("st")).select((F.col("v") + F.col("st")).alias("v"), "bases", "inner")
    exits = whole.select(F.col("last").alias("p"), (F.col("node") * 2).alias("a")).unionByName(whole.select(_turn("head").alias("p"), (F.col("node") * 2 + 1).alias("a")))
    entries = whole.select(F.col("head").alias("q"), (F.col("node") * 2).alias("b")).unionByName(whole.select(_turn("last").alias("q"), (F.col("node") * 2 + 1).alias("b")))
    arcs = materialize(every.join(exits, "p").join(entries, "q").select("a", "b", "p", "q", "dist"), "layout-arcs")
    return members, nodes, arcs


def cyclic_core(arcs: DataFrame) -> DataFrame:
    """Arcs (a, b, ...) that stay when nodes without a way in or without a way out go, round by round: all cycles, and what
    leads from one to another."""
    core, before = arcs, arcs.count()
    while before:
        has_in = core.select(F.col("b").alias("a")).distinct()
        has_out = core.select(F.col("a").alias("b")).distinct()
        new = materialize(core.join(has_in, "a", "left_semi").join(has_out, "b", "left_semi").select(*arcs.columns), "layout-core")
        if core is not arcs:
            forget(core)
        core, left = new, new.count()
        if left == before:
            break
        before = left
    return core


def closing_arcs(arcs: DataFrame) -> DataFrame:
    """``p``, ``q``: one closing link for every node that is the smallest of all that lead to it, itself among them.

    In any graph with a cycle there is such a node: the smallest of a set of cycles that nothing else leads to.
    """
    core = cyclic_core(arcs)
    low = materialize(core.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("low")).withColumn("moved", F.lit(True)), "layout-low")
    while not low.filter("moved").isEmpty():
        ahead = core.join(low.filter("moved").select(F.col("v").alias("a"), "low"), "a").select(F.col("b").alias("v"), "low", F.lit(None).cast("long").alias("was"))
        both = low.select("v", "low", F.col("low").alias("was")).unionByName(ahead)
        new = materialize(both.groupBy("v").agg(F.min("low").alias("low"), F.max("was").alias("was")).select("v", "low", (F.col("low") < F.col("was")).alias("moved")), "layout-low")
        forget(low)
        low = new
    root = low.filter("v = low").select(F.col("v").alias("b"))
    back = core.join(root, "b").join(low.select(F.col("v").alias("a"), "low"), "a").filter("low = b")
    one = back.groupBy(F.shiftright("b", 1).alias("_n")).agg(F.min(F.struct(F.shiftright("p", 1).alias("p"), F.shiftright("q", 1).alias("q"))).alias("c"))
    return one.select("c.p", "c.q")


def open_cycles(contigs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links without directed cycles, and ``id`` of the contigs that went: both ends of a closing link are taken for
    repeats, round by round, all disjoint cycles at once. Rings without an end are opened like any other cycle."""
    spark = links.sparkSession
    gone = spark.createDataFrame([], "id long")
    links = materialize(links, "open-links")
    while True:
        _, _, arcs = compact(contigs, links)
        closing = closing_arcs(arcs)
        bad = materialize(closing.select(F.explode(F.array("p", "q")).alias("id")).distinct(), "closing")
        if bad.isEmpty():
            return links, gone
        gone = gone.unionByName(bad)
        links = materialize(without(links, bad), "open-links")


def without(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links of which neither end is in ``ids``."""
    return links.join(ids.select(F.col("id").alias("x")), "x", "left_anti").join(ids.select(F.col("id").alias("y")), "y", "left_anti").select(*links.columns)


def without_rings(links: DataFrame) -> DataFrame:
    """Strict mode: contigs that stay when those with one link or none (either side) go, round by round, lose all links:
    they are on rings whatever the direction, or between two."""
    arcs = materialize(links.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), "ring-links")
    before = arcs.count()
    while before:
        many = arcs.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        new = materialize(arcs.join(many, "a", "left_semi").join(many.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"), "ring-links")
        forget(arcs)
        arcs, left = new, new.count()
        if left == before:
            break
        before = left
    loops = links.filter("x = y").select(F.col("x").alias("id"))
    return without(links, arcs.select(F.col("a").alias("id")).unionByName(loops).distinct())


def shortest_walks(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``start``, ``v``, ``dist``, ``bases``, ``prev``: from every node without a way in, the walk of the least sum of gaps to every
    node that it reaches (of equal sums that of most bases, then the smallest ``prev``).

    A round relaxes what the round before changed, for all starts at once; rows meet by (start, v) only. There are as many
    rows as pairs of a start and a node in its reach. Links with a cycle are an error where the gaps of one sum to less than nothing.
    """
    own = nodes.select(F.col("v").alias("b"), F.col("bases").alias("more"), "inner")
    steps = materialize(arcs.join(own, "b").select("a", "b", (F.col("dist") + F.col("inner")).alias("gap"), "more"), "layout-steps")
    first = nodes.join(arcs.select(F.col("b").alias("v")), "v", "left_anti")
    best = lambda d, b, p: F.struct(d.alias("dist"), (-b).alias("neg"), p.alias("prev"))
    none = F.lit(None).cast("long")
    state = materialize(first.select(F.col("v").alias("start"), "v", best(F.lit(0.0), F.col("bases"), none).alias("w"), F.lit(True).alias("moved")), "layout-walks")
    rounds, most = 0, nodes.count()
    while not state.filter("moved").isEmpty():
        if rounds > most:
            raise ValueError("a cycle of links has a negative sum of gaps")
        rounds += 1
        front = state.filter("moved").select("start", F.col("v").alias("a"), "w")
        ahead = front.join(steps, "a").select("start", F.col("b").alias("v"), best(F.col("w.dist") + F.col("gap"), F.col("more") - F.col("w.neg"), F.col("a")).alias("w"), F.lit(None).cast(state.schema["w"].dataType).alias("was"))
        both = state.select("start", "v", "w", F.col("w").alias("was")).unionByName(ahead)
        new = both.groupBy("start", "v").agg(F.min("w").alias("w"), F.max("was").alias("was")).select("start", "v", "w", (F.col("was").isNull() | (F.col("w") < F.col("was"))).alias("moved"))
        new = materialize(new, "layout-walks")
        forget(state)
        state = new
    return state.select("start", "v", "w.dist", (-F.col("w.neg")).alias("bases"), "w.prev")


def layout_links(contigs: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the walk of most contig bases of every component, among shortest-gap walks from one end to another (ties:
    smallest start, then end), with twins. Components without an end keep no link."""
    members, nodes, arcs = compact(contigs, links)
    walks = materialize(shortest_walks(nodes, arcs), "layout-best")
    ends = walks.join(arcs.select(F.col("a").alias("v")), "v", "left_anti")
    plain = nodes.filter("v % 2 = 0").select(F.shiftright("v", 1).alias("id"))
    comp = graph.components(plain, arcs.select(F.shiftright("a", 1).alias("x"), F.shiftright("b", 1).alias("y")))
    placed = ends.withColumn("id", F.shiftright("v", 1)).join(comp, "id")
    chosen = placed.groupBy("component").agg(F.min_by(F.struct("start", "v"), F.struct((-F.col("bases")).alias("neg"), "start", "v")).alias("c")).select("c.*")
    front, on = materialize(chosen, "layout-front"), None
    while True:
        step = materialize(front.join(walks.select("start", "v", "prev"), ["start", "v"]), "layout-front")
        forget(front)
        front = step.filter("prev is not null").select("start", F.col("prev").alias("v"))
        on = step.select("v", "prev") if on is None else on.unionByName(step.select("v", "prev"))
        if front.isEmpty():
            break
        front = materialize(front, "layout-front")
    on = materialize(on, "layout-on")
    used = on.select(F.shiftright("v", 1).alias("node")).distinct()
    bridges = arcs.join(on.filter("prev is not null").select(F.col("prev").alias("a"), F.col("v").alias("b")).distinct(), ["a", "b"]).select("p", "q", "dist")
    following = members.select("node", (F.col("ord") - 1).alias("ord"), F.col("v").alias("q"))
    inside = members.join(used, "node", "left_semi").join(following, ["node", "ord"]).select(F.col("v").alias("p"), "q", "dist")
    kept = bridges.unionByName(inside)
    both = kept.unionByName(kept.select(_turn("q").alias("p"), _turn("p").alias("q"), "dist")).dropDuplicates(["p", "q"])
    return both.select(F.shiftright("p", 1).alias("x"), (F.col("p") % 2).cast("int").alias("xs"), F.shiftright("q", 1).alias("y"), (F.col("q") % 2).cast("int").alias("ys"), "dist")


def validated(links: DataFrame, lengths: DataFrame, least: int = 400) -> DataFrame:
    """Links left when every side on which two contigs would overlap by ``least`` bases or more is cut, and with it the
    facing side of each contig there."""
    bad = materialize(scaffold.overlapping_sides(links, lengths, least).select("x", "xs"), "bad-sides")
    facing = links.join(bad, ["x", "xs"], "left_semi").select(F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"))
    return _cut(links, bad.unionByName(facing).distinct())


def _cut(links: DataFrame, sides: DataFrame) -> DataFrame:
    """Links without those of the given sides (x, xs), at either end."""
    back = sides.select(F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"))
    return links.join(sides, ["x", "xs"], "left_anti").join(back, ["y", "ys"], "left_anti").select(*links.columns)


def single(links: DataFrame) -> DataFrame:
    """Links without those of sides that have more than one."""
    return _cut(links, links.groupBy("x", "xs").agg(F.count("*").alias("n")).filter("n > 1").select("x", "xs"))


def build(
    contigs: DataFrame, estimates: DataFrame, copies: DataFrame | None = None, strict: bool = False, unique_from: float = 20.0, min_copy: float = 0.3, least_overlap: int = 400,
    drop_conflicts: bool = False,
) -> DataFrame:
    """``scaffold``, ``ord``, ``id``, ``st``, ``dist``: scaffolds of ``contigs`` (id, len) from distance estimates, each contig once.

    ``copies`` (id, copy_number, a_stat): what is not unique takes no part; without it all are taken for unique. Then the
    contigs of conflicting links go (``drop_conflicts``). By default polymorphic contigs go until there are none, sides that can't be
    laid out are cut, cycles are opened, and every component keeps its walk of most bases. ``strict`` takes out links that two others make up, rings
    and sides of more than one link instead. Contigs left out are scaffolds of their own.
    """
    merged = materialize(scaffold.symmetric_links(estimates), "scaffold-merged")
    if copies is not None:
        repeats = scaffold.classify(copies, unique_from, min_copy).filter("class <> 'unique'").select("id")
        merged = materialize(without(merged, repeats), "scaffold-merged")
    if drop_conflicts:
        merged = without(merged, merged.filter("conflict").select(F.explode(F.array("x", "y")).alias("id")).distinct())
    links = materialize(scaffold.twins(merged), "scaffold-twins")
    if strict:
        sized = links.join(contigs.select(F.col("id").alias("y"), F.col("len").alias("len_y")), "y")
        found = scaffold.transitive_links(sized)
        back = found.select(F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"), F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"))
        links = links.join(found.unionByName(back).distinct(), ["x", "xs", "y", "ys"], "left_anti").select(*links.columns)
        links = single(materialize(without_rings(links), "scaffold-strict"))
    else:
        while copies is not None:
            marked = materialize(scaffold.polymorphic(links, copies), "polymorphic")
            if marked.isEmpty():
                break
            links = materialize(without(links, marked), "scaffold-twins")
        links, _ = open_cycles(contigs, validated(links, contigs, least_overlap))
    kept = materialize(layout_links(contigs, materialize(links, "scaffold-links")), "scaffold-kept")
    return scaffold.chains(contigs.select("id"), single(kept))
