"""Near-duplicate vectors: a robust-pruned flat graph over overlapping shards, searched by range from every vector, verified.

Equal vectors of a label are one node. Nodes are dealt to shards by rounds of k-means on bounded samples, each node to
its nearest centroid and its next ones too; every shard builds a graph of its own; a node's neighbours from all its shards
are put together; each shard searches for every member with those lists. Links are compared in double precision, and the
recall of a bounded set of queries is measured against all nodes of their labels.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm import flat_graph
from contigua.llm.common import lean
from contigua.operators.graph import connect
from contigua.runtime import forget, join_unique, materialize, ship

#: Nodes that a shard is cut down to, nodes of a k-means sample (about), clusters that one round makes at most.
SHARD, SAMPLE, FAN = 800, 4096, 256
#: Shards of a node in every round, rounds of cutting, queries that recall is measured by (about).
OVERLAP, ROUNDS, AUDIT = 2, 8, 512
#: Recall below which the search is run again with a wider beam and more shards a node.
ENOUGH = 0.95
_MEMBER = "node long, shard string, home boolean, vec binary"


def _unit(x: object) -> np.ndarray | None:
    """A vector of length one in double precision; None for null, empty and zero vectors and those with null or non-finite components."""
    if x is None or not len(x) or any(v is None for v in x):
        return None
    v = np.array(x, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v /= top
    return v / np.sqrt(v @ v)


def _rows(vecs: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``_id``, ``digest`` (null: links with nothing), ``grp`` (label and dimension) and ``vec`` (doubles) of every row."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, grp, vec = [], [], []
            for label, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = None if label is None else _unit(x)
                grp.append(None if v is None else f"{label}:{len(v)}")
                vec.append(None if v is None else v.astype("<f8").tobytes())
                digest.append(None if v is None else hashlib.sha256(f"{grp[-1]}:".encode() + vec[-1]).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(grp, pa.string()), pa.array(vec, pa.binary())], names=["_id", "digest", "grp", "vec"])

    col = lambda c: F.col(f"`{c}`")
    slim = vecs.select(col(id_col).alias("_id"), col(label_col).cast("string").alias("label"), col(vec_col).cast("array<double>").alias("x"))
    return slim.mapInArrow(lean(run), f"_id {slim.schema['_id'].dataType.simpleString()}, digest binary, grp string, vec binary")


def _matrix(vec: pa.Array, kind: str = "<f8") -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in vec.to_pylist()])


def _centroids(overlap: int, limit: int):
    """Centroids of one cell, fitted on its sample: as many as leave six tenths of ``limit`` to a shard, four at least, so
    that a cell always gets smaller."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        n = t["n"][0].as_py()
        c = flat_graph.k_means(_matrix(t["vec"]).astype(np.float32), min(FAN, max(4, -(-10 * overlap * n // (6 * limit)))))
        return pa.table({"shard": [t["shard"][0].as_py()], "centroids": pa.array([c.astype("<f4").tobytes()], pa.binary())})

    return run


def _dealt(overlap: int):
    """A body that deals the nodes of each cell to its clusters; its rows come sorted, a cell's centroids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, c = None, None
        for b in batches:
            cell, role = b.column("shard").to_pylist(), b.column("role").to_numpy()
            starts = [0, *[i for i in range(1, len(cell)) if cell[i] != cell[i - 1] or role[i] != role[i - 1]], len(cell)]
            for i, j in zip(starts, starts[1:], strict=False):
                part = b.slice(i, j - i)
                if j == i:
                    continue
                if role[i] == 0:
                    at, raw = cell[i], part.column("centroids")[0].as_py()
                    c = np.frombuffer(raw, "<f4")
                    continue
                assert cell[i] == at, "a cell without centroids"
                x = _matrix(part.column("vec")).astype(np.float32)
                near = np.argsort(-(x @ c.reshape(-1, x.shape[1]).T), axis=1, kind="stable")[:, :overlap]
                home = part.column("home").to_numpy(zero_copy_only=False)
                for k in range(near.shape[1]):
                    mine = np.flatnonzero(home | (k == 0))  # what is at home here goes to the next clusters too
                    rows = part.take(pa.array(mine))
                    names = pa.array([f"{cell[i]}/{m}" for m in near[mine, k]], pa.string())
                    yield pa.RecordBatch.from_arrays([rows.column("node"), names, pa.array(home[mine] & (k == 0)), rows.column("vec")], names=["node", "shard", "home", "vec"])

    return run


def shards(nodes: DataFrame, overlap: int = OVERLAP, limit: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """``node``, ``shard``, ``home``, ``vec``: all nodes (``node``, ``grp``, ``vec``), each at home in one shard and a guest in others.

    Cells of more than ``limit`` nodes are cut by k-means until there is none. What is over the limit after ``rounds`` (no
    centroids tell its vectors apart) is cut by number; so no shard grows with the data.
    """
    todo = nodes.select("node", F.col("grp").alias("shard"), F.lit(True).alias("home"), "vec")
    done = None
    for r in range(rounds + 1):
        sizes = materialize(todo.groupBy("shard").agg(F.count("*").alias("n")), "shard-sizes")
        big = sizes.filter(F.col("n") > limit)
        if big.isEmpty():
            return todo if done is None else done.unionByName(todo)
        placed = materialize(join_unique(todo, sizes, "shard"), "shard-placed")
        small = placed.filter(F.col("n") <= limit).select("node", "shard", "home", "vec")
        done = small if done is None else done.unionByName(small)
        over = placed.filter(F.col("n") > limit)
        if r == rounds:
            part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / limit)).cast("string")
            return done.unionByName(over.select("node", F.concat_ws("#", "shard", part).alias("shard"), "home", "vec"))
        drawn = F.pmod(F.xxhash64("node", "shard"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n")
        centroids = over.filter(drawn).select("shard", "node", "vec", "n").groupBy("shard").applyInArrow(_centroids(overlap, limit), "shard string, centroids binary")
        # a cell is dealt out to as many tasks as it has parts of ``limit`` nodes; its centroids go to each
        parts = F.ceil(F.col("n") / limit).cast("int")
        head = materialize(centroids, "shard-centroids").join(big.hint("merge"), "shard").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("boolean").alias("home"), F.lit(None).cast("binary").alias("vec"), "centroids")
        body = over.select("shard", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(1).alias("role"), "node", "home", "vec", F.lit(None).cast("binary").alias("centroids"))
        dealt = head.unionByName(body).repartition("shard", "part").sortWithinPartitions("shard", "part", "role")
        todo = materialize(dealt.mapInArrow(lean(_dealt(overlap)), _MEMBER), "shard-members")
    raise AssertionError("unreachable")


def _grown(degree: int, beam: int, alpha: float):
    """The graph of one shard: every member with its out-neighbours."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")  # rows come in any order: the graph mustn't depend on it
        ids = t["node"].to_numpy()
        adj = flat_graph.build(_matrix(t["vec"]).astype(np.float32), degree, beam, alpha)
        return pa.table({"node": t["node"], "near": pa.array([ids[a[a >= 0]] for a in adj], pa.list_(pa.int64()))})

    return run


def _searched(least: float, beam: int):
    """Links of one shard: members whose cosine in double precision is ``least`` or more."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        ids, v = t["node"].to_numpy(), _matrix(t["vec"])
        lists = t["near"].combine_chunks()
        tails = np.searchsorted(ids, flat := lists.flatten().to_numpy())
        heads = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        here = ids[np.minimum(tails, len(ids) - 1)] == flat  # neighbours from other shards may be no members of this one
        adj = np.full((len(ids), 1), -1)
        if here.any():
            some, packed = flat_graph._packed(heads[here], tails[here])
            adj = np.full((len(ids), packed.shape[1]), -1)
            adj[some] = packed
        pairs = [np.zeros(0, np.int64)]
        for q, w in flat_graph.range_search(v.astype(np.float32), adj, least, beam=beam):
            pairs.append(np.minimum(q, w) * len(ids) + np.maximum(q, w))
        key = np.unique(np.concatenate(pairs))
        a, b = key // len(ids), key % len(ids)
        ok = np.concatenate([np.zeros(0, bool), *[np.einsum("kd,kd->k", v[a[i : i + 65536]], v[b[i : i + 65536]]) >= least for i in range(0, len(a), 65536)]])
        return pa.table({"a": ids[a[ok]], "b": ids[b[ok]]})

    return run


def graph(members: DataFrame, degree: int, beam: int, alpha: float) -> DataFrame:
    """``node`` and ``near``: the lists of a node from all its shards put together."""
    grown = members.select("shard", "node", "vec").groupBy("shard").applyInArrow(_grown(degree, beam, alpha), "node long, near array<long>")
    return grown.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search(nodes: DataFrame, least: float, overlap: int, degree: int, beam: int, alpha: float, limit: int = SHARD) -> DataFrame:
    """``a`` < ``b``: links between nodes, by graphs over overlapping shards."""
    members = materialize(shards(nodes, overlap, limit), "shard-all")
    lists = materialize(graph(members, degree, beam, alpha), "shard-lists")
    both = members.select("shard", "node", "vec").join(lists.hint("merge"), "node")
    return both.groupBy("shard").applyInArrow(_searched(least, beam), "a long, b long").distinct()


def recall(nodes: DataFrame, links: DataFrame, least: float, queries: int = AUDIT) -> float:
    """The share of the links of about ``queries`` nodes, drawn by their digests, that ``links`` holds; brute force in blocks
    against all nodes. The queries alone are broadcast, four times as many at most."""
    total = nodes.count()
    drawn = nodes.filter(F.pmod(F.xxhash64("digest"), F.lit(max(total // queries, 1))) == 0).select("node", "grp", "vec")
    asked: dict[str, list] = {}
    for r in drawn.limit(4 * queries).collect():
        asked.setdefault(r.grp, []).append((r.node, np.frombuffer(r.vec, "<f8")))
    if not asked:
        return 1.0
    sent = nodes.sparkSession.sparkContext.broadcast({g: (np.array([i for i, _ in v]), np.stack([x for _, x in v])) for g, v in asked.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grp, node = np.array(b.column(1).to_pylist(), object), b.column(0).to_numpy()
            for g in set(grp) & sent.value.keys():
                mine = np.flatnonzero(grp == g)
                ids, x = sent.value[g]
                hit = np.nonzero(_matrix(b.column(2).take(pa.array(mine))) @ x.T >= least)
                p, q = node[mine[hit[0]]], ids[hit[1]]
                ok = p != q
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)[ok]), pa.array(np.maximum(p, q)[ok])], names=["a", "b"])

    true = nodes.select("node", "grp", "vec").mapInArrow(lean(run), "a long, b long").distinct()
    got = true.join(links.withColumn("_hit", F.lit(1)).hint("merge"), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("_hit").alias("hit")).first()
    return got.hit / got.n if got.n else 1.0


def audited_links(nodes: DataFrame, least: float = 0.98, overlap: int = OVERLAP, degree: int = 32, beam: int = 64, alpha: float = 1.2, limit: int = SHARD, tries: int = 3) -> tuple[DataFrame, float]:
    """Links of the nodes and their measured recall. Below ``ENOUGH`` the search is run again with twice the beam and one more
    shard a node, and its links are added; if that isn't enough after ``tries``, a warning says so."""
    links, found = None, 0.0
    for i in range(tries):
        new = search(nodes, least, overlap + i, degree, beam << i, alpha, limit)
        links = materialize(new if links is None else links.unionByName(new).distinct(), "vector-links")
        found = recall(nodes, links, least)
        if found >= ENOUGH:
            return links, found
    warnings.warn(f"links of near-duplicate vectors: recall {found:.3f}", stacklevel=2)
    return links, found


def near_duplicates(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, overlap: int = OVERLAP, limit: int = SHARD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows of equal labels whose cosine is ``least`` or more are linked. Vectors that are null, empty or zero or hold null or
    non-finite components, and those without a label, link with nothing, as vectors of different length do. ``n_links``
    counts the other rows linked to a row; ``component_id`` is the smallest id that it reaches; ``kept`` says whether that
    is its own. Equal vectors are one node and are never paired up. Null ids are passed over in the minimum (a component
    of nothing else has none, and its rows are kept); repeated rows come out repeated and are linked; an empty table gives an
    empty one; other columns are ignored. Links between different vectors are listed once each, however dense a place is.
    """
    ship(vecs.sparkSession)
    rows = materialize(_rows(vecs, id_col, vec_col, label_col), "vector-rows")
    valid = rows.filter("digest is not null")
    one = valid.groupBy("digest").agg(F.min("grp").alias("grp"), F.min("vec").alias("vec"), F.count("*").alias("n"), F.min("_id").alias("low"))
    nodes = materialize(one.sortWithinPartitions("digest").withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    links, _ = audited_links(nodes, least, overlap, limit=limit)
    weights = nodes.select(F.col("node").alias("b"), F.col("n").alias("w"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(weights.hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("more"))
    labels = connect(links)
    placed = nodes.select("node", "digest", "n", "low").join(more.hint("merge"), "node", "left").join(labels.hint("merge"), "node", "left")
    placed = materialize(placed.select("digest", "low", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label")), "vector-placed")
    forget(labels)
    lows = placed.groupBy("label").agg(F.min("low").alias("component_id"))
    known = materialize(join_unique(placed, lows, "label").select("digest", "n_links", "component_id"), "vector-known")
    id_ = F.col("_id")
    slim = rows.select("_id", "digest")
    out = join_unique(slim.filter("digest is not null"), known, "digest").select("_id", "n_links", "component_id")
    alone = slim.filter("digest is null").select("_id", F.lit(0).cast("long").alias("n_links"), id_.alias("component_id"))
    return out.unionByName(alone).select(id_.alias("vec_id"), "n_links", "component_id", id_.eqNullSafe(F.col("component_id")).alias("kept"))
