"""SimHash near-duplicates: deletion variants of half fingerprints, equality join, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import id_and_text, lean, text_digest
from contigua.operators.graph import connect
from contigua.runtime import forget, join_unique, materialize

#: Buckets of more fingerprints than this aren't paired up but taken over by variants of the whole fingerprint.
PAIR_LIMIT = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; no words: 0."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h64, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    if len(words) < width:
        runs = [[h64(b" ".join(words), 42)]]
    else:
        spans = zip(*(words[i:] for i in range(width)))
        runs = iter(lambda: [h64(b" ".join(s), 42) for _, s in zip(range(_BLOCK), spans)], [])
    for run in runs:
        bits = np.unpackbits(np.array(run, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        total += len(run)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, digests: bool = False) -> DataFrame:
    """``_id`` and the signed 64-bit ``fp`` of every row, with ``digests`` also the ``_digest`` of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), *b.columns[2:]], names=["_id", "fp", *b.schema.names[2:]])

    slim = id_and_text(docs, id_col, text_col)
    kind = f"_id {slim.schema['_id'].dataType.simpleString()}, fp long"
    if digests:
        slim = slim.withColumn("_digest", text_digest(F.col("_text")))
        kind += ", _digest binary"
    return slim.mapInArrow(lean(run), kind)


def _segments(max_diff: int) -> list[tuple[int, int]]:
    """The fewest (offset, width) segments of which one differs by at most one bit."""
    n = max_diff // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _variants(fp: Column, max_diff: int) -> Column:
    """Keys of all segments with one bit deleted: a struct of the variant's number and the bits that stay."""
    number, out = 0, []
    for offset, width in _segments(max_diff):
        for i in range(width):
            mask = ((1 << width) - 1 & ~(1 << i)) << offset
            mask -= (mask >> 63) << 64
            out.append(F.struct(F.lit(number).cast("short").alias("no"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
            number += 1
    return F.array(*out)


def _whole_variants(fp: Column, max_diff: int) -> Column:
    """Keys of the whole fingerprint with ``max_diff`` bits deleted: those who share one differ in no other bits."""
    masks = [sum(1 << i for i in c) for c in combinations(range(64), max_diff)]
    signed = [m - ((m >> 63) << 64) for m in masks]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.struct(m.alias("gone"), fp.bitwiseAND(F.bitwise_not(m)).alias("bits")))


def links(distinct_fps: DataFrame, max_diff: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links between different fingerprints (column ``fp``, unique) whose closure is that of all links.

    Variant buckets of up to ``pair_limit`` members are paired and verified. Members of larger buckets get every
    ``max_diff``-bit deletion of the whole fingerprint instead; members of such a bucket all lie within ``max_diff``
    bits, so a star to the smallest of them is enough. No pair of a large bucket is ever listed. With some 10^10
    distinct fingerprints, whose halves less a bit take 2^31 values, most buckets are large and a fingerprint costs up
    to 2016 keys instead of 64: exact still, and the limit of scale.
    """
    if max_diff == 0:
        return distinct_fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter(F.lit(False))
    # each fingerprint becomes dozens of keys: deal them out before, so that small partitions aren't joined up first
    wide = distinct_fps.select("fp").repartition(int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = wide.select("fp", F.explode(_variants(F.col("fp"), max_diff)).alias("k")).select("fp", "k.no", "k.bits")
    sizes = keyed.groupBy("no", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keyed.join(sizes.hint("merge"), ["no", "bits"]), "simhash-shared")
    few = shared.filter(F.col("n") <= pair_limit).select("no", "bits", "fp")
    near = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b").hint("merge"), ["no", "bits"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_diff))
        .select("a", "b")
    )
    hot = shared.filter(F.col("n") > pair_limit).select("fp").distinct()
    whole = hot.select("fp", F.explode(_whole_variants(F.col("fp"), max_diff)).alias("k")).select("fp", "k.gone", "k.bits")
    stars = whole.groupBy("gone", "bits").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).filter("n > 1")
    # a bucket holds up to 2^max_diff fingerprints that agree on the other bits: link each possible member that exists
    members = whole.join(stars.filter("n > 2").select("gone", "bits", "a").hint("merge"), ["gone", "bits"]).select("a", F.col("fp").alias("b")).filter("a != b")
    return near.unionByName(stars.select("a", F.col("z").alias("b"))).unionByName(members).distinct()


def _labelled(fps: DataFrame, max_diff: int, pair_limit: int) -> DataFrame:
    """``fp``, ``low`` (smallest id of its rows), ``label`` (smallest fingerprint that it reaches) of every fingerprint."""
    one = materialize(fps.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-distinct")
    labels = connect(links(one.select("fp"), max_diff, pair_limit)).withColumnRenamed("node", "fp")
    return materialize(one.join(labels.hint("merge"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label")), "simhash-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = 2, width: int = 3, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Two rows are linked when their fingerprints differ in at most ``max_diff`` bits; ``component_id`` is the smallest
    id that a row reaches. Null and word-less texts have fingerprint zero and meet each other. Null ids are passed over
    in the minimum (a group of nothing else gets null). Repeated rows come out repeated; an empty table gives an empty
    one; other columns are ignored. A fingerprint or component with very many rows is no single task's, and no side of
    a join is broadcast that grows with the documents.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "simhash-fps")
    labelled = _labelled(fps, max_diff, pair_limit)
    ids = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    placed = materialize(join_unique(labelled, ids, "label").select("fp", "component_id"), "simhash-placed")
    forget(labelled)
    return join_unique(fps, placed, "fp").select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = 2, width: int = 3, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One row of each group of linked fingerprints, all columns kept: that of the smallest id, fingerprint and digest of
    the text.

    Rows that share an id but not a group are told apart by their texts, so neither goes for the other. Of rows that
    repeat id and text one stays, the least as JSON. Rows without an id can't be named as a copy and stay. Null and
    empty texts are one group; an empty table gives an empty one; columns of any name are passed through.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width, digests=True), "simhash-fps")
    labelled = _labelled(fps, max_diff, pair_limit)
    rows = join_unique(fps, labelled.select("fp", "label"), "fp")
    same = rows.filter(F.col("_id").isNotNull()).groupBy("label", "_id", "fp", "_digest").agg(F.count("*").alias("_n"))
    kept = materialize(same.groupBy("label").agg(F.min(F.struct("_id", "fp", "_digest", "_n")).alias("k")).select("k.*"), "simhash-kept")
    # a merge join at every size: what is kept grows with the documents
    id_, digest = docs[f"`{id_col}`"], text_digest(docs[f"`{text_col}`"].cast("string"))
    out = docs.join(kept.hint("merge"), (id_ == kept["_id"]) & (digest == kept["_digest"]), "left_semi")
    if not kept.filter("_n > 1").isEmpty():
        whole = F.struct("*")
        least = out.groupBy(F.col(f"`{id_col}`").alias("_i"), text_digest(F.col(f"`{text_col}`").cast("string")).alias("_d")).agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
        out = least.select("_row.*")
    nameless = docs.filter(id_.isNull())
    return out if nameless.isEmpty() else out.unionByName(nameless)
