"""Benchmark decontamination by winnowing: both sides keep the least k-gram hash of every window, kept fingerprints are
equi-joined, and hits are extended to whole windows.

A window of 13 words has nine 5-grams; the leftmost of the least hash stands for it, wherever the window occurs. So a
shared window has the same fingerprint on both sides, and every shared span of 13 words or more is found. The join key is
the fingerprint with a second hash of all words of the window (128 bits together): the extension of a hit to its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import id_and_text, lean, text_digest
from contigua.runtime import join_unique, materialize, ship

#: Distinct test fingerprints, of 8 bytes each, that are sent to the scan as a filter at most; with more of them all
#: windows of the documents (24 bytes a word) go to the join, which gives the same rows.
FILTER_HASHES = 8_000_000
#: Digests of texts with hits, of 32 bytes each, that may be broadcast; more of them are joined by merge.
DIGESTS_SENT = 1_000_000
#: Words of a k-gram; a window of 13 words then has 9 of them.
GRAM = 5
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GRAM_BASE, _WINDOW_BASE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII characters."""
    return (text or "").encode().translate(_TABLE).split()


def word_hashes(words: list[bytes]):
    """A 64-bit hash of every word."""
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(one, k: int, base: int):
    """A 64-bit hash of every ``k`` words in a row, from those of the words."""
    import numpy as np

    n = len(one) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(base) + one[i : i + n]
    out ^= out >> np.uint64(32)
    return out * np.uint64(_MIX)


def winnow(hashes, w: int):
    """For every ``w`` hashes in a row the place of the least (ties: the leftmost); fewer hashes give none."""
    import numpy as np

    if len(hashes) < w:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(hashes, w).argmin(1) + np.arange(len(hashes) - w + 1)


def windows(one, m: int, known=None):
    """Starts, fingerprints and window hashes of all windows of ``m`` words; with ``known`` (sorted) only of those whose
    fingerprint is among them."""
    import numpy as np

    k = min(GRAM, m)
    grams = run_hashes(one, k, _GRAM_BASE)
    if known is not None:
        where = np.searchsorted(known, grams)
        where[where == len(known)] = 0
        member = known[where] == grams if len(known) else np.zeros(len(grams), bool)
        if not member.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = winnow(grams, m - k + 1)
    starts = np.arange(len(at)) if known is None else np.flatnonzero(member[at])
    return starts, grams[at[starts]], run_hashes(one, m, _WINDOW_BASE)[starts]


def _keys(fingerprint, window) -> pa.Array:
    """Fingerprint and window hash as 16 bytes."""
    import numpy as np

    both = np.column_stack([fingerprint, window]).astype("<u8")
    return pa.Array.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def test_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``m`` (words), ``gram`` (fingerprint), ``key``, ``item`` of every window of the benchmark, a written table.

    Texts without words give none; of fewer than ``window`` words one. A null item keeps its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for item, text in zip(b.column(0), b.column(1), strict=True):
                one = word_hashes(words_of(text.as_py()))
                if not len(one):
                    continue
                m = min(window, len(one))
                _, gram, win = windows(one, m)
                n = len(gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m, np.int32)), pa.array(gram.view(np.int64)), _keys(gram, win), pa.array([item.as_py()] * n, pa.string())], names=["m", "gram", "key", "item"])

    ship(benchmark.sparkSession)
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t is not null")
    return materialize(items.mapInArrow(lean(run), "m int, gram long, key binary, item string").distinct(), "test-windows")


def _document_windows(slim: DataFrame, tests: DataFrame, filter_hashes: int) -> DataFrame:
    """``_id``, ``n_words`` and ``hits`` (key, start, end) of every row of ``slim``: windows to look up in ``tests``."""
    import numpy as np

    prints = tests.select("m", "gram").distinct()
    if prints.count() <= filter_hashes:
        found = prints.toArrow()
        m, gram = found["m"].to_numpy(), found["gram"].to_numpy().view(np.uint64)
        known = {int(x): np.sort(gram[m == x]) for x in np.unique(m)}
    else:
        known = {r["m"]: None for r in prints.select("m").distinct().collect()}
    shared = slim.sparkSession.sparkContext.broadcast(known)
    hit = pa.struct([("key", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, starts, ends, offsets = [], [], [], [], [0]
            for x in b.column(1):
                one = word_hashes(words_of(x.as_py()))
                n.append(len(one))
                many = 0
                for m, fingerprints in shared.value.items():
                    at, gram, win = windows(one, m, fingerprints)
                    if len(at):
                        keys.append(_keys(gram, win))
                        starts.append(at)
                        ends.append(at + m)
                        many += len(at)
                offsets.append(offsets[-1] + many)
            flat = [pa.concat_arrays(keys), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(ends), pa.int32())] if keys else [pa.array([], f.type) for f in hit]
            hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(hit)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), hits], names=["_id", "n_words", "hits"])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(lean(run), f"_id {kind}, n_words long, hits array<struct<key: binary, start: int, end: int>>")


def _covered(spans: Column) -> Column:
    """Length of the union of spans (start, end)."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["last"]))).alias("n"), F.greatest(acc["last"], s["end"]).alias("last"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), step, lambda acc: acc["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, filter_hashes: int = FILTER_HASHES) -> DataFrame:
    """Words of every document inside an occurrence of a benchmark window, one output row per input row.

    One scan of the documents keeps the windows whose fingerprint the benchmark has, by row; these are joined to those of
    the benchmark, hot windows apart. Neither text is shuffled. Null and empty texts have no words (never contaminated);
    items without words give no windows; those without an id count for hits, but not among the items; items of fewer
    than ``window`` words are one window; repeated rows come out repeated; an empty table on either side gives no hits;
    other columns are ignored. What grows with a document is its own list of hits and items, which the result digests.
    """
    tests = test_windows(benchmark, item_col, item_text_col, window)
    scanned = _document_windows(id_and_text(docs, id_col, text_col), tests, filter_hashes)
    rows = materialize(scanned.withColumn("_row", F.monotonically_increasing_id()), "document-windows")
    hits = rows.select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    found = join_unique(hits, tests.groupBy("key").agg(F.collect_set("item").alias("items")), "key")
    by_row = found.groupBy("_row").agg(_covered(F.collect_list(F.struct("start", "end"))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = rows.select("_row", "_id", "n_words").join(by_row.hint("merge"), "_row", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, filter_hashes: int = FILTER_HASHES, digests_sent: int = DIGESTS_SENT) -> DataFrame:
    """The rows of ``docs`` in whose text no window of the benchmark occurs, all columns kept.

    A passage in a long text is as much of a leak as in a short one, so any hit counts, whatever its share. Rows go or
    stay by their text alone: repeated rows and rows without an id like others. Null and empty texts stay; an empty
    table on either side takes nothing away; columns of any name are passed through.
    """
    tests = test_windows(benchmark, item_col, item_text_col, window)
    slim = id_and_text(docs, text_col, text_col).select(text_digest(F.col("_text")).alias("_id"), "_text")
    hits = _document_windows(slim, tests, filter_hashes).filter(F.size("hits") > 0).select("_id", F.explode("hits.key").alias("key"))
    hits = materialize(hits, "document-windows")
    bad = materialize(join_unique(hits, tests.select("key").distinct(), "key").select("_id").distinct(), "contaminated-texts")
    bad = F.broadcast(bad) if bad.count() <= digests_sent else bad.hint("merge")
    return docs.join(bad, text_digest(docs[f"`{text_col}`"].cast("string")) == bad["_id"], "left_anti")
