"""LM scoring with a probabilistic suffix tree over tokens.

Symbols are the tokens that occur twice and have ``least_share`` of all tokens, and one for all others, which are too rare for any context
with them to be frequent; contexts are runs of up to ``depth`` symbols before a token, the start of the text included. A
context is a candidate when it has ``least_share`` too, and is retained when what follows it diverges from what its next
shorter retained suffix gives. It keeps the counts of those next symbols that follow it with ``least_share``; the mass of
all others, and one count for each kept symbol (Witten and Bell), is spread as the shorter state does. A token is scored
in the longest retained suffix of what comes before it. Among the other tokens the root's distribution holds: counts, and
one symbol for all that training hasn't seen, with the mass of what training has seen once (Good and Turing).

Two occurrences are the least at every size; ``least_share`` is a further bound, 0 unless asked for. So symbols, contexts
and kept cells (context, next symbol) grow with the corpus: trees of a bounded number of them go to every task, larger
ones are learned and read in buckets (``suffix_buckets``), with the same scores. With a share above 0 no level can have more
than ``1 / least_share`` of them. Counts of all documents are gathered in tables of the shared folder and grow with them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import fold_of, id_and_text, lean
from contigua.runtime import forget, materialize

END = b"\n"
#: Distinct tokens to a chunk of texts, about.
_GATHER = 400_000
#: Cells that a task gathers before it hands their counts over.
_GATHER_CELLS = 2_000_000
#: Tokens that numpy works on at once (a longer document: all of its own).
_CHUNK = 200_000
#: Counted cells to a bucket that one task sums up at a time, about.
_BUCKET = 500_000
#: Contexts and cells a level of a tree that goes to every task, at most.
_SENT = 2_000_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered, then the end."""
    return [*(text or "").encode().lower().split(), END]


class Alphabet:
    """Numbers of the symbols: frequent tokens, then one for all others, then the start of a text."""

    def __init__(self, counts: dict[bytes, int], depth: int):
        self.counts, self.at = counts, {t: i for i, t in enumerate(counts)}
        self.other, self.start, self.base, self.depth = len(counts), len(counts) + 1, len(counts) + 2, depth
        if self.base**depth >= 1 << 63:
            raise ValueError("least_share is too small for contexts of this depth")


def _find(sorted_keys, keys):
    """Places of keys among sorted ones, -1 where there is none."""
    import numpy as np

    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _chunks(symbols: pa.ListArray, depth: int, start: int):
    """Symbols of many texts in one array with ``depth`` starts before each, where the tokens are in it, and whose."""
    import numpy as np

    offsets, values = symbols.offsets.to_numpy(), symbols.values.to_numpy(zero_copy_only=False)
    first, n = 0, len(symbols)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        last = min(last, n)
        own = values[offsets[first] : offsets[last]]
        text = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
        pos = np.arange(len(own)) + depth * (text + 1)
        out = np.full(len(own) + depth * (last - first), start, np.int64)
        out[pos] = own
        yield out, pos, text + first
        first = last


def _context(symbols, pos, d: int, base: int):
    """Numbers of the ``d`` symbols before each place."""
    import numpy as np

    key = np.zeros(len(pos), np.int64)
    for i in range(d, 0, -1):
        key = key * base + symbols[pos - i]
    return key


def _diverge(at, n, low, seen, slack: float = 4.0):
    """Which contexts, ``seen`` so often, are retained, their shares, and the gains of their cells.

    ``at``: context of each kept cell; ``n``: its count; ``low``: log of what the next shorter state gives to it. What else
    followed a context is taken as one. The test: count times Kullback-Leibler beyond its mean plus ``slack`` standard
    deviations if nothing but chance differed.
    """
    import numpy as np

    per = lambda x: np.bincount(at, x, minlength=len(seen))
    kinds, kept = per(np.ones(len(at))), per(n)
    rest, rest_low = seen - kept, np.maximum(1 - per(np.exp(low)), 1e-12)
    whole = np.maximum(seen, 1)
    gain = per(n * (np.log(n / whole[at]) - low)) + rest * np.log(np.maximum(rest, 1) / whole / rest_low)
    freedom = np.maximum(kinds - (rest <= 0), 1)
    keep = (kinds > 0) & (gain >= 0.5 * (freedom + slack * np.sqrt(2 * freedom)))
    spread = kinds + rest
    return keep, np.log(np.maximum(spread, 1e-300) / np.maximum(kept + spread, 1e-300)), np.log1p(n / (spread[at] * np.exp(low)))


class Tree:
    """States: retained contexts by depth, with what they give to symbols they keep no count of; the root is not one.

    With ``low`` the natural log of what the next shorter state gives to a symbol, a state gives exp(low + share) to one
    that it keeps no count of, and exp(low + share + gain) to one of count ``n``: gain = log(1 + n / (spread exp(low))).
    So the root, the shares and the gains of all retained suffixes add up.
    """

    def __init__(self, alphabet: Alphabet, root):
        """``root``: counts of the symbols, all others as one."""
        import numpy as np

        self.alphabet, self.width = alphabet, alphabet.other + 1
        self.root = np.log(np.maximum(np.asarray(root, float) / max(1e-300, np.sum(root)), 1e-300))
        empty, none = np.empty(0, np.int64), np.empty(0)
        self.keys, self.share, self.cells, self.gain = ([x] * (alphabet.depth + 1) for x in (empty, none, empty, none))

    def states(self) -> int:
        return 1 + sum(map(len, self.keys))

    def log_p(self, contexts, nexts):
        """Natural log of what the states give to ``nexts``; ``contexts(d)``: numbers of the ``d`` symbols before each."""
        total = self.root[nexts].copy()
        for d in range(1, self.alphabet.depth + 1):
            if not len(self.keys[d]):
                continue
            state = _find(self.keys[d], contexts(d))
            at = (state >= 0).nonzero()[0]
            state = state[at]
            total[at] += self.share[d][state]
            cell = _find(self.cells[d], state * self.width + nexts[at])
            total[at[cell >= 0]] += self.gain[d][cell[cell >= 0]]
        return total

    def grow(self, d: int, keys, seen, cells, n, slack: float = 4.0):
        """Retain those contexts ``keys`` of ``d`` symbols, ``seen`` so often, that diverge from their suffix.

        ``cells`` (place among the keys times ``width`` plus next symbol, sorted) with counts ``n`` are those kept.
        """
        import numpy as np

        at, nexts = cells // self.width, cells % self.width
        low = self.log_p(lambda e: keys[at] % self.alphabet.base**e if e < d else np.full(len(at), -1), nexts)
        keep, share, gain = _diverge(at, n, low, seen, slack)
        number = np.cumsum(keep) - 1
        own = keep[at]
        self.keys[d], self.share[d] = keys[keep], share[keep]
        self.cells[d], self.gain[d] = (number[at] * self.width + nexts)[own], gain[own]


def _spell(most: int):
    """Texts as places in a list of the tokens of their chunk, a run of rows of one task, and these lists with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        chunk, at, kind = TaskContext.get().partitionId() << 24, defaultdict(count().__next__), pa.null()
        counts = [np.empty(0, np.int64)] * 2
        names = ["chunk", "_id", "_mine", "n_tokens", "symbols", "k", "tokens", "n_all", "n_train"]
        ints, longs, texts = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = list(at)
            for i in range(0, len(tokens), 20_000):
                part = [pa.array([x[i : i + 20_000]], t) for x, t in zip([tokens, *counts], [texts, longs, longs], strict=True)]
                none = [pa.nulls(1, t) for t in (kind, pa.bool_(), pa.int64(), ints)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *none, pa.array([i], pa.int32()), *part], names=names)

        for b in batches:
            kind, mine = b.column(0).type, b.column(1).to_numpy(zero_copy_only=False)
            first, held, size = 0, [], 0
            for i, x in enumerate(b.column(2)):
                tokens = tokens_of(x.as_py())
                held.append(np.fromiter(map(at.__getitem__, tokens), np.int32, len(tokens)))
                size += len(tokens)
                if size < _CHUNK and len(at) < most and i + 1 < b.num_rows:
                    continue
                values, sizes = np.concatenate(held), np.array([len(x) for x in held])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
                rows = b.slice(first, len(sizes))
                none = [pa.nulls(len(sizes), t) for t in (pa.int32(), texts, longs, longs)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), chunk)), rows.column(0), rows.column(1), pa.array(sizes), lists, *none], names=names)
                own = values, values[np.repeat(mine[first : i + 1], sizes).astype(bool)]
                for j, v in enumerate(own):
                    n = np.bincount(v, minlength=len(at))
                    n[: len(counts[j])] += counts[j]
                    counts[j] = n
                first, held, size = i + 1, [], 0
                if len(at) >= most:
                    yield from flush()
                    chunk, at, counts = chunk + 1, defaultdict(count().__next__), [np.empty(0, np.int64)] * 2
        if at:
            yield from flush()

    return run


def _marked(docs: DataFrame, id_col: str, text_col: str, folds: int, held_fold: int) -> DataFrame:
    mine = F.coalesce(fold_of("_id", folds) != held_fold, F.lit(True))
    return id_and_text(docs, id_col, text_col).select("_id", mine.alias("_mine"), "_text")


def spell(marked: DataFrame) -> DataFrame:
    """Every row with its tokens, numbered, and the lists of tokens that ``symbols`` are places in, ``k`` being the place of a
    list's first, as a written table. Texts are read once for it."""
    kind = marked.schema["_id"].dataType.simpleString()
    rows = marked.select("_id", "_mine", "_text").mapInArrow(
        lean(_spell(_GATHER)), f"chunk long, _id {kind}, _mine boolean, n_tokens long, symbols array<int>, k int, tokens array<binary>, n_all array<long>, n_train array<long>"
    )
    return materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "lm-symbols", tidy=True)


def listed_tokens(spelled: DataFrame) -> DataFrame:
    """``chunk``, place ``k``, ``token``, ``n_all``, ``n_train`` of every token in the list of a chunk."""
    each = spelled.filter("k is not null").select("chunk", "k", F.posexplode(F.arrays_zip("tokens", "n_all", "n_train")).alias("j", "c"))
    return each.select("chunk", (F.col("k") + F.col("j")).alias("k"), F.col("c.tokens").alias("token"), F.col("c.n_all").alias("n_all"), F.col("c.n_train").alias("n_train"))


def _tokens(spelled: DataFrame) -> DataFrame:
    part = listed_tokens(spelled)
    return materialize(part.groupBy("token").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train")), "lm-tokens", tidy=True)


def token_table(marked: DataFrame) -> DataFrame:
    """``token``, ``n_all``, ``n_train`` of every distinct token, written to the shared folder."""
    return _tokens(spell(marked))


def alphabet_of(tokens: DataFrame, n_train: int, depth: int, least: float) -> Alphabet:
    """The tokens with ``least`` occurrences in training, most frequent first, and the end."""
    top = tokens.filter(F.col("n_train") >= least).select("token", "n_train").orderBy(F.desc("n_train"), "token").toArrow()
    counts = dict(zip(top["token"].to_pylist(), top["n_train"].to_pylist(), strict=True))
    if END not in counts and n_train:
        counts[END] = tokens.filter(F.col("token") == F.lit(END)).first()["n_train"]
    return Alphabet(counts, depth)


def _encode(shared):
    """Symbols of every text; sums over its tokens; those tokens that aren't shared, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at, other, base_log, share_log, known = shared.value
        get = at.get
        for b in batches:
            symbols, sizes, sums, cold, cold_n = [], [], [], [], []
            for x in b.column(2):
                tokens = tokens_of(x.as_py())
                number = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                hot = number[number >= 0]
                rare = Counter([tokens[i] for i in np.flatnonzero(number < 0).tolist()]) if len(hot) < len(tokens) else {}
                symbols.append(np.where((number >= 0) & (number < other), number, other).astype(np.int32))
                sizes.append(len(tokens))
                sums.append((base_log[hot].sum(), share_log[hot].sum(), known[hot].sum()))
                cold.append(list(rare))
                cold_n.append(list(rare.values()))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            base, share, seen = np.array(sums, float).reshape(-1, 3).T
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(symbols) if symbols else [], pa.int32()))
            out = pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), lists, pa.array(sizes, pa.int64()), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(share), pa.array(cold, pa.list_(pa.binary())), pa.array(cold_n, pa.list_(pa.int64()))],
                names=["_id", "_mine", "symbols", "n_tokens", "n_known", "base", "share", "cold", "cold_n"],
            )
            yield from (out.slice(i, 1000) for i in range(0, out.num_rows, 1000))

    return run


def encode(marked: DataFrame, tokens: DataFrame, alphabet: Alphabet, n_train: int, fresh: int, hot_tokens: int) -> DataFrame:
    """Every row with its symbols and sums over its tokens, numbered, as a written table.

    The tokens of the alphabet and the ``hot_tokens`` most frequent others at most are known to every task; the rest of a
    row's tokens are listed with it.
    """
    import numpy as np

    least = _hot(tokens, "n_all", hot_tokens)
    rest = math.log10(n_train - sum(alphabet.counts.values()) + fresh)
    at, counts = dict(alphabet.at), list(alphabet.counts.values())
    more = tokens.filter(F.col("n_all") >= least).select("token", "n_train").toArrow()
    for t, n in zip(more["token"].to_pylist(), more["n_train"].to_pylist(), strict=True):
        if t not in at:
            at[t] = len(at)
            counts.append(n)
    n = np.array(counts, float)
    share = np.log10(np.where(n > 0, n, fresh)) - rest
    share[: alphabet.other] = 0
    shared = marked.sparkSession.sparkContext.broadcast((at, alphabet.other, np.log10(n + 1), share, (n > 0).astype(np.int64)))
    kind = marked.schema["_id"].dataType.simpleString()
    rows = marked.select("_id", "_mine", "_text").mapInArrow(lean(_encode(shared)), f"_id {kind}, _mine boolean, symbols array<int>, n_tokens long, n_known long, base double, share double, cold array<binary>, cold_n array<long>")
    return materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "lm-symbols", tidy=True)


def _counts(shared, d: int, buckets: int):
    """Counted cells (place of the context among the candidates of ``d`` symbols, next symbol), many to a row, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        depth, start, base, width, keys = shared.value
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cell, n, bucket = cell[order].astype("<i8"), n[order].astype("<i8"), bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for i in range(0, len(cuts) - 1, 1000):
                ends = cuts[i : i + 1001]
                blobs = [[x[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] for x in (cell, n)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]].astype(np.int64)), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "cells", "counts"])

        for b in batches:
            for s, pos, _ in _chunks(b.column(0), depth, start):
                at = _find(keys, _context(s, pos, d, base))
                held.append((at * width + s[pos])[at >= 0])
                size += len(held[-1])
                if size >= _GATHER_CELLS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _sum_buckets(least: float):
    """Sums of the counts of a bucket's cells, of which those of ``least`` are kept; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            cells, counts = (np.concatenate([np.frombuffer(x, "<i8") for x in part]) for part in zip(*held, strict=True))
            cell, at = np.unique(cells, return_inverse=True)
            n = np.bincount(at, counts, minlength=len(cell)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[n >= least]), pa.array(n[n >= least])], names=["cell", "n"])

        for b in batches:
            for bucket, cells, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if bucket != now and held:
                    yield from flush()
                    held = []
                now = bucket
                held.append((cells.as_py(), counts.as_py()))
        if held:
            yield from flush()

    return run


def learn(rows: DataFrame, alphabet: Alphabet, n_train: int, fresh: int, least: float) -> Tree:
    """Grow the tree level by level from ``rows`` (``_mine``, ``symbols``); every level counts all texts to learn from.

    Cells are counted in full; only those with ``least`` occurrences come to the driver, ``n_train / least`` at most.
    Candidates of a level are the kept cells of the level before, as contexts.
    """
    import numpy as np

    sc, texts = rows.sparkSession.sparkContext, rows.filter("_mine").select("symbols")
    end, a = alphabet.at.get(END, -1), alphabet
    tree = Tree(a, [*a.counts.values(), n_train - sum(a.counts.values()) + fresh])
    if not n_train:
        return tree
    counts = np.array(list(a.counts.values()), np.int64)
    keys = np.array([i for i in range(a.other) if i != end and counts[i] >= least] + [a.start], np.int64)
    seen = np.append(counts[keys[:-1]], counts[end])
    buckets = max(16, n_train // _BUCKET)
    for d in range(1, a.depth + 1):
        if not len(keys):
            break
        shared = sc.broadcast((a.depth, a.start, a.base, tree.width, keys))
        partial = texts.mapInArrow(lean(_counts(shared, d, buckets)), "bucket long, cells binary, counts binary")
        kept = partial.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_sum_buckets(least)), "cell long, n long").toArrow()
        cells, n = kept["cell"].to_numpy(), kept["n"].to_numpy()
        order = np.argsort(cells)
        cells, n = cells[order], n[order]
        tree.grow(d, keys, seen, cells, n)
        nexts = cells % tree.width
        longer = (nexts != a.other) & (nexts != end)
        keys, seen = keys[cells[longer] // tree.width] * a.base + nexts[longer], n[longer]
        order = np.argsort(keys)
        keys, seen = keys[order], seen[order]
    return tree


def _hot(table: DataFrame, count: str, most: int) -> int:
    """The least power of two such that at most ``most`` rows have as high a count."""
    levels = table.groupBy(F.floor(F.log2(count)).cast("int").alias("level")).count().collect()
    held, least = 0, 1 << 62
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        least = 1 << r["level"]
    return least


def _score(shared):
    """log10 probability of the symbols of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tree = shared.value
        a = tree.alphabet
        for b in batches:
            total = np.zeros(b.num_rows)
            for s, pos, text in _chunks(b.column(1), a.depth, a.start):
                log_p = tree.log_p(lambda d: _context(s, pos, d, a.base), s[pos])  # noqa: B023
                total += np.bincount(text, log_p, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total / math.log(10))], names=["_row", "lp"])

    return run


def _by_buckets(spelled: DataFrame, sizes, least: float, depth: int) -> tuple[DataFrame, int]:
    """``_row``, ``_id``, ``n_tokens`` and sums of every row by a tree of any size, and how many tokens training has."""
    from contigua.llm import suffix_buckets as buckets

    ranks = buckets.rank(spelled, sizes["listed"], least)
    ids, levels, order = buckets.number(ranks, least, 1)
    # the end is no token of a level, it is the first symbol
    vocabulary, once = 1 + sum(m for n, m in levels if n > 0), (sizes["texts"] == 1) + sum(m for n, m in levels if n == 1)
    fresh = max(1, once)
    symbols = buckets.Symbols(Alphabet({END: sizes["texts"]}, depth), [x for x in levels if x[0] >= least], sizes["n"], fresh)
    rows = buckets.name(spelled, ids, symbols, fresh)
    for x in (spelled, ranks, order):
        forget(x)
    lp, *more = buckets.score_rows(rows, symbols, sizes["n_all"], least)
    for x in more:
        lp = lp.unionByName(x)
    sums = lp.groupBy("_row").agg((F.sum("lp") / math.log(10)).alias("lp"))
    return rows.select("_row", "_id", "n_tokens", "n_known", "base", "share").join(sums.hint("merge"), "_row").withColumn("share", F.col("share") + F.col("lp")), vocabulary


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, hot_tokens: int = 250_000, depth: int = 3, least_share: float = 0.0) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every document.

    Counts come from all documents outside the held-out fold (a null id belongs to no fold and is learned from). A tree of
    ``_SENT`` contexts and cells a level at most goes to every task, with the ``hot_tokens`` most frequent tokens at most and
    their counts; all other tokens are joined, and texts are read twice: to count tokens, and to write their symbols. A
    larger one, the same otherwise, is learned and read in buckets of places; texts are read once for it, and their tokens
    numbered chunk by chunk. Null counts as empty: only the end. Repeated rows come out repeated; an empty table gives an empty one;
    other columns are ignored.
    """
    spark = docs.sparkSession
    marked = _marked(docs, id_col, text_col, folds, held_fold)
    spelled = spell(marked)
    sizes = spelled.agg(
        F.sum(F.when(F.col("_mine"), F.col("n_tokens"))).alias("n"), F.sum("n_tokens").alias("n_all"), F.count(F.when(F.col("_mine"), 1)).alias("texts"),
        F.sum(F.when(F.col("k").isNotNull(), F.size("tokens"))).alias("listed"),
    ).first()
    n_train = sizes["n"] or 0
    least = max(2.0, least_share * n_train)

    def result(whole: DataFrame, vocabulary: int) -> DataFrame:
        # base: log10((c + 1) / (N + 1 * (V + 1))) of every token
        low = math.log10(n_train + vocabulary + 1) if n_train + vocabulary else 0.0
        return whole.select(
            F.col("_id").alias("doc_id"), F.coalesce(fold_of("_id", folds) == held_fold, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
            F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(low)).alias("base_score"), F.col("share").alias("score"),
        )

    if n_train / least > _SENT:
        return result(*_by_buckets(spelled, sizes, least, depth))
    tokens = _tokens(spelled)
    forget(spelled)
    facts = tokens.agg(F.count(F.when(F.col("n_train") > 0, 1)).alias("v"), F.count(F.when(F.col("n_train") == 1, 1)).alias("once")).first()
    fresh = max(1, facts["once"])
    alphabet = alphabet_of(tokens, n_train, depth, least)
    rows = encode(marked, tokens, alphabet, n_train, fresh, hot_tokens)
    tree = learn(rows, alphabet, n_train, fresh, least)
    scored = rows.select("_row", "symbols").mapInArrow(lean(_score(spark.sparkContext.broadcast(tree))), "_row long, lp double")
    # tokens that no task knows: each row's own go once to the table of tokens and back
    listed = rows.filter(F.size("cold") > 0).select("_row", F.explode(F.arrays_zip("cold", "cold_n")).alias("c")).select("_row", F.col("c.cold").alias("token"), F.col("c.cold_n").alias("n"))
    cold = tokens.filter(F.col("n_all") < _hot(tokens, "n_all", hot_tokens)).select("token", "n_train")
    rest = math.log10(n_train - sum(alphabet.counts.values()) + fresh)
    known = F.col("n_train") > 0
    met = listed.join(cold.hint("merge"), "token").select(
        "_row", F.when(known, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.log10(F.col("n_train") + 1)).alias("base"),
        (F.col("n") * (F.log10(F.when(known, F.col("n_train")).otherwise(F.lit(fresh))) - rest)).alias("share"),
    )
    zero = F.lit(0.0)
    parts = rows.select("_row", "n_known", "base", "share").unionByName(met).unionByName(scored.select("_row", F.lit(0).cast("long").alias("n_known"), zero.alias("base"), F.col("lp").alias("share")))
    sums = parts.groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("n_known", "base", "share")])
    return result(rows.select("_row", "_id", "n_tokens").join(sums.hint("merge"), "_row"), facts["v"])
