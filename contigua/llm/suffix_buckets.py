"""The suffix tree of a corpus that is too large for the tree to go to every task: learned and read in buckets.

All contexts of a place end with the token before it, so places dealt out by that token hold everything that the states of
their contexts are made of: a bucket counts, tests and scores level by level, as the tree in memory does. Contexts with
more than ``_SHARE`` of all places, as a sample has it, are dealt out by the token before; their cells are counted ahead,
over all texts, and come to each of the buckets. As it is a share, a larger corpus has no more of them, and their cells grow
with its vocabulary; only beyond ``_MOST`` places, which a bucket must hold, a number counts. The sample only says what is
dealt out how: the scores don't depend on it. Nothing but sums of texts leaves the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigua.llm.common import lean
from contigua.llm.suffix_tree import END, Alphabet, _chunks, _diverge, _find, listed_tokens
from contigua.runtime import forget, materialize

#: Twice the places of a bucket, about.
_BUCKET = 300_000
#: Share of all places from which on a context is dealt out over buckets of its own, and the places from which on it always is.
_SHARE, _MOST = 1 / 500, 2_000_000
#: Tokens in lists of chunks to a partition that ranks them, about.
_RANKED = 400_000
#: Places that a task deals out at once, and sums that it holds.
_DEAL = 1_000_000
#: Places to a bucket of sums, about.
_SUMS = 2_000_000
#: Symbols of the sample, about.
_SAMPLE = 2_000_000
#: The buckets are gone through in so many rounds, each of which has its share of the places on disk.
_ROUNDS = 2
#: Rows are named in so many parts, each of which has its share of the rows in shuffles.
_PARTS = 2


class Symbols:
    """Counts of all symbols by number: those of the alphabet, then all others from the most frequent on, then the rest as
    one, then the start of a text."""

    def __init__(self, alphabet: Alphabet, levels: list[tuple[int, int]], n_train: int, fresh: int):
        """``levels``: counts, and how many symbols beyond the alphabet have them, in falling order."""
        import numpy as np

        self.depth, self.hot = alphabet.depth, np.array(list(alphabet.counts.values()), np.int64)
        self.level, many = (np.array([x[i] for x in levels], np.int64) for i in (0, 1))
        self.ends = len(self.hot) + np.cumsum(many)
        self.other = len(self.hot) + int(many.sum())
        self.start, self.base = self.other + 1, self.other + 2
        if self.base >= 1 << 31:
            raise ValueError("too many symbols for 32 bits")
        self.rest = n_train - int(self.hot.sum()) - int((self.level * many).sum()) + fresh
        self.total = n_train + fresh

    def root(self, symbols):
        """Natural log of the root's share of symbols."""
        import numpy as np

        n = np.full(len(symbols), self.rest, np.int64)
        hot = symbols < len(self.hot)
        n[hot] = self.hot[symbols[hot]]
        cold = ~hot & (symbols < self.other)
        n[cold] = self.level[np.searchsorted(self.ends, symbols[cold], "right")]
        return np.log(np.maximum(n / max(1e-300, self.total), 1e-300))

    def valid(self, before, d: int):
        """Whether the last ``d`` symbols, ``before`` from the last one on, can be a context if all but the first can."""
        ok = before[d - 1] != self.other
        return ok & (before[d - 2] != self.start) if d > 1 else ok


def _rank(least: float):
    """Of the tokens of a partition, all lists' entries together: ``n``, the count in training, -1 for the end, and ``r``, the
    rank among those of the same count, for every entry whose chunk can't tell them by itself. Rows without a chunk say
    how many tokens (``k``) have a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part, names = TaskContext.get().partitionId(), ["part", "chunk", "k", "n", "r"]
        token = pa.chunked_array([b.column(2) for b in held]).combine_chunks().dictionary_encode()
        chunk, k, own = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1, 3))
        of, distinct = token.indices.to_numpy(), token.dictionary
        n = np.bincount(of, own, len(distinct)).astype(np.int64)
        end = pc.index(distinct, pa.scalar(bytes(END), distinct.type)).as_py()
        if end >= 0:
            n[end] = -1
        order = np.argsort(n, kind="stable")
        level, first, many = np.unique(n[order], return_index=True, return_counts=True)
        r = np.empty(len(n), np.int64)
        r[order] = np.arange(len(n)) - np.repeat(first, many)
        ok = level >= 0
        level, many = level[ok], many[ok]
        told = np.flatnonzero((n[of] != own) | (n[of] >= least))
        columns = [np.concatenate(x) for x in ((np.full(len(level), -1), chunk[told]), (many, k[told]), (level, n[of[told]]), (np.zeros_like(level), r[of[told]]))]
        columns = [np.full(len(columns[0]), part, np.int32), columns[0], columns[1].astype(np.int32), *columns[2:]]
        for i in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in columns], names=names)

    return run


def rank(spelled: DataFrame, listed: int, least: float) -> DataFrame:
    """What ``_rank`` says of all ``listed`` tokens of chunks, as a written table."""
    each = listed_tokens(spelled).select("chunk", "k", "token", "n_train").repartition(listed // _RANKED + 1, "token")
    return materialize(each.mapInArrow(lean(_rank(least)), "part int, chunk long, k int, n long, r long"), "lm-tokens", tidy=True)


def number(ranks: DataFrame, least: float, first: int) -> tuple[DataFrame, list[tuple[int, int]], DataFrame]:
    """``chunk``, ``k``, ``n``, ``id`` (null: no symbol) of tokens in lists, numbered by falling count, the levels of all counts,
    and the table of where the numbers of a partition's tokens of one count begin."""
    each = ranks.filter("chunk < 0").select("part", "n", "k")
    levels = sorted(map(tuple, each.groupBy("n").agg(F.sum("k")).collect()), reverse=True)
    begin, starts = first, []
    for n, many in levels:
        if n >= least:
            starts.append((n, begin))
            begin += many
    starts = ranks.sparkSession.createDataFrame(starts, "n long, _begin long")
    before = F.sum("k").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    order = materialize(each.join(F.broadcast(starts), "n").select("part", "n", (F.col("_begin") + F.coalesce(before, F.lit(0))).alias("begin")), "lm-symbol-order", tidy=True)
    ids = ranks.filter("chunk >= 0").join(order.hint("merge"), ["part", "n"], "left")
    return ids.select("chunk", "k", "n", F.when(F.col("n") < 0, 0).otherwise(F.col("begin") + F.col("r")).alias("id")), levels, order


_LISTS, _TOLD, _ROWS = range(3)


def _name(symbols: Symbols, fresh: int):
    """Rows with symbols in place of the places in their chunk's list, and sums over their tokens. A chunk's list comes first, then
    what else is told about its tokens, then its rows."""
    other, ends, rest = symbols.other, int(symbols.hot[0]), math.log10(symbols.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, lists, told, table = None, [], [], None

        def learn():
            n = np.concatenate([x for _, x in sorted(lists, key=lambda x: x[0])])
            ids = np.full(len(n), other, np.int32)
            for k, count, i in told:
                n[k], ids[k] = np.where(count < 0, ends, count), i
            share = np.where(ids == other, np.log10(np.where(n > 0, n, fresh)) - rest, 0.0)
            return ids, (n > 0).astype(np.int64), np.log10(n + 1), share

        for b in batches:
            key = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                chunk, what, part = key[low] >> 2, key[low] & 3, b.slice(low, high - low)
                if chunk != now:
                    now, lists, told, table = chunk, [], [], None
                k, n, i, own = (part.column(j) for j in range(1, 5))
                if what == _LISTS:
                    lists += zip(k.to_pylist(), (x.values.to_numpy().copy() for x in own), strict=True)
                elif what == _TOLD:
                    told.append((k.to_numpy(), n.to_numpy(), i.fill_null(other).to_numpy()))
                else:
                    ids, *per = table = table or learn()
                    at = part.column(9).flatten().to_numpy()
                    offsets = np.concatenate([[0], np.cumsum(np.diff(part.column(9).offsets.to_numpy()))]).astype(np.int32)
                    # no text is without a token: the end
                    sums = [pa.array(np.add.reduceat(x[at], offsets[:-1])) for x in per]
                    out = pa.RecordBatch.from_arrays([*(part.column(j) for j in range(5, 9)), *sums, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[at]))], names=_NAMED)
                    yield from (out.slice(j, 1000) for j in range(0, out.num_rows, 1000))

    return run


_NAMED = ["_row", "_id", "_mine", "n_tokens", "n_known", "base", "share", "symbols"]


def _mix(x, y):
    """Hashes of pairs of 64-bit numbers."""
    import numpy as np

    u = np.uint64
    z = (x ^ u(0x9E3779B97F4A7C15)) * u(0xBF58476D1CE4E5B9) + y.astype(u)
    z = (z ^ z >> u(30)) * u(0xBF58476D1CE4E5B9)
    z = (z ^ z >> u(27)) * u(0x94D049BB133111EB)
    return z ^ z >> u(31)


class Routes:
    """Where places go: by the shortest context that isn't large; large ones have ``spans`` buckets from their hash on."""

    def __init__(self, symbols: Symbols, buckets: int):
        import numpy as np

        self.symbols, self.buckets, none = symbols, buckets, np.empty(0, np.int64)
        self.large, self.firsts = [none] * (symbols.depth + 1), [0] * (symbols.depth + 2)
        self.spans, self.hashes, self.whole = none, np.empty(0, np.uint64), np.empty((0, symbols.depth), np.int64)

    def find(self, d: int, up, before):
        """Numbers of the large contexts of ``d`` symbols, -1 for others; ``up``: those of the next shorter ones."""
        import numpy as np

        if not len(self.large[d]):
            return np.full(len(up), -1)
        ok = (up >= 0 if d > 1 else np.ones(len(up), bool)) & self.symbols.valid(before, d)
        at = np.flatnonzero(ok)
        found = _find(self.large[d], np.maximum(up[at], 0) * self.symbols.base + before[d - 1][at])
        out = np.full(len(up), -1)
        out[at] = np.where(found >= 0, found + self.firsts[d], -1)
        return out

    def plan(self, before, scale: int) -> None:
        """Choose the large contexts from a sample, of which each place stands for ``scale``."""
        import numpy as np

        up, base = np.full(len(before[0]), -1), self.symbols.base
        most = min(len(up) * scale * _SHARE, _MOST)
        for d in range(1, self.symbols.depth + 1):
            ok = (up >= 0 if d > 1 else np.ones(len(up), bool)) & self.symbols.valid(before, d)
            keys, at, n = np.unique(np.maximum(up[ok], 0) * base + before[d - 1][ok], return_index=True, return_counts=True)
            big = n * scale > most
            self.large[d], self.firsts[d + 1] = keys[big], self.firsts[d] + int(big.sum())
            places = np.flatnonzero(ok)[at[big]]
            whole = np.stack([x[places] if e < d else np.full(len(places), self.symbols.start) for e, x in enumerate(before)], axis=1).reshape(-1, len(before))
            self.whole = np.concatenate([self.whole, whole])
            shorter = self.hashes[up[places]] if d > 1 else np.zeros(len(places), np.uint64)
            self.hashes = np.concatenate([self.hashes, _mix(shorter, before[d - 1][places])])
            self.spans = np.concatenate([self.spans, np.minimum(-(-2 * n[big] * scale // _BUCKET), self.buckets)])
            up = self.find(d, up, before)
        self.seen = np.zeros(len(self.spans), np.int64)
        self.depths = np.repeat(np.arange(1, self.symbols.depth + 1), np.diff(self.firsts[1:]))
        # buckets of a large context: its own, and those of the longer large ones that end with it
        own = [(int(h % np.uint64(self.buckets)) + np.arange(k)) % self.buckets for h, k in zip(self.hashes, self.spans, strict=True)]
        self.targets = [[x] for x in own]
        for i, (d, w) in enumerate(zip(self.depths, self.whole, strict=True)):
            up = np.full(1, -1)
            for e in range(1, d):
                up = self.find(e, up, [w[j : j + 1] for j in range(len(w))])
                self.targets[up[0]].append(own[i])
        self.targets = [np.unique(np.concatenate(x)) for x in self.targets]

    def deal(self, before, nexts):
        """Buckets of places."""
        import numpy as np

        u, n = np.uint64, len(nexts)
        key, span, bucket = np.zeros(n, u), np.full(n, self.buckets), np.zeros(n, np.int64)
        up, open_ = np.full(n, -1), np.ones(n, bool)

        def close(at, by):
            bucket[at] = ((key[at] % u(self.buckets) + by % span[at].astype(u)) % u(self.buckets)).astype(np.int64)
            open_[at] = False

        for d in range(1, self.symbols.depth + 1):
            ok = self.symbols.valid(before, d)
            at = np.flatnonzero(open_ & ~ok)
            close(at, _mix(key[at], nexts[at]))
            up = self.find(d, up, before)
            at = np.flatnonzero(open_ & (up < 0))
            close(at, _mix(key[at], before[d - 1][at]))
            at = np.flatnonzero(open_)
            key[at], span[at] = self.hashes[up[at]], self.spans[up[at]]
        at = np.flatnonzero(open_)
        close(at, _mix(key[at], nexts[at]))
        return bucket


def _places(batches, columns: int, symbols: Symbols):
    """Symbols before the places of many texts from the last one on, symbols at them, and the texts' other columns."""
    import numpy as np

    for b in batches:
        for s, pos, text in _chunks(b.column(columns), symbols.depth, symbols.start):
            yield [s[pos - d] for d in range(1, symbols.depth + 1)], s[pos], [b.column(i).to_numpy(zero_copy_only=False)[text] for i in range(columns)]


_PACKED = "bucket long, keys binary, values binary"


def _packed(held, parts: int) -> Iterator[pa.RecordBatch]:
    """Sums of values by key, many to a row, from pairs of arrays."""
    import numpy as np

    keys, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    values = np.bincount(at, np.concatenate([x for _, x in held]))
    bucket = (_mix(np.zeros(len(keys), np.uint64), keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket)
    keys, values, bucket = keys[order].astype("<i8"), values[order].astype("<f8"), bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for i in range(0, len(cuts) - 1, 50):
        ends = cuts[i : i + 51]
        blobs = [[x[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] for x in (keys, values)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]]), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "keys", "values"])


def _unpacked(key: str, value: str, keep=None):
    """Sums of values by key over all rows of a bucket, as far as ``keep`` (of keys and sums) says; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, held = None, ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            keys, at = np.unique(np.frombuffer(b"".join(held[0]), "<i8"), return_inverse=True)
            values = np.bincount(at, np.frombuffer(b"".join(held[1]), "<f8"))
            if keep is not None:
                ok = keep(keys, values)
                keys, values = keys[ok], values[ok]
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000]), pa.array(values[i : i + 50_000])], names=[key, value])

        for b in batches:
            for bucket, keys, values in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if bucket != now and now is not None:
                    yield from flush()
                    held = ([], [])
                now = bucket
                held[0].append(keys.as_py())
                held[1].append(values.as_py())
        if now is not None:
            yield from flush()

    return run


def _summed(packed: DataFrame, key: str, value: str, keep=None) -> DataFrame:
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_unpacked(key, value, keep)), f"{key} long, {value} double")


def _count_large(shared, parts: int):
    """Counts of the cells (large context, next symbol), as far as this task has them. What a context has in all stands under the
    start of a text, which is no place's next symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        routes, held, size = shared.value, [], 0

        for before, nexts, _ in _places(batches, 0, routes.symbols):
            up = np.full(len(nexts), -1)
            for d in range(1, routes.symbols.depth + 1):
                up = routes.find(d, up, before)
                at = np.flatnonzero(up >= 0)
                cell, n = np.unique(up[at] * routes.symbols.base + nexts[at], return_counts=True)
                whole, of_all = np.unique(up[at], return_counts=True)
                held += [(cell, n), (whole * routes.symbols.base + routes.symbols.start, of_all)]
                size += len(cell) + len(whole)
            if size >= _DEAL:
                yield from _packed(held, parts)
                held, size = [], 0
        if size:
            yield from _packed(held, parts)

    return run


def _squeeze(columns) -> bytes:
    """Columns of whole numbers, the first of them as differences, by planes of bytes, compressed."""
    import numpy as np
    import zstandard

    first, *others = columns
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (np.diff(first, prepend=first.dtype.type(0)), *others)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _stretch(data: bytes, n: int, types) -> list:
    import numpy as np
    import zstandard

    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), [], 0
    for t in types:
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=types[0])
    return out


def _cut(bucket, columns, large: bool) -> Iterator[pa.RecordBatch]:
    """A row a bucket of rows that come sorted by it."""
    import numpy as np

    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
    for i in range(0, len(cuts) - 1, 200):
        ends = cuts[i : i + 201]
        spans = list(zip(ends, ends[1:], strict=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[ends[:-1]]), pa.array([large] * len(spans)), pa.array([int(b - a) for a, b in spans], pa.int64()), pa.array([_squeeze([c[a:b] for c in columns]) for a, b in spans], pa.binary())],
            names=["bucket", "large", "n", "data"],
        )


_DEALT = "bucket long, large boolean, n long, data binary"


def _deal(shared, rounds: int, turn: int):
    """Places of this turn's buckets, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        routes, held, size = shared.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*held, strict=True))
            held.clear()
            for i, x in enumerate(columns):
                columns[i] = np.concatenate(x)
            order = np.argsort(columns[0] << 31 | columns[1])
            for i, x in enumerate(columns):
                columns[i] = x[order]
            yield from _cut(columns[0], columns[1:], False)

        for before, nexts, (row, mine) in _places(batches, 2, routes.symbols):
            bucket = routes.deal(before, nexts)
            at = np.flatnonzero(bucket % rounds == turn)
            held.append((bucket[at], *(x[at].astype(np.int32) for x in (*before, nexts)), row[at] << 1 | mine[at]))
            size += len(at)
            if size >= _DEAL:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return run


def _deliver(shared, rounds: int, turn: int):
    """Cells of large contexts to all buckets with places that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        routes = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 10_000):
                cell, n = (b.column(i).slice(k, 10_000).to_numpy().astype(np.int64) for i in range(2))
                large, nexts = cell // routes.symbols.base, cell % routes.symbols.base
                bucket = [routes.targets[i] for i in large]
                many = np.array([len(x) for x in bucket])
                bucket = np.concatenate(bucket)
                at = np.flatnonzero(bucket % rounds == turn)
                at = at[np.argsort(bucket[at], kind="stable")]
                yield from _cut(bucket[at], [np.repeat(x, many)[at] for x in (large, nexts, n)], True)

    return run


def _groups(keys):
    """A member of each group of equal keys, and the group of each key."""
    import numpy as np

    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def log_p(routes: Routes, before, nexts, mine, large, after, n, least: float):
    """Natural log of what the model gives to the places of a bucket.

    ``before``: symbols before them from the last one on; ``mine``: whether they are learned from. ``large``, ``after``,
    ``n``: cells with ``least`` of the large contexts that occur here. Every other context is here with all its places.
    """
    import numpy as np

    symbols, places = routes.symbols, len(nexts)
    before = [np.concatenate([x, w]).astype(np.int64) for x, w in zip(before, routes.whole[large].T, strict=True)]
    nexts = np.concatenate([nexts, after]).astype(np.int64)
    depths = np.concatenate([np.full(places, symbols.depth), routes.depths[large]])
    total = symbols.root(nexts)
    up, held, alive = np.full(len(nexts), -1), np.zeros(len(nexts), np.int64), np.ones(len(nexts), bool)
    for d in range(1, symbols.depth + 1):
        up = routes.find(d, up, before)
        at = np.flatnonzero(alive & symbols.valid(before, d) & (depths >= d))
        alive[:] = False
        if not len(at):
            break
        # places of large contexts count nothing here: their cells say it
        weight = np.concatenate([mine & (up[:places] < 0), np.where(routes.depths[large] == d, n, 0)])[at]
        one, context = _groups(held[at] * symbols.base + before[d - 1][at])
        seen = np.where(up[at][one] >= 0, routes.seen[up[at][one]] if len(routes.seen) else 0, np.bincount(context, weight, minlength=len(one)))
        first, cell = _groups(context * symbols.base + nexts[at])
        count = np.bincount(cell, weight, minlength=len(first))
        kept = np.flatnonzero((count >= least) & (seen[context[first]] >= least))
        of = context[first[kept]]
        keep, share, gain = _diverge(of, count[kept], total[at[first[kept]]], seen)
        more = np.zeros(len(first))
        more[kept] = np.where(keep[of], gain, 0)
        total[at] += np.where(keep, share, 0)[context] + more[cell]
        held[at] = context
        alive[at] = (seen >= least)[context]
    return total[:places]


def _sum_rows(shared, least: float, parts_out: int):
    """Sums of log probabilities by row, as far as the buckets of this task have them; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        routes = shared.value
        types = [np.int32] * (routes.symbols.depth + 1) + [np.int64]
        now, parts, done, size = None, ([], []), [], 0

        def finish() -> None:
            nonlocal size
            places, cells = ([np.concatenate(x) for x in zip(*p, strict=True)] for p in parts)
            for p in parts:
                p.clear()
            if not places:
                return
            if not cells:
                cells = [np.empty(0, np.int64)] * 3
            *before, nexts, row = places
            lp = log_p(routes, before, nexts, (row & 1) == 1, *cells, least)
            rows, at = np.unique(row >> 1, return_inverse=True)
            done.append((rows, np.bincount(at, lp)))
            size += len(rows)

        for b in batches:
            for bucket, large, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if bucket != now and now is not None:
                    finish()
                    if size >= _DEAL:
                        yield from _packed(done, parts_out)
                        done, size = [], 0
                now = bucket
                parts[large].append(_stretch(data.as_py(), n, [np.int64] * 3 if large else types))
        finish()
        if size:
            yield from _packed(done, parts_out)

    return run


def name(spelled: DataFrame, ids: DataFrame, symbols: Symbols, fresh: int) -> DataFrame:
    """The rows with symbols and sums over their tokens, as written tables."""
    weighed = spelled.filter("k is null").select(F.explode(F.array_repeat("chunk", (F.col("n_tokens") / 256 + 1).cast("int"))).alias("chunk"))
    cuts = sorted(set(weighed.agg(F.percentile_approx("chunk", [i / _PARTS for i in range(1, _PARTS)])).first()[0] or ()))
    kind = spelled.schema["_id"].dataType.simpleString()
    types = {"k": "int", "n": "long", "id": "long", "n_train": "array<long>", "_row": "long", "_id": kind, "_mine": "boolean", "n_tokens": "long", "symbols": "array<int>"}
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):

        def some(rows: DataFrame, what: int, *columns: str) -> DataFrame:
            for bound, within in ((low, F.col("chunk") > F.lit(low)), (high, F.col("chunk") <= F.lit(high))):  # noqa: B023
                rows = rows if bound is None else rows.filter(within)
            key = F.shiftleft("chunk", 2).bitwiseOR(F.lit(what).cast("long")).alias("key")
            # lists that a row hasn't are empty, not null: Arrow's writer goes over all nulls of a batch anew with every row
            none = {c: F.array() if t.startswith("array") else F.lit(None) for c, t in types.items()}
            return rows.select(key, *[(F.col(c) if c in columns else none[c]).cast(t).alias(c) for c, t in types.items()])

        lists = some(spelled.filter("k is not null"), _LISTS, "k", "n_train")
        told = some(ids, _TOLD, "k", "n", "id")
        rows = some(spelled.filter("k is null"), _ROWS, "_row", "_id", "_mine", "n_tokens", "symbols")
        met = lists.unionByName(told).unionByName(rows).repartition(F.shiftright("key", 2)).sortWithinPartitions("key")
        named = met.mapInArrow(lean(_name(symbols, fresh)), f"_row long, _id {kind}, _mine boolean, n_tokens long, n_known long, base double, share double, symbols array<int>")
        parts.append(materialize(named, "lm-named", tidy=True))
    named, *more = parts
    for x in more:
        named = named.unionByName(x)
    return named


def score_rows(rows: DataFrame, symbols: Symbols, n_all: int, least: float) -> list[DataFrame]:
    """Tables of ``_row``, ``lp`` (natural log) from named rows; a row's sum over all of them is its text's."""
    import numpy as np

    spark = rows.sparkSession
    sc, buckets, parts, scale = spark.sparkContext, max(1, 2 * n_all // _BUCKET), max(1, n_all // _SUMS), max(1, n_all // _SAMPLE)
    routes = Routes(symbols, buckets)
    sample = rows.filter(F.pmod(F.xxhash64("_row"), F.lit(scale)) == 0).select(F.slice("symbols", 1, 100_000).alias("symbols")).toArrow().combine_chunks().to_batches()
    before = [x for x, _, _ in _places(sample, 0, symbols)]
    if before:
        routes.plan([np.concatenate(x) for x in zip(*before, strict=True)], scale)
    cells = None
    if len(routes.spans):
        counted = rows.filter("_mine").select("symbols").mapInArrow(lean(_count_large(sc.broadcast(routes), parts)), _PACKED)
        base, start = symbols.base, symbols.start
        # cells of fewer occurrences make no state: they end where they are summed
        cells = materialize(_summed(counted, "cell", "n", lambda cell, n: (n >= least) | (cell % base == start)), "lm-large", tidy=True)
        in_all = F.col("cell") % base == start
        for r in cells.filter(in_all).select(F.expr(f"cell div {base}").alias("large"), "n").toLocalIterator():
            routes.seen[r["large"]] = int(r["n"])
        few = cells.filter(~in_all)
    shared, out, rounds = sc.broadcast(routes), [], min(_ROUNDS, buckets)
    for turn in range(rounds):
        dealt = rows.select("_row", "_mine", "symbols").mapInArrow(lean(_deal(shared, rounds, turn)), _DEALT)
        if cells is not None:
            dealt = dealt.unionByName(few.mapInArrow(lean(_deliver(shared, rounds, turn)), _DEALT))
        summed = dealt.repartition(buckets // rounds // 16 + 1, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_sum_rows(shared, least, parts)), _PACKED)
        out.append(materialize(_summed(summed, "_row", "lp"), "lm-sums", tidy=True))
    if cells is not None:
        forget(cells)
    return out
