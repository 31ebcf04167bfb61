"""Kernels on whole Arrow columns of sequences and qualities: rows of a block stand below one another in a matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Cells of a matrix that is worked on at once, about.
CELLS = 1 << 20


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of a string column, one after another, and where each row begins and ends in them."""
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_column(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string column of such bytes."""
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data)), mask)


def blocks(col: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a string column by blocks of some ``CELLS`` cells: which, a matrix of their characters (filled up with 0) and
    their lengths; null is empty."""
    data, at = text_buffers(col)
    if len(data) and data.max() > 127:
        texts = [x or "" for x in col.to_pylist()]
        data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    size = np.diff(at)
    i = 0
    while i < len(size):
        j, width = i, 1
        while j < len(size):
            wide = max(width, int(size[j]))
            if j > i and (j - i + 1) * wide > CELLS:
                break
            j, width = j + 1, wide
        n = size[i:j]
        if (n == width).all():
            m = data[at[i] : at[j]].reshape(j - i, width)
        else:
            m = np.zeros((j - i, width), data.dtype)
            m[np.arange(width) < n[:, None]] = data[at[i] : at[j]]
        yield slice(i, j), m, n
        i = j


def longest_runs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start (from 0) and length of the first of the longest runs of one base of every row; 0 and 0 if it has none."""
    start, length = np.zeros(len(col), np.int32), np.zeros(len(col), np.int32)
    for rows, m, _ in blocks(col):
        w = m.shape[1] + 1
        flat = np.zeros((len(m), w), m.dtype)
        flat[:, :-1] = m
        flat = flat.ravel()
        at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        n = np.diff(np.append(at, len(flat)))
        base = np.isin(flat[at], [65, 67, 71, 84])
        at, n = at[base], n[base]
        if not len(at):
            continue
        row = at // w
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        best = np.maximum.reduceat(n * w + (w - 1 - at % w), head)
        length[rows][row[head]] = best // w
        start[rows][row[head]] = w - 1 - best % w
    return start, length


def dust(col: pa.Array) -> np.ndarray:
    """Low-complexity scores, as ``sequence.dust`` has them."""
    out = np.zeros(len(col))
    for rows, m, n in blocks(col):
        if m.shape[1] <= 3:
            continue
        seen = np.unique(m) if m.dtype != np.uint8 else np.flatnonzero(np.bincount(m.ravel(), minlength=128))
        code = np.searchsorted(seen, m) if m.dtype != np.uint8 else np.cumsum(np.isin(np.arange(256), seen))[m] - 1
        k = len(seen)
        word = (code[:, :-3] * k + code[:, 1:-2]) * k + code[:, 2:-1]
        real = np.arange(word.shape[1]) < n[:, None] - 3  # the last 3-mer of a row isn't counted
        pairs = np.zeros(len(m))
        step = max(1, CELLS // k**3)
        for i in range(0, len(m), step):
            some = real[i : i + step]
            cell = (np.arange(len(some))[:, None] * k**3 + word[i : i + step])[some]
            c = np.bincount(cell, minlength=len(some) * k**3).reshape(len(some), -1)
            pairs[i : i + step] = (c * (c - 1) // 2).sum(1)
        out[rows] = np.where(n > 3, pairs / np.maximum(n - 2, 1), 0.0)
    return out


def soft_clip(col: pa.Array, threshold: int) -> np.ndarray:
    """Bases kept by quality trimming, as ``sequence.soft_clip_end`` has them."""
    out = np.zeros(len(col), np.int32)
    for rows, m, n in blocks(col):
        col_at = np.arange(m.shape[1])
        short = np.where(col_at < n[:, None], threshold + 33 - m.astype(np.int32), 0)
        sums = np.cumsum(short[:, ::-1], axis=1)  # by how many places from the matrix's right edge
        cut = np.argmax(sums, axis=1) + 1 - (m.shape[1] - n)
        last = m[np.arange(len(m)), np.maximum(n - 1, 0)].astype(np.int32)
        out[rows] = np.where((n > 0) & (last - 33 >= threshold), n, n - np.where(n > 0, cut, 0))
    return out


def count_up_to(col: pa.Array, phred: int) -> np.ndarray:
    """How many scores of every row are ``phred`` at most."""
    out = np.zeros(len(col), np.int32)
    for rows, m, n in blocks(col):
        out[rows] = ((m <= phred + 33) & (np.arange(m.shape[1]) < n[:, None])).sum(1)
    return out


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Differing places of every two rows, as far as the shorter one goes."""
    out, at = np.zeros(len(a), np.int32), 0
    step = max(1, CELLS // (1 + max([*np.diff(text_buffers(a)[1]), *np.diff(text_buffers(b)[1]), 0])))
    for at in range(0, len(a), step):
        x, y = list(blocks(a.slice(at, step))), list(blocks(b.slice(at, step)))
        assert len(x) == len(y) == 1
        (_, m, n), (_, o, k) = x[0], y[0]
        w = min(m.shape[1], o.shape[1])
        out[at : at + step] = ((m[:, :w] != o[:, :w]) & (np.arange(w) < np.minimum(n, k)[:, None])).sum(1)
    return out


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Least substitutions, insertions and deletions of every pair: columns of the table as bit vectors, all pairs in step.

    Words of 64 rows of the table; carries go from word to word. Pairs go by blocks of like lengths.
    """
    out = np.zeros(len(a), np.int32)
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    i = 0
    while i < len(order):
        j, wide = i, 1
        while j < len(order):
            now = max(wide, len(a[order[j]]) + len(b[order[j]]))
            if j > i and (j - i + 1) * now > CELLS:
                break
            j, wide = j + 1, now
        some = order[i:j]
        out[some] = _edits([a[k] for k in some], [b[k] for k in some])
        i = j
    return out


def _edits(a: list[str], b: list[str]) -> np.ndarray:
    (x, n), (y, k) = _codes(a), _codes(b)
    rows, n_words = len(a), -(-max(x.shape[1], 1) // 64)
    top = int(max(x.max(initial=0), y.max(initial=0))) + 1
    seen = np.flatnonzero(np.bincount(x.ravel(), minlength=top) + np.bincount(y.ravel(), minlength=top))
    number = np.zeros(top, np.intp)
    number[seen] = np.arange(len(seen))
    x, y = number[x], number[y]
    one = np.uint64(1)
    # of every pair, word and letter the rows of the table that have the letter
    peq = np.zeros((n_words, rows, len(seen)), np.uint64)
    for p in range(x.shape[1]):
        mine = np.flatnonzero(p < n)
        peq[p // 64, mine, x[mine, p]] |= one << np.uint64(p % 64)
    plus = [np.full(rows, 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in range(n_words)]
    minus = [np.zeros(rows, np.uint64) for _ in range(n_words)]
    last_word, last_bit = np.maximum(n - 1, 0) // 64, (np.maximum(n - 1, 0) % 64).astype(np.uint64)
    ends = [last_word == w for w in range(n_words)]
    score, every, top = n.astype(np.int64), np.arange(rows), np.uint64(63)
    for p in range(y.shape[1]):
        c, live = y[:, p], p < k
        up, down = np.ones(rows, np.uint64), np.zeros(rows, np.uint64)  # the table's first row grows by one a column
        for w in range(n_words):
            eq, pv, mv = peq[w, every, c], plus[w], minus[w]
            xv = eq | mv
            eq = eq | down
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if ends[w].any():
                here = live & ends[w]
                score[here] += (ph >> last_bit & one).view(np.int64)[here] - (mh >> last_bit & one).view(np.int64)[here]
            out_up, out_down = ph >> top, mh >> top
            ph, mh = ph << one | up, mh << one | down
            plus[w], minus[w] = mh | ~(xv | ph), ph & xv
            up, down = out_up, out_down
    return np.where(n == 0, k, score)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    m = np.zeros((len(texts), int(n.max(initial=0))), np.uint32)
    m[np.arange(m.shape[1]) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return m, n


_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[list(b"ACGT")] = list(b"TGCA")


def canonical(col: pa.Array) -> pa.Array:
    """The lesser of every sequence and its reverse complement; null stays null."""
    data, at = text_buffers(col)
    if len(data) and data.max() > 127:
        swap = str.maketrans("ACGT", "TGCA")
        least = lambda x: min(x, x.translate(swap)[::-1], key=lambda t: t.encode("utf-8", "surrogatepass"))
        return pa.array([None if x is None else least(x) for x in col.to_pylist()], pa.string())
    out = np.empty_like(data)
    for rows, m, n in blocks(col):
        width, back = m.shape[1], _OTHER[m][:, ::-1]
        real = np.arange(width) < n[:, None]
        if not real.all():  # what a row is filled up with stands in front now
            back = np.take_along_axis(back, (np.arange(width) + (width - n)[:, None]) % width, axis=1)
        differ = m != back
        first = np.argmax(differ, axis=1)
        every = np.arange(len(m))
        less = m[every, first] <= back[every, first]
        out[at[rows.start] : at[rows.stop]] = np.where(less[:, None], m, back)[real]
    return text_column(out, at, col.is_valid().to_numpy(zero_copy_only=False))


def max_share(col: pa.Array) -> pa.Array:
    """Share of the most frequent base of every row; null where there is none to share."""
    out, size = np.zeros(len(col)), np.zeros(len(col), np.int64)
    for rows, m, n in blocks(col):
        out[rows] = np.max([(m == base).sum(1) for base in b"ACGT"], axis=0) / np.maximum(n, 1)
        size[rows] = n
    return pa.array(out, mask=size == 0)


def quality_sums(col: pa.Array, q_min: int) -> np.ndarray:
    """Of every place (from 0) of the strings of a column how many have it, the sum of their scores and how many reach ``q_min``."""
    out = np.zeros((0, 3), np.int64)
    for _, m, n in blocks(col):
        real = np.arange(m.shape[1]) < n[:, None]
        score = m.astype(np.int64) - 33
        some = np.column_stack([real.sum(0), (score * real).sum(0), ((score >= q_min) & real).sum(0)])
        if len(some) > len(out):
            out, some = some, out
        out[: len(some)] += some
    return out[out[:, 0] > 0]


def _masked(values: np.ndarray, *cols: pa.Array) -> pa.Array:
    """Values, null where one of the columns is."""
    return pa.array(values, mask=~np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in cols]))


def other_share(col: pa.Array, bases: bytes) -> pa.Array:
    """Share of characters other than ``bases`` of every row; null where there is none to share."""
    out, size = np.zeros(len(col)), np.zeros(len(col), np.int64)
    for rows, m, n in blocks(col):
        out[rows] = (n - sum((m == base).sum(1) for base in bases)) / np.maximum(n, 1)
        size[rows] = n
    return pa.array(out, mask=size == 0)


@arrow_udf(T.DoubleType())
def gc_udf(seq: pa.Array) -> pa.Array:
    return other_share(seq, b"AT")


@arrow_udf(T.StringType())
def canonical_udf(seq: pa.Array) -> pa.Array:
    return canonical(seq)


@arrow_udf(T.DoubleType())
def max_share_udf(seq: pa.Array) -> pa.Array:
    return max_share(seq)


@arrow_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
def longest_run_udf(seq: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([_masked(x, seq) for x in longest_runs(seq)], names=["start", "length"])


@arrow_udf(T.DoubleType())
def dust_udf(seq: pa.Array) -> pa.Array:
    return _masked(dust(seq), seq)


@arrow_udf(T.IntegerType())
def soft_clip_udf(qual: pa.Array, threshold: pa.Array) -> pa.Array:
    return _masked(soft_clip(qual, threshold[0].as_py() if len(threshold) else 0), qual)


@arrow_udf(T.IntegerType())
def count_up_to_udf(qual: pa.Array, phred: pa.Array) -> pa.Array:
    return _masked(count_up_to(qual, phred[0].as_py() if len(phred) else 0), qual)


@arrow_udf(T.IntegerType())
def differing_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _masked(differing(a, b), a, b)
