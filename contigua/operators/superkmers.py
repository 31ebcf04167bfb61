"""k-mers counted where they meet: reads travel as pieces of many windows, two bits a base, instead of one row a window.

A window's bucket follows from the least hash of its canonical m-mers, so that both strands of a k-mer share one and
neighbouring windows mostly do. A run of windows of one bucket is one piece; the pieces of a bucket are cut into windows,
sorted and counted in the task that holds it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.runtime import ship

#: Bits of a bucket's number: a share of 1 in 4096 of all windows is what a task sorts at once.
BUCKET_BITS = 12
#: Longest m-mer that places windows, bases cut at once, windows counted at once, rows of an answer.
M, CHUNK, WINDOWS, ROWS = 11, 1_000_000, 1_000_000, 100_000
PIECES = "bucket int, tag int, blob binary, odd string, id long"

_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = [0, 1, 2, 3]
_FOUR = np.array([list(bytes("ACGT"[b >> 6] + "ACGT"[b >> 4 & 3] + "ACGT"[b >> 2 & 3] + "ACGT"[b & 3], "ascii")) for b in range(256)], np.uint8)
_BASES = np.array([[b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3] for b in range(256)], np.uint8)
_SWAP = str.maketrans("ACGT", "TGCA")


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of ranges that start at ``starts``, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _mers(codes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the m-mers from every place and of their reverse complements."""
    n = len(codes) - m + 1
    fwd, rev = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for i in range(m):
        c = codes[i : i + n].astype(np.uint32) & np.uint32(3)
        fwd = fwd << np.uint32(2) | c
        rev |= (np.uint32(3) - c) << np.uint32(2 * i)
    return fwd, rev


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of ``w`` values from every place."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def _buckets(codes: np.ndarray, k: int) -> np.ndarray:
    """The bucket of the window from every place; -1 where it isn't of ACGT only."""
    m = min(k, M)
    fwd, rev = _mers(codes, m)
    h = np.minimum(fwd, rev)
    h = h * np.uint32(2654435761)
    h = _least((h ^ h >> np.uint32(15)) * np.uint32(2246822519), k - m + 1)
    b = ((h ^ h >> np.uint32(13)) * np.uint32(3266489917) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    bad = np.concatenate([[0], np.cumsum(codes == 4, dtype=np.int32)])
    b[bad[k:] != bad[:-k]] = -1
    return b


def _odd(seqs: pa.Array, ids: np.ndarray | None, rows: np.ndarray, k: int, tag: int) -> Iterator[pa.RecordBatch]:
    """Windows with other letters, a row each, as their reads have them."""
    for r in rows:
        s = seqs[int(r)].as_py()
        found = [w for w in (s[i : i + k] for i in range(len(s) - k + 1)) if w.strip("ACGT")]
        for at in range(0, len(found), ROWS):
            some = found[at : at + ROWS]
            n = len(some)
            yield _batch(np.array([_bucket_of(w) for w in some], np.int32), tag, [None] * n, some, np.full(n, 0 if ids is None else ids[r], np.int64))


def _bucket_of(window: str) -> int:
    """A bucket for a window with other letters, the same for both strands."""
    return zlib.crc32(_canonical(window).encode("utf-32-le", "surrogatepass")) >> (32 - BUCKET_BITS)


def _canonical(window: str) -> str:
    return min(window, window.translate(_SWAP)[::-1])


def _batch(bucket: np.ndarray, tag: int, blobs: list, odd: list, ids: np.ndarray) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(n, tag, np.int32)), pa.array(blobs, pa.binary()), pa.array(odd, pa.string()), pa.array(ids)], ["bucket", "tag", "blob", "odd", "id"])


def _cut(seqs: pa.Array, ids: np.ndarray | None, k: int, tag: int) -> Iterator[pa.RecordBatch]:
    n = len(seqs)
    offsets = np.frombuffer(seqs.buffers()[1], np.int32, n + 1, seqs.offset * 4)
    data = np.frombuffer(seqs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    codes = np.insert(_CODE[data], offsets[1:] - offsets[0], 4)
    first = offsets[:-1] - offsets[0] + np.arange(n)  # of every read, one place between two of them
    other = codes == 4
    other[first[1:] - 1] = other[-1] = False
    if other.any():
        yield from _odd(seqs, ids, np.unique(np.searchsorted(first, np.flatnonzero(other), "right") - 1), k, tag)
    if len(codes) < k:
        return
    b = _buckets(codes, k)
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    size = np.diff(np.append(edge, len(b)))
    edge, size = edge[b[edge] >= 0], size[b[edge] >= 0]
    if not len(edge):
        return
    parts = (size + 254) // 255  # a piece has 255 windows at most
    within = _spread(np.zeros(len(parts), np.int64), parts)
    start = np.repeat(edge, parts) + 255 * within
    size = np.minimum(255, np.repeat(size, parts) - 255 * within)
    order = np.argsort(b[start], kind="stable")
    start, size = start[order], size[order]
    bucket = b[start]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    count = np.diff(np.append(head, len(bucket)))
    bases = np.add.reduceat(size + (k - 1), head)
    held = (bases + 3) // 4
    out = np.zeros(int(held.sum()) * 4, np.uint8)
    out[_spread(4 * (np.cumsum(held) - held), bases)] = codes[_spread(start, size + (k - 1))]
    packed = (out[0::4] << 6 | out[1::4] << 4 | out[2::4] << 2 | out[3::4]).tobytes()
    size = size.astype(np.uint8).tobytes()
    own = None if ids is None else ids[np.searchsorted(first, start, "right") - 1].tobytes()
    blobs, at = [], 0
    for h, c, n in zip(head.tolist(), count.tolist(), held.tolist(), strict=True):
        blobs.append(b"".join((c.to_bytes(4, "little"), size[h : h + c], b"" if own is None else own[8 * h : 8 * (h + c)], packed[at : at + n])))
        at += n
    yield _batch(bucket[head], tag, blobs, [None] * len(blobs), np.zeros(len(blobs), np.int64))


def pieces(reads: DataFrame, k: int, tag: int = 0, ids: bool = False) -> DataFrame:
    """``bucket``, ``tag``, ``blob`` (pieces of windows of ``reads``; with ``ids`` each with its ``read_idx``), ``odd`` and
    ``id``: windows with letters other than ACGT, one a row. Reads shorter than ``k`` give none."""
    ship(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seqs = batch.column(0)
            own = batch.column(1).to_numpy() if ids else None
            ends = np.cumsum(np.diff(np.frombuffer(seqs.buffers()[1], np.int32, len(seqs) + 1, seqs.offset * 4).astype(np.int64)))
            at = 0
            while at < len(seqs):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                yield from _cut(seqs.slice(at, to - at), None if own is None else own[at:to], k, tag)
                at = to

    return reads.filter(F.length("seq") >= k).select("seq", *[F.col("read_idx").cast("long")] * ids).mapInArrow(run, PIECES)


class Windows:
    """Windows of pieces: ``words`` (of 32 bases, the canonical k-mer from the left), ``fwd`` (whether the piece has it so),
    ``size`` of every piece in windows, ``ids``."""

    def __init__(self, blobs: list[bytes], k: int, ids: bool) -> None:
        sizes, own, packed, starts, at = [], [], [], [], 0
        for blob in blobs:
            n = int.from_bytes(blob[:4], "little")
            size = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
            if ids:
                own.append(np.frombuffer(blob, np.int64, n, 4 + n) if (4 + n) % 8 == 0 else np.frombuffer(blob[4 + n : 4 + 9 * n], np.int64))
            body = np.frombuffer(blob, np.uint8, offset=4 + n + 8 * n * ids)
            starts.append(at + np.cumsum(size + (k - 1)) - (size + (k - 1)))
            sizes.append(size)
            packed.append(body)
            at += 4 * len(body)
        self.size, self.ids = np.concatenate(sizes), np.concatenate(own) if ids else None
        n_words = -(-k // 32)
        raw = np.concatenate([*packed, np.zeros(8 * n_words + 9, np.uint8)])
        long = np.zeros(len(raw) - 7, np.uint64)
        for i in range(8):
            long = long << np.uint64(8) | raw[i : i + len(long)]
        place = _spread(np.concatenate(starts), self.size)
        byte, shift = place >> 2, (2 * (place & 3)).astype(np.uint64)
        words = [long[byte + 8 * j] << shift | raw[byte + 8 * j + 8].astype(np.uint64) >> (np.uint64(8) - shift) for j in range(n_words)]
        spare = np.uint64(2 * (32 * n_words - k))
        words[-1] = words[-1] >> spare << spare
        back = [_reversed(~w) for w in words[::-1]]
        if spare:
            back = [w << spare | (back[j + 1] >> (np.uint64(64) - spare) if j + 1 < n_words else np.uint64(0)) for j, w in enumerate(back)]
        fwd = words[-1] <= back[-1]
        for w, b in zip(words[-2::-1], back[-2::-1], strict=True):
            fwd = (w < b) | ((w == b) & fwd)
        self.fwd, self.words = fwd, [np.where(fwd, w, b) for w, b in zip(words, back, strict=True)]


def _reversed(x: np.ndarray) -> np.ndarray:
    """The 32 bases of every word from the last to the first."""
    x = x.byteswap()
    for bits, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        b, low = np.uint64(bits), np.uint64(mask)
        x = (x >> b & low) | (x & low) << b
    return x


def _groups(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal k-mers stand together, and the first places of the groups in it."""
    key = words[0]
    for w in words[1:]:
        key = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) ^ w
    order = np.argsort(key)
    for attempt in range(2):
        change = np.zeros(len(order), bool)
        change[:1] = True
        for w in words:
            s = w[order]
            change[1:] |= s[1:] != s[:-1]
        key = key[order]
        if attempt or len(words) == 1 or change.sum() == 1 + np.count_nonzero(key[1:] != key[:-1]):
            break
        order = np.lexsort(words[::-1])  # two k-mers of one key
    return order, np.flatnonzero(change)


def _count(words: list[np.ndarray], column: np.ndarray, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    order, first = _groups(words)
    size = np.diff(np.append(first, len(order)))
    at = np.repeat(np.arange(len(first)), size) * columns + column[order]
    return [w[order[first]] for w in words], np.bincount(at, minlength=len(first) * columns).reshape(len(first), columns)


def _merge(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    words = [np.concatenate(w) for w in zip(*[p[0] for p in parts], strict=True)]
    order, first = _groups(words)
    return [w[order[first]] for w in words], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], first)


def _texts(words: list[np.ndarray], k: int) -> pa.Array:
    n = len(words[0])
    letters = np.concatenate([_FOUR[w.byteswap().view(np.uint8)].reshape(n, 32) for w in words], axis=1)[:, :k]
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


class Bucket:
    """What has come of one bucket: blobs by tag, odd windows (tag, window, id)."""

    def __init__(self) -> None:
        self.blobs: dict[int, list[bytes]] = {}
        self.odd: list[tuple[int, str, int]] = []


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    last, held = None, None
    for batch in batches:
        for bucket, tag, blob, odd, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != last:
                if held is not None:
                    yield held
                last, held = bucket, Bucket()
            if blob is None:
                held.odd.append((tag, odd, own))
            else:
                held.blobs.setdefault(tag, []).append(blob)
    if held is not None:
        yield held


def _some(blobs: list[bytes]) -> Iterator[list[bytes]]:
    """Blobs by some ``WINDOWS`` windows."""
    out, n = [], 0
    for blob in blobs:
        out.append(blob)
        n += sum(blob[4 : 4 + int.from_bytes(blob[:4], "little")])
        if n >= WINDOWS:
            yield out
            out, n = [], 0
    if out:
        yield out


def _tally(b: Bucket, tags: range, k: int, ids: bool = False) -> tuple[list[np.ndarray], np.ndarray] | None:
    """Canonical k-mers of a bucket in order of first use, with two columns a tag: as they are, and as reverse complements."""
    parts = []
    for tag in tags:
        for blobs in _some(b.blobs.get(tag, [])):
            w = Windows(blobs, k, ids)
            parts.append(_count(w.words, 2 * (tag - tags[0]) + ~w.fwd, 2 * len(tags)))
    return _merge(parts) if parts else None


def _odd_tally(b: Bucket, tags: range) -> dict[str, Counter]:
    out: dict[str, Counter] = {}
    for tag, window, _ in b.odd:
        if tag in tags:
            c = _canonical(window)
            out.setdefault(c, Counter())[2 * tag + (window != c)] += 1
    return out


def _meet(sides: list[DataFrame], work: Callable[[Bucket], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    all_sides = sides[0]
    for s in sides[1:]:
        all_sides = all_sides.unionByName(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_bucket(batches):
            yield from work(b)

    return all_sides.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def counts(read_sets: dict[str, DataFrame], k: int) -> DataFrame:
    """``kmer`` (canonical) and for every named read set its occurrences ``n_fwd`` + name and those of its reverse complement
    ``n_rc`` + name: a row for each k-mer of any set. A palindrome has all its occurrences in ``n_fwd``."""
    tags, names = range(len(read_sets)), [f"{c}{s}" for s in read_sets for c in ("n_fwd", "n_rc")]

    def work(b: Bucket) -> Iterator[pa.RecordBatch]:
        found = _tally(b, tags, k)
        if found is not None:
            words, n = found
            for at in range(0, len(n), ROWS):
                some = slice(at, at + ROWS)
                yield pa.RecordBatch.from_arrays([_texts([w[some] for w in words], k), *[pa.array(np.ascontiguousarray(c)) for c in n[some].T]], ["kmer", *names])
        odd = _odd_tally(b, tags)
        if odd:
            yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), *[pa.array([c[i] for c in odd.values()], pa.int64()) for i in range(len(names))]], ["kmer", *names])

    schema = ", ".join(["kmer string", *[f"`{n}` long" for n in names]])
    return _meet([pieces(r, k, i) for i, r in enumerate(read_sets.values())], work, schema)


def levels(reads: DataFrame, k: int) -> DataFrame:
    """``n_fwd``, ``n_rc``, ``kmers``: how many canonical k-mers come so often on either strand; palindromes apart (``same``)."""
    even = k % 2 == 0

    def work(b: Bucket) -> Iterator[pa.RecordBatch]:
        found = _tally(b, range(1), k)
        seen: Counter = Counter()
        if found is not None:
            words, n = found
            same = _palindromes(words, k) if even else np.zeros(len(n), bool)
            pairs, times = np.unique(np.column_stack([n, same]), axis=0, return_counts=True)
            seen.update({tuple(p): t for p, t in zip(pairs.tolist(), times.tolist(), strict=True)})
        for window, c in _odd_tally(b, range(1)).items():
            seen[c[0], c[1], int(window == window.translate(_SWAP)[::-1])] += 1
        cells = [[*p, t] for p, t in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], pa.int64()) for i in range(4)], ["n_fwd", "n_rc", "same", "kmers"])

    part = _meet([pieces(reads, k)], work, "n_fwd long, n_rc long, same long, kmers long")
    return part.groupBy("n_fwd", "n_rc", (F.col("same") == 1).alias("same")).agg(F.sum("kmers").alias("kmers"))


def _palindromes(words: list[np.ndarray], k: int) -> np.ndarray:
    spare = np.uint64(2 * (32 * len(words) - k))
    back = [_reversed(~w) for w in words[::-1]]
    if spare:
        back = [w << spare | (back[j + 1] >> (np.uint64(64) - spare) if j + 1 < len(back) else np.uint64(0)) for j, w in enumerate(back)]
    out = np.ones(len(words[0]), bool)
    for w, r in zip(words, back, strict=True):
        out &= w == r
    return out


def _place(own: list[np.ndarray], words: list[np.ndarray]) -> np.ndarray:
    """Where each of ``words`` stands in ``own`` (k-mers, each once); -1: nowhere."""
    n = len(own[0])
    order, first = _groups([np.concatenate([a, b]) for a, b in zip(own, words, strict=True)])
    size = np.diff(np.append(first, len(order)))
    known = np.full(len(first), -1, np.int64)
    group = np.repeat(np.arange(len(first)), size)
    mine = order < n
    known[group[mine]] = order[mine]
    out = np.empty(len(words[0]), np.int64)
    out[order[~mine] - n] = known[group[~mine]]
    return out


def weak_reads(reads: DataFrame, k: int, threshold: int, both_strands: bool = False) -> DataFrame:
    """``read_idx`` of the reads of which a window comes ``threshold`` times at most in all reads, both strands together or,
    with ``both_strands``, on either. Reads shorter than ``k`` have no window."""

    def level(n: np.ndarray, same: np.ndarray) -> np.ndarray:
        return n.min(axis=1) if both_strands else n.sum(axis=1) * np.where(same, 2, 1)

    def work(b: Bucket) -> Iterator[pa.RecordBatch]:
        found, out = _tally(b, range(1), k, True), []
        if found is not None:
            words, n = found
            low = level(n, _palindromes(words, k) if k % 2 == 0 else np.zeros(len(n), bool)) <= threshold
            if low.any():
                weak = [w[low] for w in words]
                for blobs in _some(b.blobs[0]):
                    w = Windows(blobs, k, True)
                    if low.all():
                        out.append(w.ids)
                    else:
                        hit = np.add.reduceat(_place(weak, w.words) >= 0, np.cumsum(w.size) - w.size, dtype=np.int64) > 0
                        out.append(w.ids[hit])
        odd = _odd_tally(b, range(1))
        for _, window, own in b.odd:
            c = _canonical(window)
            n = level(np.array([[odd[c][0], odd[c][1]]]), np.array([c == c.translate(_SWAP)[::-1]]))
            if n[0] <= threshold:
                out.append(np.array([own], np.int64))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], ["read_idx"])

    return _meet([pieces(reads, k, ids=True)], work, "read_idx long").distinct()


def reads_holding(reads: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """``read_idx`` of the reads that hold any of the words (``word``, of ``k`` bases) on either strand, once."""

    def work(b: Bucket) -> Iterator[pa.RecordBatch]:
        found, out = _tally(b, range(1, 2), k), []
        if found is not None:
            for blobs in _some(b.blobs.get(0, [])):
                w = Windows(blobs, k, True)
                hit = np.add.reduceat(_place(found[0], w.words) >= 0, np.cumsum(w.size) - w.size, dtype=np.int64) > 0
                out.append(w.ids[hit])
        asked = {_canonical(window) for tag, window, _ in b.odd if tag == 1}
        out.append(np.array([own for tag, window, own in b.odd if tag == 0 and _canonical(window) in asked], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], ["read_idx"])

    asked = words.filter(F.length("word") == k).select(F.col("word").alias("seq"))
    return _meet([pieces(reads, k, ids=True), pieces(asked, k, 1)], work, "read_idx long").distinct()


def counts_of(words: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """``id``, ``n_same``, ``n_other``: occurrences in ``reads`` of every word (``id``, ``word`` of ``k`` bases) as it is
    and of its reverse complement, a row for each row of ``words``; a palindrome has all in ``n_same``."""

    def work(b: Bucket) -> Iterator[pa.RecordBatch]:
        found = _tally(b, range(1), k)
        for blobs in _some(b.blobs.get(1, [])):
            w = Windows(blobs, k, True)
            n = np.zeros((len(w.ids), 2), np.int64)
            if found is not None:
                at = _place(found[0], w.words)
                n[at >= 0] = found[1][at[at >= 0]]
            n = np.where(w.fwd[:, None], n, n[:, ::-1])
            yield pa.RecordBatch.from_arrays([pa.array(w.ids), pa.array(np.ascontiguousarray(n[:, 0])), pa.array(np.ascontiguousarray(n[:, 1]))], ["id", "n_same", "n_other"])
        odd = _odd_tally(b, range(1)) if b.odd else {}
        asked = [(own, window, odd.get(_canonical(window), Counter())) for tag, window, own in b.odd if tag == 1]
        if asked:
            same = [c[int(w != _canonical(w))] for _, w, c in asked]
            other = [c[int(w == _canonical(w))] for _, w, c in asked]
            yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in asked], pa.int64()), pa.array(same, pa.int64()), pa.array(other, pa.int64())], ["id", "n_same", "n_other"])

    asked = words.filter(F.length("word") == k).select(F.col("id").alias("read_idx"), F.col("word").alias("seq"))
    return _meet([pieces(reads, k), pieces(asked, k, 1, ids=True)], work, "id long, n_same long, n_other long")
