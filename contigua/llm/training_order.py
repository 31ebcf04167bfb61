"""Training-order materialisation: packed token sequences, a keyed permutation to global slots, fixed-stride shards.

A shard file holds ``shard_span`` slots in a row (the last one what is left); a slot is ``seq_len`` token ids as
little-endian unsigned 16-bit integers and a line feed. So slot ``k`` is at byte ``(k % shard_span) * stride`` of shard
``k // shard_span``: both are computed, nothing is looked up.
"""

from __future__ import annotations

import base64
import re
import struct
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.llm.bpe import WIDE_SPACE, _letters, pattern
from contigua.llm.common import id_and_text, lean
from contigua.runtime import materialize

_BLOCK = 1 << 16
#: Sequences that are compressed together in the table of packed texts.
_TOGETHER = 256
#: Partitions whose first numbers are broadcast; with more of them they are joined by merge.
_STARTS_SENT = 1_000_000
#: Pre-tokens remembered by a worker, about 150 bytes each: three workers of an executor, 200 MB in all.
_KNOWN = 400_000
_ROUNDS = 6


class Feistel:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network over the next even number of bits, walked along its
    cycle until it is back below ``n`` (less than four steps on average)."""

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)

    def _mix(self, x, r: int):
        import numpy as np

        u = np.uint64
        z = x + u((self.key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (1 << 64) - 1)
        z = (z ^ z >> u(30)) * u(0xBF58476D1CE4E5B9)
        z = (z ^ z >> u(27)) * u(0x94D049BB133111EB)
        return (z ^ z >> u(31)) & u((1 << self.half) - 1)

    def _pass(self, x, rounds):
        import numpy as np

        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for r in rounds:
            left, right = right, left ^ self._mix(right, r)
        return left << h | right

    def _walk(self, x, step):
        import numpy as np

        out = step(np.asarray(x, np.uint64))
        while (far := out >= np.uint64(self.n)).any():
            out[far] = step(out[far])
        return out

    def slot(self, index):
        """Slots of sequence numbers."""
        return self._walk(index, lambda x: self._pass(x, range(_ROUNDS)))

    def index(self, slot):
        """Sequence numbers of slots."""
        import numpy as np

        def back(x):
            h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
            left, right = x >> h, x & mask
            for r in reversed(range(_ROUNDS)):
                left, right = right ^ self._mix(left, r), left
            return left << h | right

        return self._walk(slot, back)


class Pieces:
    """Token ids as packed 16-bit integers by way of remembered pre-tokens, from a file of ranks."""

    def __init__(self, path: str):
        import tiktoken

        rules = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
        self.end = max(ranks.values()) + 1
        if self.end >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        encode = tiktoken.Encoding("ranks", pat_str=rules, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ascii, self.any = pattern(), None
        self.cut = re.compile(r"(?<=\S) (?=\S)")

        self.wide = re.compile(f"[{WIDE_SPACE}]")

        class Known(dict):
            """Ids of what stands between two spaces, the first of them included."""

            def __missing__(self, piece: str) -> bytes:
                ids = encode(" " + piece)
                out = struct.pack(f"<{len(ids)}H", *ids)
                if len(piece) <= 64:
                    if len(self) >= _KNOWN:
                        self.clear()
                    self[piece] = out
                return out

        self.known = Known()
        self.plain = lambda piece: struct.pack(f"<{len(ids := encode(piece))}H", *ids)

    def _splits_at_spaces(self, text: str) -> bool:
        """Whether every space begins a pre-token: none ends the text or comes before other white space."""
        return not (text.endswith(" ") or any(x in text for x in ("  ", " \n", " \t", " \r", " \x0b", " \x0c")) or (not text.isascii() and self.wide.search(text)))

    def encode(self, text: str) -> bytes:
        """Ids of ordinary text."""
        if self._splits_at_spaces(text):
            first, *rest = text.split(" ")
            return self.plain(first) + b"".join(map(self.known.__getitem__, rest))
        at, out, known = 0, [], self.plain
        while at < len(text):
            end = len(text)
            if end - at > _BLOCK and (m := self.cut.search(text, at + _BLOCK)):
                end = m.start()
            block = text[at:end]
            if not block.isascii():
                self.any = self.any or pattern(*_letters())
            out.append(b"".join(map(known, (self.ascii if block.isascii() else self.any).findall(block))))
            at = end
        return b"".join(out)


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _pack(slim: DataFrame, ranks_path: str, seq_len: int) -> DataFrame:
    """Texts encoded and packed: ``part``, ``first`` (number of the first sequence within the part), ``n_tokens`` and
    ``doc_ids`` of up to ``_TOGETHER`` sequences, and their tokens compressed; a written table."""
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, use, width = TaskContext.get().partitionId(), _pieces(ranks_path), 2 * seq_len
        shrink, end = zstandard.ZstdCompressor(level=3), struct.pack("<H", use.end)
        held, spans, done = bytearray(), deque(), 0  # spans: texts with tokens in held, and how many bytes

        def out(n: int, id_type: pa.DataType, last: int = seq_len) -> pa.RecordBatch:
            nonlocal done
            ids = []
            for _ in range(n):
                mine, room = [], width
                while room and spans:
                    doc, b = spans.popleft()
                    mine.append(doc)
                    if b > room:
                        spans.appendleft((doc, b - room))
                    room -= min(room, b)
                ids.append(mine)
            data = shrink.compress(bytes(held[: n * width]))
            del held[: n * width]
            first, done = done, done + n
            row = [[part], [first], [[seq_len] * (n - 1) + [last]], [ids], [data]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(id_type)), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["part", "first", "n_tokens", "doc_ids", "data"])

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for i, x in zip(b.column(0), b.column(1), strict=True):
                tokens = use.encode(x.as_py() or "") + end
                held += tokens
                spans.append((i.as_py(), len(tokens)))
                while len(held) >= _TOGETHER * width:
                    yield out(_TOGETHER, id_type)
        if held:
            last = len(held) // 2 % seq_len or seq_len
            held += end * (-(len(held) // 2) % seq_len)
            yield out(len(held) // width, id_type, last)

    return materialize(slim.mapInArrow(lean(run), f"part int, first long, n_tokens array<int>, doc_ids array<array<{kind}>>, data binary"), "packed")


def materialise(docs: DataFrame, path: str, ranks_path: str, seq_len: int = 2048, shard_span: int = 8192, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``path`` and return ``slot``, ``shard``, ``byte_offset``, ``n_tokens``, ``doc_ids`` of every sequence.

    Texts are encoded once, closed by an end token and packed back to back within their partition, into a written table;
    only the last sequence of a partition is filled up, with end tokens. Its partitions are counted, their sequences
    numbered on without gaps, and the keyed permutation of those N numbers gives each its slot among 0 .. N-1. Shards are
    ranges of ``shard_span`` slots, written by one task each.

    Null counts as empty (an end token alone); repeated rows are packed each; an empty table writes no shard; other
    columns are ignored. Packed texts and shards are written by Spark's own writer and commit protocol, so a lost
    executor costs its tasks only.
    """
    spark = docs.sparkSession
    slim = id_and_text(docs, id_col, text_col)
    id_type = slim.schema["_id"].dataType.simpleString()
    packed = _pack(slim, ranks_path, seq_len)
    starts, total = [], 0
    for part, n in sorted(packed.groupBy("part").agg(F.sum(F.size("n_tokens")).alias("n")).collect()):
        starts.append((part, total))
        total += n
    stride, order = 2 * seq_len + 1, Feistel(total, key)
    layout = spark.createDataFrame([(total, seq_len, shard_span, key, stride)], "sequences long, seq_len int, shard_span int, key long, stride int")
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/_layout")
    if not total:
        return spark.createDataFrame([], f"slot long, shard long, byte_offset long, n_tokens int, doc_ids array<{id_type}>")
    begin = spark.createDataFrame(starts, "part int, start long")
    begin = F.broadcast(begin) if len(starts) <= _STARTS_SENT else begin.hint("merge")
    numbered = packed.join(begin, "part").withColumn("first", F.col("start") + F.col("first"))

    def slots(first: int, n: int):
        import numpy as np

        return order.slot(np.arange(first, first + n, dtype=np.uint64)).astype(np.int64)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for first, n, ids in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                slot = slots(first, len(n.values))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // np.int64(shard_span)), pa.array(slot % shard_span * stride), n.values, ids.values], names=["slot", "shard", "byte_offset", "n_tokens", "doc_ids"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink, grow, width = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), 2 * seq_len
        for b in batches:
            for first, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = grow.decompress(data.as_py())
                rows = [shrink.compress(raw[i : i + width]) for i in range(0, len(raw), width)]
                yield pa.RecordBatch.from_arrays([pa.array(slots(first, len(rows))), pa.array(rows, pa.binary())], names=["slot", "data"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([grow.decompress(x.as_py()) for x in part.column(1)], pa.binary())], names=["slot", "value"])

    shard = F.expr(f"cast(slot div {shard_span} as int)")
    n_shards = -(-total // shard_span)
    rows = numbered.select("first", "data").mapInArrow(lean(spread), "slot long, data binary").repartitionById(n_shards, shard)
    values = rows.sortWithinPartitions("slot").mapInArrow(lean(unpack), "slot long, value binary")
    sorted_ = values.select(F.col("value").cast("string").alias("value"), shard.alias("shard"), "slot").sortWithinPartitions("shard", "slot")
    sorted_.drop("slot").write.partitionBy("shard").mode("overwrite").text(f"{path}/shards")
    return numbered.select("first", "n_tokens", "doc_ids").mapInArrow(lean(listed), f"slot long, shard long, byte_offset long, n_tokens int, doc_ids array<{id_type}>")


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> Iterator[list[int]]:
    """Token ids of slots in training order from ``start`` on: a reader that stopped resumes at any slot.

    One shard at a time is opened, through Spark's own readers.
    """
    import numpy as np

    lay = spark.read.json(f"{path}/_layout").first()
    stop, span = lay["sequences"] if stop is None else min(stop, lay["sequences"]), lay["shard_span"]
    while start < stop:
        shard = start // span
        blob = spark.read.format("binaryFile").load(f"{path}/shards/shard={shard}").select("content").first()["content"]
        rows = np.frombuffer(blob, np.uint8).reshape(-1, lay["stride"])[:, :-1]
        for r in rows[start - shard * span : stop - shard * span]:
            yield np.frombuffer(r.tobytes(), "<u2").tolist()
        start = (shard + 1) * span
