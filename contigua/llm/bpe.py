"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding by an incremental byte-to-text machine.

A split point between two neighbouring tokens survives all merges exactly if no merge of a node on the right edge of
the left token's merge tree with a node on the left edge of the right token's tree comes while both are there. So the
encoding of a prefix is a chain of tokens, each compatible with the one before, and every position has exactly one
last token. The chains of the last few positions share all but their ends; what they share can't change and is emitted.
A pre-token shorter than the lookahead ends before anything of it is stable; its chain is found longest token first.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from contigua.llm.common import id_and_text, lean

_FOREVER = 1 << 60
_BLOCK = 1 << 16
#: Short pre-tokens that a worker remembers, of about 150 bytes each.
_CACHE = 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def _letters(top: int = sys.maxunicode) -> tuple[str, str]:
    """Non-ASCII letters and numbers up to a code point as ranges for a character class, in the Unicode version of the
    tokenizer's library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    beyond = "".join(chr(c) for c in range(128, top + 1) if not 0xD800 <= c < 0xE000)
    runs = lambda kind: Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(beyond)
    return tuple("".join(f"{a}-{b}" for run, _ in runs(kind) for a, b in _ranges(run)) for kind in "LN")


def _ranges(run: str) -> Iterator[tuple[str, str]]:
    """A run of characters in ascending order as ranges without gaps."""
    start = 0
    for i in range(1, len(run) + 1):
        if i == len(run) or ord(run[i]) != ord(run[i - 1]) + 1:
            yield run[start], run[i - 1]
            start = i


#: Last code points of the narrower splitting rules: Latin with its extensions, all that takes 16 bits, and the plane after it.
_TOPS = (0x24F, 0xFFFF, 0x1FFFF)
#: Unicode white space beyond ASCII.
WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pattern(letters: str = "", numbers: str = "") -> re.Pattern:
    """The splitting rule of the byte-level pre-tokenizer, for the given non-ASCII letters and numbers."""
    space = " \\t-\\r" + (WIDE_SPACE if letters else "")
    letter, number = f"A-Za-z{letters}", f"0-9{numbers}"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Merges:
    """A merge list with what the transducer needs of it: edges of merge trees, lookahead, a trie of reversed tokens."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        model = spec["model"]
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of = {i: to_bytes(s) for s, i in model["vocab"].items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        self.rank: dict[int, dict[int, int]] = {}
        left_edge: dict[int, list[tuple[int, int]]] = {}
        right_edge: dict[int, list[tuple[int, int]]] = {}
        for b in letters:
            left_edge[vocab[b]] = right_edge[vocab[b]] = [(vocab[b], _FOREVER)]
        size = {i: len(b) for i, b in self.bytes_of.items()}
        reach: dict[int, int] = {}  # of a left part: how far merges of it depend on what follows
        self.lookahead = 1
        for r, (x, y) in enumerate(pairs):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            self.rank.setdefault(a, {})[b] = r
            if c in left_edge:
                raise ValueError("a token with two merges: this transducer takes proper merge lists only")
            # a node of an edge is there until its parent's merge
            left_edge[c] = [(c, _FOREVER)] + [(a, r)] + left_edge[a][1:]
            right_edge[c] = [(c, _FOREVER)] + [(b, r)] + right_edge[b][1:]
            far = size[a] + size[b]
            for whole, end in ((a, size[a]), (b, size[a] + size[b])):
                for node, _ in right_edge[whole]:
                    far = max(far, end - size[node] + reach.get(node, 0))
            reach[a] = max(reach.get(a, 0), far)
            self.lookahead = max(self.lookahead, far)
        self.left_edge, self.right_edge = left_edge, right_edge
        self.longest = max(size[i] for i in left_edge)
        self.trie: dict[int, list] = {}  # byte: [token or None, the same for what follows]
        for i in left_edge:
            nodes = self.trie
            for byte in self.bytes_of[i]:
                step = nodes.setdefault(byte, [None, {}])
                nodes = step[1]
            step[0] = i
        token_of = {self.bytes_of[i]: i for i in left_edge}
        self.size = {i: size[i] for i in left_edge}
        #: of a token, the longest other token that begins it
        self.shorter = {i: next((token_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in token_of), None) for b, i in token_of.items()}
        self.compatible: dict[int, dict[int, bool]] = {}  # of pairs met, emptied now and then
        self.met = 0

    def splits(self, left: int, right: int) -> bool:
        """Whether the split point between two neighbouring tokens survives all merges."""
        self.met += 1
        if self.met > 2_000_000:
            self.compatible.clear()
            self.met = 0
        for u, ends_u in self.right_edge[left]:
            row = self.rank.get(u)
            if row:
                for v, ends_v in self.left_edge[right]:
                    r = row.get(v)
                    if r is not None and r < ends_u and r <= ends_v:
                        return False
        return True

    def encode_short(self, piece: bytes) -> list[int]:
        """Token ids of a pre-token within one lookahead, which is stable only as a whole.

        A chain of compatible tokens to a position is the encoding of that prefix, so a position from which no chain
        goes on to the end needn't be tried again: each position is left once at most.
        """
        out: list[int] = []
        if not piece:
            return out
        size, shorter, known, splits, trie, n = self.size, self.shorter, self.compatible, self.splits, self.trie, len(piece)
        dead: set[int] = set()
        at, row, fresh, token = 0, None, True, None
        while True:
            if fresh:
                nodes = trie
                for byte in piece[at : at + self.longest]:
                    step = nodes.get(byte)
                    if step is None:
                        break
                    if step[0] is not None:
                        token = step[0]
                    nodes = step[1]
            while token is not None:
                if at + size[token] not in dead:
                    if row is None:
                        break
                    ok = row.get(token)
                    if ok is None:
                        ok = row[token] = splits(out[-1], token)
                    if ok:
                        break
                token = shorter[token]
            fresh = token is not None
            if fresh:
                out.append(token)
                at += size[token]
                if at == n:
                    return out
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                token = shorter[token]
            if out:
                row = known.get(out[-1])
                if row is None:
                    row = known[out[-1]] = {}
            else:
                row = None

    def encode(self, piece: bytes) -> Iterator[int]:
        """Token ids of one pre-token, emitted once no byte to come can change them.

        Each position has one last token; its start is known once all earlier positions are done. Kept: the tokens of
        the positions after the last emitted split point, in all about ``lookahead`` and a few longest tokens of them.
        """
        trie, known, splits, longest, n = self.trie, self.compatible, self.splits, self.longest, len(piece)
        window = 2 * (self.lookahead + longest)
        base, due = 0, window
        tokens: list[int | None] = [None] * (min(n, window + longest) + 1)  # that end at each position since base
        starts = [0] * len(tokens)
        for at in range(n):
            before, nodes, i = tokens[at - base], trie, at - base
            row = None if before is None else known.get(before) or known.setdefault(before, {})
            for byte in piece[at : at + longest]:
                step = nodes.get(byte)
                if step is None:
                    break
                i += 1
                token, nodes = step
                if token is not None and tokens[i] is None:
                    if row is None:
                        ok = True
                    elif (ok := row.get(token)) is None:
                        ok = row[token] = splits(before, token)
                    if ok:
                        tokens[i], starts[i] = token, at
            if at == due and n - base > window:
                stable = self._shared(starts, base, at + 1)
                if stable > base:
                    yield from self._chain(tokens, starts, base, stable)
                    tokens, starts = tokens[stable - base :], starts[stable - base :]
                    base = stable
                more = at + 1 + window + longest - base + 1 - len(tokens)
                tokens += [None] * max(0, more)
                starts += [0] * max(0, more)
                due = at + window
        yield from self._chain(tokens, starts, base, n)

    def _shared(self, starts: list[int], base: int, p: int) -> int:
        """The last split point that the chains of all positions share from which a token to come can start."""
        live = set(range(max(base, p - self.longest), p + 1))
        while len(live) > 1:
            q = max(live)
            live.discard(q)
            live.add(max(base, starts[q - base]))
        return live.pop()

    @staticmethod
    def _chain(tokens: list[int | None], starts: list[int], base: int, p: int) -> list[int]:
        out = []
        while p > base:
            out.append(tokens[p - base])
            p = starts[p - base]
        return out[::-1]


class Codec:
    """Encoder and decoder of one tokenizer file; short pre-tokens are remembered, long texts go block by block."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("byte-level BPE without a normalizer or an added space only")
        self.merges = Merges(spec)
        self.ascii, self.any, self.tops = pattern(), {}, [(top, re.compile(f"[^\0-{chr(top)}]").search) for top in _TOPS]
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.short = min(64, self.merges.lookahead // 4)  # characters of pre-tokens that end within the lookahead
        self.cut = re.compile(r"(?<=[^\s]) (?=[^\s])")
        codec = self

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                short = len(piece) <= codec.short
                found = codec.merges.encode_short(piece.encode()) if short else list(codec.merges.encode(piece.encode()))
                ids = struct.pack(f"<{len(found)}I", *found)
                if short:
                    if len(self) >= _CACHE:
                        self.clear()
                    self[piece] = ids
                return ids

        self.known = Known()

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of ordinary text, a block at a time; blocks end where a single space begins a pre-token."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > _BLOCK and (m := self.cut.search(text, at + _BLOCK)):
                end = m.start()
            block = text[at:end]
            if block.isascii():
                yield self.ascii.findall(block)
            else:
                yield self._splitter(block).findall(block)
            at = end

    def _splitter(self, block: str) -> re.Pattern:
        """The splitting rule for the least range of characters that covers the block: long classes are slow to test."""
        top = next((top for top, beyond in self.tops if not beyond(block)), sys.maxunicode)
        if top not in self.any:
            self.any[top] = pattern(*_letters(top))
        return self.any[top]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in chunks."""
        at, known = 0, self.known.__getitem__
        for m in self.special.finditer(text) if self.special else ():
            for pieces in self._pieces(text[at : m.start()]):
                yield b"".join(map(known, pieces))
            yield self.merges.special[m[0]].to_bytes(4, "little")
            at = m.end()
        for pieces in self._pieces(text[at:] if at else text):
            yield b"".join(map(known, pieces))

    def decode(self, chunks: Iterator[bytes]) -> Iterator[str]:
        """Text of chunks of ids; a character whose bytes are split over tokens or chunks waits in the machine's state."""
        import numpy as np

        state, table = codecs.getincrementaldecoder("utf-8")("replace"), self.merges.bytes_of.__getitem__
        for c in chunks:
            yield state.decode(b"".join(map(table, np.frombuffer(c, "<u4").tolist())))
        yield state.decode(b"", True)

    def round_trip(self, text: str, keep: bool = False) -> tuple[int, str, str, bytes | None]:
        """n_tokens, digests of ids and of the decoded text, and the ids if they are to be kept."""
        ids, back, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []

        def seen() -> Iterator[bytes]:
            nonlocal n
            for c in self.encode(text):
                n += len(c) // 4
                ids.update(c)
                if keep:
                    kept.append(c)
                yield c

        for s in self.decode(seen()):
            back.update(s.encode())
        return n, ids.hexdigest(), back.hexdigest(), b"".join(kept) if keep else None


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, built once a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document; ``ids`` too if asked for.

    Null counts as empty (no tokens, digests of nothing). Special strings inside texts are special tokens, as the
    tokenizer's library has it by default. One output row per input row, repeated rows repeated; an empty table gives
    an empty one; other columns are ignored. One narrow pass, memory bounded besides the text itself.
    """
    slim = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(tokenizer_path)
        for b in batches:
            step = 256 if with_ids else max(1, b.num_rows)
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                rows = [use.round_trip(x.as_py() or "", with_ids) for x in part.column(1)]
                n, ids, back, kept = zip(*rows, strict=True)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return slim.mapInArrow(lean(run), f"doc_id {slim.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
