"""Spelling variants: words of a corpus one edit apart, found by Aho-Corasick automata over the words' halves.

A word with one inserted, deleted or replaced code point keeps one half of the other word whole, either its first at the
start or its second at the end. Shards of the index hold both halves of every word in one automaton each; every word is
scanned by the shards that can hold a half of a near word, hits at other offsets or of other lengths are passed over,
and what is left of the two words is compared. Halves are dealt to shards by the code points that start or end them and
by the length of the word; a place of more words than ``SPLIT`` is cut into several shards, each of which scans.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import id_and_text, lean
from contigua.runtime import forget, join_unique, materialize

#: Letters of a run, one in how many runs of a document loses a code point.
_RUN = re.compile("[a-zÀ-ÿ]+")
ALTERED = 199
#: Words (of one half) of a shard on the average, and of one place before it is cut.
SHARD, SPLIT = 10_000, 20_000
#: Code points that place a half, at most: halves of the shortest words have three.
_ANCHOR = 4
_LONG, _HELD = 1 << 20, 200_000


def altered(doc_id: str, runs: Iterator[str] | list[str]) -> Counter:
    """How often each lower-cased run occurs in a document, after the deletions that its id calls for."""
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in Counter(runs).items():
        h = zlib.crc32(run.encode(), start)
        if h % ALTERED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """``word`` and ``n`` of all words of at least ``min_chars`` code points that occur ``min_count`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for b in batches:
            for i, x in zip(b.column(0), b.column(1), strict=True):
                text = (x.as_py() or "").encode().lower().decode()
                runs = _RUN.findall(text) if len(text) < _LONG else (m.group() for m in _RUN.finditer(text))
                for w, n in altered("" if i.as_py() is None else str(i.as_py()), runs).items():
                    if len(w) >= min_chars:
                        held[w] += n
                if len(held) >= _HELD:
                    yield emit()
        yield emit()

    slim = id_and_text(docs, id_col, text_col)
    return slim.withColumn("_id", F.col("_id").cast("string")).mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def halves(word: str) -> tuple[str, str]:
    """The two segments of a word; the first is the shorter one where they differ."""
    cut = len(word) // 2
    return word[:cut], word[cut:]


def _places(word: Column, length: Column) -> list[Column]:
    """Where the first and the second half of a near word (``word`` itself, if ``length`` is its own) of that length lie."""
    n = F.least(F.floor(length / 2), F.lit(_ANCHOR)).cast("int")
    return [F.concat_ws(":", F.lit(side), length.cast("string"), part) for side, part in (("a", F.substring(word, F.lit(1), n)), ("z", F.right(word, n)))]


def one_edit(a: str, b: str) -> bool:
    """Whether two texts differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class _Rests:
    """What follows (or goes before) one segment in the words of one length, with the words and their counts."""

    FEW = 12

    def __init__(self) -> None:
        self.words: list[str] = []
        self.counts: list[int] = []
        self.rests: list[str] = []
        self.table = None

    def add(self, word: str, n: int, rest: str) -> None:
        self.words.append(word)
        self.counts.append(n)
        self.rests.append(rest)

    def near(self, rest: str) -> Iterator[int]:
        """Positions of the words whose rest is one edit from ``rest``."""
        if len(self.rests) <= self.FEW:
            return (i for i, r in enumerate(self.rests) if one_edit(r, rest))
        return iter(self._near_of_many(rest).tolist())

    def _near_of_many(self, rest: str):
        import numpy as np

        code = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if self.table is None:
            self.table = code(self.rests).reshape(len(self.rests), -1)
        a, b = self.table, code([rest])
        if a.shape[1] == len(b):
            return np.flatnonzero((a != b).sum(1) == 1)
        # as many code points as the shorter one has agree from the start and from the end together
        short = min(a.shape[1], len(b))
        ahead = np.logical_and.accumulate(a[:, :short] == b[:short], axis=1).sum(1)
        behind = np.logical_and.accumulate(a[:, ::-1][:, :short] == b[::-1][:short], axis=1).sum(1)
        return np.flatnonzero(ahead + behind >= short)


def automaton(rows: Iterator[tuple[str, int, str]]):
    """An automaton over segments of (word, n, side) rows; a segment's value maps (side, length of the word) to its ``_Rests``."""
    import ahocorasick

    found: dict[str, dict[tuple[str, int], _Rests]] = {}
    for word, n, side in rows:
        first, second = halves(word)
        segment, rest = (first, second) if side == "a" else (second, first)
        found.setdefault(segment, {}).setdefault((side, len(word)), _Rests()).add(word, n, rest)
    out = ahocorasick.Automaton()
    for segment, value in found.items():
        out.add_word(segment, (segment, value))
    out.make_automaton()
    return out


def scan(index, word: str) -> tuple[int, int, str | None]:
    """How many words of an automaton are near ``word`` by the halves that it holds; of those the largest count and its word
    (the smallest, if several)."""
    n_near, best_n, best = 0, 0, None
    for end, (segment, value) in index.iter(word):
        for (side, length), rests in value.items():
            if abs(len(word) - length) > 1:
                continue
            if side == "a":
                if end != len(segment) - 1:
                    continue
                rest = word[len(segment) :]
            elif end != len(word) - 1:
                continue
            else:
                rest = word[: len(word) - len(segment)]
            for i in rests.near(rest):
                w = rests.words[i]
                if side == "z" and word.startswith(halves(w)[0]):
                    continue  # both halves are whole: found by the first
                n_near += 1
                n = rests.counts[i]
                if n > best_n or n == best_n and w < best:
                    best_n, best = n, w
    return n_near, best_n, best


def near_words(words: DataFrame, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """``word``, ``n_near``, ``best_n``, ``best`` of all distinct ``words`` (``word``, ``n``; a written table) that have near words."""
    n_shards = max(2 * words.count() // shard, 1)
    length = F.length("word")
    index = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), p.alias("place")) for s, p in zip("az", _places(F.col("word"), length), strict=True)])).alias("i")).select("word", "n", "i.*")
    # places of more words than one shard should hold: at most one in ``split`` rows, a table all the same
    cut = materialize(index.groupBy("place").count().filter(F.col("count") > split).select("place", F.ceil(F.col("count") / split).cast("int").alias("parts")), "spelling-cut")
    at = lambda part: F.pmod(F.xxhash64("place", part), F.lit(n_shards))
    part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
    asked = F.array(*[p for d in (-1, 0, 1) for p in _places(F.col("word"), length + d)])
    asking = words.select("word", F.explode(asked).alias("place"))
    if cut.isEmpty():
        index, asking = (t.withColumn("parts", F.lit(1)) for t in (index, asking))
    else:
        index, asking = (join_unique(materialize(t, "spelling-places"), cut, "place", "left") for t in (index, asking))
    asking = asking.select("word", "place", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    held = index.select(at(part).alias("shard"), F.lit(0).alias("role"), "word", "n", "side")
    asks = asking.select(at(F.col("part")).alias("shard"), "word").distinct().select("shard", F.lit(1).alias("role"), "word", F.lit(0).cast("long").alias("n"), F.lit("").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, ready = None, [], None
        for b in batches:
            out = []
            for shard_, role, word, n, side in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if shard_ != now:
                    now, rows, ready = shard_, [], None
                if role == 0:
                    rows.append((word, n, side))
                elif rows or ready is not None:
                    if ready is None:
                        ready, rows = automaton(rows), []
                    got = scan(ready, word)
                    if got[0]:
                        out.append((word, *got))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    dealt = held.unionByName(asks).repartition(F.col("shard")).sortWithinPartitions("shard", "role")
    found = dealt.mapInArrow(lean(run), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word that ``form`` leads to from there; counts grow along the way, so that it ends."""
    state = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(join_unique(state, ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "spelling-roots")
        done = new.filter("moved").isEmpty()
        forget(state)
        state = new.select("word", "root")
        state._scratch = new._scratch
        if done:
            return state


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of the corpus.

    A word's form is its near word (one edit apart) of largest count, if that is at least ``ratio`` times its own; of
    equal ones the smallest in code-point order. The root is where forms lead to. Null texts have no words; a row without
    an id counts its words as one whose id is the empty text; repeated rows count repeatedly; an empty table gives an empty
    one; other columns are ignored. A word with very many near words is counted shard by shard, and a form that very many
    words share is no single task's.
    """
    words = materialize(word_counts(docs, id_col, text_col, min_chars, min_count), "spelling-words")
    near = near_words(words).withColumnRenamed("word", "_w")
    chosen = F.col("best_n") >= ratio * F.col("n")
    forms = words.join(near.hint("merge"), F.col("word") == F.col("_w"), "left").select(
        "word", F.when(chosen, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best_n")).alias("form_n")
    )
    forms = materialize(forms, "spelling-forms")
    return forms.join(roots(forms).hint("merge"), "word").select("word", "form", "root", "n", "n_near", "form_n")
