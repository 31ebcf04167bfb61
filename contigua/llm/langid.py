"""Language identification: averaged hashed subword embeddings, linear softmax, SGD in numpy, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import fold_of, id_and_text, lean

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Bytes of text whose n-grams are summed at once.
_CHUNK = 1 << 19
_LETTER_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def framed(text: str):
    """Bytes of a text: A-Z lowered, all but letters one space, words framed by spaces."""
    import numpy as np

    return np.frombuffer(b" ".join((b"", *text.encode().translate(_LETTER_FOLD).split(), b"")), np.uint8)


def grams(framed_text, start: int = 0, stop: int | None = None):
    """Bucket of every n-gram of bytes that begins in a range."""
    import numpy as np

    out = []
    for n in ORDERS:
        b = framed_text[start : None if stop is None else stop + n - 1].astype(np.uint32)
        if len(b) >= n:
            h = np.zeros(len(b) - n + 1, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) + b[i : i + len(h)] + np.uint32(n)
            out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(16))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def subwords(text: str):
    """Bucket of every n-gram of a text."""
    return grams(framed(text))


class Model:
    """Embeddings, softmax weights, temperature and the least score of an accepted language."""

    def __init__(self, langs: list[str], dim: int = 16, seed: int = 0):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.langs, self.temperature, self.least = langs, 1.0, 0.0
        self.embed = rng.uniform(-0.5, 0.5, (BUCKETS, dim)) / dim
        self.weights, self.bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
        self.table = None

    def fit(self, samples: list[tuple[str, int]], epochs: int = 4, rate: float = 1.0, seed: int = 0, target: float = 0.999) -> Model:
        """SGD over texts and short cuts of them; a tenth is held back for temperature and rejection."""
        import numpy as np

        rng, grams = np.random.default_rng(seed), []
        for text, y in samples:
            grams.append((subwords(text), y))
            words = text.split()
            for size in (3, 12):
                if len(words) > size:
                    at = int(rng.integers(len(words) - size))
                    grams.append((subwords(" ".join(words[at : at + size])), y))
        grams = [(np.unique(g, return_counts=True), y) for g, y in grams if len(g)]
        order = rng.permutation(len(grams))
        held, train = order[: len(order) // 10], order[len(order) // 10 :]
        per_class = np.bincount([grams[i][1] for i in train], minlength=len(self.langs)).astype(float)
        balance = np.sqrt(per_class.sum() / (len(self.langs) * np.maximum(per_class, 1)))
        steps, done = epochs * max(1, len(train)), 0
        for _ in range(epochs):
            for i in rng.permutation(train):
                (ids, n), y = grams[i]
                f = n / n.sum()
                e = f @ self.embed[ids]
                z = e @ self.weights + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                p *= balance[y] * rate * (1 - done / steps)
                back = self.weights @ p
                self.weights -= np.outer(e, p)
                self.bias -= 0.1 * p
                self.embed[ids] -= np.outer(f, back) * 20
                done += 1
        self.table = None
        z = np.array([self._logits(*grams[i][0]) for i in held]).reshape(-1, len(self.langs))
        y = np.array([grams[i][1] for i in held], int)
        if len(y):
            self._calibrate(z, y, target)
        self.table = (self.embed @ self.weights).astype(np.float32)
        return self

    def _logits(self, ids, n):
        return (n / n.sum()) @ self.embed[ids] @ self.weights + self.bias

    def _calibrate(self, z, y, target: float) -> None:
        """Temperature of the least log loss; least score above which held-back texts are right often enough."""
        import numpy as np

        def scores(t):
            p = np.exp((z - z.max(1, keepdims=True)) / t)
            return p / p.sum(1, keepdims=True)

        grid = np.exp(np.linspace(-3, 3, 61))
        self.temperature = float(min(grid, key=lambda t: -np.log(np.maximum(scores(t)[np.arange(len(y)), y], 1e-12)).mean()))
        p = scores(self.temperature)
        right, best = p.argmax(1) == y, p.max(1)
        order = np.argsort(-best)
        share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(share >= target)
        self.least = float(best[order[good[-1]]]) if len(good) else 1.0

    def predict(self, text: str) -> tuple[str, float]:
        """Language and calibrated probability; n-grams are summed in ranges of a fixed size, none lost between two."""
        import numpy as np

        whole, total, n = framed(text), np.zeros(len(self.langs)), 0
        for at in range(0, len(whole), _CHUNK):
            g = grams(whole, at, at + _CHUNK)
            total += self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        z = total / max(n, 1) + self.bias
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        return self.langs[int(p.argmax())], float(p.max())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, folds: int = 4, held_fold: int = 2) -> Model:
    """Fit on about ``per_lang`` labelled documents of each language outside the held-out fold, chosen by a hash of the id.

    The sample is bounded by ``per_lang`` and the number of languages; its texts are taken whole. Of rows that repeat an id
    and a language the least text is taken, before any reaches the driver.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang"))
    own = slim.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.coalesce(fold_of("_id", folds) != held_fold, F.lit(False)))
    counts = {r["_lang"]: r["n"] for r in own.select("_lang", "_id").distinct().groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(["und"])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])[F.col("_lang")]
    draw = F.pmod(F.xxhash64(F.lit("langid"), "_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = own.filter(draw < share).groupBy("_lang", "_id").agg(F.min("_text").alias("_text"))
    picked = sorted((r["_lang"], r["_id"], r["_text"]) for r in drawn.toLocalIterator())
    langs = sorted(counts)
    return Model(langs).fit([(t, langs.index(k)) for k, _, t in picked])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``accepted`` of every document.

    Null texts and texts without a letter are ``und`` with score 0. ``accepted`` is false below the calibrated least
    score. One output row per input row, repeated rows repeated; an empty table gives an empty one; other columns are
    ignored. One narrow pass; only the model is sent out, whose size is fixed by ``BUCKETS`` and the languages.
    """
    slim = id_and_text(docs, id_col, text_col)
    model.embed = None  # scoring takes the product of embeddings and weights
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.predict(t) if m.table is not None and t and any(map(str.isalpha, t)) else ("und", 0.0) for t in (x.as_py() for x in b.column(1))]
            lang, score = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s > 0 and s >= m.least for s in score], pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    found = slim.mapInArrow(lean(run), f"doc_id {slim.schema['_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
