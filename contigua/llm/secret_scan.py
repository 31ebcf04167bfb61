"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import id_and_text, lean
from contigua.runtime import ship

KINDS = ("assign", "access", "hex", "markov")
_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), f"{_ANY_CASE('api')}_?{_ANY_CASE('key')}"])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Strings that the models judge: long enough for the ratio to tell, of the characters that keys are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_LENGTH = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_NAME_HINTS = ("password", "passwd", "secret", "token", "api")
_WORDS = (
    "get set user name account service request response handler manager index value list map data file path config "
    "default error message client server session database table column record update delete create insert select read "
    "write open close start stop test unit integration version release build module package import export public "
    "private static final string number integer boolean date time stamp format parse encode decode token stream buffer "
    "queue worker thread process task event listener controller view model template render page image color width height "
    "internationalization responsibilities configuration implementation understanding transportation nevertheless "
    "wissenschaft verantwortung gesellschaft entwicklung geschwindigkeit zusammenarbeit gouvernement developpement "
    "organisation naturellement desarrollo administracion universidad investigacion conocimiento"
).split()


class Markov:
    """First-order character chain with add-``k`` smoothing."""

    def __init__(self, samples: Iterable[str], k: float = 0.5):
        n = len(ALPHABET)
        at = {c: i for i, c in enumerate(ALPHABET)}
        start, step = [k] * n, [[k] * n for _ in range(n)]
        for s in samples:
            ids = [at[c] for c in s if c in at]
            if ids:
                start[ids[0]] += 1
            for a, b in zip(ids, ids[1:], strict=False):
                step[a][b] += 1
        self.start = {c: math.log(start[i] / sum(start)) for c, i in at.items()}
        self.step = {a + b: math.log(step[i][j] / sum(step[i])) for a, i in at.items() for b, j in at.items()}

    def log_likelihood(self, s: str) -> float:
        return self.start[s[0]] + sum(map(self.step.__getitem__, map("".join, zip(s, s[1:], strict=False))))


def default_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled samples: random strings over the usual key alphabets (1); compound names, numbers, rules (0)."""
    rng = random.Random(seed)
    sets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", ALPHABET[26:62]]
    out = []
    for _ in range(n):
        letters = rng.choice(sets)
        out.append(("".join(rng.choice(letters) for _ in range(rng.randint(20, 48))), 1))
        words = [rng.choice(_WORDS) for _ in range(rng.randint(1, 5))]
        style = rng.randrange(7)
        name = {0: "_".join(words), 1: "-".join(words), 2: words[0] + "".join(w.title() for w in words[1:]), 3: "_".join(words).upper(), 4: "".join(words), 5: "/".join(words) + f".{rng.randint(1, 99)}", 6: str(rng.randrange(10 ** rng.randint(4, 20)))}[style]
        out.append((name, 0))
        if style == 5:
            out.append((rng.choice("-=_") * rng.randint(8, 60), 0))
    return out


class Detector:
    """Both chains, trained from labelled samples, and the least ratio (natural log, and per character) of a secret."""

    def __init__(self, samples: Iterable[tuple[str, int]] | None = None, least: float = 10.0, per_char: float = 0.3):
        rows = list(default_samples() if samples is None else samples)
        self.random = Markov(s for s, y in rows if y)
        self.plain = Markov(s for s, y in rows if not y)
        self.least, self.per_char = least, per_char
        self.begins = {c: p - self.plain.start[c] for c, p in self.random.start.items()}
        self.steps = {c: p - self.plain.step[c] for c, p in self.random.step.items()}

    def ratio(self, s: str) -> float:
        return self.random.log_likelihood(s) - self.plain.log_likelihood(s)

    def is_secret(self, s: str) -> bool:
        r = self.ratio(s)
        return r >= self.least and r >= self.per_char * len(s)

    def _best(self, s: str) -> tuple[int, int]:
        """The part of ``s`` whose ratio exceeds ``per_char`` a character by most in sum."""
        best, now, begin, out = -math.inf, -math.inf, 0, (0, 0)
        for i, c in enumerate(s):
            new = self.begins[c] - self.per_char
            longer = now + self.steps[s[i - 1 : i + 1]] - self.per_char if i else -math.inf
            now, begin = (longer, begin) if longer >= new else (new, i)
            if now > best:
                best, out = now, (begin, i + 1)
        return out

    def secrets(self, s: str) -> list[tuple[int, int]]:
        """Parts of a run of key characters that are secrets: the best part, then those left and right of it."""
        found, todo = [], [(0, len(s))]
        while todo:
            a, b = todo.pop()
            if b - a < LEAST_LENGTH:
                continue
            x, y = self._best(s[a:b])
            if y - x >= LEAST_LENGTH and self.is_secret(s[a + x : a + y]):
                found.append((a + x, a + y))
                todo += [(a, a + x), (a + y, b)]
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points: the fixed patterns, and what the models add outside of those."""
        low = text.lower()
        base: list[tuple[int, int, str]] = []
        if any(h in low for h in _NAME_HINTS):
            base += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
        base += [(*m.span(), "hex") for m in HEX.finditer(text)]
        more = []
        for m in CANDIDATE.finditer(text):
            # what the fixed patterns leave of the run
            at, cuts = m.start(), []
            for a, b in sorted((a, b) for a, b, _ in base if a < m.end() and b > m.start()):
                cuts.append((at, a))
                at = max(at, b)
            for a, b in [*cuts, (at, m.end())]:
                more += [(a + x, a + y, "markov") for x, y in self.secrets(text[a:b])]
        return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """Secrets of every document: counts of the fixed kinds, a digest of their spans, and all spans.

    Null counts as empty (no spans, digest of the empty string). One output row per input row, repeated rows repeated;
    an empty table gives an empty one; other columns are ignored. One narrow pass over whole texts.
    """
    slim = id_and_text(docs, id_col, text_col)
    found = detector or Detector()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for x in b.column(1):
                spans = found.spans(x.as_py() or "")
                base = [s for s in spans if s[2] != "markov"]
                for c, kind in zip(cols[:3], KINDS[:3], strict=True):
                    c.append(sum(s[2] == kind for s in base))
                cols[3].append(hashlib.sha256(_said(base).encode()).hexdigest())
                cols[4].append(_said(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return slim.mapInArrow(lean(run), f"doc_id {slim.schema['_id'].dataType.simpleString()}, {_OUT}")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", detector: Detector | None = None) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask`` (overlapping spans by one), all columns kept.

    Null texts stay null and empty ones empty; repeated rows stay repeated; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    found, at, schema = detector or Detector(), docs.columns.index(text_col), docs.schema

    def clean(text: str | None) -> str | None:
        if not text or not (spans := found.spans(text)):
            return text
        out, last = [], 0
        for a, b, _ in spans:
            if a >= last:
                out += [text[last:a], mask]
            last = max(last, b)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([clean(x.as_py()) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    out = docs.mapInArrow(lean(run), schema)
    return out.withColumn("n_chars", F.length(F.col(text_col)).cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
