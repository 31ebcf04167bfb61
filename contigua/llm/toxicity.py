"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.llm.common import fold_of, id_and_text, lean

#: Labelled texts of each label that training takes at most.
PER_LABEL = 3000
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)
_KNOWN = 300_000
#: Fixed voters, whole words.
LEXICON = (
    "idiot idiots moron morons stupid imbecile loser losers scum trash garbage worthless pathetic disgusting clown "
    "dumb fool freak jerk vermin parasite filth filthy crap bastard bitch damn hate ugly cretin dimwit lowlife "
    "dumm dummkopf arschloch abschaum idiotisch connard salaud merde imbécile imbécil estúpido basura escoria"
).split()
#: Fixed voters, patterns of whole texts.
PATTERNS = {
    "you_are": re.compile(r"\byou(?:'re| are| r)? (?:an? |such an? |all )?(?:idiot|moron|stupid|loser|trash|scum|fool|clown|disgusting|pathetic|worthless)"),
    "shouting": re.compile(r"(?:[A-Z]{3,}[^A-Za-z\n]{1,3}){6,}"),
    "bangs": re.compile(r"!{3,}"),
    "masked": re.compile(r"\b[a-z]+\*{2,}[a-z]*\b"),
}


def features(text: str | None) -> set[str]:
    """Words of letters (``=word``) and their stems (``stem*``), lower-cased, as a set."""
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.update(of_word(w))
    return out


def of_word(w: str) -> list[str]:
    return ["=" + w, *(w[:n] + "*" for n in _STEMS if len(w) > n or len(w) == n)]


#: Smallest feature hashes of a text that are compared, and the share of them that copies have in common at least.
_SKETCH, _ALIKE = 64, 0.5


def without_copies(rows: Iterable[tuple[str, int | None]]) -> Iterator[tuple[set[str], str, int | None]]:
    """Features, text and label of one of each group of copies and near-copies of a label.

    What copies share by chance would otherwise look like a mark of their label. Texts of the same two smallest feature
    hashes are compared by ``_SKETCH`` of them (all, if they have fewer); unlike ones all stay.
    """
    import xxhash

    kept: dict[tuple, list[frozenset[int]]] = {}
    for t, y in rows:
        x = features(t)
        low = heapq.nsmallest(_SKETCH, map(xxhash.xxh64_intdigest, x))
        mine, group = frozenset(low), kept.setdefault((*low[:2], y), [])
        if any(_alike(mine, other) for other in group):
            continue
        group.append(mine)
        yield x, t, y


def _alike(a: frozenset[int], b: frozenset[int]) -> bool:
    """Whether the Jaccard similarity of two texts, told from their smallest hashes, is ``_ALIKE`` or more."""
    low = heapq.nsmallest(_SKETCH, a | b)
    return not low or sum(h in a and h in b for h in low) >= _ALIKE * len(low)


def least_support(n_features: int, share: float) -> int:
    """So many rows that no feature is likely to be only in toxic ones by chance."""
    return max(3, math.ceil((math.log(max(2, n_features)) + math.log(100)) / -math.log(min(0.5, max(1e-3, share)))))


def mine_voters(toxic: list[set[str]], clean: list[set[str]], least: int = 3, most: int = 80, cover: int = 3, precision: float = 0.9) -> list[str]:
    """Words and stems that ``least`` toxic texts and few clean ones have, chosen until each toxic text has ``cover`` of
    them where it can.

    Greedy by the toxic texts newly covered, longer ones first among equals.
    """
    df = {f: n for f, n in Counter(f for x in toxic for f in x).items() if n >= least}
    bad = Counter(f for x in clean for f in x if f in df)
    weight = len(toxic) / max(1, len(clean))
    good = {f for f, n in df.items() if n / (n + weight * bad[f] + 0.5) >= precision and bad[f] <= 0.02 * n}
    holders: dict[str, list[int]] = {}
    for i, x in enumerate(toxic):
        for f in x & good:
            holders.setdefault(f, []).append(i)
    left, chosen = [cover] * len(toxic), []
    while holders and len(chosen) < most:
        gain = {f: sum(left[i] > 0 for i in h) for f, h in holders.items()}
        top = max(gain, key=lambda f: (gain[f], len(f), f))
        if gain[top] < least:
            break
        chosen.append(top)
        for i in holders.pop(top):
            left[i] -= 1
        holders = {f: h for f, h in holders.items() if gain[f] >= least}
    return chosen


def voters(mined: Iterable[str]) -> list[tuple[str, Callable[[str, set[str]], bool]]]:
    """All voters as (name, fires): on a text and its features. A voter that doesn't fire abstains."""
    names = dict.fromkeys([*("=" + w for w in LEXICON), *mined])
    return [(n, lambda t, f, n=n: n in f) for n in names] + [(n, lambda t, f, p=p: bool(p.search(t))) for n, p in PATTERNS.items()]


class LabelModel:
    """Generative model of votes: the label, and for every voter its firing rate by label and by one other voter's vote.

    Which voter depends on which is a maximum spanning forest by mutual information given the label, of those pairs whose
    information is beyond chance. Accuracies and correlations are its parameters, fitted by expectation maximisation; a
    voter that repeats another adds nothing to the posterior.
    """

    def __init__(self, share: float, start: list[tuple[float, float]]):
        import numpy as np

        self.share = min(max(share, 1e-3), 0.5)
        fire = np.array(start or np.empty((0, 2)), float).reshape(-1, 2)
        #: rates by the vote of the parent (0, 1), voter, label (toxic, clean); without a parent both are the same
        self.fire = np.stack([fire, fire])
        self.parent = np.full(len(fire), -1)

    def posterior(self, votes):
        """Probability of toxic for rows of votes (0 or 1)."""
        import numpy as np

        above = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0) > 0 if len(self.parent) else votes > 0
        bad, good = (np.where(above, self.fire[1, :, side], self.fire[0, :, side]) for side in (0, 1))
        z = math.log(self.share / (1 - self.share)) + np.where(votes > 0, np.log(bad / good), np.log((1 - bad) / (1 - good))).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _structure(self, votes, weights) -> None:
        """Parents from the weighted votes of both labels."""
        import numpy as np

        n_voters, info = votes.shape[1], np.zeros((votes.shape[1],) * 2)
        total = sum(w.sum() for w in weights)
        for w in weights:
            n, one = w.sum(), w @ votes
            both = (votes * w[:, None]).T @ votes
            for cell, a, b in ((both, one[:, None], one), (one[:, None] - both, one[:, None], n - one), (one - both, n - one[:, None], one), (n - one[:, None] - one + both, n - one[:, None], n - one)):
                want = a * b / max(n, 1e-9)
                info += np.where((cell > 1e-9) & (want > 1e-9), cell * np.log(np.maximum(cell, 1e-9) / np.maximum(want, 1e-9)), 0)
        # twice the information is chi-squared with two degrees if nothing but chance links a pair: one false link in 100
        bar = math.log(100 * max(1, n_voters * (n_voters - 1) / 2)) if total else math.inf
        info = np.where(info > bar, info, 0)
        np.fill_diagonal(info, 0)
        self.parent[:] = -1
        best, source, left = np.full(n_voters, -1.0), np.full(n_voters, -1), set(range(n_voters))
        while left:
            j = max(left, key=lambda v: (best[v], -v))
            left.discard(j)
            self.parent[j] = source[j] if best[j] > 0 else -1
            closer = info[j] > np.maximum(best, 0)
            best[closer], source[closer] = info[j][closer], j

    def fit(self, votes, known, rounds: int = 15, trust: float = 2.0) -> LabelModel:
        """``known``: labels of the rows that have one, else nan; those anchor the two classes. The first rounds take voters
        as independent, then links are looked for and fitted; a rate by a parent's vote is drawn to the plain rate with
        the weight of ``trust`` rows."""
        import numpy as np

        if not votes.size:
            return self
        sure = ~np.isnan(known)
        for turn in range(2 * rounds):
            p = np.where(np.isnan(known), self.posterior(votes), np.nan_to_num(known))
            if turn == rounds or (turn > rounds and not sure.any()):
                # a posterior off the mark looks like a link, so labels tell links where there are some
                self._structure(votes, (p * sure, (1 - p) * sure) if sure.any() else (p, 1 - p))
            for side, w in ((0, p), (1, 1 - p)):
                prior = 0.02 if side == 0 else 0.001
                plain = (w @ votes + prior) / (w.sum() + 1)
                above = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0)
                for vote, mine in ((1, above * w[:, None]), (0, (1 - above) * w[:, None])):
                    rate = ((mine * votes).sum(0) + trust * plain) / (mine.sum(0) + trust)
                    self.fire[vote, :, side] = np.clip(np.where(self.parent >= 0, rate, plain), 1e-5, 0.95)
        return self


class Classifier:
    """Logistic regression over words and stems, with weights of those that count only."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[set[str]], p, least: int = 3, most: int = 3000, steps: int = 600, ridge: float = 1e-4) -> Classifier:
        """Gradient descent on soft labels; features are those most tied to them."""
        import numpy as np

        soft: dict[str, float] = {}
        df: Counter = Counter()
        for x, w in zip(rows, p, strict=True):
            if w > 0.1:
                for f in x:
                    soft[f] = soft.get(f, 0.0) + float(w)
        for x in rows:
            df.update(f for f in x if f in soft)
        total, hot = len(rows), float(np.sum(p))
        tie = lambda f: (math.log((soft[f] + 0.5) / (df[f] - soft[f] + 0.5)) - math.log((hot + 1) / (total - hot + 1))) * math.sqrt(soft[f])
        names = sorted((f for f in soft if soft[f] >= least and soft[f] >= 0.8 * df[f]), key=lambda f: (-tie(f), f))[:most]
        at = {f: i for i, f in enumerate(names)}
        where = [[at[f] for f in x if f in at] for x in rows]
        row = np.repeat(np.arange(len(rows)), [len(x) for x in where])
        col = np.array([c for x in where for c in x], int)
        w, b = np.zeros(len(names)), math.log((hot + 1) / (total - hot + 1))
        p = np.asarray(p, float)
        # each weight moves by its own curvature, shared with the stems that come with it
        curve = 2 * np.bincount(col, minlength=len(names)) / max(total, 1) + ridge
        for _ in range(steps):
            z = np.bincount(row, w[col], len(rows)) + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p) / max(total, 1)
            w = w - (np.bincount(col, err[row], len(names)) + ridge * w) / curve
            b = b - err.sum()
        return cls({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(b))

    def scorer(self) -> Callable[[str | None], float]:
        weights, bias = self.weights, self.bias

        class Known(dict):
            def __missing__(self, w: str) -> tuple[str, ...]:
                found = tuple(f for f in of_word(w) if f in weights)
                if len(self) >= _KNOWN:
                    self.clear()
                self[w] = found
                return found

        known = Known()

        def score(text: str | None) -> float:
            held = {f for fs in map(known.__getitem__, set(_WORD.findall((text or "").lower()))) for f in fs}
            z = bias + math.fsum(weights[f] for f in held)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, folds: int, held_fold: int) -> list[tuple[str, int | None]]:
    """Whole texts from outside the held-out fold: about ``per_label`` of each label and as many halved without one (None).

    Drawn by a hash of the id; the bound holds whatever the size of the tables.
    """
    own = labels.select(F.col("doc_id").alias("_lid"), F.col(f"`{label_col}`").cast("int").alias("_y")).filter("_lid is not null")
    own = own.filter(fold_of("_lid", folds) != held_fold).groupBy("_lid").agg(F.coalesce(F.max(F.when(F.col("_y").isin(0, 1), F.col("_y"))), F.lit(-1)).alias("_y"))
    ids = docs.select(F.col(f"`{id_col}`").alias("_lid")).filter("_lid is not null").filter(fold_of("_lid", folds) != held_fold).distinct()
    all_ids = ids.join(own, "_lid", "left").select("_lid", F.coalesce("_y", F.lit(-1)).alias("_y"))
    counts = {r["_y"]: r["n"] for r in all_ids.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "_lid"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.lit(0.0)
    for y, most in ((1, per_label), (0, per_label), (-1, per_label // 2)):
        share = F.when(F.col("_y") == y, min(1.0, most / max(1, counts.get(y, 0)))).otherwise(share)
    picked = all_ids.filter(draw < share)
    slim = id_and_text(docs, id_col, text_col).filter("_text is not null")
    # of rows that repeat an id the least text, taken together before they move
    rows = slim.join(F.broadcast(picked), F.col("_id") == F.col("_lid")).groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_id", "_text", "_y")
    return [(t, None if y < 0 else y) for _, t, y in sorted((r["_id"], r["_text"], r["_y"]) for r in rows.toLocalIterator())]


def learn(rows_of: list[tuple[str, int | None]]) -> Classifier:
    """Mine voters, fit the label model on their votes, fit the classifier on its posteriors.

    Labels choose voters and anchor the label model; the classifier sees posteriors only.
    """
    import numpy as np

    rows, df, by = [], Counter(), Counter()
    for x, t, y in without_copies(rows_of):
        rows.append((t, y))
        by[y] += 1
        if y == 1:
            df.update(x)
    share = by[1] / max(1, by[0] + by[1])
    least = least_support(len(df), share)
    # only features of toxic texts that can't be there by chance are kept of any text: what is held stays small
    able = {f for f, n in df.items() if n >= least} | {"=" + w for w in LEXICON}
    df.clear()
    held = [features(t) & able for t, _ in rows]
    cast = voters(mine_voters([x for x, (_, y) in zip(held, rows, strict=True) if y == 1], [x for x, (_, y) in zip(held, rows, strict=True) if y == 0], least))
    votes = np.array([[fires(t, x) for _, fires in cast] for x, (t, _) in zip(held, rows, strict=True)], float).reshape(len(held), len(cast))
    known = np.array([np.nan if y is None else float(y) for _, y in rows], float)
    model = LabelModel(share if by[1] else 0.1, [(0.2, 0.01)] * len(cast)).fit(votes, known)
    return Classifier.fit(held, model.posterior(votes), least)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL, folds: int = 4, held_fold: int = 2) -> Classifier:
    """The classifier learned from a bounded ``sample``."""
    return learn(sample(docs, labels, id_col, text_col, label_col, per_label, folds, held_fold))


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document.

    Null counts as empty and gets the score of a text without features. One output row per input row, repeated rows
    repeated; an empty table gives an empty one; other columns are ignored. One narrow pass over whole texts; only the
    classifier goes out, of a bounded number of weights.
    """
    slim = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = classifier.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rate(x.as_py()) for x in b.column(1)], pa.float64())], names=["doc_id", "score"])

    found = slim.mapInArrow(lean(run), f"doc_id {slim.schema['_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
