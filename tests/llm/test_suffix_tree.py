import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from contigua.llm import suffix_buckets
from contigua.llm import suffix_tree as st
from pyspark.sql import functions as F
from texts import rows

HOW = {"depth": 3, "least_share": 2e-3}


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute():
    """Counts, and scores by a tree grown with dictionaries."""
    learn = [st.tokens_of(r[1]) for r in rows() if not held(r[0])]
    train = Counter(t for x in learn for t in x)
    n, v, once = sum(train.values()), len(train), max(1, sum(c == 1 for c in train.values()))
    least = max(2.0, HOW["least_share"] * n)
    hot = {t for t, c in train.items() if c >= least} | {st.END}
    sym = lambda t: t if t in hot else None
    root = Counter({t: train[t] for t in hot})
    root[None] = n - sum(root.values()) + once
    states = {(): {t: root[t] / sum(root.values()) for t in root}}
    cands = {(t,) for t in hot if t != st.END and train[t] >= least} | {("start",)}
    for d in (1, 2, 3):
        counts = {c: Counter() for c in cands}
        for x in learn:
            s = ["start"] * 3 + [sym(t) for t in x]
            for i in range(3, len(s)):
                if (c := tuple(s[i - d : i])) in counts:
                    counts[c][s[i]] += 1
        grown = {}
        for c, k in counts.items():
            parent = next(states[c[j:]] for j in range(1, d + 1) if c[j:] in states)
            m, kept = sum(k.values()), {t: a for t, a in k.items() if a >= least}
            if not kept:
                continue
            rest = m - sum(kept.values())
            gain = sum(a * math.log(a / m / parent[t]) for t, a in kept.items())
            if rest:
                gain += rest * math.log(rest / m / (1 - sum(parent[t] for t in kept)))
            free = max(1, len(kept) - (rest == 0))
            if gain >= 0.5 * (free + 4 * math.sqrt(2 * free)):
                spread = len(kept) + rest
                grown[c] = {t: (kept.get(t, 0) + spread * parent[t]) / (m + len(kept)) for t in root}
        states |= grown
        cands = {(*c, t) for c, k in counts.items() for t, a in k.items() if a >= least and t not in (None, st.END)}
    rest = n - sum(train[t] for t in hot) + once
    out = []
    for r in rows():
        x = st.tokens_of(r[1])
        s, total = ["start"] * 3 + [sym(t) for t in x], 0.0
        for i in range(3, len(s)):
            p = next(states[c] for c in (tuple(s[i - d : i]) for d in (3, 2, 1, 0)) if c in states)
            total += math.log10(p[s[i]]) + (math.log10((train[x[i - 3]] or once) / rest) if s[i] is None else 0)
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in x)
        out.append((-1 if r[0] is None else r[0], held(r[0]), len(x), sum(train[t] > 0 for t in x), n, round(base, 5), round(total, 5)))
    assert len({len(c) for c in states}) == 4
    return sorted(out), len(states)


@pytest.mark.parametrize("hot", [0, 20, 200_000])
def test_against_brute_force(docs, hot):
    want, states = brute()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in st.score(docs, hot_tokens=hot, **HOW).collect())
    assert states > 2
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-5)


@pytest.mark.parametrize(("hot", "bucket"), [(0, 300), (20, 60), (20, 100_000), (200_000, 60)])
def test_buckets_against_brute_force(docs, monkeypatch, hot, bucket):
    """A tree too large for a task, with contexts dealt out over several buckets or none, gives the same scores."""
    monkeypatch.setattr(st, "_SENT", 0)
    for name, size in (("_BUCKET", bucket), ("_DEAL", 1500)):
        monkeypatch.setattr(suffix_buckets, name, size)
    want, _ = brute()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in st.score(docs, hot_tokens=hot, **HOW).collect())
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-5)


def test_buckets_leave_no_shuffles_and_name_rows_in_parts(spark, docs, monkeypatch):
    """Disk holds no shuffle of a table that is written, and never those of more than a share of the rows that are named."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for f in files.getAllFiles().mkString("\n").split("\n") if (x := f.rsplit("/", 1)[-1]).startswith("shuffle_") and x.endswith(".data")}
    write, left, named = suffix_buckets.materialize, {}, []

    def materialize(df, name, **how):
        before = shuffles()
        out = write(df, name, **how)
        end = time.time() + 5
        while (new := shuffles() - before) and time.time() < end:
            time.sleep(0.1)
        left[name] = new
        if name == "lm-named":
            named.append(out.agg(F.sum("n_tokens")).first()[0])
        return out

    monkeypatch.setattr(st, "_SENT", 0)
    monkeypatch.setattr(st, "materialize", materialize)
    monkeypatch.setattr(suffix_buckets, "materialize", materialize)
    many = docs
    for _ in range(4):
        many = many.unionByName(docs)
    assert st.score(many, hot_tokens=0, **HOW).count() == 5 * len(rows())
    assert {"lm-tokens", "lm-symbol-order", "lm-symbols", "lm-named", "lm-sums"} <= left.keys()
    assert not any(left.values())
    assert len(named) == 2 and max(named) < 0.7 * sum(named)


def test_cells_counted_ahead_keep_their_share(docs, monkeypatch):
    """Five times the texts have the same contexts counted ahead: these are told by their share, not by a number of places."""
    write, ahead = suffix_buckets.materialize, []

    def materialize(df, name, **how):
        out = write(df, name, **how)
        if name == "lm-large":
            ahead.append(out.count())
        return out

    monkeypatch.setattr(st, "_SENT", 0)
    monkeypatch.setattr(suffix_buckets, "_BUCKET", 300)
    monkeypatch.setattr(suffix_buckets, "materialize", materialize)
    five = docs
    for _ in range(4):
        five = five.unionByName(docs)
    assert [st.score(x, **HOW).count() for x in (docs, five)] == [len(rows()), 5 * len(rows())]
    assert len(ahead) == 2 and ahead[0] == ahead[1]


def test_texts_are_read_once_for_buckets(docs, monkeypatch):
    """Tokens are named chunk by chunk, however small the chunks, and no text is read to be encoded again."""
    monkeypatch.setattr(st, "_SENT", 0)
    for module, name, size in ((st, "_GATHER", 20), (st, "_CHUNK", 200), (suffix_buckets, "_RANKED", 100)):
        monkeypatch.setattr(module, name, size)
    monkeypatch.setattr(st, "encode", None)
    want, _ = brute()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in st.score(docs, **HOW).collect())
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-5)


def test_no_context_is_too_rare_in_a_large_corpus(spark, monkeypatch):
    """A passage that occurs twice is known however large the corpus is, by default: its contexts aren't a share of it."""
    rng = np.random.default_rng(5)
    twice = " ".join(f"p{i}" for i in range(40))
    many = spark.createDataFrame([(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"], 50_000))) for i in range(8, 120)], "doc_id long, text string")
    a, b, c = [i for i in range(8) if not held(i)][:3]
    docs = many.unionByName(spark.createDataFrame([(a, twice), (b, twice), (c, " ".join(twice.split()[::-1]))], "doc_id long, text string"))
    rows = st.score(docs)
    score = {r.doc_id: r.score for r in rows.filter("doc_id < 8").collect()}
    assert rows.first().train_tokens * 5e-7 > 2
    assert score[a] == pytest.approx(score[b]) and score[a] > score[c] + 100
    monkeypatch.setattr(st, "_SENT", 10**9)
    again = {r.doc_id: r.score for r in st.score(docs).filter("doc_id < 8").collect()}
    assert again == pytest.approx(score, rel=1e-9)


def test_contexts_are_found_and_distributions_sum_to_one(spark):
    rng = np.random.default_rng(1)
    texts = []
    for i in range(400):
        w = ["a"]
        while len(w) < 50:
            w.append("bc"[int(rng.random() < 0.9)] if w[-1] == "a" else "abcd"[rng.integers(4)])
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marked = st._marked(docs, "doc_id", "text", 7, 2)
    tokens = st.token_table(marked)
    n = tokens.selectExpr("sum(n_train)").first()[0]
    alphabet = st.alphabet_of(tokens, n, 3, 2.0)
    tree = st.learn(st.encode(marked, tokens, alphabet, n, 1, 1000), alphabet, n, 1, 2.0)
    every = np.arange(tree.width)
    give = lambda *c: np.exp(tree.log_p(lambda d: np.full(tree.width, sum(s * alphabet.base**i for i, s in enumerate(c[::-1][:d]))), every))
    a, b, c = (alphabet.at[x] for x in (b"a", b"b", b"c"))
    assert a in tree.keys[1] and tree.states() > 2
    for context in ((a, a, a), (b, c, a), (alphabet.start, alphabet.start, alphabet.start), (c, b, c), (alphabet.other, b, b)):
        assert abs(give(*context).sum() - 1) < 1e-9
    assert abs(give(b, b, a)[c] - 0.9) < 0.05
    out = st.score(docs).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert out[0] > out[1]


def test_empty(none):
    assert st.score(none).count() == 0


def test_every_frequent_context_counts(spark):
    """More pairs than any fixed number of contexts or symbols: each is a state, and rare ranks are told by what precedes."""
    pairs = [(f"a{i}", f"b{i}") for i in range(1500)]
    docs = spark.createDataFrame([(k * 1500 + i, " ".join([*pairs[i], *pairs[(i * 7 + k) % 1500]])) for k in range(4) for i in range(1500)], "doc_id long, text string")
    marked = st._marked(docs, "doc_id", "text", 7, 2)
    tokens = st.token_table(marked)
    n = tokens.selectExpr("sum(n_train)").first()[0]
    alphabet = st.alphabet_of(tokens, n, 3, 2.0)
    tree = st.learn(st.encode(marked, tokens, alphabet, n, 1, 1000), alphabet, n, 1, 2.0)
    assert alphabet.other == tokens.filter("n_train >= 2").count() > 2900
    # every a tells its b; what follows a b is told by no count of its own but that of the end
    assert len(tree.keys[1]) > 1400 and tree.states() > 1500
    scores = {r.doc_id: r.score for r in st.score(docs).collect()}
    assert max(scores.values()) > -12 and sum(scores.values()) / len(scores) > -14


def test_long_texts_ties_and_small_buckets(spark, monkeypatch):
    """Chunks, flushes and buckets of any size give the same counts, and repeated rows the same scores."""
    text = " ".join(f"w{i * i % 61} x{i % 7}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (3, text), (3, text), (4, None), (None, "w1 x1 unseen")], "doc_id long, text string")
    want = sorted((r.doc_id or 0, r.n_tokens, r.score) for r in st.score(docs).collect())
    assert want[0][1] == 4 and want[1][2] == want[2][2] == want[3][2]
    for name, size in (("_CHUNK", 1000), ("_GATHER_CELLS", 500), ("_BUCKET", 300)):
        monkeypatch.setattr(st, name, size)
    got = sorted((r.doc_id or 0, r.n_tokens, r.score) for r in st.score(docs, hot_tokens=0).collect())
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-9)
