import random
import re
import zlib
from collections import Counter

import pytest
from contigua.llm import spelling
from pyspark.sql import functions as F
from texts import rows

LETTERS = "abcdé"


def brute_words(docs):
    n = Counter()
    for r in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(words):
    near = {w: set() for w in words}
    for w in words:
        for v in _edits(w) & words.keys():
            near[w].add(v)
            near[v].add(w)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def _edits(w):
    letters = {c for c in LETTERS + "abcdefghijklmnopqrstuvwxyzàéñÉ"}
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}) - {w}


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def sample(seed, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(6, 9))) for _ in range(12)]
    for _ in range(500):
        w = rng.choice(words)
        words.append(rng.choice(sorted(_edits(w))))
    weights = [1 / (i + 1) ** 1.3 for i in range(len(words))]
    return [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=60))) for i in range(n)]


def test_one_edit():
    assert all(spelling.one_edit("abcabc", w) == (w in _edits("abcabc")) for w in _edits("abcabc") | {"abcabc", "abc", "abcabcaa", "bacabc", ""})


@pytest.mark.parametrize(("shard", "split", "few"), [(10_000, 20_000, 12), (40, 20_000, 0), (25, 10, 3)])
def test_against_brute_force(spark, monkeypatch, shard, split, few):
    monkeypatch.setattr(spelling._Rests, "FEW", few)
    docs = sample(shard)
    words = brute_words(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    counted = spelling.materialize(spelling.word_counts(df), "words")
    assert {r.word: r.n for r in counted.collect()} == words and len(words) > 200
    want = {r[0]: r[4] for r in brute(words) if r[4]}
    assert {r.word: r.n_near for r in spelling.near_words(counted, shard, split).collect()} == want


def test_all_columns_and_chains(spark):
    docs = sample(7) + [(1000 + i, "caféteria cafeteria") for i in range(40)] + [(2000, "caféteri " * 7 + "cafétera " * 7 + "zzzzzz " * 6 + "zzzzzzz " * 31 + "zzzzzzzz " * 160)]
    got = found(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    assert got == brute(brute_words(docs))
    assert {r[2] for r in got if r[0] == "zzzzzz"} == {"zzzzzzzz"}


def test_awkward_rows(spark, docs, none):
    assert found(spelling.variants(docs)) == brute(brute_words(rows()))
    assert spelling.variants(none).count() == 0
    clash = spark.createDataFrame([(1, "abcdef " * 9, 2, 3, "x"), (None, "abcdeg", 2, 3, "x"), (2, None, 2, 3, "x")], "doc_id long, text string, n long, n_near long, word string")
    assert [r.n for r in spelling.variants(clash).collect()] == [9]


def test_a_form_of_very_many_words(spark, monkeypatch):
    from contigua import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 100)
    forms = spark.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.lit("top").alias("form")).unionByName(spark.createDataFrame([("top", None)], "word string, form string"))
    assert {r.root for r in spelling.roots(forms).collect()} == {"top"}
