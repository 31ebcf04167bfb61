import itertools
import random

import numpy as np
import pytest
from contigua.llm import toxicity as tx
from contigua.llm.common import fold_of
from pyspark.sql import functions as F

SYL = "th er on an re he in ed nd ha at es".split()


def corpus(spark, n=1200):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SYL) for _ in range(rng.randint(2, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "zarko" + word(), "zarko" + word()]))
        docs.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 0, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = {r.doc_id: r for r in tx.score(docs, tx.train(docs, labels)).collect()}
    held = [(out[r.doc_id].predicted, r.toxic) for r in labels.collect() if out[r.doc_id].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = corpus(spark, 600)
    flipped = labels.withColumn("toxic", F.when(fold_of("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tx.train(docs, x).weights.items()) for x in (labels, flipped))
    assert a == b


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.2
    fire = lambda a, b: np.where(y, rng.random(6000) < a, rng.random(6000) < b)
    v = fire(0.6, 0.02)
    votes = np.stack([v, v & (rng.random(6000) < 0.95), fire(0.4, 0.01), fire(0.5, 0.03), fire(0.05, 0.05)], 1).astype(float)
    known = np.where(rng.random(6000) < 0.3, y, np.nan).astype(float)
    m = tx.LabelModel(0.2, [(0.2, 0.01)] * 5).fit(votes, known)
    plain = m.fire[0]
    assert np.allclose(plain[[0, 2, 3], 0], [0.6, 0.4, 0.5], atol=0.06) and np.allclose(plain[[0, 2, 3, 4], 1], [0.02, 0.01, 0.03, 0.05], atol=0.02)
    # the second voter follows the first; the others follow nobody
    assert m.parent.tolist() == [-1, 0, -1, -1, -1]
    assert np.allclose(m.fire[:, 1, 0], [0, 0.95], atol=0.05) and m.fire[0, 1, 1] < 0.01
    best = tx.LabelModel(0.2, [(0.6, 0.02), (0.5, 0.5), (0.4, 0.01), (0.5, 0.03), (0.5, 0.5)])  # the true rates; the copy has no say
    assert ((m.posterior(votes) > 0.5) == y).mean() > ((best.posterior(votes) > 0.5) == y).mean() - 0.01


def test_awkward(docs, none, spark):
    labels = spark.createDataFrame([(6, 1), (6, 1), (None, 1), (3, None), (7, 0), (10, 0)], "doc_id long, toxic int")
    c = tx.train(docs, labels)
    out = {r.doc_id: r.score for r in tx.score(docs, c).collect()}
    assert out[0] == out[1] == out[2] and tx.score(docs, c).count() == docs.count()
    assert tx.score(none, c).count() == 0
    assert tx.train(none, labels.limit(0)).weights == {}


def test_posterior_against_enumeration():
    """The posterior is what the joint probabilities of label and votes give."""
    rng = np.random.default_rng(4)
    m = tx.LabelModel(0.2, [(0.3, 0.05), (0.6, 0.1), (0.2, 0.02), (0.4, 0.3)])
    m.parent[:] = [-1, 0, 1, -1]
    m.fire = rng.uniform(0.05, 0.9, m.fire.shape)
    m.fire[1, [0, 3]] = m.fire[0, [0, 3]]
    for votes in itertools.product((0, 1), repeat=4):
        joint = []
        for side, prior in ((0, 0.2), (1, 0.8)):
            for j, v in enumerate(votes):
                rate = m.fire[votes[m.parent[j]] if m.parent[j] >= 0 else 0, j, side]
                prior *= rate if v else 1 - rate
            joint.append(prior)
        assert m.posterior(np.array([votes], float))[0] == pytest.approx(joint[0] / sum(joint))


def test_correlated_voters_are_found_and_have_one_say():
    rng = np.random.default_rng(5)
    y = rng.random(6000) < 0.3
    fire = lambda a, b: np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b)
    first = fire(0.5, 0.1)
    votes = np.column_stack([first, first, np.where(rng.random(len(y)) < 0.97, first, ~first), fire(0.4, 0.05), fire(0.3, 0.02)]).astype(float)
    known = np.where(rng.random(len(y)) < 0.5, y, np.nan)
    m = tx.LabelModel(0.3, [(0.2, 0.01)] * 5).fit(votes, known)
    linked = {frozenset((j, int(p))) for j, p in enumerate(m.parent) if p >= 0}
    assert len(linked) == 2 and all(pair <= {0, 1, 2} for pair in linked)
    single = tx.LabelModel(0.3, [(0.2, 0.01)] * 3).fit(votes[:, [0, 3, 4]], known)
    a, b = m.posterior(votes), single.posterior(votes[:, [0, 3, 4]])
    assert np.abs(a - b).mean() < 0.02
    fired = (votes[:, :3].sum(1) == 3) & (votes[:, 3:].sum(1) == 0)
    assert abs(a[fired].mean() - y[fired].mean()) < 0.05


def test_only_copies_go():
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    near = base.replace("wordaa", "other")
    unlike = [(f"aaa bbb {w} " + " ".join(f"{w}{chr(97 + i)}" for i in range(20)), 0) for w in ("xq", "yq", "zq")]
    kept = [t for _, t, _ in tx.without_copies([(base, 0), (near, 0), (base, 1), (base, 0), *unlike])]
    assert kept == [base, base, *(t for t, _ in unlike)]


def test_repeated_and_long_rows(spark):
    long = "calm text " * 60_000 + "you idiot"
    docs = spark.createDataFrame([(1, long), (1, long), (1, "calm"), (2, None), (None, "you idiot"), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    out = tx.score(docs, tx.train(docs, labels)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
