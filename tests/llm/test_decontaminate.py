import hashlib
import random
import re

import numpy as np
import pytest
from contigua.llm import decontaminate as dc
from texts import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        if not v:
            continue
        m = min(13, len(v))
        wins = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found |= {item} - {None}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("size", [dc.FILTER_HASHES, 0])
def test_against_brute_force(docs, bench, size):
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.decontaminate(docs, bench, filter_hashes=size).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *brute(r[1], items)) for r in rows())
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_winnowing_keeps_the_least_of_any_window():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 9, 10, 300):
        for top in (3, 1 << 62):
            h = rng.integers(0, top, n).astype(np.uint64)
            at = dc.winnow(h, 9).tolist()
            assert at == [i + h[i : i + 9].tolist().index(min(h[i : i + 9].tolist())) for i in range(max(0, n - 8))]


def test_random_shared_spans_at_every_window_length(spark):
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(30)]
    items = [(f"i{n}-{j}", " ".join(rng.choice(voc) for _ in range(n))) for n in range(1, 41) for j in range(2)] + [(None, " ".join(rng.choice(voc) for _ in range(20)))]
    texts = []
    for _, t in items:
        v = t.split()
        texts.append(" ".join([rng.choice(voc) for _ in range(rng.randint(0, 30))] + v[rng.randrange(len(v)) // 2 :] + [rng.choice(voc) for _ in range(9)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (1, 13):
        mine = [i for i in items if len(i[1].split()) >= least]
        bench = spark.createDataFrame(mine, "item_id string, text string")
        want = [(i, *brute(t, mine)) for i, t in enumerate(texts)]
        for size in (dc.FILTER_HASHES, 0):
            assert sorted(map(tuple, dc.decontaminate(docs, bench, filter_hashes=size).collect())) == want


def test_empty_sides(docs, none, bench):
    assert dc.decontaminate(none, bench).count() == 0
    assert dc.decontaminate(docs, bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_keep_clean(docs, bench):
    hit = dc.decontaminate(docs, bench).filter("n_hit > 0").count()
    kept = dc.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - hit and hit


def test_kept_rows_depend_on_texts_alone(spark):
    item = " ".join(f"item{i}" for i in range(20))
    other = " ".join(f"other{i}" for i in range(20))
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    benchmark = spark.createDataFrame([("a", item), (None, other), ("c", None), ("d", "")], "item_id string, text string")
    rows = [(None, item, "k"), (None, "clean words", "k"), (1, item, "k"), (1, "clean too", "k"), (2, None, "k"), (3, "", "k"), (4, long, "k"), (5, long + " " + item + " " + long, "k"), (6, other, "k"), (1, "clean too", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    for how in ({}, {"filter_hashes": 0}, {"digests_sent": 0}, {"filter_hashes": 0, "digests_sent": 0}):
        kept = sorted((r.doc_id or 0, r.text or "") for r in dc.keep_clean(docs, benchmark, **how).collect())
        assert kept == sorted((i or 0, t or "") for i, t, _ in rows if not t or (item not in t and other not in t))
    assert dc.keep_clean(docs, benchmark.limit(0)).count() == len(rows) and dc.keep_clean(docs.limit(0), benchmark).count() == 0


def test_hot_windows(spark, monkeypatch):
    from contigua import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    item = " ".join(f"item{i}" for i in range(15))
    docs = spark.createDataFrame([(i, f"a{i} " + (item if i % 3 else "b")) for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item), ("b", "a7"), ("c", item + " z")], "item_id string, text string")
    got = sorted(map(tuple, dc.decontaminate(docs, bench).collect()))
    assert got == [(r.doc_id, *brute(r.text, [("a", item), ("b", "a7"), ("c", item + " z")])) for r in sorted(docs.collect())]
