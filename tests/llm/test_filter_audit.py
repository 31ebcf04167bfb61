import re
from itertools import permutations

import pytest
from contigua.llm import filter_audit
from texts import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = [(3, 1, 0), (6, 0, 1), (6, None, None), (6, 1, 1), (8, 1, 0), (99, 1, 1), (None, 1, 1), (13, 0, 0), (7, None, 1), (500, 1, 1)]


def fails(text):
    t, out = text or "", ""
    w = WORD.findall(t)
    out += "A" * (len(w) < 100)
    out += "B" * (100 * len(set(w)) < 80 * len(w))
    out += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
    return out + "D" * bool(re.search("[#$%&*|]", t))


def brute(docs, labels):
    first = {}
    for d in docs:
        if d[0] is not None:
            first[d[1] or ""] = min(first.get(d[1] or "", d[0]), d[0])
    facts = []
    for d in docs:
        copy = d[0] is not None and d[0] > first[d[1] or ""]
        mine = [x for x in labels if d[0] is not None and x[0] == d[0]]
        facts.append((d[2] or "", set(fails(d[1]) + "E" * copy), any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                n = sum(f in x[1] for x in own)
                out[part, "".join(order), i + 1] = [len(left), len(gone), n - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, i), v in out.items():
            if p == part:
                v.append(total[order[i - 1]])
    return out


@pytest.fixture(scope="module")
def mixed():
    out = []
    for i, r in enumerate(rows()):
        out.append((*r[:2], [None, "", "en", "fr"][i % 4], *r[3:]))
    return out + [(None, "one", "en", *out[0][3:]), (None, None, "fr", *out[0][3:]), (-4, "one two", None, *out[0][3:])]


def test_against_brute_force(spark, docs, mixed):
    df = spark.createDataFrame(mixed, docs.schema).repartition(3)
    got = filter_audit.audit(df, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = brute(mixed, LABELS)
    have = {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()}
    assert have == want and len(have) == 3 * 600


def test_joint_counts_are_of_all_subsets(spark, docs, mixed):
    df = spark.createDataFrame(mixed, docs.schema)
    j = filter_audit.joint_failures(filter_audit.failures(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()
    assert sum(r.joint[0] for r in j) == len(mixed)
    assert all(len(r.joint) == 32 and set(r.joint_good) == {0} for r in j)
    assert sum(r.joint[1] for r in j) == sum("A" in fails(r[1]) for r in mixed)


def test_empty_tables_and_clashing_names(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 5, 7, "q"), (2, "a b", "x", 5, 7, "q")], "doc_id long, text string, lang string, n long, bits int, part string")
    got = filter_audit.audit(clash, labels).filter("filter_order = 'EABCD' and step = 1").collect()
    assert [(r.part, r.kept, r.removed, r.shapley) for r in got] == [("x", 1, 1, 60)]


def test_rows_that_share_a_text_are_grouped_before_they_meet(spark):
    docs = spark.createDataFrame([(i, "same", "en") for i in range(3000)] + [(None, "same", "en")] * 2000, "doc_id long, text string, lang string").repartition(8)
    found = filter_audit.failures(docs, spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.good, r.n, r.n_copy) for r in found) == [(False, 4999, 2998), (True, 1, 1)]
