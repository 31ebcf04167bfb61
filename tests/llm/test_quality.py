import re

from contigua.llm import quality
from texts import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = _many(tri)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def _many(tri):
    at = {}
    for i, k in enumerate(tri):
        at.setdefault(k, []).append(i)
    return {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 3)}


def test_counts_equal_brute_force(docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.quality(docs).collect())
    want = sorted((r[0] if r[0] is not None else -1, *brute(r[1])) for r in rows())
    assert [g[:6] for g in got] == want
    for g in got:
        assert g[6] == (g[1] < 50 or 100 * g[5] > 50 * g[1])
        assert not (g[6] and g[7])


def test_no_python_in_the_plan(docs):
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty(none):
    assert quality.quality(none).count() == 0
    assert quality.keep_good(none).columns == none.columns


def test_keep_good_keeps_columns_and_rows(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality(docs).filter("kept").count()
