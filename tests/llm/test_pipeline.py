"""The pipeline against brute force on a small fixture, stage by stage."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from contigua.llm import quality, secret_scan
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_hits
from test_quality import brute as brute_counts
from test_simhash import brute_components, brute_fp
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    words = "the of and to is a in thing ones there reading erhat onblen".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "x", str(rng.randrange(999))]) for _ in range(n))
    base, item = prose(150), prose(30)
    near = base.replace("thing", "things", 1)
    texts = [None, "", "short text", base, base, near, prose(90) + " " + item + " " + prose(40), prose(80) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(10), "### $$$ %%% " * 60,
             ("of the " * 200), prose(60) + " Ünïcode 中文 " + prose(20), prose(3000), prose(700) + " " + item, prose(60) + " password: Xk29fQ0vLzR7mTqB <|endoftext|>"]
    rows = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(120), None, None, None), (9, base, "en", "s", len(base))]
    out = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, COLUMNS).repartition(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([("i", item), ("j", None)], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, [("i", item), ("j", None)]


def test_against_brute_force(spark, sf_dir):
    path, rows, items = sf_dir
    verdicts = {r.text: r.ok for r in spark.createDataFrame([(r[1],) for r in rows], "text string").select("text", quality.compile_rules(quality.measures(F.col("text"))).alias("ok")).collect()}
    kept = []
    for r in rows:
        n, *_, repeats = brute_counts(r[1])
        if n >= 50 and 100 * repeats <= 50 * n and verdicts[r[1]]:
            kept.append(r)
    comp = brute_components({brute_fp(r[1]) for r in kept}, 2)
    low = {}
    for r in kept:
        if r[0] is not None:
            c = comp[brute_fp(r[1])]
            low[c] = min(low.get(c, r[0]), r[0])
    one, seen = [], set()
    for r in kept:
        c = comp[brute_fp(r[1])]
        if r[0] is None or (r[0] == low[c] and c not in seen):
            seen.add(c)
            one.append(r)
    clean = [r for r in one if not brute_hits(r[1], items)[1]]
    assert len(rows) > len(kept) > len(one) > len(clean) > 3
    tok, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for r in clean:
        text, last, out = r[1], 0, []
        for a, b, _ in secret_scan.Detector().spans(text):
            if a >= last:
                out += [text[last:a], "[SECRET]"]
            last = max(last, b)
        ids = tok.encode("".join([*out, text[last:]]), add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((r[0] if r[0] is not None else -1, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest(), raw))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got) == sorted(want)


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir[0])
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")] and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir[0]).count() == 0
