import uuid

import public_tokenizers as P
import pytest
import sentencepiece
from contigua.llm import token_counts as tc
from texts import rows
from tokenizers import Tokenizer


def want(name):
    if name.endswith(".model"):
        m = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(m.encode(t))
    else:
        m = Tokenizer.from_file(P.path(name))
        count = lambda t: len(m.encode(t, add_special_tokens=False).ids)
    return sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_against_library_and_cache(docs, none, tmp_path, name):
    cache = f"file://{tmp_path}/{uuid.uuid4().hex}"
    got = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in tc.token_counts(d, P.path(name), cache).collect())
    assert got(none) == []
    assert got(docs.filter("doc_id < 9")) == [x for x in want(name) if x[0] in range(9)]
    stored = docs.sparkSession.read.parquet(cache).count()
    assert got(docs) == want(name)
    assert docs.sparkSession.read.parquet(cache).count() == len({r[1] or "" for r in rows()}) > stored
    assert got(docs) == want(name)
    assert docs.sparkSession.read.parquet(cache).count() == len({r[1] or "" for r in rows()})


def test_limit(docs, tmp_path):
    out = tc.token_counts(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/c", max_tokens=100).collect()
    assert all(r.over_limit == (r.n_tokens > 100) for r in out) and {r.over_limit for r in out} == {True, False}
