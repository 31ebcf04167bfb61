import base64
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from contigua.llm import training_order as to
from texts import rows

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 1023, 4097])
def test_feistel_is_a_bijection(n):
    f = to.Feistel(n, 11)
    s = f.slot(np.arange(n, dtype=np.uint64))
    assert sorted(s.tolist()) == list(range(n))
    assert f.index(s).tolist() == list(range(n))
    if n > 50:
        assert s.tolist() != to.Feistel(n, 12).slot(np.arange(n, dtype=np.uint64)).tolist() and s.tolist() != list(range(n))


def test_pieces_equal_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    lib = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    p = to.Pieces(PATH)
    for r in rows():
        assert np.frombuffer(p.encode(r[1] or ""), "<u2").tolist() == lib.encode_ordinary(r[1] or "")
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "b.", " ", " ", "\n", "it's", "é", "\xa0", "9", "\t", "\u2003", "###", "中"]) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(p.encode(t), "<u2").tolist() == lib.encode_ordinary(t), t


def test_remembered_pre_tokens_stay_small():
    """However many pre-tokens differ, a worker remembers less than 80 MB of them, and encodes the same."""
    p = to.Pieces(PATH)
    for k in range(9):
        p.encode(" ".join(f"w{i:x}" for i in range(k * 100_000, (k + 1) * 100_000)))
    assert sys.getsizeof(p.known) + sum(sys.getsizeof(a) + sys.getsizeof(b) for a, b in p.known.items()) < 80 << 20
    assert p.encode("a w0 wff w0") == to.Pieces(PATH).encode("a w0 wff w0")


@pytest.mark.parametrize(("seq_len", "span"), [(64, 17), (5000, 4)])
def test_round_trip_and_resume(spark, docs, tmp_path, seq_len, span):
    path = f"file://{tmp_path}/out"
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    table = sorted(((r.slot, r.shard, r.byte_offset, r.n_tokens, tuple(r.doc_ids)) for r in to.materialise(docs, path, PATH, seq_len, span).collect()))
    n = len(table)
    assert [t[0] for t in table] == list(range(n))
    first = {}
    for slot, shard, offset, *_ in table:
        assert offset == (slot - first.setdefault(shard, slot)) * (2 * seq_len + 1)
    assert list(first) == sorted(first) and max(Counter(t[1] for t in table).values()) <= span
    seqs = list(to.read_slots(spark, path))
    assert len(seqs) == n and all(len(s) == seq_len for s in seqs)
    assert list(to.read_slots(spark, path, n // 2, n // 2 + 3)) == seqs[n // 2 : n // 2 + 3]
    # texts and their ids are found again, pieced together over the sequences that hold them
    pieces = to.Pieces(PATH)
    whole = sorted((np.frombuffer(pieces.encode(r[1] or ""), "<u2").tolist(), r[0] or -1) for r in rows())
    assert sum(t[3] for t in table) == sum(len(w) + 1 for w, _ in whole)
    ends = sum(s[: t[3]].count(pieces.end) for s, t in zip(seqs, table, strict=True))
    assert ends == len(whole)
    assert {i for t in table for i in t[4]} == {r[0] for r in rows()}
    for w, i in whole:
        if 0 < len(w) < seq_len // 2 and i >= 0:
            near = [s[: t[3]] for s, t in zip(seqs, table, strict=True) if i in t[4]]
            assert any(w == s[k : k + len(w)] for s in near for k in range(len(s))) or len(near) > 1
    again = sorted((r.slot, tuple(r.doc_ids)) for r in to.materialise(docs, f"{path}2", PATH, seq_len, span).collect())
    assert again == [(t[0], t[4]) for t in table]


@pytest.mark.parametrize(("seq_len", "span", "together"), [(16, 7, 256), (40, 1000, 3)])
def test_slots_against_brute_force(spark, docs, tmp_path, monkeypatch, seq_len, span, together):
    """Slots, places and tokens from a plain recomputation: pack each partition, number on, permute."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(to, "_TOGETHER", together)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    lib = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    end, parts = to.Pieces(PATH).end, {}
    for r in docs.select(F.spark_partition_id().alias("part"), "doc_id", "text").collect():
        parts.setdefault(r.part, []).extend((t, r.doc_id) for t in [*lib.encode_ordinary(r.text or ""), end])
    seqs = [part[i : i + seq_len] for _, part in sorted(parts.items()) for i in range(0, len(part), seq_len)]
    order, want, tokens = to.Feistel(len(seqs), 5), [], {}
    for slot, s in zip(order.slot(np.arange(len(seqs), dtype=np.uint64)).tolist(), seqs, strict=True):
        ids = [i for k, (_, i) in enumerate(s) if k == 0 or s[k - 1][0] == end]
        want.append((slot, slot // span, slot % span * (2 * seq_len + 1), len(s), ids))
        tokens[slot] = [t for t, _ in s] + [end] * (seq_len - len(s))
    path = f"file://{tmp_path}/out"
    got = sorted((r.slot, r.shard, r.byte_offset, r.n_tokens, r.doc_ids) for r in to.materialise(docs, path, PATH, seq_len, span, 5).collect())
    assert got == sorted(want)
    assert list(to.read_slots(spark, path)) == [tokens[k] for k in range(len(seqs))]


def test_empty(spark, none, tmp_path):
    path = f"file://{tmp_path}/none"
    assert to.materialise(none, path, PATH).count() == 0
    assert list(to.read_slots(spark, path)) == []
