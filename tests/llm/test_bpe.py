import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from contigua.llm import bpe
from texts import rows
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def ids(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


def test_query_equals_library(docs, none, lib):
    def want(t):
        e = lib.encode(t or "", add_special_tokens=False).ids
        return len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()

    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, PATH).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *want(r[1])) for r in rows())
    assert bpe.encode_decode(none, PATH).count() == 0
    with_ids = bpe.encode_decode(docs, PATH, with_ids=True).filter("doc_id = 13").first()
    assert np.frombuffer(with_ids.ids, "<u4").tolist() == lib.encode(rows()[13][1], add_special_tokens=False).ids


def test_noise_and_long_runs(lib):
    codec, rng = bpe.codec(PATH), random.Random(4)
    for k in range(600):
        letters = rng.choice(["ab", "aeinst", "the quick ", "aA1 \n\t'sll", "éüñ中文🤦‍♂️ a \x85", "=-_*#", "\x00\x1c\x1f \x7f"])
        t = "".join(rng.choice(letters) for _ in range(rng.choice([1, 9, 60, 6000 if k % 60 == 0 else 30])))
        t += ("<|endoftext|>" + t) * (k % 9 == 0)
        assert ids(codec, t) == lib.encode(t, add_special_tokens=False).ids, t[:80]
    for t in ("a" * 30000, "ab" * 9000, "-" * 20001, " " * 70000 + "x", ("word " * 40000)):
        assert ids(codec, t) == lib.encode(t, add_special_tokens=False).ids


def test_memory_of_the_transducer_is_bounded():
    m, seen = bpe.codec(PATH).merges, []
    shared = m._shared

    def spy(starts, base, p):
        seen.append(len(starts))
        return shared(starts, base, p)

    m._shared = spy
    try:
        rng = random.Random(6)
        list(m.encode(bytes(rng.choice(b"aeionrst") for _ in range(60000))))
    finally:
        del m._shared
    assert len(seen) > 10 and max(seen) <= 6 * (m.lookahead + m.longest)


def test_split_characters_decode_over_chunks():
    codec, t = bpe.codec(PATH), "🤦é中"
    chunks = [bytes(x) for x in np.frombuffer(b"".join(codec.encode(t)), "<u4").reshape(-1, 1).view(np.uint8).tolist()]
    assert "".join(codec.decode(iter(chunks))) == t


def test_short_pieces_equal_the_stream_and_narrow_classes_the_library(lib):
    codec, rng = bpe.codec(PATH), random.Random(9)
    for _ in range(2000):
        piece = "".join(rng.choice("ab  eE1é漢😀-_.xzthingation") for _ in range(rng.randint(0, 60))).encode()
        assert codec.merges.encode_short(piece) == list(codec.merges.encode(piece))
    for t in ("é   a", "aɏ bɐ", "漢字 ٣٤　x", "𐐀 b 𝟙 ²½", "\U00020000 ok", "\U0010ffff z y"):  # each needs a wider class than the one before
        assert ids(codec, t) == lib.encode(t, add_special_tokens=False).ids, t
