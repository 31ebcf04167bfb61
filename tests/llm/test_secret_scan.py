import hashlib
import random
import re

from contigua.llm import secret_scan as ss
from texts import rows


def brute(t):
    t = t or ""
    out = []
    names = r"(?a:(?i:password|passwd|secret|token|api_?key))"
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((*m.span(), 0))
    out += [(*m.span(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    out.sort(key=lambda s: (s[0], s[2]))
    said = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, b, k in out)
    return [sum(s[2] == k for s in out) for k in range(3)], hashlib.sha256(said.encode()).hexdigest(), said


def test_base_equals_brute_force(docs):
    got = sorted((-1 if r.doc_id is None else r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in ss.scan(docs).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *brute(r[1])[:2]) for r in rows())


def test_base_on_noise():
    rng, d = random.Random(2), ss.Detector()
    bits = ["token", "PASSWORD", "Api_Key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "abcdef12", "é", "\n", "passwd", "x"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        spans = [s for s in d.spans(t) if s[2] != "markov"]
        assert ss._said(spans) == brute(t)[2], t


def test_models_tell_random_from_ordinary():
    d = ss.Detector()
    held = ss.default_samples(1500, seed=99)
    right = sum(d.is_secret(s) == bool(y) for s, y in held if len(s) >= 20)
    assert right >= 0.97 * sum(len(s) >= 20 for s, _ in held)
    for word in ("Verantwortungsbewusstseinstraining", "internationalization_of_responsibilities", "thoningerreouhaatedinthan", "1234567890123456789012345", "-----------------------------"):
        assert not d.is_secret(word)
    assert d.is_secret("Xk29fQ0vLzR7mTqB1cYw8UeH") and d.is_secret("ghp_x7Kq2Lw9ZpR4tVb8NcM1sDf6GhJ3")


def test_redact(docs, none):
    out = {r.doc_id: r for r in ss.redact(docs).collect()}
    assert out[16].text == "x [SECRET]\" and [SECRET] [SECRET] secret=short" and out[16].n_chars == len(out[16].text)
    assert out[0].text is None and out[6].text == {r[0]: r[1] for r in rows()}[6]
    assert ss.redact(none).count() == 0 and ss.scan(none).count() == 0
