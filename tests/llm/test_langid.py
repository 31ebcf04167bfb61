import random
import zlib

from contigua.llm import langid

STEMS = {"aa": "th er on an re he in ed nd ha", "bb": "ción ñ que mente dad ar os la el", "cc": "ung heit sch ß ä ü keit ver ge"}


def corpus(spark, n=240):
    rng, rows = random.Random(8), []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        words = [" ".join("".join(rng.choice(STEMS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))]
        rows.append((i, words[0], lang if i % 9 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_held_out_accuracy(spark):
    docs, rows = corpus(spark)
    out = langid.identify(docs, langid.train(docs)).collect()
    truth = {i: lang for i, _, lang in rows if lang}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_are_not_inputs_and_fold_is_not_learned(spark):
    docs, _ = corpus(spark)
    fold = langid.fold_of("doc_id", 4) == 2
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(fold, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(x, langid.train(x)).collect()) for x in (docs, other))
    assert a == b


def test_awkward_texts(docs, none, spark):
    model = langid.train(docs)
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 3)] == ["und", "und", "und", "en"] and out[0].score == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    digits = spark.createDataFrame([(1, "123 456 !")], "doc_id long, text string")
    assert langid.identify(digits, model).first().lang_pred == "und"


def test_a_repeated_id_is_one_text_of_the_sample(spark, monkeypatch):
    docs, rows = corpus(spark, 60)
    own = next(r for r in rows if r[2] == "bb" and zlib.crc32(str(r[0]).encode()) % 4 != 2)
    many = spark.range(100_000).selectExpr(f"{own[0]}L as doc_id", f"concat('{own[1]} ', id) as text", "'bb' as lang")
    taken = []
    monkeypatch.setattr(langid.Model, "fit", lambda self, texts: taken.extend(texts) or self)
    langid.train(docs.unionByName(many))
    trained = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(taken) == len(trained) and len({t for t, _ in taken}) == len(trained)


def test_long_texts_go_by_ranges(spark, monkeypatch):
    """No n-gram is lost or made up where a range ends, whatever stands there."""
    docs, rows = corpus(spark, 60)
    m = langid.train(docs)
    text = " ".join(r[1] for r in rows[:20])
    whole = m.predict(text)
    for size in (1, 2, 5, 97):
        monkeypatch.setattr(langid, "_CHUNK", size)
        parts = m.predict(text)
        assert whole[0] == parts[0] and abs(whole[1] - parts[1]) < 1e-9


def test_scores_against_brute_force(spark):
    """Predictions from n-grams counted by a dictionary, one at a time."""
    docs, rows = corpus(spark)
    m = langid.train(docs)
    for _, text, _ in rows[:40]:
        b = (" " + " ".join("".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text.lower()).split()) + " ").encode()
        z, n = [0.0] * len(m.langs), 0
        for k in (2, 3, 4):
            for i in range(len(b) - k + 1):
                h = 0
                for c in b[i : i + k]:
                    h = (h * 0x01000193 + c + k) % (1 << 32)
                row = m.table[((h ^ h >> 15) * 0x9E3779B1 % (1 << 32)) >> 16]
                z, n = [x + float(y) for x, y in zip(z, row, strict=True)], n + 1
        z = [x / n + float(y) for x, y in zip(z, m.bias, strict=True)]
        e = [2.718281828459045 ** ((x - max(z)) / m.temperature) for x in z]
        lang, score = m.predict(text)
        assert lang == m.langs[e.index(max(e))] and abs(score - max(e) / sum(e)) < 1e-9
