from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from sedimenta.llm import langid, queries

DIR = "/root/testdata/sf0.01"


def plain_grams(text):
    words, out = [""], []
    for c in text.lower():
        words[-1] += c if c.isalpha() else ""
        if not c.isalpha():
            words.append("")
    words = [f"\0{w}\0" for w in words if w]
    for n in langid.GRAMS:
        for k, w in enumerate(words):
            own = [w[i : i + n] for i in range(len(w) - n + 1)]
            out += [g for g in own if g.strip("\0")]
    return out


def plain_bucket(gram):
    """Bucket of one n-gram by integer arithmetic."""
    h = len(gram)
    for c in gram:
        h = (h * 0x100000001B3 + (0 if c == "\0" else ord(c))) % 2**64
    return ((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BUCKET_BITS)


def test_buckets_and_scores_against_plain_python():
    text = "Été 12 ab-c, ß\U0001f600x"
    assert sorted(np.concatenate(list(langid.buckets(text)))) == sorted(map(plain_bucket, plain_grams(text)))
    sample = [(lang, k, *langid.features(t)) for k, (lang, t) in enumerate([("a", "the cat sat"), ("b", "le chat est"), ("c", "der hund")] * 4)]
    model = langid.train(sample)
    logits = np.mean([model.table[plain_bucket(g)].astype(float) for g in plain_grams(text)], axis=0) + model.bias
    e = np.exp((logits - logits.max()) / model.temperature)
    lang, score, _ = model.predict(text)
    assert lang == model.languages[int(e.argmax())] and abs(score - e.max() / e.sum()) < 1e-5


def test_a_text_and_its_fragment_never_part():
    keys = [(2**32 // 7) * k for k in range(40)]
    sample = [("en" if k % 2 else "fr", key, np.array([k, 50 + part]), np.array([1, 2])) for k, key in enumerate(keys) for part in (0, 1)]
    seen = []
    held = {key for key in keys if key % 2**32 < langid.CALIBRATION * 2**32}
    original, langid.softmax = langid.softmax, lambda x: seen.append(x.shape) or original(x)
    try:
        langid.train(sample)
    finally:
        langid.softmax = original
    assert 0 < len(held) < len(keys) and (2 * len(held), 2) in seen
    assert sum(s == (2,) for s in seen) == 2 * (len(keys) - len(held)) * langid.EPOCHS


def test_clashing_columns_are_ignored(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 1, "x", 2), (2, "le chat", "fr", 1, "x", 2)], "doc_id long, text string, lang string, key int, at string, score int")
    model = langid.fit(docs, F.lit(True))
    assert langid.identify(docs, model).columns == ["doc_id", "lang_pred", "score", "accepted"] and langid.identify(docs, model).count() == 2


def test_grams_are_those_of_single_words():
    text = "Été 12 ab-c, ß\U0001f600x"
    got = np.concatenate(list(langid.buckets(text)))
    assert len(got) == len(plain_grams(text))
    assert sorted(got) == sorted(np.concatenate([np.concatenate(list(langid.buckets(w))) for w in ("été", "ab", "c", "ß", "x")]))
    assert list(langid.buckets("12 ..")) == list(langid.buckets(None)) == []


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    got = queries.op7_langid(spark, DIR).toPandas()
    assert len(got) == len(docs)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == docs.loc[held.doc_id].values).mean() > 0.95
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= set(docs) | {"und"}
    again = queries.op7_langid(spark, DIR).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_nulls_empty_texts_and_tables(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(8)] + [(i, "le chat est sur la table", "fr") for i in range(8, 16)]
    rows += [(20, None, "en"), (21, "", None), (22, "12 !", "fr"), (None, "the cat", None), (None, "the cat", None), (23, "chat " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in (20, 21, 22)] == ["und"] * 3 and got[None] == "en" and got[23] == "fr"
    none = langid.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
