from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from sedimenta.llm import queries, toxicity

rng = random.Random(8)
BAD = ["vile", "rotten", "scummy", "nasty"]


def prose(n, bad=0):
    words = ["".join(rng.choices("aeioutrsn", k=4)) for _ in range(n)]
    for _ in range(bad):
        words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


def tables(spark, n=400):
    docs = [(i, prose(rng.randrange(20, 80), 2 if i % 4 == 0 else 0), "en" if i % 3 else "xx") for i in range(n)]
    docs += [(n, None, "en"), (n + 1, "", None), (n + 2, "12 !", "en"), (n + 3, prose(50_000), "en"), (n + 4, prose(50_000, 3), "en"), (None, docs[0][1], "en"), (0, *docs[0][1:])]
    labels = [(i, int(i % 4 == 0)) for i in range(n)] + [(n + 50, 1), (None, 1), (n, None), (0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), docs


def test_learns_and_keeps_its_contract(spark):
    docs, labels, rows = tables(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = toxicity.score_toxicity(docs, model, keep={"again": F.col("doc_id")}).collect()
    assert len(got) == len(rows)
    held = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0}
    right = np.mean([r.predicted == (i % 4 == 0) for i, r in held.items()])
    assert right > 0.9
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert [by_id[i].predicted for i in (400, 401, 402, 404)] == [0, 0, 0, 1]
    assert by_id[400].score == by_id[401].score == by_id[402].score
    kept = toxicity.without_toxic(docs.selectExpr("*", "1 AS one", "2 AS c0", "3 AS score"), model)
    assert kept.columns == ["doc_id", "text", "lang", "one", "c0", "score"]
    assert kept.count() == sum(not r.rejected for r in got) and kept.first().c0 == 2


def test_folded_tables_score_like_the_plain_network():
    words = toxicity.Encoder()("one two three two one")
    sample = [(i % 2, "en", toxicity.Encoder()(prose(30, i % 2))) for i in range(80)]
    model = toxicity.train(sample)
    folded = model.responses(words)[0]
    model.table = None
    assert np.allclose(folded, model.responses(words)[0], atol=1e-4)
    plain = []
    padded = np.concatenate((words, np.zeros((3, toxicity.HASHES), np.int64)))
    for width, f, bias in zip(toxicity.WIDTHS, model.filters, model.biases):
        vectors = [model.embedding[w].sum(axis=0) for w in padded]
        each = [sum(vectors[i + j] @ f[j] for j in range(width)) + bias for i in range(len(words))]
        plain.append(np.maximum(np.max(each, axis=0), 0))
    assert np.allclose(folded, np.concatenate(plain), atol=1e-4)


def test_without_labels_or_documents(spark):
    docs, labels, _ = tables(spark, 8)
    model = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.score_toxicity(docs, model).filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.8 and clean.predicted.mean() < 0.04


def test_long_texts_teach_by_a_run_of_words_and_copies_share_a_part(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_WORDS", 50)
    words = toxicity.Encoder()(prose(500))
    run = toxicity.window(words)
    at = [i for i in range(451) if (words[i : i + 50] == run).all()]
    assert len(run) == 50 and at and (toxicity.window(words) == run).all() and len(toxicity.window(words[:50])) == 50
    plain = [(0, "en", toxicity.Encoder()(prose(30))) for _ in range(60)]
    first = toxicity.train(plain + [(1, "en", toxicity.Encoder()(prose(30, 2))) for _ in range(60)])
    assert first.score(words) < 0.5


def test_repeated_ids_and_texts_stay_within_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_LABEL", 5)
    docs = spark.createDataFrame([(1, f"vile text x{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}", "en") for i in range(3000)] + [(2, "good text", "en")] * 50, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sample: seen.extend(sample))
    toxicity.fit(docs, labels, F.lit(True))
    assert len(seen) == 20 and len({w.tobytes() for _, _, w in seen}) == 20


def test_training_holds_little_more_than_the_model():
    sample = [(i % 2, "en", toxicity.Encoder()(prose(30, i % 2))) for i in range(8)]
    tracemalloc.start()
    try:
        model = toxicity.train(sample)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.6 * (model.table.nbytes + model.embedding.nbytes)
