from __future__ import annotations

import random
import re

from test_pii import plain as plain_pii
from test_simhash import plain_alike

import corpus_pipeline
from sedimenta.llm import decontaminate, mixing

rng = random.Random(21)
BAD = ["vile", "rotten", "scummy", "nasty"]


def prose(n, bad=0):
    words = ["".join(rng.choices("aeioutrsnlm", k=5)) for _ in range(n)]
    for _ in range(bad):
        words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


def write(spark, root):
    bench = [(i, prose(30)) for i in range(5)]
    docs = []
    for i in range(400):
        text = prose(rng.randrange(40, 90), 3 if i % 5 == 1 else 0)
        if i % 20 == 2:
            text = f"{text} {bench[i % 5][1]} end"
        if i % 20 == 3:
            text += f" write a{i}@mail.example.com or 10.0.0.{i % 256} now"
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
    docs += [(1000 + i, docs[4][1], "en", "s0", docs[4][4]) for i in range(60)]
    for i in range(30):
        words = docs[10 * i][1].split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((3000 + i, " ".join(words), "en", "s3", 0))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (None, docs[5][1], "en", "s1", 5), (2002, "é " * 30_000, "fr", "s2", 60_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(i, 1, int(i % 5 == 1)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return docs, bench


def test_each_stage_against_brute_force(spark, tmp_path):
    docs, bench = write(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")

    frame = corpus_pipeline.materialize(stages["toxicity"](spark, frame, str(tmp_path)), "t")
    assert frame.columns == columns
    kept = {r.doc_id for r in frame.collect()}
    toxic = {i for i in range(400) if i % 5 == 1}
    assert len(toxic & kept) <= 0.1 * len(toxic) and len(({d[0] for d in docs} - toxic) - kept) <= 5

    before = [tuple(r) for r in frame.collect()]
    frame = corpus_pipeline.materialize(stages["near duplicates"](spark, frame, str(tmp_path)), "t")
    group = dict(zip([r[1] for r in before], plain_alike([r[1] or "" for r in before]), strict=True))
    after = [tuple(r) for r in frame.collect()]
    assert frame.columns == columns and sorted(group[r[1]] for r in after) == sorted(set(group.values()))
    assert len(before) - len(after) >= 60 + 15

    index = decontaminate.Index(bench)
    frame = corpus_pipeline.materialize(stages["decontamination"](spark, frame, str(tmp_path)), "t")
    clean = [r for r in after if not any(b[1] in (r[1] or "") for b in bench)]
    assert sorted(map(str, frame.collect())) and sorted(str(tuple(r)) for r in frame.collect()) == sorted(map(str, clean))
    assert len(clean) < len(after) and not any(index.find(r[1]) for r in clean)

    frame = corpus_pipeline.materialize(stages["personal data"](spark, frame, str(tmp_path)), "t")
    new = {r.doc_id: r for r in frame.collect()}
    assert frame.columns == columns and len(new) == len(clean)
    for r in clean:
        found = [s.split(":") for s in plain_pii(r[1])[1].split(",") if s]
        want = r[1]
        for kind, a, b in reversed(found):
            want = want[: int(a)] + f"<{kind.upper()}>" + want[int(b) :]
        assert new[r[0]].text == want and (want is None or new[r[0]].n_chars == len(want))
    assert sum("<EMAIL>" in (r.text or "") for r in new.values()) >= 15

    mixed = stages["mixing"](spark, frame, str(tmp_path)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in new.items()}
    sources = {}
    for r in mixed:
        assert r.taken == r.copies * size[r.doc_id] <= 2 * size[r.doc_id]
        assert tuple(r)[: len(columns)] == tuple(new[r.doc_id])
        total, target = sources.get(r.source, (0, r.target))
        sources[r.source] = (total + r.taken, target)
    assert abs(sum(t for _, t in sources.values()) - 1.5 * sum(size.values())) < 1
    assert all(abs(total - target) <= max(size.values()) / 2 for total, target in sources.values())
    # the corpus itself: every text as often as it is taken, redacted
    corpus = [r.text for r in mixed for _ in range(r.copies)]
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in corpus) == sum(r.taken for r in mixed)
    assert not any("@mail.example.com" in (t or "") for t in corpus) and any("<EMAIL>" in (t or "") for t in corpus)


def test_run_writes_and_rereads_every_stage(spark, tmp_path):
    write(spark, tmp_path)
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "lang", "source", "n_chars", "copies", "taken"} <= set(result.columns) and result.count() > 50
    assert result.filter("text LIKE '%<EMAIL>%'").count() and not result.filter("text LIKE '%@mail.example.com%'").count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert mixing.ORACLE


def test_empty_tables_and_columns_of_the_mix(spark, tmp_path):
    write(spark, tmp_path)
    for name in ("documents", "benchmark", "labels"):
        whole = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        whole.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(20).selectExpr("*", "7 AS copies", "8 AS size", "9 AS doc")
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert mixed.columns == [*docs.columns, "mix_copies", "taken", "source_size", "target"] and {r.copies for r in mixed.collect()} == {7}
