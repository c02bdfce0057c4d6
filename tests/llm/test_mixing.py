from __future__ import annotations

import random
import re

import duckdb
import pytest

from sedimenta.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Share by weight, then cut what is above its cap and reshare the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        over = {s for s in free if target[s] > cap * sizes[s]}
        left = sum(target[s] - cap * sizes[s] for s in over)
        for s in over:
            target[s] = cap * sizes[s]
        free -= over
    return target


def rows_of(seed, hot=0.4):
    rng = random.Random(seed)
    sources = [None, "é", "z", "Z", "", "src10", "src2"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", sources[0] if rng.random() < hot else rng.choice(sources), 0) for i in range(500)]
    return rows + [(900, None, None, "z", None), (901, " \t\n\x0b", None, "empty", 1), (902, "é a b", None, "z", 1), (903, "w " * 30_000, "en", "Z", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_and_oracle(spark, seed):
    rows = rows_of(seed)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    want = plain_targets(sizes)
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs).collect()
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(size[r[0]] for r in rows if r[3] == s) / 2 + 1
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    oracle = con.execute(mixing.ORACLE).fetchall()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((o[0], o[4]) for o in oracle)


def test_reruns_ties_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame(rows_of(3), DOCS).selectExpr("*", "1 AS size", "2 AS h", "3 AS skey")
    first = sorted(map(str, mixing.mix_sources(docs).collect()))
    assert first == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    ties = spark.createDataFrame([(None, "a b", None, "s", 1)] * 9, DOCS)
    # target 27: all once, 18 words, and of equal rows as many again as the middle of each lies within the other 9
    assert sorted(r.taken for r in mixing.mix_sources(ties).collect()) == [2] * 4 + [4] * 5


def test_repeated_rows_come_near_the_target(spark):
    rows = [(1, "w " * 10, None, "big", 1)] * 300 + [(i, "w " * 7, None, "small", 1) for i in range(200, 230)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS).repartition(5), carry=["n_chars", "text"]).collect()
    want = plain_targets({"big": 3000, "small": 210})
    for s in want:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 5
    assert all(r.doc.text.split() == ["w"] * r.size for r in got)
    assert not hasattr(mixing.mix_sources(spark.createDataFrame(rows, DOCS)).first(), "doc")
