from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sedimenta.llm import maxscore

VECTORS = "vec_id long, embedding array<float>"


def plain(rows, k=20):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows):
    return sorted(map(tuple, maxscore.top_k(spark.createDataFrame(rows, VECTORS)).collect()))


def test_against_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.3) for _ in range(16)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)]
    rows += [(400, None), (420, [None] * 16), (440, [float("nan")] * 16), (460, [float("inf")] * 16), (None, rows[0][1]), (480, []), (500, [0.5, 0.5]), (20, rows[20][1])]
    assert found(spark, rows) == plain(rows)


def test_large_components_few_rows_and_empty_table(spark):
    assert found(spark, []) == []
    rows = [(0, [1e6, -1e6]), (1, [2e6, 3e6]), (20, [-1e6, 0.1])]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("zeros", [0.0, 0.9])
def test_only_essential_postings_are_read(zeros):
    rng = np.random.default_rng(2)
    scale = np.repeat([40, 2], 8)
    x = (rng.normal(size=(4000, 16)) * scale).astype(np.int64)
    x[rng.random(x.shape) < zeros] = 0
    asked = np.arange(0, 4000, 20)
    found, read, every = maxscore.search_block(np.arange(4000), x, asked, x[asked], 5)
    assert 0 < read < 0.8 * every
    for (ids, scores), own in zip(found, asked, strict=True):
        want = x @ x[own]
        want[own] = -(10**9)
        order = np.lexsort((np.arange(4000), -want))[:5]
        assert ids.tolist() == order.tolist() and scores.tolist() == want[order].tolist()


def test_many_shards_and_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 40)
    monkeypatch.setattr(maxscore, "BLOCK", 6)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(7, [9.0] * 8)] * 150
    assert found(spark, rows) == plain(rows)
