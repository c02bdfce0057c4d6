from __future__ import annotations

import random

import numpy as np

from sedimenta.llm import decontaminate as d

rng = random.Random(11)
ITEM = "item_id long, text string"
DOCS = "doc_id long, text string"


def words(n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def plain(text, item):
    """Most words of any gapless alignment with enough equal words, by trying every segment."""
    a, b = d.tokens(text), d.tokens(item)
    best = 0
    for s in range(-len(b), len(a)):
        eq = [a[s + i] == b[i] for i in range(max(0, -s), min(len(b), len(a) - s))]
        for i in range(len(eq)):
            for j in range(i + 1, len(eq) + 1):
                n = sum(eq[i:j])
                if n >= d.needed(len(b)) and n >= d.SIMILARITY * (j - i) - 1e-9:
                    best = max(best, n)
    return best


def test_against_brute_force(spark):
    items = [(i, " ".join(words(n))) for i, n in enumerate((5, 7, 12, 30, 40, 4, 1))] + [(9, None), (7, ""), (8, "same " * 20)]
    docs = []
    for i in range(60):
        _, text = items[rng.choice((0, 1, 2, 3, 4, 5))]
        part = text.split()
        if len(part) > 12:
            for _ in range(i % 8):
                part[rng.randrange(len(part))] = "other"
        at = rng.randrange(max(1, len(part) - 12)) if i % 3 == 0 else 0
        docs.append((i, " ".join(words(20) + [w.upper() + "," for w in part[at:]] + words(15))))
    docs += [(100, None), (101, ""), (102, " ".join(words(200))), (103, "same " * 9), (104, "same " * 400), (3, docs[3][1])]
    got = d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEM)).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    for doc, text in docs:
        for item, other in items:
            want = plain(text, other) if other and doc != 104 else 0
            if (doc, item) == (104, 8):
                continue
            assert ((doc, item) in found) == bool(want), (doc, item, want)
    assert found[104, 8].equal == 20 and len([r for r in got if r.doc_id == 3]) == 2
    assert all(r.similarity >= d.SIMILARITY and r.words >= r.equal for r in got)


def test_blocks_and_empty_tables(spark):
    items = spark.createDataFrame([(i, " ".join(words(15))) for i in range(6)], ITEM)
    docs = spark.createDataFrame([(r.item_id, f"x {r.text} y") for r in items.collect()], DOCS + "")
    got = d.contaminated(docs.selectExpr("*", "1 AS id", "2 AS item"), items, block_words=20)
    assert sorted((r.doc_id, r.item_id, r.start, r.equal) for r in got.collect()) == [(i, i, 1, 15) for i in range(6)]
    assert d.contaminated(docs, items.limit(0)).count() == d.contaminated(docs.limit(0), items).count() == 0


def changed(part, errors):
    part = list(part)
    for at in rng.sample(range(len(part)), errors):
        part[at] = "other"
    return part


def test_exact_mode_misses_nothing_and_spaced_seeds_little():
    missed, asked = {}, {}
    for n in (1, 2, 4, 5, 6, 8, 10, 12, 13, 16, 20, 30, 60):
        for errors in {0, n // 10, n - max(d.needed(n), -(-4 * n // 5))}:
            for _ in range(40):
                item = words(n)
                text = " ".join(words(9) + changed(item, errors) + words(9))
                if not plain(text, " ".join(item)):
                    continue
                assert d.Index([(1, " ".join(item))], exact=True).find(text), (n, errors)
                key = "short" if n <= d.SHORT_ITEM else "long"
                asked[key] = asked.get(key, 0) + 1
                missed[key] = missed.get(key, 0) + (not d.Index([(1, " ".join(item))]).find(text))
    assert missed["short"] == 0 and asked["short"] > 500 and missed["long"] <= 0.03 * asked["long"]


def test_very_long_texts_that_repeat_words():
    index = d.Index([(1, "same " * 300), (2, " ".join(words(30)))])
    found = {i: n for i, _, n, _, _ in index.find("x " + "same " * 60_000)}
    assert found == {1: 300}


def test_windows_that_no_item_has_are_not_searched_for(monkeypatch):
    pool = words(300)
    items = [(i, " ".join(rng.choices(pool, k=n))) for i, n in enumerate([40] * 30 + [3, 5, 8, 12])]
    texts = [" ".join(rng.choices(pool, k=3000)) for _ in range(3)]
    texts += [f"{texts[0]} {items[k][1]} new {texts[1]}" for k in (0, 7, 30, 33)] + ["", None, "new", *(t for _, t in items)]
    for exact in (False, True):
        index, plain = d.Index(items, exact), d.Index(items, exact)
        plain.flags = [np.ones(1, bool) for _ in plain.tables]  # all pass
        want = [plain.find(t) for t in texts]
        searched, search = [], np.searchsorted
        with monkeypatch.context() as m:
            m.setattr(d.np, "searchsorted", lambda a, v, *x: (searched.append(np.size(v)), search(a, v, *x))[1])
            for t in texts[:3]:
                index.find(t)
            # before, each of about 3000 windows of a text was searched for twice under each mask
            assert sum(searched) < 0.5 * 2 * 3 * 3000 * len(index.masks)
        assert [index.find(t) for t in texts] == want and any(want)
