from __future__ import annotations

import random
from itertools import combinations

from sedimenta.llm import licenses as lic

DOCS = "doc_id long, text string"
rng = random.Random(4)


def prose(n):
    return " ".join("".join(rng.choices("aeioubst", k=5)) for _ in range(n))


def longest_increasing(values):
    return max((len(c) for n in range(len(values) + 1) for c in combinations(values, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)


def test_patience_piles_give_the_longest_increasing_subsequence():
    for _ in range(50):
        b = rng.sample(range(10), 8)
        chain = lic._increasing(list(enumerate(b)))
        assert len(chain) == longest_increasing(b) and all(x < y and p < q for (x, p), (y, q) in zip(chain, chain[1:]))


def test_gaps_are_aligned_again():
    template = "a x b x c y d".split()
    assert lic.align("a x b x c y d".split(), template) == [(i, i) for i in range(7)]
    pairs = lic.align("q a x z b x c w y d q".split(), template)
    assert [t for _, t in pairs] == list(range(7))


def test_against_planted_notices(spark):
    rows, want = [], set()
    for i, (name, text) in enumerate(lic.TEMPLATES.items()):
        for j in range(3):
            doc = 10 * i + j
            words = text.split()
            if j == 1 and len(words) > 12:
                words[5] = "changed"
            if j == 2:
                words = [w.upper() for w in words]
            rows.append((doc, f"{prose(60)} {' '.join(words)}\n{prose(40)}"))
            want.add((doc, name))
    clean = [(1000 + i, prose(300)) for i in range(20)] + [(2000, None), (2001, ""), (2002, "all rights"), (2003, "license " * 5000), (2004, "version 2.0 of the license, apache under licensed the")]
    got = lic.scan_licenses(spark.createDataFrame(rows + clean, DOCS)).collect()
    assert want <= {(r.doc_id, r.license) for r in got}
    assert not [r for r in got if r.doc_id >= 1000]
    own = {(r.doc_id, r.license): r for r in got}
    assert own[0, "Apache-2.0-notice"].start == 60 and own[0, "Apache-2.0-notice"].aligned == 7


def test_repeated_notices_empty_table_and_clashes(spark):
    notice = lic.TEMPLATES["MIT-notice"]
    text = f"{prose(5)} {notice} {prose(2)} {notice} {prose(30)} {notice}"
    docs = spark.createDataFrame([(1, text), (1, text)], DOCS).selectExpr("*", "1 AS id", "2 AS license")
    got = [r.start for r in lic.scan_licenses(docs).collect() if r.license == "MIT-notice"]
    assert sorted(got) == [5, 5, 12, 12, 47, 47]
    assert lic.scan_licenses(docs.limit(0)).count() == 0


def test_the_template_with_more_aligned_words_wins():
    scanner = lic.Scanner(lic.TEMPLATES, lic.COVERAGE)
    assert [r[0] for r in scanner.scan("x Licensed under CC BY-NC 4.0. y")] == ["CC-BY-NC-4.0"]
    assert [r[0] for r in scanner.scan("x Licensed under CC BY 4.0. y")] == ["CC-BY-4.0"]
    assert [r[0] for r in scanner.scan(lic.TEMPLATES["Apache-2.0-header"])] == ["Apache-2.0-header"]
    both = scanner.scan(f"{lic.TEMPLATES['MIT-notice']} All rights reserved. {lic.TEMPLATES['CC-BY-4.0']}")
    assert [r[0] for r in both] == ["MIT-notice", "all-rights-reserved", "CC-BY-4.0"]


def test_notices_on_consecutive_lines_are_all_reported():
    scanner = lic.Scanner(lic.TEMPLATES, lic.COVERAGE)
    for name in ("all-rights-reserved", "MIT-notice", "CC-BY-4.0", "GPL-header"):
        size = len(lic.tokens(lic.TEMPLATES[name]))
        for n in (2, 3, 4, 7):
            got = scanner.scan(" ".join(["x x", *[lic.TEMPLATES[name]] * n, "x x x"]))
            assert [(r[0], r[2], r[3]) for r in got] == [(name, 2 + k * size, 2 + (k + 1) * size) for k in range(n)]
