from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from sedimenta.llm import pii
from sedimenta.llm.spans import SPAN, crosses, matches, overlaps, redact, within

DOCS = "doc_id long, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def keep(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    found = {k: [(m.start(), i, m.end(), k) for m in re.finditer(p, text or "") if keep(k, m.group())] for i, (k, p) in enumerate(PATTERNS.items())}
    text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(sum(found.values(), [])))
    return [len(v) for v in found.values()], text


TEXTS = [
    None, "", "plain words only", "mail a.b@mail.example.com now", "x@y.z_d@e.f@g.h", "é\U0001f600 a@b.c +1 (017) 555-7713 end",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 and 000255.1.1.1 and 1.2.3", "4485275742308327 and 4485-2757 4230 8327, 1234 5678 9012 3456",
    "0" * 25, "0" * 12, "+12 34567 8901234567", "+1+2 (3) 4-5678 90", "9807915762804490@a.b-c.d", "call (212) 555-0199 or 555-44-3333 for item 12-34-5678",
    "write to joe (at) host (dot) com, Dr. Émile Zed and Dr Zed Young", "a" * 200_000 + "@b.c", "1.2.3.4 " * 3000, "+" * 5000 + "1 2", "@" * 100 + "a@b..c",
    ("9807915762804490 x@y.zz 10.0.0.1 +1 (017) 555-7713 " * 100) + "\n",
]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    got = pii.digest(pii.find_pii(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        counts, base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, r
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        own = [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS]
        assert ",".join(own) == base


def test_method_adds_candidates_and_never_touches_base(spark):
    text = "phone (212) 555-0199. mail joe (at) host (dot) com. From +1 (017) 555-7713 and 10.0.0.1, version 12-34-5678"
    docs = spark.createDataFrame([(i, text.replace("0199", f"{i:04}")) for i in range(50)], DOCS)
    spans = pii.digest(pii.find_pii(docs)).first().spans
    assert "number:6:20" in spans and "mailtext:" in spans
    assert spans.count("ip:") == 1 and spans.count("phone:") == 1


def test_em_recovers_reliable_labelers():
    patterns = [((1, 1, 0), 80), ((-1, -1, 0), 100), ((1, -1, 1), 5), ((-1, 1, 1), 5), ((0, 0, 1), 10)]
    prior, rel, post = pii.expectation_maximisation(patterns)
    assert 0.3 < prior < 0.6 and post[1, 1, 0] > 0.9 > 0.1 > post[-1, -1, 0]
    assert rel[0][1, 1] > rel[0][1, 0]


def test_redaction_empty_tables_and_clashing_names(spark):
    schema = "doc_id long, text string, row string, base int, found int"
    docs = spark.createDataFrame([(1, "at 10.0.0.1, é a@b.c!", "r", 1, 2), (2, None, None, None, None), (3, "none", "r", 1, 2)], schema)
    got = {r.doc_id: r for r in pii.redact_pii(docs).collect()}
    assert got[1].text == "at <IP>, é <EMAIL>!" and got[2].text is None and got[3].text == "none"
    assert got[1].row == "r" and pii.redact_pii(docs).columns == docs.columns
    assert pii.digest(pii.find_pii(docs.limit(0))).count() == 0


def test_many_matches(spark):
    text = "1.2.3.4 é " * 2000
    df = spark.createDataFrame([(text,)], "text string").select(matches(F.col("text"), pii.IP).alias("m"))
    assert [x.start for x in df.first().m] == [m.start() for m in re.finditer(PATTERNS["ip"], text)]


def test_a_long_text_dense_in_spans(spark):
    unit = "é x@y.zz 10.0.0.1 +1 (017) 555-7713 call (212) 555-0199, "
    text = unit * 5000  # 20 000 spans in 285 000 code points
    docs = spark.createDataFrame([(1, text)], DOCS)
    began = time.time()
    row = pii.digest(pii.find_pii(docs)).first()
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [5000, 5000, 0, 5000]
    counts, base = plain(text)
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    clean = pii.redact_pii(docs).first().text
    want = text
    for kind, a, b in reversed([s.split(":") for s in row.spans.split(",")]):
        want = want[: int(a)] + f"<{kind.upper()}>" + want[int(b) :]
    assert clean == want and "@" not in clean
    assert time.time() - began < 60


def test_overlaps_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        edges = sorted(rng.sample(range(200), 2 * rng.randrange(0, 12)))
        found = [(a, 0, b, "k") for a, b in zip(edges[::2], edges[1::2], strict=True)]
        start = rng.randrange(0, 199)
        rows.append((found, start, rng.randrange(start + 1, 201)))
    df = spark.createDataFrame(rows, f"found array<{SPAN}>, a int, b int")
    ask = [f(F.col("found"), F.col("a"), F.col("b")).alias(f.__name__) for f in (overlaps, crosses, within)]
    for r in df.select("*", *ask).collect():
        spans = [(s.start, s.end) for s in r.found]
        assert r.overlaps == any(s < r.b and r.a < e for s, e in spans)
        assert r.within == any(s <= r.a and r.b <= e for s, e in spans)
        assert r.crosses == any(s < r.b and r.a < e and not (r.a <= s and e <= r.b) for s, e in spans)


def test_redaction_of_overlapping_spans_against_brute_force(spark):
    rng, rows = random.Random(4), []
    for n in (0, 1, 5, 40, 400):
        text = "".join(rng.choices("aé\U0001f600 \n", k=rng.choice([3000, 1024, 1025])))
        found = [(a, 0, min(len(text), a + rng.randrange(1, 30)), "k") for a in rng.choices(range(len(text)), k=n)]
        rows.append((text, found))
    got = spark.createDataFrame(rows, f"text string, found array<{SPAN}>").select("text", "found", redact(F.col("text"), F.col("found")).alias("out")).collect()
    for r in got:
        at, out = 0, ""
        for s in sorted(r.found):
            if s.start >= at:
                out += r.text[at : s.start] + "<K>"
            at = max(at, s.end)
        assert r.out == out + r.text[at:]
