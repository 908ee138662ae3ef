"""Personal data: base spans against the plain expressions, added spans on planted texts."""

import hashlib
import re
import time
from collections import Counter

import numpy as np

from chunkmill.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip('0')) <= 3 and int(p.lstrip('0') or 0) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_row(doc_id, text):
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
    written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (doc_id, *[sum(s[0] == k for s in spans) for k in PATTERNS], hashlib.sha256(written.encode()).hexdigest(), written)


def order(row):
    return tuple((x is not None, x) for x in row)


def test_base_spans(spark, odd_docs, sample, no_docs):
    more = spark.createDataFrame([(7, "a@b a@@b.c @d.e f@g.h@i.j ..@-.- k@l..m x+y%z@q.r.s"), (8, "1.2.3.4.5.6.7.8 0001.1.1.1 1.1.1.0256"), (9, "4111-1111 1111 1111-  +1 (2) 3.4-5 6 7 8 9 +12"), (10, "9" * 5000), (11, "1.2.3." + "0" * 5000), (12, "1.2.3.4.5.6.7 1.2.3.4.5.6.7.8.9 .1.2.3.4. 1..2.3.4.5"), (13, "a@b.c@d.e.f a@-.- @x.y " + "w" * 300 + "@h.i")], "doc_id long, text string")
    for docs in (odd_docs, sample, more):
        want = sorted((base_row(r.doc_id, r.text) for r in docs.collect()), key=order)
        rows = pii.pii_report(spark, docs).collect()
        assert sorted(((*r[:6], ",".join(s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE)) for r in rows), key=order) == want
    assert pii.pii_report(spark, no_docs).collect() == []


def test_added_spans(spark):
    good = ["please call (030) 555 1234 today", "my ssn 123-45-6789 is here", "mail me at john dot", "write mail: jane (at) home (dot) org now", "Dear Mrs Anna Smith, hello"]
    bad = ["table 0000 000 0000 total", "order 000-00-0000 price", "version 12 345 678"]
    docs = spark.createDataFrame(list(enumerate((good + bad) * 20)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.pii_report(spark, docs).collect()}
    assert rows[1] == "identity:7:18" and rows[3].startswith("written_email:12:")
    assert all(rows[i] == "" for i in (5, 6, 7))


def test_long_runs_take_linear_time():
    for text in ("7" * 1_000_000, "+49 30 1234567 " * 70_000, "1.2.3.4 mail a@b.de " * 50_000, "x@" * 300_000, "a.b-c_" * 150_000 + " at " + "z" * 500_000, "Mr " * 300_000, "+" + "1 " * 400_000 + "x"):
        began = time.process_time()
        rows = pii.read_text(text, pii.GAZETTEERS)
        assert time.process_time() - began < 40 and len(rows) < 200_000
    words = "w" * 5000 + " at " + "h" * 4000 + " dot " + "d" * 3000
    assert pii.candidate_spans(words, []) == [(4, 0, len(words))]


def test_overlaps_against_all_pairs():
    text = "card 4111 1111 1111 1111 +49 30 123 4567 030 555 1234 mail jane at home dot org x@home.org Mr Tom@x.de Mrs Eva Lee 123-45-6789 " * 3
    base = pii.base_spans(text)
    every = pii.candidate_spans(text, [])
    assert pii.candidate_spans(text, base) == [(k, a, b) for k, a, b in every if not any(x < b and a < y for _, x, y in base)]


def test_classifier_learns_the_context(spark):
    """Equal votes, but words around that only the classifier sees."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        good = i % 2 == 0
        told = ("please call me today" if i % 4 == 0 else "reach us anytime") if good else ("table row 7" if i % 4 == 1 else "serial part code")
        rows.append((i, f"{told} 0{rng.integers(20, 99)} {rng.integers(100, 999)} {rng.integers(1000, 9999)} end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(spark, docs).collect()
    again = pii.detect(spark, docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    share = lambda k: np.mean([any(s.kind == 5 for s in r.spans) for r in found if r.doc_id % 4 == k])
    assert share(0) > 0.9 and share(1) < 0.1


def test_classifier_sums_against_brute_force(spark):
    docs = spark.createDataFrame([(i, f"Dear Mrs Anna Lee, call (030) 555 1{i % 10}34 or write a{i}@b.de") for i in range(30)], "doc_id long, text string")
    spans = [s for r in docs.collect() for s in pii.read_text(r.text, pii.GAZETTEERS)]
    rows = docs.selectExpr("doc_id AS id", "text AS body").mapInArrow(pii.finder(pii.GAZETTEERS), pii.FOUND)
    counts = Counter((s["kind"], s["votes"]) for s in spans)
    known = pii.posteriors([(k, v, n) for (k, v), n in counts.items()])
    sums = np.zeros((len(pii.KINDS), pii.FEATURES, 2))
    for s in spans:
        for at in s["places"]:
            sums[s["kind"], at] += known[s["kind"]][s["votes"]] / pii.WHOLE, 1
    model, want = pii.train(rows), pii.SpanClassifier(sums)
    assert np.allclose(model.weights, want.weights) and np.allclose(model.bias, want.bias) and (model.slope > 0).all()


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.85])
    vote = np.where(rng.random((4000, 6)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    vote[rng.random((4000, 6)) < 0.2] = 0
    patterns, n = np.unique(vote, axis=0, return_counts=True)
    found, p = pii.reliabilities(patterns, n.astype(float))
    assert np.abs(found - right).max() < 0.06
    own = {tuple(x): v for x, v in zip(patterns.tolist(), p)}
    assert np.mean([(own[tuple(v)] > 0.5) == t for v, t in zip(vote.tolist(), truth)]) > 0.93
