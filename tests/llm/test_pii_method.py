"""Personal data: the query's added spans against exact marginals, planted forms and mentions, bounds of tokens and batches."""

import itertools
import random

import numpy as np
import pytest

from plyforge.llm import pii
from tests.conftest import SF


def enumerated(graph, model, known):
    """P(label) of each node by adding up all labellings of its connected part; None for nodes of parts over six nodes."""
    n, k = len(graph.doc), 1 + len(pii.KINDS)
    near = {i: [] for i in range(n)}
    for (a, b), kind in zip(graph.edges.tolist(), graph.kinds.tolist()):
        near[a].append((b, kind))
        near[b].append((a, kind))
    emit, pair = np.array(model["emit"]), np.array(model["pair"])
    score = [[float(emit[y] @ graph.x[i]) for y in range(k)] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        part, todo = [], [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                part.append(x)
                todo += [y for y, _ in near[x]]
        if not part or len(part) > 6:
            continue
        total = {x: np.zeros(k) for x in part}
        choices = [[known[x]] if known[x] else range(k) for x in part]
        for ys in itertools.product(*choices):
            y = dict(zip(part, ys))
            w = sum(0 if known[x] else score[x][y[x]] for x in part) + sum(pair[kind, y[a], y[b]] for a in part for b, kind in near[a] if a < b)
            for x in part:
                total[x][y[x]] += np.exp(w)
        for x in part:
            out[x] = total[x] / total[x].sum()
    return out


@pytest.fixture(scope="module")
def learned(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_the_querys_spans_equal_exact_marginals(spark, monkeypatch):
    """All documents whose connected parts have six nodes at most: the decision with enumerated marginals is the query's."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    compared = 0
    for r in pii.op6_skip_chain_pii(spark, SF).collect():
        text = docs[r.doc_id]
        base = pii.base_spans(text)
        exact = enumerated(graph := pii.Graph([text]), model, pii.labels_of(graph, [base]))
        if all(p is not None for p in exact):
            with monkeypatch.context() as m:
                m.setattr(pii, "infer", lambda *_, exact=exact: np.array(exact).reshape(-1, 5))
                more = pii.added_spans([text], [base], model)[0]
            assert r.spans == pii.joined(pii.ordered(base + more)) and r.n_added == len(more)
            compared += 1
    assert compared > 0.95 * len(docs)


def test_small_texts_decided_by_exact_marginals(learned, monkeypatch):
    """Texts dense with loops, where messages are an approximation: nearly all decisions are those of enumerated marginals."""
    rng = random.Random(6)
    words = ["+1", "(988)", "555-2485", "988-555-2485", "4845168114407329", "4845.1681.1440.7329", "10.0.0.7", "10-0-0-7", "a@b.cc", "a@b", "2020", "v2,", "so", "on", "and"]
    equal, texts, added = 0, 0, 0
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(9))
        base = pii.base_spans(text)
        exact = enumerated(graph := pii.Graph([text]), learned, pii.labels_of(graph, [base]))
        if any(p is None for p in exact):
            continue
        got = pii.added_spans([text], [base], learned)[0]
        with monkeypatch.context() as m:
            m.setattr(pii, "infer", lambda *_, exact=exact: np.array(exact).reshape(-1, 5))
            equal += got == pii.added_spans([text], [base], learned)[0]
        texts, added = texts + 1, added + len(got)
    assert texts > 60 and added > 30 and equal > 0.95 * texts


def test_planted_forms_and_mentions_are_found(spark):
    """Fitted on one half of the documents, held against rewritten copies of the other half."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text and pii.NODE.search(r.text)]
    model = pii.fit([t[: pii.SAMPLE_CHARS] for t in texts[::2]])
    rng = random.Random(77)
    hit = miss = wrong = clean = 0
    for t in texts[1::2]:
        base = pii.base_spans(t)
        clean += len(pii.added_spans([t], [base], model)[0])
        if not base:
            continue
        copy, known = pii.rewritten(t, base, rng)
        patterns = pii.base_spans(copy)
        hidden = [x for x in known if not any(a < x[2] and x[1] < b for _, a, b in patterns)]
        got = pii.added_spans([copy], [patterns], model)[0]
        meets = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        hit += sum(any(meets(x, y) for y in got) for x in hidden)
        miss += sum(not any(meets(x, y) for y in got) for x in hidden)
        wrong += sum(not any(meets(x, y) for y in hidden) for x in got)
    assert hit + miss > 150 and hit > 0.9 * (hit + miss) and wrong < 0.1 * hit
    assert clean < 0.02 * len(texts)


def test_long_tokens_count_whole():
    a, b = "7" * 300 + "1" * 9, "7" * 300 + "2" * 9
    x, y = "q7" * 200 + "u", "q7" * 200 + "v"
    graph = pii.Graph([f"{a} so {b} so {a} so {x} so {y} so {x}"])
    assert sorted(map(tuple, graph.edges.tolist())) == [(0, 2), (3, 5)]


def test_labels_are_those_of_the_spans_that_nodes_overlap():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choice(["12", "a1", "so", "9-9"]) for _ in range(12))
        spans = [(rng.choice(pii.KINDS), a, a + rng.randint(1, 6)) for a in [rng.randrange(len(text)) for _ in range(3)]]
        graph = pii.Graph([text, None, text])
        want = [0] * len(graph.doc)
        for i, (d, (s, e)) in enumerate(zip(graph.doc.tolist(), graph.span.tolist())):
            for kind, a, b in [spans, [], spans[:1]][d]:
                if a < e and s < b:
                    want[i] = 1 + pii.KINDS.index(kind)
        assert pii.labels_of(graph, [spans, [], spans[:1]]).tolist() == want


def test_batches_of_texts_and_edges_change_nothing(spark, learned, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0")
    want = sorted(map(tuple, pii.find(docs, learned).collect()))
    monkeypatch.setattr(pii, "TOGETHER", 3000)
    monkeypatch.setattr(pii, "EDGES", 3)
    assert sorted(map(tuple, pii.find(docs, learned).collect())) == want
    many = "1.5 " * 60_000  # a log-like text of numbers
    spans = [pii.base_spans(many)]
    monkeypatch.setattr(pii, "EDGES", 1 << 16)
    assert len(pii.added_spans([many], spans, learned)) == 1
