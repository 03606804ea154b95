"""Line dedup: the join against all pairs, the edit distance against a plain table, edges."""

import random

import pytest

from plyforge.llm import linededup as ld
from tests.conftest import SF


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def edited(rng, text, n, letters="abcé "):
    t = list(text)
    for _ in range(n):
        k, r = rng.randint(0, len(t)), rng.random()
        if r < 0.33:
            t.insert(k, rng.choice(letters))
        elif t:
            k = min(k, len(t) - 1)
            t[k : k + 1] = [] if r < 0.66 else [rng.choice(letters)]
    return "".join(t)


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_edit_distance(most):
    rng = random.Random(most)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 7), "abc")
        assert ld.edit_distance(a, b, most) == min(distance(a, b), most + 1)
    assert ld.edit_distance("x" * 100_000 + "a", "x" * 100_000 + "b", most) == 1


def brute(docs):
    """(doc_id, n_lines, n_dropped, dropped, n_linked) by comparing all lines with each other."""
    lines = sorted((d if d is not None else -1, k, x) for d, t in docs for k, x in enumerate((t or "").split("\n")) if x.strip(ld.BLANK))
    texts = sorted({x for _, _, x in lines})
    root = {x: x for x in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            most = min(ld.MAX_EDITS, min(len(a), len(b)) // ld.CHARS_PER_EDIT)
            if most and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                root[top(a)] = top(b)
                linked |= {a, b}
    seen, out = {}, {d if d is not None else -1: [0, [], 0] for d, _ in docs}
    for d, k, x in lines:
        first = seen.setdefault(top(x), (d, k))
        out[d][0] += 1
        out[d][2] += x in linked
        if first != (d, k):
            out[d][1].append(k)
    return {(d, n, len(k), tuple(k), m) for d, (n, k, m) in out.items()}


def ours(df):
    return {(r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, tuple(r.dropped), r.n_linked) for r in ld.deduplicated(df).collect()}


def test_planted_lines(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefg é") for _ in range(rng.randint(7, 70))) for _ in range(60)]
    docs = [(d, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(0, 8)))) for d in range(80)]
    want = brute(docs)
    assert sum(m for *_, m in want) > 100
    assert ours(spark.createDataFrame(docs, "doc_id long, text string")) == want


def test_edges(spark):
    long = "z" * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (None, "a common line of words here"), (4, "a common line of words hare"), (5, "short\nshort\nshor"), (6, long + "a\n" + long + "b\n" + long), (7, "a common line of words here\r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as id", "3 as class")
    got = {r[0]: r[1:] for r in ours(df)}
    assert got[1] == got[2] == got[3] == (0, 0, (), 0)
    assert got[-1] == (1, 0, (), 1) and got[4] == (1, 1, (0,), 1) and got[7] == (1, 1, (0,), 1)
    assert got[5] == (3, 1, (1,), 0) and got[6] == (3, 2, (1, 2), 3)
    assert ld.deduplicated(df.limit(0)).count() == 0
    left = {r.doc_id: r.text for r in ld.without_dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[5] == "short\nshor" and left[4] == "" and left[None] == rows[3][1] and left[1] is None


def test_query_equals_brute_force_on_a_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id: r.n_lines for r in ld.op7_segment_edit_lines(spark, SF).collect()} == {
        r.doc_id: sum(1 for x in r.text.split("\n") if x.strip(ld.BLANK)) for r in docs.collect()
    }
    some = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 1500]
    assert ours(spark.createDataFrame(some, "doc_id long, text string")) == brute(some)


def substituted(base, n):
    """n different lines, each one substitution from base."""
    return [base[:k] + c + base[k + 1 :] for c in "0123456789" for k in range(len(base))][:n]


@pytest.mark.parametrize("n", [100, 400])
def test_links_grow_with_the_lines_of_a_group(spark, n):
    base = "the quick brown fox jumps over the lazy dog and goes on"
    lines = substituted(base, n)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(7)
    links = [tuple(r) for r in ld.near_lines(docs).collect()]
    root = {bytes(x): bytes(x) for x in ld.line_ids(lines)}
    for _ in lines:
        for a, b in links:
            root[bytes(a)] = root[bytes(b)] = min(root[bytes(a)], root[bytes(b)])
    assert len(set(root.values())) == 1
    assert len(links) <= 12 * n
    assert sum(r.n_dropped for r in ld.deduplicated(docs).collect()) == n - 1


def test_large_keys_are_dealt_in_blocks(spark, monkeypatch):
    """Cells of a few lines: all blocks together lose no link, long chains and far members included."""
    from plyforge.llm import common

    rng = random.Random(2)
    monkeypatch.setattr(common, "CELL_ROWS", 6)
    monkeypatch.setattr(ld, "VERIFIED", 3)
    head, lines = "a frequent beginning of many lines, ", []
    for _ in range(12):
        line = head + "".join(rng.choice("abcdefgh ") for _ in range(20))
        for _ in range(rng.randint(1, 9)):
            lines.append(line)
            line = edited(rng, line, rng.choice([1, 2, 2, 3]))
    docs = [(i, x) for i, x in enumerate(lines)]
    assert ours(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_lines_of_ten_to_nineteen_code_points_may_have_one_edit(spark):
    docs = [(1, "subscribe here!"), (2, "subscribe here."), (3, "subscribe hero?"), (4, "one edit"), (5, "one edi"), (6, "ten chars!"), (7, "ten chars")]
    assert ours(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
    got = {r.doc_id: r.n_linked for r in ld.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}


def test_short_lines_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randint(9, 22))) for _ in range(12)]
    docs = [(d, edited(rng, rng.choice(base), rng.choice([0, 1, 1, 2, 3]), "ab ")) for d in range(150)]
    assert ours(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
