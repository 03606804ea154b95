"""SimHash operator against brute force and on edge cases."""

import numpy as np
import pytest
import xxhash

from plyforge.llm import simhash
from tests.conftest import SF


def plain(text):
    words = []
    for ch in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words.append("")
        else:
            words = words or [""]
            words[-1] += ch
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted((str(d), f"{f:016x}", str(least.get(c))) for (d, _), f, c in zip(rows, fps, comp))


def ours(df):
    return sorted((str(r[0]), f"{r[1] & (1 << 64) - 1:016x}", str(r[2])) for r in simhash.near_duplicates(df).collect())


def test_fixture_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert ours(docs) == brute([tuple(r) for r in docs.collect()])
    got = simhash.op3_simhash_neardup(spark, SF).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute([tuple(r) for r in docs.collect()])


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, " \n\t"), (1, "One"), (2, "oNE"), (7, "a b"), (None, "a b"), (None, None), (9, "İ Ünï x\x1cy a"), (9, "İ Ünï x\x1cy a"), (11, "w " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(docs) == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    wide = docs.selectExpr("doc_id", "text", "text as fp", "doc_id as component_id", "1 as a", "2 as cell")
    assert ours(wide) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_bits(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = set(base.tolist())
    for k in range(1, 6):
        for b in base[:100]:
            fps.add(int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {frozenset((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)) for r in simhash.linked_pairs(df).collect()}
    want = {frozenset((x, y)) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= 3}
    assert got == want


def components_of(fps):
    """{fingerprint: least fingerprint that links reach}, by comparing all."""
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                a, b = sorted((top(x), top(y)))
                root[b] = a
    return {f: top(f) for f in fps}


@pytest.mark.parametrize("rows", [4096, 7])
def test_forest_connects_what_all_links_connect(spark, monkeypatch, rows):
    """Few links: a group of n gives n - 1 at most in a cell; cells that are dealt in blocks lose none."""
    from plyforge.llm import common

    monkeypatch.setattr(common, "CELL_ROWS", rows)
    rng = np.random.default_rng(3)
    base = [int(b) for b in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    fps = set(base) | {base[0] ^ 1 << k for k in range(64)}
    for k in (1, 2, 3, 4, 6):
        for b in base[1:]:
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.linked_forest(df).collect()]
    assert all(x != y and (x ^ y).bit_count() <= 3 for x, y in links)
    want, got = components_of(fps), {f: f for f in fps}
    for _ in fps:
        for x, y in links:
            got[x] = got[y] = min(got[x], got[y])
    assert got == want
    if rows > 64:
        hub = spark.createDataFrame([((base[0] ^ 1 << k) - (1 << 64 if (base[0] ^ 1 << k) >> 63 else 0),) for k in range(64)], "fp long")
        assert simhash.linked_forest(hub).distinct().count() <= 2 * 63 and simhash.linked_pairs(hub).count() >= 64 * 63 // 2


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (2, 5000), dtype=np.uint64)
    b[:2500] = a[:2500] ^ (np.uint64(1) << rng.integers(0, 64, 2500, dtype=np.uint64))
    counts = [np.array([[(int(x) >> s & 3).bit_count() for s in range(0, 64, 2)] for x in v]) for v in (a, b)]
    got = np.bitwise_count(simhash.unary(a) ^ simhash.unary(b))
    assert (got == np.abs(counts[0] - counts[1]).sum(1)).all() and (got <= np.bitwise_count(a ^ b)).all()


def test_stage_tells_rows_with_one_id_apart(spark):
    t, u, v, w = ("".join(f"{c}{i} " for i in range(30)) for c in "tuvw")
    rows = [(1, t), (3, t), (3, u), (5, v), (5, w), (5, w), (6, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as first", "3 as stays", "4 as fp")
    got = simhash.keep_one(spark, docs, SF)
    assert got.columns == docs.columns and sorted((r.doc_id, str(r.text)) for r in got.collect()) == [(1, t), (3, u), (5, v), (5, w), (6, "None")]


def test_stage_keeps_one(spark):
    rows = [(1, "x y z"), (2, "X y z"), (3, "other words here"), (3, "other words here"), (None, "x y z")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.keep_one(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_pieces_change_nothing(monkeypatch):
    from plyforge.llm import common

    texts = ["", "a", "a b", " a b c", "x " * 50 + "yy\x1c\tz", "long" * 40 + " w" * 9, "İ é " * 30]
    want = [simhash.fingerprint(t) for t in texts]
    assert want == [plain(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        assert [simhash.fingerprint(t) for t in texts] == want
