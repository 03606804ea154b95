"""Pfair mixing: windows and deviations of the schedule, positions against a plain run, edges, the stage's order."""

import random

import pytest

from plyforge.llm import mixing
from plyforge.llm.common import materialize
from tests.conftest import SF


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_within_one_block(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.random() ** 3 + 1e-6 for i in range(rng.randint(1, 40))}
    counts = mixing.blocks_in_cycle(weights, rng.choice([16, 100, 1024]))
    slots = mixing.pfair(counts)
    q = len(slots)
    assert sum(counts.values()) == q and all(c > 0 for c in counts.values())
    done = dict.fromkeys(counts, 0)
    for t, (s, k) in enumerate(slots * 2):
        c = counts[s]
        if t < q:
            assert k * q // c <= t < -(-(k + 1) * q // c)  # the block's window
            assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * counts[x] / q) < 1 for x in counts)


def test_query_places_every_row_once(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = mixing.op4_pfair_mix(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and sorted(r.position for r in rows) == list(range(len(rows)))
    by_slot = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in by_slot] == sorted(r.slot for r in rows)
    for r in rows:
        assert r.source == docs[r.doc_id].source and r["size"] == len(docs[r.doc_id].text.encode()) + 1


def test_small_blocks_equal_a_plain_run(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 60), "a" if i % 3 else "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 1.0, "b": 3.0}
    got = sorted(mixing.mix(docs, weights, block_bytes=200, cycle=8).collect(), key=lambda r: r.position)
    counts = mixing.blocks_in_cycle(weights, 8)
    place = {(s, k): t for t, (s, k) in enumerate(mixing.pfair(counts))}
    q = sum(counts.values())
    at = dict.fromkeys(counts, 0)
    for r in got:  # in a source, positions follow its blocks
        assert r.block == at[r.source] // 200
        assert r.slot == r.block // counts[r.source] * q + place[r.source, r.block % counts[r.source]]
        at[r.source] += r["size"]
    both = min(max(r.slot for r in got if r.source == s) for s in "ab")
    assert all(r.on_target == (r.slot <= both) for r in got)
    blocks = {s: {r.block for r in got if r.source == s and r.slot <= both} for s in "ab"}
    assert abs(len(blocks["b"]) / (both + 1) - 0.75) <= 1 / (both + 1) + 0.02


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "t", ""), (2, "z" * 300_000, "s"), (3, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as position", "2 as block", "3 as cell", "4 as h")
    got = mixing.mix(docs).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3, 4] and {r.source for r in got} == {"", "s"}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, {}).count() == 5


def plain_mix(rows, order, weights, block_bytes, cycle):
    """{row index: (block, slot, position)}: blocks of each source's rows in the given order, slots chosen one by one."""
    counts = mixing.blocks_in_cycle(weights, cycle)
    q = sum(counts.values())
    blocks, ends = {}, dict.fromkeys(counts, 0)
    for i in order:
        _, text, source = rows[i]
        blocks.setdefault((source, ends[source] // block_bytes), []).append(i)
        ends[source] += len((text or "").encode()) + 1
    slot_of = {}
    done = dict.fromkeys(counts, 0)
    for t in range(q):  # of the released blocks that are left, the one due first
        free = [(-(-(done[s] + 1) * q // c), s) for s, c in counts.items() if done[s] < c and done[s] * q // c <= t]
        _, s = min(free)
        slot_of[s, done[s]] = t
        done[s] += 1
    at = {b: b[1] // counts[b[0]] * q + slot_of[b[0], b[1] % counts[b[0]]] for b in blocks}
    out, position = {}, 0
    for b in sorted(blocks, key=at.get):
        for i in blocks[b]:
            out[i] = (b[1], at[b], position)
            position += 1
    return out


@pytest.mark.parametrize("n_sources", [1, 3, 30])
def test_positions_equal_a_plain_scheduler(spark, monkeypatch, n_sources):
    monkeypatch.setattr(mixing, "CELL_ROWS", 20)
    rng = random.Random(n_sources)
    rows = [(i, "x" * rng.randint(0, 90), f"s{int(rng.random() ** 2 * n_sources)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {f"s{k}": rng.random() + 0.01 for k in range(n_sources)}
    got = {r.doc_id: (r.block, r.slot, r.position) for r in mixing.mix(docs, weights, block_bytes=150, cycle=16).collect()}
    # The order inside a source: cells by the hash of id and text, then that hash.
    h = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) as h").collect()}
    per = {s: sum(r[2] == s for r in rows) for _, _, s in rows}
    order = sorted(h, key=lambda i: (h[i] % -(-per[rows[i][2]] // 20), h[i]))
    present = {s: weights[s] for s in per}
    assert got == plain_mix(rows, order, present, 150, 16)


def test_every_source_has_its_own_weight(spark):
    """Thousands of sources: none shares a weight, none is late or early by a block."""
    n = 3000
    weights = {f"s{k:05d}": 1.0 + k % 7 for k in range(n)}
    docs = spark.range(n * 3).selectExpr("id as doc_id", "'four' as text", f"format_string('s%05d', id % {n}) as source")
    got = mixing.mix(docs, weights, block_bytes=1).collect()
    assert sorted(r.position for r in got) == list(range(3 * n)) and len({r.source for r in got}) == n
    counts = mixing.blocks_in_cycle(weights)
    q = sum(counts.values())
    assert len(set(counts.values())) > 3
    assert all(abs(counts[s] - w / sum(weights.values()) * q) <= 1 for s, w in weights.items())
    for r in got:
        c = counts[r.source]
        k = r.block % c
        assert k * q // c <= r.slot % q < -(-(k + 1) * q // c)


def test_a_row_repeated_many_times(spark):
    docs = spark.range(20_000).selectExpr("7L as doc_id", "'same' as text", "'a' as source").unionByName(spark.createDataFrame([(1, "x", "b")], "doc_id long, text string, source string"))
    got = mixing.mix(docs, block_bytes=1000).collect()
    assert sorted(r.position for r in got) == list(range(20_001))


def test_stage_writes_rows_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionAll(docs.limit(3))
    out = materialize(mixing.mix_stage(spark, docs, SF), "mixed")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())
    place = {}
    for r in mixing.mix(docs).collect():
        place[r.doc_id] = min(r.position, place.get(r.doc_id, 1 << 60))
    order = [place[r.doc_id] for r in out.selectExpr("doc_id", "_metadata.file_name as f", "_metadata.row_index as i").orderBy("f", "i").collect()]
    assert order == sorted(order)


def test_counts_of_many_sources():
    """A fifth of them over the floor by little: giving blocks back is no search of all sources for each block."""
    rng = random.Random(3)
    weights = {f"h{i:06d}": rng.random() ** 4 + 1e-4 for i in range(50_000)}
    counts = mixing.blocks_in_cycle(weights)
    total = sum(weights.values())
    assert sum(counts.values()) == 200_000 and min(counts.values()) == 1
    assert all(c <= weights[s] / total * 200_000 + 1 for s, c in counts.items() if c > 1)
    slots = mixing.pfair(counts)
    at = dict.fromkeys(counts, 0)
    for t, (s, k) in enumerate(slots):
        assert k == at[s] and k * 200_000 // counts[s] <= t < -(-(k + 1) * 200_000 // counts[s])
        at[s] += 1
