"""Byte shards against a plain running sum; edges; file order."""

import zlib

import pytest

from plyforge.llm import sharding
from plyforge.llm.common import materialize
from tests.conftest import SF


def brute(sizes, shards=8):
    total, before, out, slots = sum(sizes), 0, [], {}
    for s in sizes:
        k = (2 * before + s) * shards // (2 * total)
        out.append((k, slots.setdefault(k, 0)))
        slots[k] += 1
        before += s
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    docs = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in sharding.op2_byte_prefix_shards(spark, d).collect()}
    data = [t.encode() for _, t in docs]
    for (doc, _), b, (k, slot) in zip(docs, data, brute([len(b) + 1 for b in data])):
        r = got.pop(doc)
        assert (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", k, slot, None)
    assert not got


def test_edges(spark):
    rows = [(3, None), (1, ""), (2, "é" * 50_000), (2, "é" * 50_000), (None, "x"), (5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard", "3 as part", "4 as tie")
    got = sharding._result(sharding._slim(docs), ["doc_id", "text_crc32", "size"]).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    assert sharding._result(sharding._slim(docs.limit(0)), ["doc_id", "text_crc32", "size"]).count() == 0


def test_stage_follows_file_order(spark):
    docs = spark.createDataFrame([(i, "abc" * 10, "en", f"s{i % 3}", 30) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    turned = materialize(docs.repartitionByRange(5, (-docs.doc_id)).sortWithinPartitions(-docs.doc_id), "turned")
    got = sorted(sharding.shard_stage(spark, turned, SF).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == list(range(399, -1, -1))
    assert [r.doc_id for r in sorted(sharding.shard_stage(spark, docs, SF).collect(), key=lambda r: (r.shard, r.slot))] == list(range(400))
