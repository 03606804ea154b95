"""Separator scan: an exact round trip through flat files, block sizes, open ends, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.llm import tokenscan as ts
from tests.conftest import SF


@pytest.mark.parametrize("block", [2, 3, 6, 64, 1 << 20])
def test_scan_of_hand_made_files(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    sep, want = 9, set()
    files = {"a": [9], "b": [1, 2, 9, 9, 3, 4, 5], "c": [], "d": [7], "e": rng.integers(0, 12, 500).tolist(), "f": [1] * 100 + [9], "g": [9, 9, 9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        number, start = 0, 0
        for i, t in enumerate([*ids, None]):
            if t == sep or (t is None and start < len(ids)):
                want.add((name, number, start, i - start))
                number, start = number + 1, i + 1
    names = spark.createDataFrame([(n,) for n in files] + [("a",)], "file string")
    got = {tuple(r) for r in ts.scan(names, f"file://{tmp_path}", sep, block).select("file", "number", "start", "n_tokens").collect()}
    assert got == want


def test_round_trip(spark):
    encode = ts.encoder(ts.VOCABULARY)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = ts.op8_separator_scan_tokens(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {d: len(encode(t)) for d, t in docs.items()} and len(got) == len(docs)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "hello"), (3, "word " * 20_000), (4, "<|endoftext|>"), (4, "é\x00"), (4, "é\x00")]
    encode = ts.encoder(ts.VOCABULARY)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as file", "2 as number", "3 as start")
    got = ts.count_tokens(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), len(encode(t or ""))) for d, t in rows)
    assert ts.count_tokens(docs.where(F.lit(False))).count() == 0


def test_parts_change_no_id(monkeypatch):
    encode = ts.encoder(ts.VOCABULARY)
    monkeypatch.setattr(ts, "TOGETHER", 20)
    for text in ("plain words go on and on " * 9, "x" * 500, "a  b\n\n c d e f g h i j k l m n o p q r s t", "1 2 3 é à ü " * 20, ""):
        assert [i for p in ts.parts(text) for i in encode(p)] == encode(text)


def test_vocabularies_that_do_not_fit(tmp_path):
    import base64

    path = tmp_path / "v"
    for ids in ([0, 1 << 16], [0, ts.SEPARATOR]):
        path.write_bytes(b"\n".join(base64.b64encode(bytes([65 + i])) + b" %d" % n for i, n in enumerate(ids)))
        with pytest.raises(ValueError, match="65,536"):
            ts.ranks_of(str(path))


def test_the_prefix_scan_carries_totals_only(spark, tmp_path):
    """No window of the plan holds the separators' places."""
    import re

    (tmp_path / "a").write_bytes(np.array([1, 9, 2] * 50, "<u2").tobytes())
    plan = ts.scan(spark.createDataFrame([("a",)], "file string"), f"file://{tmp_path}", 9, 16)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if re.search(r"Window \[", line)]
    assert windows and not any("ends" in line for line in windows)
