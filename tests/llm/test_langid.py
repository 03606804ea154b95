"""Byte network: folded and plain evaluation agree, held-out accuracy, edges."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.llm import langid
from tests.conftest import SF


def plain_probabilities(par, text):
    data = text.encode()
    total, weight = 0, 0
    for at in range(0, len(data), langid.WINDOW):
        piece = data[at : at + langid.WINDOW + langid.TAPS - 1]
        part = min(langid.WINDOW, len(data) - at)
        piece = piece + bytes(langid.WINDOW + langid.TAPS - 1 - len(piece))
        e = par["embed"][list(piece)]
        act = np.array([sum(e[t + k] @ par["conv"][k] for k in range(langid.TAPS)) + par["bias"] for t in range(langid.WINDOW)])
        z = np.maximum(act.max(0), 0) @ par["dense"] + par["out"]
        p = np.exp(z - z.max())
        total, weight = total + part * p / p.sum(), weight + part
    return total / weight


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.train(docs, ~langid.held_out())


def test_folded_network_equals_plain(spark, learned):
    names, par = learned
    texts = ["the cat", "é", "Über " * 100, "a" * 256, "b" * 257, "x" * 3000 + "é"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), names, par).collect()
    for r in got:
        p = plain_probabilities(par, texts[r.doc_id])
        assert r.lang_pred == names[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-4)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = langid.op10_byte_cnn_language(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[r.doc_id].text))
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_edges(spark, learned):
    names, par = learned
    rows = [(1, None), (2, ""), (3, "123 !? _ ²½Ⅷ"), (None, "the and of"), (4, "the and of " * 200_000), (4, "the"), (4, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lang_pred", "2 as score")
    got = langid.identify(docs, names, par).collect()
    assert len(got) == len(rows) and {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert all(r.lang_pred in names for r in got if r.doc_id not in (1, 2, 3))
    assert langid.identify(docs.limit(0), names, par).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, [], None).collect()} == {"und"}
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert langid.train(empty, F.lit(True)) == ([], None)


def test_query_equals_the_plain_network(spark):
    """Every document of a small table: windows of the whole text through the network as written down, not folded."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, par = langid.train(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = langid.op10_byte_cnn_language(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        if re.search(r"[^\W\d_]", text) is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(text) < 6_000:
            p = plain_probabilities(par, text)
            assert r.score == pytest.approx(p.max(), abs=1e-4) and names[int(p.argmax())] == r.lang_pred


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"l{i % 250:03d}", chr(0x4E00 + i % 250) * 40) for i in range(1000)]
    names, par = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True))
    assert len(names) == 250 and par["dense"].shape[1] == 250


def test_sample_is_bounded_and_the_same_on_any_partitioning(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as lang", "concat(if(id % 3 = 0, 'ab ', 'xy '), id) as text")
    one, two = (langid.train(d, F.lit(True), 50) for d in (rows.coalesce(1), rows.repartition(9)))
    assert one[0] == two[0] == ["a", "b"] and all((one[1][k] == two[1][k]).all() for k in one[1])
