"""The pipeline: what each stage keeps, against the operators' brute-force rules; nulls and an empty table."""

import corpus_pipeline
from plyforge.llm.common import materialize
from tests.conftest import SF
from tests.llm import test_decontaminate, test_quality, test_sharding, test_simhash


def test_run_equals_its_stages_brute_forced(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    kept = {r.doc_id for r in stages["quality rules"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert not any(test_quality.plain(docs[d])[5] for d in kept)  # the base rules; the model's verdicts are tested there
    left = [(d, docs[d]) for d in sorted(kept)]
    left = [(d, docs[int(d)]) for d, _, c in test_simhash.brute(left) if d == c]
    bad = {int(d) for d, *_ in test_decontaminate.brute(left, items)}
    want = sorted(int(d) for d, _ in left if int(d) not in bad)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == want
    by = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.shard, r.slot) for r in by] == test_sharding.brute([r["size"] for r in by])
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 1 for r in got)


def test_stages_take_nulls_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 1), (1, "same", None, None, None), (2, "w " * 20 + " ".join(f"w{i}" for i in range(90)), "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "1 as position", "2 as shard", "3 as size", "4 as fp", "5 as component_id", "6 as file")
    for table in (docs, extra, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns
            out = materialize(out, "stage")
            assert out.count() <= table.count()
        last = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert last.count() == table.count()


def test_run_deletes_what_it_no_longer_needs(spark):
    from plyforge.llm import common

    before = common.made()
    other = common.materialize(spark.range(3), "other")
    corpus_pipeline.run(spark, SF).count()
    left = sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common.made() - before)
    # The last stage's input and tables, which its result reads; and what others have made.
    assert left == ["mixing-sources", "other", "ranges", "shards"]
    assert other.count() == 3


def test_a_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    import pytest

    from plyforge.llm import common

    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_broadcasts_are_bounded_by_bytes(spark):
    from pyspark.sql import functions as F

    from plyforge.llm import common

    hint = lambda df: df._jdf.queryExecution().analyzed().toString()
    wide = spark.range(1000).select("id", F.repeat(F.lit("x"), 50_000).alias("text"), F.array(F.lit("a"), F.lit("b")).alias("words"))
    assert "merge" in hint(common.sized(wide)) and "broadcast" in hint(common.sized(wide.select("id", "words")))
    assert "broadcast" in hint(common.sized(wide.limit(0)))
