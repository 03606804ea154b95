"""End-to-end jobs on a small bucket tree."""

import pytest
from pyspark.sql import functions as F

from plyforge import __main__ as cli
from plyforge.functions import tokens
from plyforge.operators import sampling
from plyforge.plans import jobs
from plyforge.sources import games as sources


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    schema = sources.GAME_SCHEMA
    for w, b, n in (("1000", "1000", 300), ("1500+", "1000", 20), ("2000", "2000+", 40), ("2500", "2500", 5)):
        rows = [(f"e4 e5 N{'fc'[i % 2]}3", "180 179 178", None, i % 3, int(w.strip("+")), int(b.strip("+")), "w", "b", 30 + 60 * (i % 10), i % 4) for i in range(n)]
        df = spark.createDataFrame(rows, schema).withColumn("white", F.concat(F.lit(w), F.monotonically_increasing_id()))
        (root / w / b).mkdir(parents=True)
        df.toPandas().astype({"result": "int8", "welo": "int16", "belo": "int16", "timeCtl": "int16", "increment": "int16"}).to_parquet(root / w / b / "data.parquet")
    return f"{root}"


def test_build(spark, tree, tmp_path):
    cli_options = dict(min_time=300, min_rows=3, max_repeats=3, valid=10, test=20)
    rows = jobs.balanced(sources.read_bucket_tree(spark, tree), **cli_options).collect()
    per = {}
    for r in rows:
        per[r.bucket] = per.get(r.bucket, 0) + 1
        assert r.timeCtl >= 300
    assert per == {"1000/1000": 150, "1500+/1000": 30, "2000/2000+": 60}  # 2500/2500 has two such rows
    splits = [r.split for r in rows]
    assert (splits.count("val"), splits.count("test")) == (24, 48)
    jobs.build_dataset(spark, tree, f"{tmp_path}/out", **cli_options)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 240


def test_merge_and_split(spark, tree, tmp_path):
    plan = {(r.outer, r.inner): r.to_outer for r in jobs.merge_tree(spark, tree, f"{tmp_path}/m", 2000).collect()}
    assert plan == {("1000", "1000"): "1000", ("1500+", "1000"): None, ("2000", "2000+"): "2000", ("2500", "2500"): "2000+"}
    assert spark.read.parquet(f"{tmp_path}/m").count() == 345
    jobs.split_files(spark, tree, f"{tmp_path}/s", 0.2, 0.2)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 365


def test_statistics_and_sequences(spark, tree):
    found = jobs.statistics(sources.read_bucket_tree(spark, tree), [0.0, 1000.0, 1600.0, 2200.0, 4000.0])
    assert {(r.low, r.high): r.n for r in found["ratings"].collect()} == {(0, 1000): 0, (1000, 1600): 640, (1600, 2200): 80, (2200, 2501): 10}
    assert {(r.i, r.j): r.n for r in found["pairs"].collect()} == {(1, 1): 320, (2, 2): 40, (3, 3): 5}
    assert found["whitening"].first().n == 730
    row = jobs.sequences_of(sources.read_bucket_tree(spark, tree).where("w_bucket = '2500'").limit(1), 2400).first()
    special = tokens.special_tokens()
    assert row.ids[:4] == [special["<|ELOMAX|>"], 93, special["<|ELOMAX|>"], 93] and len(row.ids) == 8 + 6  # e4 e5 N f3 with two spaces


def test_ranks_do_not_depend_on_ranges(spark):
    df = spark.range(500).selectExpr("id % 7 as p", "(id * 37) % 501 as o", "cast(id as string) as s")
    want = {r.o: r.k for r in sampling.ranked_within(df, ["p"], ["o"], "k", 1).collect()}
    assert want == {r.o: r.k for r in sampling.ranked_within(df, ["p"], ["o"], "k", 16).collect()}
    assert sorted(r.k for r in sampling.ranked_within(df, [], ["o"], "k").collect()) == list(range(500))
    assert sorted(r.k for r in sampling.ranked_within(df, [], ["s"], "k").collect()) == list(range(500))
    nulls = spark.createDataFrame([(None,), (1,), (None,), (0,)], "o int")
    assert sorted((r.k, r.o) for r in sampling.ranked_within(nulls, [], ["o"], "k").where("o is not null").collect()) == [(2, 0), (3, 1)]


def test_mining(spark):
    plies = spark.createDataFrame([(1, i, float(x), f"m{i}") for i, x in enumerate((20, 300, 50))] + [(2, i, 0.0, "m") for i in range(3)], "g int, ply long, score double, best string")
    rows = jobs.mined(plies, "g").collect()
    assert [(r.g, [tuple(m) for m in r.misses]) for r in rows] == [(1, [(2, "m1", 280.0, 250.0)])]


def test_command_line(capsys, tree, spark, tmp_path):
    cli.main(["budget", "--days", "10", "--params", "1000", "--tokens", "20"])
    assert capsys.readouterr().out.startswith("138.88")
    cli.main(["merge", tree, f"{tmp_path}/x", "2000", "--dry-run"])
    assert "2000+" in capsys.readouterr().out
    cli.main(["stats", tree, "--metadata", f"file://{tmp_path}/fmd.json"])
    assert (tmp_path / "fmd.json").exists()
    cli.main(["fens", tree, f"{tmp_path}/fens", "--per-game", "2"])
    assert spark.read.text(f"{tmp_path}/fens").count() == 730


def test_chain_of_written_trees(spark, tmp_path):
    """ingest, merge, merge again, build and split: each reads what the one before wrote."""
    from plyforge.streaming import ingest
    from tests.test_sources import dump

    (tmp_path / "land").mkdir()
    games = [(f"p{i}", ("1-0", "0-1", "1/2-1/2")[i % 3], 1450 if i < 30 else 2450, "300+2") for i in range(40)]
    for k in range(2):
        (tmp_path / "land" / f"{k}.pgn").write_text(dump(*games[k::2]))
    ingest.ingest(spark, *(f"{tmp_path}/{x}" for x in ("land", "tree", "ledger", "check")), files_per_batch=1).awaitTermination()
    tree = sources.read_bucket_tree(spark, f"{tmp_path}/tree")
    assert {(r.w_bucket, r.b_bucket, r.n) for r in sources.bucket_catalog(tree).collect()} == {("1500", "1600", 30), ("2500", "1600", 10)}
    assert sources.row_count(spark, f"{tmp_path}/tree") == 40
    cli.main(["merge", f"{tmp_path}/tree", f"{tmp_path}/m", "2000"])
    cli.main(["merge", f"{tmp_path}/m", f"{tmp_path}/m2", "2000"])
    told = [{(r.w_bucket, r.b_bucket): r.n for r in sources.bucket_catalog(sources.read_bucket_tree(spark, f"{tmp_path}/{x}")).collect()} for x in ("m", "m2")]
    assert told[0] == told[1] and sum(told[0].values()) == 40
    cli.main(["build", f"{tmp_path}/m", f"{tmp_path}/built", "--min-timectl", "300", "--max-repeats", "2"])
    built = spark.read.parquet(f"{tmp_path}/built")
    assert built.count() == sum(min(2 * n, max(told[0].values())) if n < max(told[0].values()) else n for n in told[0].values())
    cli.main(["split", f"{tmp_path}/m", f"{tmp_path}/s", "--valid", "0.3", "--test", "0.2"])
    below = {p.relative_to(tmp_path / "m").as_posix() for p in (tmp_path / "m").rglob("*.parquet")}
    split = {p.parent.relative_to(tmp_path / "s").as_posix().split("/", 1)[1] for p in (tmp_path / "s").rglob("*.parquet") if p.is_file()}
    assert split == below and spark.read.parquet(f"{tmp_path}/s").count() == 40
    assert {p.name for p in (tmp_path / "s").iterdir()} <= {"split=train", "split=val", "split=test"}


def test_files_that_cannot_be_read_are_told(spark, tmp_path, capsys):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in/a b+c")
    (tmp_path / "in/broken.parquet").write_bytes(b"PAR1 not a table PAR1")
    cli.main(["concat", f"{tmp_path}/in", f"{tmp_path}/out"])
    said = capsys.readouterr().out
    assert "broken.parquet (21 bytes)" in said and said.count("no rows read") == 1
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_copies_of_tables_with_clashing_names(spark):
    df = spark.createDataFrame([("a", i, 7, 8, 9, 10) for i in range(3)], "bucket string, at long, n int, i int, quota int, k int")
    quotas = spark.createDataFrame([("a", 3, 7)], "bucket string, n long, quota long")
    rows = sampling.oversampled(df, quotas, "bucket", ["at"])
    assert rows.columns == [*df.columns, "copy", "turn"]
    got = rows.collect()
    assert sorted((r.turn, r.at) for r in got) == [(t, t % 3) for t in range(7)] and {(r.n, r.i, r.quota) for r in got} == {(7, 8, 9)}
    assert sorted(r.turn for r in sampling.resumed(rows, "bucket", 4, "a").collect()) == [5, 6]
    assert [r.at for r in sampling.capped(df, ["at"], 2).collect()] == [0, 1]
    assert "i" in sampling.skewed_prefix(df.drop("k"), "bucket", ["at"], 2, 1).columns


def test_string_ranks_have_many_tasks(spark):
    df = spark.range(3000).selectExpr("concat('k', lpad(id * 7 % 3001, 4, '0')) as s", "id % 2 as p")
    ranked = sampling.ranked_within(df, [], ["s"], "at", 16)
    got = ranked.collect()
    assert [r.s for r in sorted(got, key=lambda r: r.at)] == sorted(r.s for r in got) and sorted(r.at for r in got) == list(range(3000))


def test_mined_with_parameters(spark, tmp_path):
    import json

    plies = spark.createDataFrame([(1, i, float(x), f"m{i}") for i, x in enumerate((20, 300, 50))], "g int, ply long, score double, best string")
    jobs.write_mined(spark, plies, "g", f"file://{tmp_path}/mined", 200, 0.5, engine="given scores")
    assert json.loads((tmp_path / "mined/parameters.json").read_text()) == {"threshold": 200, "share": 0.5, "engine": "given scores"}
    assert spark.read.parquet(f"{tmp_path}/mined/misses").count() == 1


def test_vocabulary_up_to_an_id():
    assert max(tokens.vocabulary(20).values()) == 20 and tokens.vocabulary(20).items() <= tokens.vocabulary().items()
