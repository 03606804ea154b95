"""Dumps, bucket trees, splits, metadata, blocks and the ingest stream."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.sources import games as g
from plyforge.streaming import ingest as s

GAME = """[Event "Rated game"]
[White "{w}"]
[Black "b"]
[Result "{res}"]
[WhiteElo "{elo}"]
[BlackElo "1520"]
[TimeControl "{tc}"]

1. e4 {{ [%eval 0.17] [%clk 0:03:00] }} 1... e5 {{ [%eval 0.19] [%clk 0:02:59] }} 2. Nf3!? {{ [%clk 0:02:58] }} {res}

"""


def dump(*games):
    return "".join(GAME.format(w=w, res=res, elo=elo, tc=tc) + "\n" for w, res, elo, tc in games).rstrip("\n") + "\n"


GAMES = [("a", "1-0", 1500, "180+2"), ("c", "0-1", 2100, "60+0"), ("d", "1/2-1/2", 999, "30+0"), ("e", "*", 1500, "180+2"), ("f", "1-0", "?", "180+2"), ("h", "1-0", 3100, "-")]


def test_read_dump(spark, tmp_path):
    import zstandard

    (tmp_path / "x.pgn.zst").write_bytes(zstandard.compress(dump(*GAMES).encode()))
    (tmp_path / "y.pgn").write_text(dump(GAMES[1], GAMES[0]))
    rows = g.read_dump(spark, f"{tmp_path}/*").collect()
    assert len(rows) == 8 and {r.moves for r in rows} == {"e4 e5 Nf3"} and {r.clk for r in rows} == {"180 179 178"} and {r.eval for r in rows} == {"0.17 0.19"}
    a = next(r for r in rows if r.white == "a")
    assert (a.result, a.welo, a.belo, a.black, a.timeCtl, a.increment) == (0, 1500, 1520, "b", 180, 2)
    assert {r.white: r.result for r in rows} == {"a": 0, "c": 1, "d": 2, "e": None, "f": 0, "h": 0}
    assert sorted(r.white for r in g.accepted(g.read_dump(spark, f"{tmp_path}/x*")).collect()) == ["a", "c"]


def test_buckets_and_trees(spark, tmp_path):
    df = spark.createDataFrame([(r, 1500) for r in (900, 1000, 1001, 3000, 3001)], "welo int, belo int")
    g.write_buckets(df, f"{tmp_path}/hive")
    back = spark.read.option("basePath", f"{tmp_path}/hive").schema("welo int, belo int, w_bucket string, b_bucket string").parquet(f"{tmp_path}/hive")
    assert {r.welo: r.w_bucket for r in back.collect()} == {900: "1000", 1000: "1000", 1001: "1100", 3000: "3000", 3001: "3000+"}
    for w, b, n in (("1000", "800", 2), ("2500+", "1000", 3), ("junk", "1000", 1)):
        spark.range(n).toPandas().to_parquet((lambda p: (p.mkdir(parents=True), p / "data.parquet")[1])(tmp_path / "tree" / w / b))
    tree = g.read_bucket_tree(spark, f"{tmp_path}/tree")
    assert [(r.w_bucket, r.b_bucket, r.n) for r in g.bucket_catalog(tree).collect()] == [("1000", "800", 2), ("2500+", "1000", 3)]
    assert g.read_bucket_tree(spark, f"{tmp_path}/tree", 2000).count() == 2
    assert g.read_recursive(spark, f"{tmp_path}/tree").count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        g.read_bucket_tree(spark, f"{tmp_path}/none")


def test_sinks(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "if(id < 3, 'val', 'train') as split")
    g.write_splits(df, f"{tmp_path}/splits", 4)
    assert spark.read.parquet(f"{tmp_path}/splits/split=val").count() == 3
    g.write_lines(df.select(F.when(F.col("id") > 7, F.col("id").cast("string")).alias("x")), "x", f"{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["8", "9"]
    meta = f"file://{tmp_path}/fmd.json"
    g.update_metadata(spark, meta, mean=1.5)
    assert g.update_metadata(spark, meta, std=2) == {"mean": 1.5, "std": 2}
    assert json.loads((tmp_path / "fmd.json").read_text()) == {"mean": 1.5, "std": 2}
    (tmp_path / "block-0").mkdir()
    np.save(tmp_path / "block-0/welos.npy", np.array([1, -2, 3], np.int16))
    assert sorted(map(tuple, g.read_blocks(spark, f"{tmp_path}", "welos").collect())) == [("block-0", 0, 1), ("block-0", 1, -2), ("block-0", 2, 3)]


def test_ingest_takes_each_file_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    paths = [str(tmp_path / x) for x in ("land", "out", "ledger", "check")]
    (land / "a.pgn").write_text(dump(*GAMES))
    for extra, games, files in ((None, 2, 1), ("b.pgn", 4, 2), (None, 4, 2)):
        if extra:
            time.sleep(1)
            (land / extra).write_text(dump(*GAMES))
        q = s.ingest(spark, *paths)
        q.awaitTermination()
        assert spark.read.option("recursiveFileLookup", "true").parquet(paths[1]).count() == games
        ledger = spark.read.parquet(paths[2])
        assert ledger.count() == files and {r.ngames for r in ledger.collect()} == {6}
    assert s.progress(q) == {} or "rows" in s.progress(q)
    work = spark.createDataFrame([("a.pgn",), ("c.pgn",), ("d.pgn",)], "file string")
    assert [r.file for r in s.remaining(work, ledger).collect()] == ["d.pgn", "c.pgn"]
    assert [r.file for r in s.landed(work, ledger, ledger).collect()] == ["a.pgn"]


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)]
    ev = spark.createDataFrame(rows, "t string, k string, value double").select(F.to_timestamp("t").alias("ts"), "k", "value")
    assert sorted((r.n, r.total) for r in s.windowed(ev).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in s.sessions(ev, "ts", "30 minutes", "1 hour", "k").collect()) == [1, 2]
    ev.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = s.windowed(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("w").collect()) == [(1, 4.0), (2, 3.0)]


def test_arrays_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(g, "BLOCK_VALUES", 100)
    (tmp_path / "block-7").mkdir()
    rows = np.arange(1230 * 4).reshape(-1, 4)
    np.save(tmp_path / "block-7/train.npy", rows)
    got = sorted(map(tuple, g.read_blocks(spark, f"{tmp_path}", "train", ["gidx", "gs", "nmoves", "block"]).collect()))
    assert got == [("block-7", i, *r) for i, r in enumerate(rows.tolist())]
    np.save(tmp_path / "block-7/flat.npy", np.arange(1001, dtype=np.int16))
    assert sorted(map(tuple, g.read_blocks(spark, f"{tmp_path}", "flat").collect())) == [("block-7", i, i) for i in range(1001)]
    np.save(tmp_path / "block-7/none.npy", np.zeros(0, np.int64))
    assert g.read_blocks(spark, f"{tmp_path}", "none").count() == 0


def test_stream_stops_at_a_marker_and_archives(spark, tmp_path):
    (tmp_path / "land").mkdir()
    (tmp_path / "land/a.pgn").write_text(dump(*GAMES))
    paths = [str(tmp_path / x) for x in ("land", "out", "ledger", "check")]
    q = s.ingest(spark, *paths, poll="1 second", archive=f"{tmp_path}/done")
    (tmp_path / "stop").write_text("")
    for _ in range(60):
        if (tmp_path / "ledger").exists():
            break
        time.sleep(1)
    s.run_until(spark, q, f"file://{tmp_path}/stop")
    assert not q.isActive and spark.read.parquet(paths[2]).count() == 1
    total = s.totals(spark.read.parquet(paths[2]), spark.createDataFrame([("a.pgn",), ("b.pgn",)], "file string")).first()
    assert (total.files, total.games, total.share) == (1, 6, 0.5)
