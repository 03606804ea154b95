"""Operators against results worked out by hand, and properties that hold for any input."""

import pytest
from pyspark.sql import functions as F

from plyforge.functions import parse, scores, tokens
from plyforge.operators import buckets, evaluation, sampling, sequences


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_quotas_drop_small_buckets_first(spark):
    df = spark.createDataFrame([(b,) for b, n in (("A", 100), ("B", 40), ("C", 3), ("D", 1)) for _ in range(n)], "b string")
    got = buckets.quotas(buckets.bucket_counts(df, ["b"], F.lit(True), 2), 10)
    assert {r.b: r.quota for r in got.collect()} == {"A": 100, "B": 100, "C": 30}


def test_split_sizes_are_exact_and_stable(spark):
    df = spark.range(230)
    a = {r.id: r.split for r in sampling.quota_split(df, ["id"]).collect()}
    assert sorted(a.values()).count("train") == 208 and list(a.values()).count("val") == 11 and list(a.values()).count("test") == 11
    assert a == {r.id: r.split for r in sampling.quota_split(df.repartition(7), ["id"]).collect()}
    with pytest.raises(ValueError):
        sampling.quota_split(df, ["id"], valid=60, test=40)
    with pytest.raises(ValueError):
        sampling.chunk_split(df, "id", ["id"], valid=0.9, test=0.2)


@pytest.mark.parametrize(("n", "q", "want"), [(3, 7, [3, 2, 2]), (5, 5, [1] * 5), (5, 3, [1, 1, 1, 0, 0]), (1, 4, [4])])
def test_oversampling_meets_the_quota(spark, n, q, want):
    df = spark.range(n).selectExpr("'b' as b", "id")
    rows = sampling.oversampled(df, spark.createDataFrame([("b", n, q)], "b string, n long, quota long"), "b", ["id"]).collect()
    assert [sum(r.id == i for r in rows) for i in range(n)] == want
    assert [r.id for r in sorted(rows, key=lambda r: r.turn)] == [k % n for k in range(q)]


def test_shards_drop_the_remainder(spark):
    got = {r.id: r.shard for r in sampling.rank_shard(spark.range(10), ["id"], 3).collect()}
    assert got == {i: i // 3 for i in range(9)}


def test_chunks(spark):
    for n, size in ((1000, 2), (499, 1)):
        rows = sampling.chunk_split(spark.range(n).selectExpr("'f' as f", "id"), "f", ["id"]).collect()
        assert all(r.chunk == r.id // size for r in rows)
        assert all(len({r.split for r in rows if r.chunk == c}) == 1 for c in range(0, 20))


def test_roll_up(spark):
    outer = [("1000", "1000"), ("1500+", None), ("2000", "2000"), ("2000+", "2000+"), ("2500", "2000+"), ("2500+", "2000+")]
    df = spark.createDataFrame([(o, i) for o, _ in outer for i in ("1500", "1500+", "2000", "2000+", "2500", "x")], "o string, i string")
    merged = buckets.merge_buckets(df, "o", "i", 2000)
    got = {(r.o, r.i) for r in merged.collect()}
    # Below an outer bucket that stays, a small + bucket stays too; below a rolled-up one it is dropped.
    assert got == {(o, i) for o in ("1000", "2000") for i in ("1500", "1500+", "2000", "2000+")} | {("2000+", i) for i in ("1500", "2000", "2000+")}
    again = buckets.merge_buckets(merged, "o", "i", 2000)
    assert sorted(again.collect()) == sorted(merged.collect())
    plan = {(r.outer, r.inner): (r.to_outer, r.to_inner) for r in buckets.merge_plan(df, "o", "i", 2000).collect()}
    assert plan["2500", "2500"] == ("2000+", "2000+") and plan["1500+", "2000"] == (None, None) and plan["1000", "x"] == (None, None)


def test_histograms(spark):
    edges = [0.0, 1000.0, 1200.0, 4000.0]
    df = spark.createDataFrame([(float(v),) for v in (-5, 0, 999, 1000, 1199, 4000, 4001, float("nan"))] + [(None,)], "v double")
    assert [r.n for r in buckets.histogram(df, "v", edges).orderBy("bin").collect()] == [2, 2, 1]
    games = spark.createDataFrame([(1000.0, 1250.0), (1250.0, 1000.0), (3000.0, 900.0)], "w double, b double")
    full = buckets.adjusted_edges([*(1000.0 + 200 * i for i in range(9)), 4000.0], 3000.0)
    assert full == [0, *range(1000, 2601, 200), 3001]
    assert {(r.i, r.j): r.n for r in buckets.pair_matrix(games, "w", "b", full).collect()} == {(2, 1): 2, (9, 0): 1}
    assert buckets.adjusted_edges([0, 1000, 2000], 2500) == [0, 1000, 2000, 2501]


def test_whitening(spark):
    row = buckets.whiten_params(spark.createDataFrame([(1000, 1400), (1200, 1600)], "w int, b int"), "w", "b").first()
    assert (row.n, row.mean, round(row["std"], 4)) == (4, 1300, 258.1989)


@pytest.mark.parametrize(("scores_", "shift", "want"), [([20, 300, 50], 0, (280, 250)), ([300, 50, 280], 1, (250, 230)), ([20, 100, 50], 0, None), ([20, 300, 250], 0, None)])
def test_misses(spark, scores_, shift, want):
    df = spark.createDataFrame([(1, i + shift, float(s)) for i, s in enumerate(scores_)], "g int, ply long, score double")
    rows = sequences.misses(df, "g", "score", 200, 0.5).collect()
    assert [(r.gain, r.cp_loss) for r in rows] == ([want] if want else [])


def test_lengths(spark):
    for cell in (1, 50, 1 << 20):
        row = sequences.lengths(spark.createDataFrame([(0,), (40,), (100,)], "s long"), "s", cell).first()
        assert (row.n, row.longest, row["mean"], row["std"]) == (2, 60, 50, 10)


def test_located(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 0), ("c", 3)], "b string, n long")
    got = {r.id: (r.b, r.place) for r in sequences.located(spark.range(7), "id", counts, "b", "n").collect()}
    assert got == {0: ("a", 0), 1: ("a", 1), 2: ("c", 0), 3: ("c", 1), 4: ("c", 2)}


@pytest.mark.parametrize(("rating", "most", "want"), [(1000, 2600, "ELO1000"), (1001, 2600, "ELO1200"), (2600, 2600, "ELO2600"), (2601, 2600, "ELOMAX"), (3000, 3000, "ELO3000"), (3001, 9000, "ELOMAX"), (2450, 2500, "ELO2600"), (None, 2600, None)])
def test_rating_tokens(spark, rating, most, want):
    assert value(spark, tokens.rating_token(F.lit(rating).cast("int"), most)) == (want and f"<|{want}|>")


def test_header_tokens(spark):
    for s, want in ((60, "1MINUTE"), (61, "3MINUTES"), (300, "5MINUTES"), (3600, "1HOUR"), (3601, "3HOURS")):
        assert value(spark, tokens.time_token(F.lit(s))) == f"<|{want}|>"
    for s, want in ((0, "0SECONDS"), (1, "1SECOND"), (5, "5SECONDS"), (16, "MAXSECONDS"), (30, "30SECONDS"), (31, "MAXSECONDS"), (-1, "5SECONDS")):
        assert value(spark, tokens.increment_token(F.lit(s))) == f"<|{want}|>"
    assert [value(spark, tokens.outcome(F.lit(r))) for r in (0, 1, 2)] == [1, -1, 0]
    with pytest.raises(Exception, match="no such result"):
        value(spark, tokens.outcome(F.lit(3)))


def test_vocabulary():
    vocab, special = tokens.vocabulary(), tokens.special_tokens()
    assert (len(vocab), vocab["O-O-O"], vocab["a1"], vocab["h8"], vocab[" "]) == (94, 0, 29, 92, 93)
    assert (special["<|NOOP|>"], special["<|ELOUNKNOWN|>"], special["<|3HOURS|>"], special["<|MAXSECONDS|>"]) == (103, 119, 120, 134)


def test_move_pieces(spark):
    text = "e4 N1f3 O-O-O exd8=Q+ a9 zz!"
    want = ["e4", " ", "N", "1", "f3", " ", "O-O-O", " ", "e", "x", "d8", "=", "Q", "+", " ", "a9", " "]
    assert value(spark, tokens.move_pieces(F.lit(text))) == want
    vocab = tokens.vocabulary()
    ids = [i for p in want for i in ([vocab[p]] if p in vocab else [vocab[c] for c in p])]
    assert value(spark, tokens.move_ids(F.lit(text))) == ids
    assert value(spark, tokens.move_groups(F.lit("N1f3"))) == [["N", "f3"]]


def test_ids_agree_with_a_bpe_library(spark):
    import tiktoken

    vocab = {t.encode(): i for t, i in tokens.vocabulary().items()}
    encode = tiktoken.Encoding("moves", pat_str=tokens.MOVE_PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
    for text in ("e4 e5 Nf3 Nc6", "O-O-O# a9 R1xh8=Q+", "exd5  b9"):
        assert value(spark, tokens.move_ids(F.lit(text))) == encode(text)


def test_clocks_and_positions(spark):
    for n, want in (("180", ["100", "80"]), ("105", ["100", "0", "5"]), ("0", []), ("7", ["7"])):
        assert value(spark, tokens.clock_digits(F.lit(n))) == want
    assert value(spark, tokens.interleaved(F.lit("180 105 7"), F.lit("e4 N1f3"))) == ["100", "80", "e4", "100", "0", "5", "N", "f3", "7"]
    fen = F.lit("8/8/8/8/8/8/8/K1k5 w - - 0 1")
    assert value(spark, tokens.fen_trimmed(fen)) == "8/8/8/8/8/8/8/K1k5 w - -" and value(spark, tokens.fen_board(fen)) == "8888888K1k5"


def test_scores(spark):
    score = lambda rel, mate, white: value(spark, scores.white_score(F.lit(rel).cast("int"), F.lit(mate).cast("int"), F.lit(white)))
    assert (score(None, 0, False), score(None, 0, True), score(-1500, None, True), score(300, None, False)) == (1000, -1000, -1000, -300)
    assert (score(None, 3, True), score(None, -3, True), score(None, 3, False), score(None, -3, False)) == (1000, -1000, -1000, 1000)
    assert round(scores.compute_budget(days=10, params=1000, tokens=20), 2) == 138.89
    with pytest.raises(ValueError):
        scores.compute_budget(days=10)
    assert value(spark, scores.elapsed(F.lit(3671.9))) == "1:01:11"
    assert value(spark, scores.log10_or_null(F.lit(0))) is None


def test_padding(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "id long, ids array<int>").withColumn("g", F.lit(0))
    assert [r.ids for r in sampling.padded(df, "ids", ["id"], 2, ["g"], 103).orderBy("id").collect()] == [[1, 2, 3], [4, 103, 103]]


def test_names(spark):
    assert value(spark, parse.bucket_value(F.lit("2500+"))) == 2500 and value(spark, parse.bucket_plus(F.lit("2500+"))) is True
    assert value(spark, parse.bucket_value(F.lit("x2500"))) is None
    assert value(spark, parse.dump_name(F.lit("https://d/db_standard_rated_2017-04.pgn.zst"))) == "2017-04"
    assert value(spark, parse.bucket_of_path(F.lit("file:/r/2500+/1000/data.parquet"), 1)) == "2500+"


def test_evaluation(spark):
    rows = [(1, 1, 5, 0.5), (1, 2, 6, 0.3), (1, 3, 7, 0.2), (2, 1, 5, 0.9), (2, 2, 8, 0.1)]
    df = spark.createDataFrame(rows, "k int, r int, token int, p double")
    found = evaluation.ranked(df, ["k"], "token", "p", 5)
    got = {r.top: (r.hits, r.total) for r in evaluation.top_n_accuracy(found, ["k"], F.col("token") == 6, [1, 3]).collect()}
    assert got == {1: (0, 2), 3: (1, 2)}
    empty = evaluation.band_accuracy(spark.range(3), "id", F.lit(True), F.lit(False)).first()
    assert empty.total == 0 and empty.accuracy is None


def test_skewed_prefix_lengths(spark):
    df = spark.range(2000).selectExpr("id div 20 as g", "id % 20 as o")
    rows = sampling.skewed_prefix(df, "g", ["o"], 5, 1).groupBy("g").agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert 0 < len(rows) <= 100 and all(r.n == min(5, 20 - r.a) and r.b - r.a + 1 == r.n for r in rows)
