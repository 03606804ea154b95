"""Figures on ranked predictions: accuracies by rank, position band and rating pair, probabilities, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(predictions: DataFrame, key: list[str], token: str, p: str, k: int) -> DataFrame:
    """The k likeliest candidates of each key, with rank from 1; ties go to the lesser token."""
    w = Window.partitionBy(*key).orderBy(F.desc(p), F.col(token))
    return predictions.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def top_n_accuracy(found: DataFrame, key: list[str], hit: Column, tops: list[int]) -> DataFrame:
    """(top, hits, total, accuracy): keys whose target is among the first n candidates, of all keys."""
    best = found.groupBy(*key).agg(F.min(F.when(hit, F.col("rank"))).alias("at"))
    sums = best.agg(F.count("*").alias("total"), *(F.count_if(F.col("at") <= n).alias(f"h{n}") for n in tops))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("top"), F.col(f"h{n}").alias("hits"), F.col("total").alias("total")) for n in tops))).alias("r"))
    return rows.select("r.top", "r.hits", "r.total", F.try_divide(F.col("r.hits").cast("double"), F.col("r.total")).alias("accuracy"))


def band_accuracy(df: DataFrame, position: str, hit: Column, counts: Column, width: int = 10) -> DataFrame:
    """(band, hits, total, accuracy) by bands of positions, over the rows that count; null where none does."""
    sums = df.groupBy(F.expr(f"{position} div {width}").cast("long").alias("band")).agg(F.count_if(hit & counts).alias("hits"), F.count_if(counts).alias("total"))
    return sums.withColumn("accuracy", F.try_divide(F.col("hits").cast("double"), F.col("total")))


def side_matrix(df: DataFrame, white: str, black: str, position: str, hit: Column, error: Column, counts: Column) -> DataFrame:
    """(w, b, side, moves, correct, abs_error): by rating pair and side to move, over the rows that count."""
    kept = df.where(counts)
    return kept.groupBy(F.col(white).alias("w"), F.col(black).alias("b"), (F.col(position) % 2).cast("long").alias("side")).agg(
        F.count("*").alias("moves"), F.count_if(hit).alias("correct"), F.sum(F.abs(error)).alias("abs_error")
    )


def matrix_report(matrix: DataFrame) -> DataFrame:
    """(w, b, accuracy as text): correct of moves in percent with one decimal, - where empty."""
    pairs = matrix.groupBy("w", "b").agg(F.sum("correct").alias("c"), F.sum("moves").alias("m"))
    return pairs.select("w", "b", F.when(F.col("m") == 0, "-").otherwise(F.format_string("%.1f", 100.0 * F.col("c") / F.col("m"))).alias("accuracy"))


def target_probability(df: DataFrame, target_p: str, adjacent_p: str, counts: Column) -> DataFrame:
    kept = df.where(counts)
    return kept.agg(F.count("*").alias("n"), F.avg(target_p).alias("mean_target"), F.avg(adjacent_p).alias("mean_adjacent"))


def ratio_means(df: DataFrame, head: str, candidate_p: str, target_p: str) -> DataFrame:
    """(head, below, n_below, above, n_above): mean candidate / target, apart for candidates below the target and not."""
    ratio, below = F.try_divide(F.col(candidate_p), F.col(target_p)), F.col(candidate_p) < F.col(target_p)
    return df.groupBy(head).agg(
        F.avg(F.when(below, ratio)).alias("below"), F.count_if(below).alias("n_below"), F.avg(F.when(~below, ratio)).alias("above"), F.count_if(~below).alias("n_above")
    )


def mean_with_default(df: DataFrame, *metrics: str) -> DataFrame:
    """The metrics' means over batches, an absent one counting as 0."""
    return df.agg(*(F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics))


def masked_tokens(df: DataFrame, token: str, p: str, least: float) -> DataFrame:
    """df with the token -1 where its probability is below least."""
    return df.withColumn(token, F.when(F.col(p) < least, F.lit(-1)).otherwise(F.col(token)))


def legality(df: DataFrame, game: str, legal: Column, reason: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Legal games and moves; how many games have their nth illegal move; and the reasons' counts."""
    marked = df.withColumn("__bad", (~legal).cast("int"))
    games = marked.groupBy(game).agg(F.sum("__bad").alias("fails"), F.count("*").alias("moves"))
    totals = games.agg(F.count("*").alias("games"), F.count_if(F.col("fails") == 0).alias("legal_games"), F.sum("moves").alias("moves"), F.sum(F.col("moves") - F.col("fails")).alias("legal_moves"))
    nth = games.where("fails > 0").select(F.explode(F.expr("sequence(1L, fails)")).alias("nth")).groupBy("nth").agg(F.count("*").alias("games"))
    reasons = marked.where("__bad = 1").groupBy(reason).agg(F.count("*").alias("n"))
    return totals, nth, reasons
