"""End-to-end jobs over files: the balanced dataset, roll-ups, splits, statistics, token sequences, mistake mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import tokens
from plyforge.operators import board, buckets, sampling, sequences
from plyforge.sources import games as sources

#: The columns of a game in a built dataset.
COLUMNS = ["moves", "clk", "result", "welo", "belo", "timeCtl", "increment"]


def balanced(tree: DataFrame, min_time: int, min_rows: int = 1, max_repeats: int = 10, valid: int = 5, test: int = 5, seed: int = 42) -> DataFrame:
    """Rows of a bucket tree with a time control of min_time or more, each bucket oversampled to its quota, with turn and split."""
    kept = tree.where(F.col("timeCtl") >= min_time).withColumn("bucket", F.concat_ws("/", "w_bucket", "b_bucket"))
    kept = kept.select("bucket", *(c for c in COLUMNS if c in tree.columns)).withColumn("__at", F.xxhash64(*(c for c in COLUMNS if c in tree.columns)))
    quotas = buckets.quotas(buckets.bucket_counts(kept, ["bucket"], F.lit(True), min_rows), max_repeats)
    copies = sampling.oversampled(kept, quotas, "bucket", ["__at"]).drop("__at", "copy")
    return sampling.quota_split(copies, ["bucket", "turn"], seed, valid, test)


def build_dataset(spark: SparkSession, root: str, out: str, batch: int = 0, **options) -> None:
    sources.write_splits(balanced(sources.read_bucket_tree(spark, root), **options), out, batch)


def merge_tree(spark: SparkSession, root: str, out: str, threshold: int, dry_run: bool = False) -> DataFrame:
    """Writes the rolled-up tree to out (unless dry_run) and returns the plan."""
    tree = sources.read_bucket_tree(spark, root)
    plan = buckets.merge_plan(tree, "w_bucket", "b_bucket", threshold)
    if not dry_run:
        merged = buckets.merge_buckets(tree, "w_bucket", "b_bucket", threshold)
        merged.hint("rebalance", "w_bucket", "b_bucket").write.mode("overwrite").partitionBy("w_bucket", "b_bucket").parquet(out)
    return plan


def split_files(spark: SparkSession, root: str, out: str, valid: float, test: float, seed: int = 42) -> None:
    """Whole chunks of every file below root to one split each; a file's rows keep their order within a split.

    The rows of a file are in the folder out/split=<split>/<the file's path below root>. They are written beside out
    first; then the folders take their names by a rename each, on the driver, after what was in out is deleted.
    """
    rows = sources.read_recursive(spark, root).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    parts = sampling.chunk_split(rows, "__file", ["__row"], seed, valid, test).drop("chunk")
    parts = parts.withColumn("__below", sources.path_below(spark, F.col("__file"), root)).repartition("split", "__below").sortWithinPartitions("split", "__below", "__row")
    fresh = f"{out.rstrip('/')}.new"
    parts.drop("__row", "__file").write.mode("overwrite").partitionBy("split", "__below").parquet(fresh)
    sources.unfold(spark, fresh, out, "__below")


def concat(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Writes the rows of all readable files below root to out and returns (file, bytes) of those that gave none."""
    sources.read_recursive(spark, root, skip_unreadable=True).write.mode("overwrite").parquet(out)
    return sources.unreadable(spark, root)


def sequences_of(games: DataFrame, max_group: int = 2600, max_length: int = 768) -> DataFrame:
    """games with the header tokens, the outcome and ids, the token ids of header spaces and moves, cut at max_length - 4."""
    c = F.col
    head = [tokens.rating_token(c("welo"), max_group), tokens.rating_token(c("belo"), max_group), tokens.time_token(c("timeCtl")), tokens.increment_token(c("increment"))]
    special = F.create_map(*(F.lit(x) for pair in tokens.special_tokens().items() for x in pair))
    space = F.lit(tokens.vocabulary()[" "])
    header = F.flatten(F.array(*(F.array(F.element_at(special, h), space) for h in head)))
    moves = F.array_join(F.filter(F.split(c("moves"), r"\s+"), lambda m: m != ""), " ")
    ids = F.slice(F.concat(header, tokens.move_ids(moves)), 1, max_length - 4)
    return games.withColumn("outcome", tokens.outcome(c("result"))).withColumn("ids", ids)


def statistics(tree: DataFrame, edges: list[float]) -> dict[str, DataFrame]:
    """The rating histogram, the folded pair matrix, the time controls by increment class and the whitening parameters."""
    both = tree.select(F.explode(F.array(F.col("welo").cast("double"), F.col("belo").cast("double"))).alias("rating"))
    most = both.agg(F.max("rating")).first()[0]
    full = buckets.adjusted_edges(edges, most)
    klass = F.when(F.col("increment") == 0, "none").when(F.col("increment") > 0, "some")
    return {
        "ratings": buckets.histogram(both, "rating", full),
        "pairs": buckets.pair_matrix(tree, "welo", "belo", full),
        "times": buckets.classed_histogram(tree, "timeCtl", klass, [0.0, 300.0, 600.0, 1800.0, 10800.0]),
        "whitening": buckets.whiten_params(tree, "welo", "belo"),
    }


def mined(plies: DataFrame, game: str, threshold: float = 200, share: float = 0.5) -> DataFrame:
    """(game, misses): a game's mistakes (ply, gain, cp_loss, best) as one array, from scored plies (game, ply, score, best)."""
    found = sequences.misses(plies, game, "score", threshold, share, "best")
    return found.groupBy(game).agg(F.sort_array(F.collect_list(F.struct("ply", "best", "gain", "cp_loss"))).alias("misses"))


def write_mined(spark: SparkSession, plies: DataFrame, game: str, out: str, threshold: float = 200, share: float = 0.5, **more) -> None:
    """mined as Parquet in out/misses, and the parameters that gave it, with more, as JSON in out/parameters.json."""
    mined(plies, game, threshold, share).write.mode("overwrite").parquet(f"{out}/misses")
    sources.update_metadata(spark, f"{out}/parameters.json", threshold=threshold, share=share, **more)


def sampled_positions(games: DataFrame, game: str, most: int = 10, seed: int = 42, skew: int = 4) -> DataFrame:
    """(game, ply, fen, k, i): up to most positions of each replayed game from a random place on, later places being likelier.

    They are sampling.skewed_prefix of the plies; as a game's plies leave its replay as one row, nothing is shuffled.
    Each row of games is a game, also where its id is another's.
    """
    taken = board.lines(games, game).withColumn("__at", sampling.skewed_places(game, F.size("fens"), most, seed, skew))
    at = F.transform("__at", lambda i, k: F.struct(i.alias("ply"), F.get("fens", i.cast("int")).alias("fen"), k.cast("long").alias("k"), i.alias("i")))
    return taken.select(game, F.inline(at))


def positions(games: DataFrame, game: str, per_game: int = 20) -> DataFrame:
    """(game, ply, fen) of the first per_game positions of each game."""
    return board.replayed(games, game, "moves", per_game).select(game, "ply", "fen")
