"""Windows over ordered records: gains and losses, prefixes, gathers, running figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plies(df: DataFrame, game: str, order: list[str]) -> DataFrame:
    """df with ply: each row's place in its game, from 0."""
    return df.withColumn("ply", (F.row_number().over(Window.partitionBy(game).orderBy(*order)) - 1).cast("long"))


def misses(scored: DataFrame, game: str, score: str, threshold: float, share: float, best: str | None = None) -> DataFrame:
    """(game, ply, gain, cp_loss[, best]) where the mover gained threshold by the other's move and lost share of it again.

    scored has ply and the score from white's side. Even plies are white's: gain is what the score rose before the
    ply, loss what it fell in it; odd plies with the signs changed. Both need two rows before. best: the row before's.
    """
    w = Window.partitionBy(game).orderBy("ply")
    one, two = F.lag(score, 1).over(w), F.lag(score, 2).over(w)
    even = F.col("ply") % 2 == 0
    out = scored.withColumn("gain", F.when(even, one - two).otherwise(two - one)).withColumn("cp_loss", F.when(even, one - F.col(score)).otherwise(F.col(score) - one))
    if best:
        out = out.withColumn("best", F.lag(best, 1).over(w))
    hit = (F.col("gain") >= threshold) & (F.col("cp_loss") >= share * F.col("gain"))
    return out.where(hit).select(game, "ply", "gain", "cp_loss", *(["best"] if best else []))


def until_first(df: DataFrame, game: str, bad) -> DataFrame:
    """A game's rows before the first one for which bad holds."""
    w = Window.partitionBy(game).orderBy("ply").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__bad", F.max(F.coalesce(bad, F.lit(False)).cast("int")).over(w)).where("__bad = 0").drop("__bad")


def lengths(starts: DataFrame, start: str, cell: int = 1 << 20) -> DataFrame:
    """(n, longest, mean, std): over the differences of consecutive starts, population std; the last start has none.

    Starts are cut into cells of equal width; a cell's last start meets the next cell's first in a table of a row a cell.
    """
    celled = starts.select(F.col(start).cast("long").alias("s")).withColumn("cell", F.floor(F.col("s") / cell))
    inner = celled.select((F.lead("s").over(Window.partitionBy("cell").orderBy("s")) - F.col("s")).alias("d"))
    edges = celled.groupBy("cell").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    seams = edges.select((F.lead("a").over(Window.orderBy("cell")) - F.col("b")).alias("d"))
    all_ = inner.unionAll(seams).where("d is not null")
    return all_.agg(F.count("*").alias("n"), F.max("d").alias("longest"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))


def prefix_starts(counts: DataFrame, bucket: str, n: str) -> DataFrame:
    """counts (a row a bucket) with start: the rows of the buckets before, in the order of bucket."""
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def located(indices: DataFrame, index: str, buckets: DataFrame, bucket: str, n: str) -> DataFrame:
    """indices with the bucket that holds each flat index, and its place there; outside all buckets: dropped."""
    starts = F.broadcast(prefix_starts(buckets, bucket, n).select(bucket, "start", F.col(n).alias("__n")))  # a row a bucket
    at = (F.col(index) >= F.col("start")) & (F.col(index) < F.col("start") + F.col("__n"))
    return indices.join(starts, at).withColumn("place", F.col(index) - F.col("start")).drop("start", "__n")


def gathered(values: DataFrame, key: str, place: str, slices: DataFrame) -> DataFrame:
    """values (key, place, ...) that the slices (key, gs, nmoves) take: place in [gs, gs + nmoves)."""
    return values.join(slices, key).where((F.col(place) >= F.col("gs")) & (F.col(place) < F.col("gs") + F.col("nmoves")))


def running_metrics(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_mean", F.avg(value).over(w)).withColumn("running_max", F.max(value).over(w))


def first_k(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group, with ply."""
    return plies(df, group, order).where(F.col("ply") < k)


def looked_up(index: DataFrame, at: str, table: DataFrame, key: str) -> DataFrame:
    """index with the columns of the table's row that its column at names by key; without such a row: dropped."""
    return index.join(table, index[at] == table[key])


def novel(places: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows of places whose key is not among those of known."""
    return places.join(known.select(key).distinct(), key, "left_anti")


def distinct_count(places: DataFrame, key: str) -> DataFrame:
    return places.agg(F.count_distinct(key).alias("n"))
