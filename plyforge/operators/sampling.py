"""Oversampling to quotas, exact random splits, shards, padding and skewed sampling.

Random orders are md5 hashes of a seed and the row's key, so they are the same on any partitioning and in any engine.
Ranks over a whole table are taken in two steps, so that no task holds more than a slice of it: rows are cut into cells
by the leading hash digits, the cells' counts are prefix-summed, and ranks inside the cells are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash digits that make a cell: 16 ** CELL_DIGITS cells.
CELL_DIGITS = 3
#: Ranges of the order column that ranks are taken in.
RANGES = 64
#: Values that the quantiles of a column without arithmetic are taken from.
SAMPLE = 4096


def random_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def global_rank(df: DataFrame, key: str, alias: str = "rank", digits: int = CELL_DIGITS) -> DataFrame:
    """df with alias: each row's place (from 0) by the hexadecimal string key, whose ties are broken arbitrarily."""
    cell = F.substring(key, 1, digits)
    cells = df.groupBy(cell.alias("__cell")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** digits rows at most
    cells = cells.select("__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = df.withColumn("__cell", cell).withColumn("__i", F.row_number().over(Window.partitionBy("__cell").orderBy(key)) - 1)
    return ranked.join(F.broadcast(cells), "__cell").withColumn(alias, (F.col("__before") + F.col("__i")).cast("long")).drop("__cell", "__before", "__i")


def ranked_within(df: DataFrame, partition: list[str], order: list[str], alias: str, ranges: int = RANGES) -> DataFrame:
    """df with alias: each row's place (from 0) in its partition, by order.

    Partitions are cut into ranges of the first order column at its quantiles, so that a partition that holds much of
    the table is ranked by several tasks; the quantiles only decide who does the work. Those of numbers and times are
    approximate ones of all rows, those of other types come from the SAMPLE values of the least hashes.
    """
    first = df.schema[order[0]].dataType.typeName()
    if first in ("byte", "short", "integer", "long", "float", "double", "timestamp", "date"):
        number = (F.col(order[0]).cast("timestamp") if first == "date" else F.col(order[0])).cast("double")
        shares = [i / ranges for i in range(1, ranges)]
        bounds = df.agg(F.percentile_approx(number, shares, 1000)).first()[0] or []  # ranges - 1 numbers
        marks = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    else:
        number = F.col(order[0])
        some = df.where(number.isNotNull()).select(number.alias("v")).distinct().orderBy(F.xxhash64("v")).limit(SAMPLE)
        row = some.agg(F.array_sort(F.collect_list("v"))).first()[0] or []  # SAMPLE values at most
        marks = F.array(*(F.lit(row[len(row) * i // ranges]) for i in range(1, ranges))) if row else F.array().cast(f"array<{df.schema[order[0]].dataType.simpleString()}>")
    celled = df.withColumn("__cell", F.coalesce(F.size(F.filter(marks, lambda b: b <= number)), F.lit(0)))
    counts = celled.groupBy(*partition, "__cell").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # at most ranges rows
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*partition, "__cell").orderBy(*order)
    placed = celled.withColumn("__place", F.row_number().over(inside) - 1).join(counts, [*partition, "__cell"])
    return placed.withColumn(alias, (F.col("__before") + F.col("__place")).cast("long")).drop("__cell", "__before", "__place")


def oversampled(df: DataFrame, quotas: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """df's rows with copy (from 0) and turn: row i of a bucket of n rows is copied until the bucket's quota is met.

    quotas (bucket, n, quota). turn is the copy's place in its bucket's cyclic sequence; ordering by (turn, bucket)
    gives the round robin over buckets. Rows of buckets without a quota are dropped.
    """
    quotas = quotas.select(F.col(bucket).alias("__bucket"), F.col("n").alias("__n"), F.col("quota").alias("__quota"))
    ranked = ranked_within(df, [bucket], order, "__i")
    told = ranked.join(F.broadcast(quotas), F.col(bucket) == F.col("__bucket")).where("__i < __quota")  # a row a bucket
    copies = told.withColumn("copy", F.explode(F.expr("sequence(0L, (__quota - 1 - __i) div __n)")))
    return copies.withColumn("turn", F.col("copy") * F.col("__n") + F.col("__i")).drop("__bucket", "__n", "__quota", "__i")


def resumed(copies: DataFrame, bucket: str, turn: int, after: str) -> DataFrame:
    """What a reader of oversampled's round robin, in the order of (turn, bucket), has yet to read after the given place."""
    return copies.where((F.col("turn") > turn) | ((F.col("turn") == turn) & (F.col(bucket) > after)))


def capped(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first most rows of df by order."""
    return df.orderBy(*order).limit(most)


def quota_split(df: DataFrame, key: list[str], seed: int = 42, valid: int = 5, test: int = 5) -> DataFrame:
    """df with split: exactly n * valid div 100 and n * test div 100 rows at random, the rest train."""
    if valid < 0 or test < 0 or valid + test >= 100:
        raise ValueError("valid and test must be percentages of which train keeps some")
    ranked = global_rank(df.withColumn("__key", random_key(seed, *key)), "__key", "__rank")
    n = df.count()
    split = F.when(F.col("__rank") < n * valid // 100, "val").when(F.col("__rank") < n * valid // 100 + n * test // 100, "test")
    return ranked.withColumn("split", split.otherwise("train")).drop("__key", "__rank")


def chunk_split(df: DataFrame, file: str, order: list[str], seed: int = 42, valid: float = 0.05, test: float = 0.05, chunks: int = 500) -> DataFrame:
    """df with chunk and split: a file's rows in order, in chunks of a chunks-th of it, each chunk in one split at random."""
    if not (0 <= valid <= 1 and 0 <= test <= 1 and valid + test <= 1):
        raise ValueError("valid and test must be shares")
    sizes = df.groupBy(file).agg(F.greatest(F.lit(1), F.expr(f"count(*) div {chunks}")).cast("long").alias("__size"))
    ranked = ranked_within(df, [file], order, "__i").join(F.broadcast(sizes), file)  # a row a file
    ranked = ranked.withColumn("chunk", F.expr("__i div __size").cast("long"))
    draw = F.conv(F.substring(random_key(seed, file, "chunk"), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    split = F.when(draw < valid, "val").when(draw < valid + test, "test").otherwise("train")
    return ranked.withColumn("split", split).drop("__i", "__size")


def rank_shard(df: DataFrame, order: list[str], world: int, partition: list[str] | None = None) -> DataFrame:
    """df with shard: n div world consecutive rows for each rank, the remainder dropped; within partition, if given."""
    keys = partition or []
    ranked = ranked_within(df, keys, order, "__i")
    if keys:
        sizes = df.groupBy(*keys).agg(F.expr(f"count(*) div {world}").cast("long").alias("__each"))
        ranked = ranked.join(F.broadcast(sizes), keys)  # a row a file
    else:
        ranked = ranked.withColumn("__each", F.lit(df.count() // world))
    return ranked.where(F.col("__i") < F.col("__each") * world).withColumn("shard", F.expr("__i div __each").cast("long")).drop("__i", "__each")


def padded(df: DataFrame, ids: str, order: list[str], batch: int, group: list[str], filler: int) -> DataFrame:
    """df with batch and ids padded by filler to its batch's longest; batches of consecutive rows within group."""
    ranked = ranked_within(df, group, order, "__i").withColumn("batch", F.expr(f"__i div {batch}").cast("long")).drop("__i")
    width = F.max(F.size(ids)).over(Window.partitionBy(*group, "batch"))
    filled = F.concat(F.col(ids), F.array_repeat(F.lit(filler), (width - F.size(ids)).cast("int")))
    return ranked.withColumn("width", width.cast("long")).withColumn(ids, filled)


def _mass(i: Column, n: Column, skew: int) -> Column:
    """The summed weights of the rows 0 to i of n."""
    least = 1.0 / (skew * (n + 1))
    rise = (1.0 / (n + 1) - least) * (2.0 / n)
    return (i + 1) * least + rise * (i * (i + 1) / 2.0)


def _draw(group: str, seed: int) -> Column:
    return F.conv(F.substring(random_key(seed, group), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def skewed_places(group: str, n: Column, most: int, seed: int, skew: int = 4) -> Column:
    """The places i, as an array, of the rows that skewed_prefix takes of a group of n rows, where a row stands for the group."""
    n = n.cast("long")
    places = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    # Drawn once for a group: what stands inside a filter is computed for each of its elements.
    return F.flatten(F.transform(F.array(_draw(group, seed)), lambda d: F.slice(F.filter(places, lambda i: d < _mass(i, n, skew)), 1, most)))


def skewed_prefix(df: DataFrame, group: str, order: list[str], most: int, seed: int, skew: int = 4) -> DataFrame:
    """For each group up to most rows from a random place on; later places are likelier, and a group may give none.

    Adds k, the row's place in the sample, and i, its place in the group, where df has no i of its own; both from 0.

    Of a group of n rows, row i has weight 1/(skew(n+1)) + 2i/n (1/(n+1) - 1/(skew(n+1))); one draw, the hash of seed
    and group, and the first row at which the summed weights pass it starts the sample.
    """
    w = Window.partitionBy(group).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(group))
    ranked = df.withColumn("__i", (F.row_number().over(w) - 1).cast("long")).withColumn("__n", n)
    fired = ranked.where(_draw(group, seed) < _mass(F.col("__i"), F.col("__n"), skew)).withColumn("k", (F.row_number().over(w) - 1).cast("long")).where(F.col("k") < most)
    return (fired if "i" in df.columns else fired.withColumn("i", F.col("__i"))).drop("__n", "__i")
