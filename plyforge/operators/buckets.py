"""Histograms over ratings and times, bucket counts and quotas, and threshold roll-ups of bucket trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.parse import bucket_plus, bucket_value


def bin_index(value: Column, edges: list[float]) -> Column:
    """The bin of a value: half-open bins, the last one closed; null outside the edges and for null and NaN."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low, high = F.lit(edges[i]), F.lit(edges[i + 1])
        inside = (value >= low) & ((value <= high) if i == len(edges) - 2 else (value < high))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return F.when(~F.isnan(value.cast("double")), out)


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, low, high, n) for every bin, empty ones included; values outside the edges are dropped."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    counts = df.select(bin_index(F.col(value), edges).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def adjusted_edges(edges: list[float], most: float | None) -> list[float]:
    """Edges that start at 0 and end one above the greatest value; those at or above that are dropped."""
    out = [0.0, *edges] if edges and edges[0] > 0 else list(edges)
    if most is None:
        return out
    return [e for e in out if e < most + 1] + [most + 1]


def pair_matrix(df: DataFrame, first: str, second: str, edges: list[float]) -> DataFrame:
    """(i, j, n): the 2-D histogram folded onto its lower triangle, n(i, j) + n(j, i) for i > j; sparse."""
    cells = df.select(bin_index(F.col(first), edges).alias("a"), bin_index(F.col(second), edges).alias("b")).where("a is not null and b is not null")
    return cells.groupBy(F.greatest("a", "b").alias("i"), F.least("a", "b").alias("j")).agg(F.count("*").alias("n"))


def classed_histogram(df: DataFrame, value: str, klass: Column, edges: list[float]) -> DataFrame:
    """(class, bin, n) of values by a class column; rows without a class or bin are dropped."""
    return (
        df.select(klass.alias("class"), bin_index(F.col(value), edges).alias("bin"))
        .where("class is not null and bin is not null")
        .groupBy("class", "bin")
        .agg(F.count("*").alias("n"))
    )


def bucket_counts(df: DataFrame, bucket: list[str], condition: Column, least: int = 1) -> DataFrame:
    """(bucket..., n): rows that meet the condition by bucket, buckets with fewer than least dropped."""
    return df.where(condition).groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def quotas(counts: DataFrame, repeats: int) -> DataFrame:
    """counts with quota: the largest bucket's count, or repeats times the bucket's own if that is less."""
    most = F.max("n").over(Window.partitionBy(F.lit(0)))  # counts has a row a bucket
    return counts.withColumn("quota", F.least(most, F.col("n") * repeats))


def rolled_up(outer: Column, inner: Column, threshold: int) -> tuple[Column, Column]:
    """The target buckets of a two-level tree rolled up at a threshold; null where the tree drops a bucket.

    Outer buckets up to the threshold keep their name, those above it, and the threshold's own +, become threshold+;
    a + bucket below the threshold is dropped. Inner buckets in a kept outer one stay below the threshold or at it
    without +, and become threshold+ above; in the rolled-up outer one a + below the threshold is dropped as well.
    """
    plus_name = F.lit(f"{threshold}+")
    ov, op, iv, ip = bucket_value(outer), bucket_plus(outer), bucket_value(inner), bucket_plus(inner)
    above = (ov > threshold) | ((ov == threshold) & op)
    keeps = (ov <= threshold) & ~op
    new_outer = F.when(keeps, outer).when(above, plus_name)
    inner_kept = F.when((iv == threshold) & ~ip, inner).when(iv >= threshold, plus_name).otherwise(inner)
    inner_above = F.when((iv <= threshold) & ~ip, inner).when(iv >= threshold, plus_name)
    new_inner = F.when(iv.isNotNull(), F.when(keeps, inner_kept).when(above, inner_above))
    whole = new_outer.isNotNull() & new_inner.isNotNull()
    return F.when(whole, new_outer), F.when(whole, new_inner)


def merge_buckets(df: DataFrame, outer: str, inner: str, threshold: int) -> DataFrame:
    """df with its bucket columns rolled up, rows of dropped buckets left out. Applying it again changes nothing."""
    a, b = rolled_up(F.col(outer), F.col(inner), threshold)
    return df.withColumn("__o", a).withColumn("__i", b).where("__o is not null").withColumn(outer, F.col("__o")).withColumn(inner, F.col("__i")).drop("__o", "__i")


def merge_plan(df: DataFrame, outer: str, inner: str, threshold: int) -> DataFrame:
    """The dry run: (outer, inner, to_outer, to_inner, n) by source bucket; null targets are dropped buckets."""
    counts = df.groupBy(F.col(outer).alias("outer"), F.col(inner).alias("inner")).agg(F.count("*").alias("n"))
    to_outer, to_inner = rolled_up(F.col("outer"), F.col("inner"), threshold)
    return counts.select("outer", "inner", to_outer.alias("to_outer"), to_inner.alias("to_inner"), "n")


def whiten_params(df: DataFrame, *columns: str) -> DataFrame:
    """(n, mean, std): over the union of the columns, std with n - 1."""
    values = df.select(F.explode(F.array(*(F.col(c).cast("double") for c in columns))).alias("x")).where("x is not null")
    return values.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
