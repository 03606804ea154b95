"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are range-partitioned and sorted; each partition's bytes and rows are totalled, the totals (one row a partition)
are prefix-summed, and every row's global offset is its partition's plus a running sum inside it. Shards are cut at
equal targets of the whole. Only narrow columns move: texts stay where they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm.common import materialize, read

SHARDS = 8


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text, none for null, plus one."""
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long")


def offsets(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """rows with before (bytes of the rows before it in order, all rows), total (bytes of all) and rank (from 0).

    Rows that tie in order are placed in any order among themselves. Columns part, part_bytes and part_rows are reserved.
    """
    parts = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    held = materialize(parts.withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = held.groupBy("part").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("part_rows"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order, "tie")
    running = held.withColumn("before", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = running.withColumn("rank", F.row_number().over(inside) - 1)
    return (
        running.join(F.broadcast(totals), "part")
        .withColumn("before", F.col("before") + F.col("part_bytes"))
        .withColumn("rank", (F.col("rank") + F.col("part_rows")).cast("long"))
        .drop("part", "tie", "part_bytes", "part_rows")
    )


def byte_shards(rows: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """rows (with size, a long over 0) and shard (int), slot (long, gapless from 0 in each shard).

    A row goes to the shard in whose share of all bytes its middle lies, so shards are contiguous in order and differ
    from total / shards by less than the sizes of the rows at their two ends. A row over a whole share leaves shards
    empty. No rows: no rows.
    """
    middle = 2 * F.col("before") + F.col("size")
    cut = materialize(
        offsets(rows, order).withColumn("shard", F.expr(f"cast((2 * before + size) * {shards} div (2 * total) as int)")).drop("before", "total"), "shards"
    )
    first = cut.groupBy("shard").agg(F.min("rank").alias("first"))  # a row a shard
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first")).drop("rank", "first")


def _result(rows: DataFrame, order: list[str], *extra: str) -> DataFrame:
    out = byte_shards(rows, order)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *extra
    )


def _slim(docs: DataFrame, *extra: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_size().alias("size"), F.crc32(text).alias("text_crc32"), *extra)


def op2_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in the order of doc_id (null first), then checksum and size. A null text counts as empty."""
    return _result(_slim(read(spark, sf_dir, "documents")), ["doc_id", "text_crc32", "size"])


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the shard and slot of each document, contiguous in the order in which the files hold the rows.

    That order is the mixing stage's. Rows that don't come from files are taken in the order of doc_id.
    """
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    try:
        rows = _slim(docs, F.col("source"), F.when(number != "", number.cast("long")).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("line"))
    except AnalysisException:
        return _result(_slim(docs, F.col("source")), ["doc_id", "text_crc32", "size"], "source")
    return _result(rows, ["file", "path", "line"], "source")
