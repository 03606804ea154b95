"""What the operators of this subpackage share: table reading, lineage cuts, size-checked joins, cells, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a broadcast table may hold, by its rows' measured size.
BROADCAST_BYTES = 32 << 20
#: Rows, and code points of their texts, that a cell's task compares with each other; larger cells are dealt in blocks.
CELL_ROWS, CELL_CHARS = 4096, 16 << 20
#: Pairs that a task looks at together.
PAIRS = 1 << 21
#: Bytes of a text whose words are held in Python at a time.
PIECE_BYTES = 1 << 22
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on a local master (tests), a temporary one is set."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_to:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='plyforge-')}"
        sc.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class _Made(threading.local):
    """The tables and folders that a thread has made and that are still there."""

    def __init__(self) -> None:
        self.paths: set[str] = set()


MADE = _Made()


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under the application's id; removed when this process ends."""
    path = f"{shared_dir(spark)}/plyforge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    MADE.paths.add(path)

    def gone():
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(gone)
    return path


def made() -> set[str]:
    return set(MADE.paths)


def drop_made(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Delete what this thread has made since made() was before, but for the tables keep."""
    for path in MADE.paths - before - {getattr(df, "_plyforge_path", None) for df in keep}:
        delete_path(spark, path)
        MADE.paths.discard(path)


def word_pieces(data: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words (runs without ASCII white space) of a text's bytes, those of some size bytes at a time."""
    size, at = size or PIECE_BYTES, 0
    while len(data) - at > size:
        cut = BLANK.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()].split()
        at = cut.end()
    yield (data[at:] if at else data).split()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and lost executors cost nothing.

    The schema is kept, as Parquet readers would otherwise forget nothing but nullability.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plyforge_path = path
    return out


def drop_table(df: DataFrame) -> None:
    if path := getattr(df, "_plyforge_path", None):
        delete_path(df.sparkSession, path)
        MADE.paths.discard(path)


def least_hashes(rows: DataFrame, most: int) -> pd.DataFrame:
    """The most rows (a bound that callers document) of the least h, a long that is a hash; in its order, without rows whose h is null."""
    n = rows.count()
    if n > most:  # the hashes' spread tells near enough where the last one lies: few others are sorted
        rows = rows.where(F.col("h") <= F.lit(min((1 << 63) - 1, int(((most + 6 * most**0.5 + 20) / n) * 2**64) - (1 << 63))))
    return rows.orderBy("h").limit(most).toPandas()


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row of df in a hash table: 16, 8 a column, and what strings and arrays hold."""

    def more(c: Column, t: T.DataType) -> list[Column]:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return [F.coalesce(F.octet_length(c), F.lit(0))]
        if isinstance(t, T.ArrayType):
            inner = F.octet_length(F.array_join(c, "")) if isinstance(t.elementType, T.StringType) else F.lit(0)
            return [F.coalesce(F.size(c) * 16 + inner, F.lit(0))]
        if isinstance(t, T.StructType):
            return [F.lit(8 * len(t)), *(x for f in t for x in more(c[f.name], f.dataType))]
        return []

    out = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        for x in more(F.col(f"`{f.name}`"), f.dataType):
            out = out + x
    return out


def sized(small: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if its rows, measured here, take most bytes at most; else with one for a shuffled join.

    small should be a materialized table. Without the second hint Spark might broadcast by the files' size, which says
    little about rows that compress well.
    """
    held = small.agg(F.sum(row_bytes(small))).first()[0] or 0
    return F.broadcast(small) if held <= most else small.hint("merge")


def dealt(rows: DataFrame, size: Column | None = None, more: DataFrame | None = None) -> DataFrame:
    """rows (key, id, filed, ...), once each, joined with more (id, ...), as tasks want them: a partition holds whole blocks, sorted by (key, block, filed first).

    A key's rows are one block (0) while they are CELL_ROWS at most, with CELL_CHARS in all by size. A larger key's rows
    are cut into g cells by the hash of id, and a block for each two cells, or one and itself, gets the rows of both: any two rows
    of a key meet in a block, and no task holds more than two cells. rows should be a materialized table.
    """
    big = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(size if size is not None else F.lit(0)).alias("chars"))
    big = big.select("key", F.ceil(F.greatest(F.col("n") / CELL_ROWS, F.col("chars") / CELL_CHARS)).cast("long").alias("g")).where("g > 1")
    with_g = rows.join(sized(materialize(big, "large-keys")), "key", "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("g", F.lit(1).cast("long"))))
    blocks = F.expr("if(g is null, array(0L), transform(sequence(0L, g - 1L), j -> least(own, j) * g + greatest(own, j)))")
    out = with_g.withColumn("block", F.explode(blocks)).drop("g", "own")
    out = out if more is None else out.join(more, "id")
    return out.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("filed"))


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches with columns key and block as tables that hold all rows of their blocks."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))
        if len(cut):
            yield table.slice(0, cut[-1] + 1)
            held = table.slice(cut[-1] + 1)
        else:
            held = table
    if held is not None:
        yield held


def pairs_in_blocks(key: np.ndarray, block: np.ndarray, filed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i > j, of all pairs of rows of one block with j filed; some PAIRS at a time. Filed rows are a block's first."""
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)[run]
    partners = np.minimum(np.arange(len(key)) - start, np.bincount(run, filed).astype(np.int64)[run])
    total = np.cumsum(partners)
    at = 0
    while at < len(key):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = partners[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + start[i]
        yield i, j
        at = end


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each node's representative, one that represents itself) after the nodes a[k] and b[k] are joined, for all k."""
    parent = np.arange(len(label))
    a, b = label[a], label[b]
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent[label]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which links (a[k], b[k]) join nodes that label and the links taken so far leave apart, and the new label.

    The links taken are a spanning forest: every class takes its first link to another one (Boruvka's algorithm).
    """
    taken, on = [], np.arange(len(a))
    while len(on := on[label[a[on]] != label[b[on]]]):
        first = np.full(len(label), len(a))
        np.minimum.at(first, label[a[on]], on)
        np.minimum.at(first, label[b[on]], on)
        picked = np.unique(first[first < len(a)])
        taken.append(picked)
        label = join_labels(label, a[picked], b[picked])
    return (np.concatenate(taken) if taken else np.zeros(0, np.int64)), label


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected edges (a, b), of any type, as rows (id, root), root the least id of each component.

    Alternating large-star and small-star steps, each written to the shared folder; every step keeps one edge for
    each node and star at most, so hubs need no task of their own beyond a join that adaptive execution splits.
    Ends when a step changes nothing. No edges: no rows.
    """
    links = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )
    before = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = materialize(small, name)
        # A star forest is the fixed point; row count and two sums of hashes tell it from any other step.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        drop_table(links)
        links = after
        if state == before or state[0] == 0:
            break
        before = state
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def running(df: DataFrame, cell: list[str], order: list, value: str, alias: str) -> DataFrame:
    """alias: the sum of value over the rows of the same cell that come before, in order."""
    w = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(alias, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))
