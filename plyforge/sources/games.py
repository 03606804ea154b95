"""Reading game dumps and bucket trees; writing buckets, splits, texts and metadata."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.parse import bucket_of_path, bucket_plus, bucket_value

GAME_SCHEMA = (
    "moves string, clk string, eval string, result tinyint, welo smallint, belo smallint, white string, black string, timeCtl smallint, increment smallint"
)
#: Records of a dump begin with this header; readers cut there, which takes it off all records but a file's first.
RECORD = "\n\n[Event "
#: Upper bounds of the rating buckets that ingest writes.
BUCKETS = list(range(1000, 3001, 100))


def _header(record: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(record, rf'\[{name} "([^"]*)"\]', 1), F.lit(""))


def parsed(records: DataFrame, column: str = "value") -> DataFrame:
    """Games of GAME_SCHEMA from the text records of a dump; records without moves are dropped."""
    r = F.col(column)
    body = F.regexp_extract(r, r"(?s)\n\n(.*)$", 1)
    bare = F.regexp_replace(body, r"\{[^}]*\}|\([^)]*\)|\$\d+|\d+\.+|[!?]+|(1-0|0-1|1/2-1/2|\*)\s*$", " ")
    moves = F.array_join(F.filter(F.split(bare, r"\s+"), lambda m: m != ""), " ")
    clocks = F.transform(
        F.regexp_extract_all(body, F.lit(r"%clk (\d+:\d+:\d+)"), F.lit(1)),
        lambda c: (F.split(c, ":")[0].cast("int") * 3600 + F.split(c, ":")[1].cast("int") * 60 + F.split(c, ":")[2].cast("int")).cast("string"),
    )
    evals = F.regexp_extract_all(body, F.lit(r"%eval ([^\]\s]+)"), F.lit(1))
    code = F.create_map(*(F.lit(x) for pair in (("1-0", 0), ("0-1", 1), ("1/2-1/2", 2)) for x in pair))
    control = _header(r, "TimeControl")
    number = lambda c: c.try_cast("smallint")
    return records.select(
        moves.alias("moves"),
        F.nullif(F.array_join(clocks, " "), F.lit("")).alias("clk"),
        F.nullif(F.array_join(evals, " "), F.lit("")).alias("eval"),
        F.element_at(code, F.coalesce(_header(r, "Result"), F.lit("*"))).cast("tinyint").alias("result"),
        number(_header(r, "WhiteElo")).alias("welo"),
        number(_header(r, "BlackElo")).alias("belo"),
        _header(r, "White").alias("white"),
        _header(r, "Black").alias("black"),
        number(F.regexp_extract(control, r"^(\d+)\+\d+$", 1)).alias("timeCtl"),
        number(F.regexp_extract(control, r"^\d+\+(\d+)$", 1)).alias("increment"),
    ).where("moves <> ''")


def accepted(games: DataFrame, min_seconds: int = 60, max_seconds: int = 10800, max_increment: int = 600) -> DataFrame:
    """Decided or drawn games with both ratings and a time control in range."""
    return games.where(
        F.col("timeCtl").between(min_seconds, max_seconds) & (F.col("increment") <= max_increment) & F.col("result").isNotNull() & F.col("welo").isNotNull() & F.col("belo").isNotNull()
    )


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Games of text dumps, compressed or not. A compressed file is one task until it is parsed."""
    return parsed(spark.read.option("lineSep", RECORD).text(path))


def bucket_name(rating: Column, edges: list[int] = BUCKETS) -> Column:
    """The least edge that a rating doesn't exceed; the last one with a + beyond it."""
    out = F.lit(f"{edges[-1]}+")
    for e in reversed(edges):
        out = F.when(rating <= e, F.lit(str(e))).otherwise(out)
    return F.when(rating.isNotNull(), out)


def write_buckets(games: DataFrame, path: str, edges: list[int] = BUCKETS, mode: str = "append") -> None:
    """Partitions w_bucket / b_bucket; rows of a bucket are brought together first, large buckets in several files."""
    named = games.withColumn("w_bucket", bucket_name(F.col("welo"), edges)).withColumn("b_bucket", bucket_name(F.col("belo"), edges))
    named.hint("rebalance", "w_bucket", "b_bucket").write.mode(mode).partitionBy("w_bucket", "b_bucket").parquet(path)


def read_bucket_tree(spark: SparkSession, root: str, max_group: int | None = None) -> DataFrame:
    """All Parquet files below root in two levels of bucket directories, with w_bucket and b_bucket; buckets above max_group are left out.

    Reads <white>/<black>/*.parquet as well as what write_buckets, ingest and merge write
    (w_bucket=<white>/b_bucket=<black>/..., below batch=<n> or not). Directories that aren't named like buckets are
    skipped. Raises where there is no such folder, or no file in it.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    w, b = bucket_of_path(F.col("_metadata.file_path"), 1), bucket_of_path(F.col("_metadata.file_path"), 2)
    out = files.select("*", w.alias("w_bucket"), b.alias("b_bucket"))
    out = out.where(bucket_value(F.col("w_bucket")).isNotNull() & bucket_value(F.col("b_bucket")).isNotNull())
    if max_group is not None:
        out = out.where((bucket_value(F.col("w_bucket")) <= max_group) & (bucket_value(F.col("b_bucket")) <= max_group))
    return out


def bucket_catalog(tree: DataFrame) -> DataFrame:
    """(w_bucket, b_bucket, n) in numeric order."""
    counts = tree.groupBy("w_bucket", "b_bucket").agg(F.count("*").alias("n"))
    return counts.orderBy(*(x for c in ("w_bucket", "b_bucket") for x in (bucket_value(F.col(c)), bucket_plus(F.col(c)))))


def read_recursive(spark: SparkSession, root: str, skip_unreadable: bool = False) -> DataFrame:
    """All Parquet files below root; skip_unreadable: without those that can't be read, see unreadable."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.option("ignoreCorruptFiles", str(skip_unreadable).lower()).parquet(root)


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes) of the Parquet files below root of which read_recursive has no row: broken or empty ones."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    path = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    read = read_recursive(spark, root, True).select(path(F.col("_metadata.file_path")).alias("__read")).distinct()
    return there.join(read, path(F.col("file")) == F.col("__read"), "left_anti")


def row_count(spark: SparkSession, root: str) -> int:
    """The rows of all Parquet files below root, from their footers: no column is read."""
    return read_recursive(spark, root).count()


def write_splits(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """One directory a split; rows_per_file 0: as many as come."""
    writer = df.write.mode("overwrite").partitionBy("split")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).write.mode("overwrite").text(path)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    out = jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def move(spark: SparkSession, old: str, new: str, overwrite: bool = False) -> None:
    """Renames a file or folder, making the folders above new; overwrite replaces a file in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (source, _), (target, store) = _path(spark, old), _path(spark, new)
    store.mkdirs(target.getParent())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if overwrite else option.NONE
    where = target.makeQualified(store.getUri(), store.getWorkingDirectory())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(source, where, options)


def path_below(spark: SparkSession, file: Column, root: str) -> Column:
    """The part of a file's path (as _metadata.file_path gives it) below the folder root."""
    where, store = _path(spark, root)
    whole = re.sub("^file:/+", "file:/", where.makeQualified(store.getUri(), store.getWorkingDirectory()).toString().rstrip("/")) + "/"
    plain = F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return F.when(F.startswith(plain, F.lit(whole)), F.substring(plain, len(whole) + 1, 1 << 30)).otherwise(F.regexp_extract(plain, "([^/]*)$", 1))


def unfold(spark: SparkSession, fresh: str, out: str, column: str) -> None:
    """Moves the folders fresh/<split>/<column>=<path> to out/<split>/<path>, in place of what was in out."""
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    (source, store), (target, _) = _path(spark, fresh), _path(spark, out)
    store.delete(target, True)
    for split in store.listStatus(source):
        if split.isDirectory():
            for folder in store.listStatus(split.getPath()):
                below = unescape(folder.getPath().getName().removeprefix(f"{column}="))
                move(spark, folder.getPath().toString(), f"{out.rstrip('/')}/{split.getPath().getName()}/{below}")
    store.delete(source, True)


def update_metadata(spark: SparkSession, path: str, **values) -> dict:
    """Adds values to the one-line JSON document at path and returns it.

    The new one is written beside and then takes the old one's place in one rename, so that a crash leaves either.
    """
    file, store = _path(spark, path)
    known = json.loads(spark.read.text(path, wholetext=True).first()[0]) if store.exists(file) else {}
    known |= values
    fresh, _ = _path(spark, f"{path}.new")
    out = store.create(fresh, True)
    out.write(bytearray(json.dumps(known).encode()))
    out.close()
    move(spark, f"{path}.new", path, overwrite=True)
    return known


#: Values of an array that a task holds at a time.
BLOCK_VALUES = 1 << 20


def read_blocks(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """(blk, pos, value) of the flat integer arrays root/block-*/name.npy; of two-dimensional ones (blk, pos, *columns).

    pos counts values, or rows, from 0; columns can't be named blk or pos. Files are listed, and cut into ranges that tasks read by themselves through the
    file system of their URI, so that their size is not bounded.
    """
    import numpy as np

    width = len(columns) if columns else 1
    listed = spark.read.format("binaryFile").load(f"{root}/block-*/{name}.npy").select("path", "length")
    ranges = listed.select("path", F.explode(F.expr(f"sequence(0L, length div {BLOCK_VALUES // width}L)")).alias("part")).repartition("path", "part")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_file(where) as f:
                    version = np.lib.format.read_magic(f)
                    header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                    shape, fortran, kind = header(f)
                    if fortran or kind.kind not in "iu" or (shape[1:] or (1,)) != (width,):
                        raise ValueError(f"{path}: {kind} array of shape {shape}, not {width} integers a row")
                    each = BLOCK_VALUES // width
                    count = max(0, min(each, shape[0] - part * each))
                    if not count:
                        continue
                    f.seek(f.tell() + part * each * width * kind.itemsize)
                    values = np.frombuffer(f.read(count * width * kind.itemsize), kind).reshape(count, width).astype(np.int64)
                blk = re.search(r"(block-[^/]*)/[^/]*$", path)[1]
                at = part * each
                cols = [pa.array([blk] * count, pa.string()), pa.array(np.arange(at, at + count)), *(pa.array(values[:, k].copy()) for k in range(width))]
                yield pa.RecordBatch.from_arrays(cols, ["blk", "pos", *(columns or ["value"])])

    return ranges.mapInArrow(rows, ", ".join(["blk string", "pos long", *(f"{c} long" for c in columns or ["value"])]))
