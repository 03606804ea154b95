"""Incremental ingest of dumps with a ledger, and event-time windows, as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plyforge.sources.games import RECORD, accepted, parsed, write_buckets


def ingest(spark: SparkSession, landing: str, out: str, ledger: str, checkpoint: str, files_per_batch: int = 2, poll: str | None = None, min_seconds: int = 60, archive: str | None = None) -> StreamingQuery:
    """Parses dumps that land in a folder into bucketed games, each file once.

    The checkpoint remembers the files, files_per_batch bounds what is read ahead, poll (as "60 seconds") keeps the query
    running and None ends it when nothing is left. A batch overwrites its own directories only, so that a batch that is
    run again after a failure leaves no duplicates. The ledger has (batch, file, ngames). archive: a folder outside
    landing that files which an earlier batch took are moved to; "delete" deletes them; None leaves them.
    """
    stream = spark.readStream.format("text").option("lineSep", RECORD).option("maxFilesPerTrigger", files_per_batch)
    if archive == "delete":
        stream = stream.option("cleanSource", "delete")
    elif archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    stream = stream.load(landing)

    def load(batch: DataFrame, number: int) -> None:
        games = accepted(parsed(batch.select("value", F.col("_metadata.file_name").alias("file")).select("value")), min_seconds)
        write_buckets(games, f"{out}/batch={number}", mode="overwrite")
        counts = batch.select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count("*").alias("ngames"))
        counts.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    writer = stream.select("value", "_metadata").writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def remaining(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """The work list's files (file) that the ledger doesn't have, newest first."""
    return work.join(ledger.select("file").distinct(), "file", "left_anti").orderBy(F.desc("file"))


def landed(work: DataFrame, on_disk: DataFrame, downloaded: DataFrame) -> DataFrame:
    """Files of the work list that are there and were fetched completely."""
    return work.join(on_disk.select("file"), "file", "left_semi").join(downloaded.select("file"), "file", "left_semi")


def totals(ledger: DataFrame, work: DataFrame) -> DataFrame:
    """(files, games, share): the ledger's different files, its games, and the files' share of the work list."""
    per = ledger.groupBy("file").agg(F.sum("ngames").alias("ngames")).agg(F.count("*").alias("files"), F.sum("ngames").alias("games"))
    return per.select("files", "games", (F.col("files") / F.lit(work.count())).alias("share"))


def run_until(spark: SparkSession, query: StreamingQuery, marker: str, seconds: int = 1) -> None:
    """Waits for the query's end, and stops it once there is a file marker. A batch that is stopped is run again by the next start."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marker)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while not query.awaitTermination(seconds):
        if store.exists(path):
            query.stop()


def progress(query: StreamingQuery) -> dict:
    """Rows and rows a second of the last batch; empty before the first."""
    last = query.lastProgress
    return {} if not last else {"batch": last["batchId"], "rows": last["numInputRows"], "rows_per_second": last["processedRowsPerSecond"]}


def windowed(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    """(start, keys..., n, total) by tumbling event-time windows; for streams, events later than late are dropped."""
    w = F.window(time, width)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n) of sessions: a key's events with less than gap between them."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
