"""Mixing sources to target weights by a Pfair schedule of blocks.

A source's rows, in hash order, are packed into blocks of equal bytes. Target weights are rounded to whole blocks in a
cycle of slots; block k of a source with c blocks in a cycle of q slots is released at floor(k q / c) and due at
ceil((k + 1) q / c), and the earliest deadline among the released goes next. Weights fill the cycle exactly, so every
block meets its window and, while no source has run out, each source is within one block of its share at every slot.
The schedule repeats from cycle to cycle: only one cycle is worked out, whatever the data's size. That is done on the
driver, which so holds a row a source and four slots a source; every source has a weight of its own.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm.common import materialize, read, sized
from plyforge.llm.sharding import row_size

BLOCK_BYTES = 256 * 1024
#: Slots of a cycle at least; four times the number of sources if that is more.
CYCLE = 1024
#: Default targets are byte shares to this power: small sources weigh more than their share.
TEMPER = 0.7
#: Rows that are put in order together, on average.
CELL_ROWS = 2000


def blocks_in_cycle(weights: dict[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Whole blocks of each source in a cycle: one each, then largest remainders; they fill the cycle exactly."""
    names = sorted(weights)
    cycle, total = max(cycle, 4 * len(names)), sum(weights.values())
    exact = {s: weights[s] / total * cycle if total > 0 else cycle / len(names) for s in names}
    counts = {s: max(1, int(exact[s])) for s in names}
    by_rest = sorted(names, key=lambda s: (counts[s] - exact[s], s))
    spare = cycle - sum(counts.values())
    for s in by_rest[: max(0, spare)]:
        counts[s] += 1
    # The floor of one took too many: those furthest over their share give them back, the last name first among equals.
    over = [(exact[s] - counts[s], i, s) for i, s in enumerate(reversed(names)) if counts[s] > 1]
    heapq.heapify(over)
    for _ in range(sum(counts.values()) - cycle):
        _, i, s = over[0]
        counts[s] -= 1
        heapq.heapreplace(over, (exact[s] - counts[s], i, s)) if counts[s] > 1 else heapq.heappop(over)
    return counts


def pfair(counts: dict[str, int]) -> list[tuple[str, int]]:
    """The (source, block) of each slot of a cycle: earliest deadline first among the released blocks, then the least name."""
    cycle = sum(counts.values())
    names = sorted(counts)
    waiting = [(0, -(-cycle // counts[s]), i, 0) for i, s in enumerate(names)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots = []
    for t in range(cycle):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, i, k = heapq.heappop(ready)
        c = counts[names[i]]
        slots.append((names[i], k))
        if k + 1 < c:
            heapq.heappush(waiting, ((k + 1) * cycle // c, -(-(k + 2) * cycle // c), i, k + 1))
    return slots


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, cycle: int = CYCLE) -> DataFrame:
    """(doc_id, source, text_hash, size, block, slot, position, on_target) of each row of docs (doc_id, text, source).

    position (from 0, gapless) is the row's place in the mix. A row is in the block in which its first byte falls.
    on_target: no source has run out before the row's slot; who wants the targets to hold for the whole mix takes these
    rows only.
    weights: targets by source; sources that it lacks share the weight of the least. None: byte shares to the power
    TEMPER. Every row is used once: when a source runs out, the others go on in proportion. A null source counts as
    the empty name, a null text as empty. Rows that are equal in doc_id, text and source lie next to each other in
    their source. Other columns are ignored, whatever their names. No rows: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.xxhash64(text).alias("text_hash"), row_size().alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"),
    )
    # Equal rows are one row with their number until the end, so that no cell fills up with copies.
    slim = materialize(slim.groupBy("doc_id", "source", "text_hash", "size", "h").agg(F.count("*").alias("copies")), "mix")
    sums = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.count("*").alias("n")).collect()  # a row a source
    if not sums:
        own_weights = {"": 1.0}
    elif weights is None:
        own_weights = {r.source: float(r.bytes) ** TEMPER for r in sums}
    else:
        own_weights = {r.source: weights.get(r.source, min(weights.values(), default=1.0)) for r in sums}
    counts, rows_of = blocks_in_cycle(own_weights, cycle), {r.source: r.n for r in sums}
    slots = pfair(counts)
    cycle = len(slots)
    plan = spark.createDataFrame(pa.table({"source": [s for s, _ in slots], "k": pa.array([k for _, k in slots], pa.int64()), "t": pa.array(range(cycle), pa.int64())}))
    names = list(counts)
    sources = spark.createDataFrame(
        pa.table({"source": names, "cells": pa.array([-(-rows_of.get(s, 1) // CELL_ROWS) for s in names], pa.int64()), "per_cycle": pa.array([counts[s] for s in names], pa.int64())})
    )

    # Offsets inside each source: cells by hash, their totals prefix-summed, running sums inside the cells.
    rows = slim.join(sized(sources), "source").withColumn("cell", F.expr("pmod(h, cells)")).withColumn("bytes", F.col("size") * F.col("copies"))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("source", "cell").agg(F.sum("bytes").alias("bytes"))
    cells = cells.select("source", "cell", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("cell_start"))
    inside = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(cells, ["source", "cell"])
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1L)")))
    rows = rows.withColumn("start", F.expr("cell_start + first + copy * size")).withColumn("block", F.expr(f"start div {block_bytes}L"))
    rows = rows.withColumn("k", F.expr("block % per_cycle")).withColumn("turn", F.expr("block div per_cycle"))
    placed = rows.join(sized(plan), ["source", "k"])
    placed = materialize(placed.select("doc_id", "source", "text_hash", "size", "block", "turn", "t", "start"), "placed")

    # Positions: rows of the cycles before, of the slots before in the cycle, and before in the slot.
    per_slot = placed.groupBy("turn", "t").agg(F.count("*").alias("n"))
    per_turn = per_slot.groupBy("turn").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_turn = per_turn.select("turn", before(Window.orderBy("turn")).alias("turn_rows"))  # a row for cycle * block_bytes of input
    per_slot = per_slot.select("turn", "t", before(Window.partitionBy("turn").orderBy("t")).alias("slot_rows")).join(per_turn, "turn")
    inside = F.row_number().over(Window.partitionBy("turn", "t").orderBy("source", "start")) - 1
    slot = F.col("turn") * cycle + F.col("t")
    full = placed.groupBy("source").agg(F.max(slot).alias("last")).agg(F.min("last")).first()[0]  # one number
    out = placed.withColumn("i", inside).join(per_slot, ["turn", "t"])
    return out.select(
        "doc_id", "source", "text_hash", "size", "block", slot.alias("slot"),
        (F.col("turn_rows") + F.col("slot_rows") + F.col("i")).cast("long").alias("position"), (slot <= F.lit(full)).alias("on_target"),
    )


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of documents without the texts' hashes; nulls, repeated rows and an empty table as in mix."""
    return mix(read(spark, sf_dir, "documents")).drop("text_hash")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: all documents, in the order of the mix: files, and rows in them, follow position.

    Rows that repeat an id and text stay together at the first one's position. The order is the files', as the stage
    returns the columns of documents and so has none for the position. Nulls, empty tables and clashing names: see mix.
    """
    places = materialize(mix(docs).groupBy("doc_id", "text_hash").agg(F.min("position").alias("position")), "places")
    places = places.select(F.col("doc_id").alias("__mix_id"), F.col("text_hash").alias("__mix_text"), F.col("position").alias("__mix_position"))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    placed = docs.join(sized(places), docs["doc_id"].cast("long").eqNullSafe(F.col("__mix_id")) & (text == F.col("__mix_text")))
    return placed.repartitionByRange("__mix_position").sortWithinPartitions("__mix_position").select(*docs.columns)
