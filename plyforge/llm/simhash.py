"""SimHash near-duplicate detection with a segment-popcount embedding.

Fingerprints are 64-bit SimHashes of 3-word shingles. Each fingerprint is embedded as the vector of its 32 two-bit
segments' bit counts. The Manhattan distance of two such vectors never exceeds the fingerprints' Hamming distance, so
links within 3 bits lie within 3 in the embedding, and, as the vector has two halves, within 1 in one half at least.
The range join is therefore a grid (cells of width 1 of the half vectors): every fingerprint is filed in the cells of
its two halves and probes the cells one step up, so that the pair with the lower count finds the other. Cells in which
two fingerprints meet are compared in tasks: pairs over 3 in the Manhattan distance of the whole vectors are out, the
others are verified by the exact Hamming distance, and of the links of a cell a spanning forest leaves the task. So
the links that are kept grow with the fingerprints, not with the pairs of a group, and connect the same classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import components, dealt, forest, materialize, pairs_in_blocks, read, sized, whole_blocks, word_pieces

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Row b holds the bits of the byte b, most significant first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
BYTE = np.arange(8, dtype=np.int64) * 256
#: The lower bit of each segment.
LOWS = np.uint64(0x5555555555555555)


def _votes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """How many of the shingles' hashes have each bit, most significant first."""
    n = len(words) - shingle + 1
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(flat[s:e], seed) for s, e in zip(starts, ends, strict=True)]), np.uint8).reshape(n, 8)
    return (np.bincount((hashes + BYTE).ravel(), minlength=2048).reshape(8, 256).astype(np.float64) @ BITS).ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 for a null text or one without words.

    Long texts are taken piece by piece, each with the last words of the one before.
    """
    votes, n, last = np.zeros(64), 0, []
    # Of bytes: only A-Z change case, and white space is ASCII's.
    for words in word_pieces(text.encode("utf-8", "surrogatepass").lower()) if text else ():
        last += words
        if len(last) >= shingle:
            votes += _votes(last, shingle, seed)
            n += len(last) - shingle + 1
            last = last[len(last) - shingle + 1 :]
    if not n and last:
        votes, n = _votes(last, len(last), seed), 1
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding with each segment's count 0, 1 or 2 written as 00, 01 or 11: the vectors' Manhattan distance is these words' Hamming distance."""
    low, high = fp & LOWS, fp >> np.uint64(1) & LOWS
    return (low | high) | (low & high) << np.uint64(1)


def _links(every: bool):
    """A function from blocks of cells to links (a, b): all of a block (every), or some that connect what all connect."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            fp = table.column("id").to_numpy().view(np.uint64)
            vector = unary(fp)
            names, node = np.unique(fp, return_inverse=True)
            label = np.arange(len(names))
            for i, j in pairs_in_blocks(table.column("key").to_numpy(), table.column("block").to_numpy(), table.column("filed").to_numpy(zero_copy_only=False)):
                near = np.bitwise_count(vector[i] ^ vector[j]) <= MAX_BITS
                i, j = i[near], j[near]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= MAX_BITS
                i, j = i[near], j[near]
                if not every:
                    taken, label = forest(label, node[i], node[j])
                    i, j = i[taken], j[taken]
                yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], ["a", "b"])

    return found


def in_cells(fps: DataFrame) -> DataFrame:
    """Rows (key, id, filed) of the fingerprints fps (fp) in the cells where two meet: filed in their own, the others one step up."""
    halves = fps.select("fp", F.posexplode(F.expr("array(shiftrightunsigned(fp, 32), fp & 4294967295L)")).alias("half", "x")).select(
        "fp", F.expr("(x & 1431655765L) + (shiftright(x, 1) & 1431655765L) + half * 4294967296L").alias("cell")
    )  # 16 fields of two bits: the bit counts of a half's segments; bit 32 tells the lower half
    steps = F.expr("concat(array(0L), transform(filter(sequence(0, 30, 2), i -> shiftright(cell, i) & 3L < 2L), i -> shiftleft(1L, i)))")
    rows = halves.select("cell", F.explode(steps).alias("up"), F.col("fp").alias("id")).select((F.col("cell") + F.col("up")).alias("key"), "id", (F.col("up") == 0).alias("filed"))
    met = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("filed").alias("any")).where("any and lo <> hi").select("key")
    return materialize(rows.join(sized(materialize(met, "cells")), "key"), "in-cells")


def linked_pairs(fps: DataFrame) -> DataFrame:
    """All pairs (a, b) of different fingerprints at most MAX_BITS apart, for callers who want them; fps has distinct, non-null longs fp.

    A pair that both halves find comes out twice. Their number grows with the square of a group's size: see linked_forest.
    """
    return dealt(in_cells(fps)).mapInArrow(_links(True), "a long, b long")


def linked_forest(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever linked_pairs connects; every fingerprint with a link is in one. A cell gives fewer than it has fingerprints."""
    return dealt(in_cells(fps)).mapInArrow(_links(False), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs (doc_id, text).

    component_id is the least doc_id that links reach, the row's own included. Texts without words have fingerprint
    zero and link like any other. Rows with a null doc_id are kept: they take their component's least id, or null.
    Repeated rows stay repeated. Other columns are ignored. An empty table gives no rows.
    """
    marked = materialize(with_fingerprints(docs), "fp")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(linked_forest(fps.select("fp")), "simhash")
    # A component's root is a fingerprint; its least document is the least over its fingerprints. Those without links
    # aren't in roots: they are components of their own.
    # These tables grow with the documents: the hints keep Spark from broadcasting them by their files' size. Sides that
    # meet on a key of a large group are tables of their own, so that adaptive execution can split that key.
    linked = fps.join(roots.withColumnRenamed("id", "fp").hint("merge"), "fp")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    known = materialize(roots.select(F.col("id").alias("fp"), "root").join(sized(least), "root").select("fp", "component_id"), "linked")
    of = fps.join(known.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(materialize(of, "classes").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each group of near duplicates one document stays: that with the least doc_id, then the least text hash.

    A document is a doc_id with its text: rows that share an id and differ in text are judged apart, and of equal rows
    one stays. Rows with a null doc_id all stay. Columns beside doc_id and text are kept as they are, whatever their
    names; an empty table gives no rows. Texts are shuffled only for rows that are repeated, or where those to drop are
    too many to broadcast.
    """
    text = F.xxhash64(F.col("text").cast("string"))
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text_hash"), F.col("text").cast("string").alias("text"))
    fps = materialize(own.mapInArrow(_marked, "doc_id long, text_hash long, fp long"), "fp")
    roots = components(linked_forest(materialize(fps.select("fp").distinct(), "fps")), "simhash").withColumnRenamed("id", "fp")
    classed = fps.join(sized(materialize(roots, "classes")), "fp", "left").select("doc_id", "text_hash", F.coalesce("root", "fp").alias("class"))
    classed = materialize(classed, "classed")
    # Only classes of several rows lose any.
    first = classed.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first")
    of = classed.join(sized(materialize(first, "firsts")), "class").withColumn("stays", F.col("first") == F.struct("doc_id", "text_hash"))
    found = materialize(of.groupBy("doc_id", "text_hash", "stays").agg(F.count("*").alias("n")).where("not stays or n > 1"), "decided")
    found = found.select(F.col("doc_id").alias("__sim_id"), F.col("text_hash").alias("__sim_text"), F.col("stays").alias("__sim_stays"))
    told, again = materialize(found.drop("__sim_stays"), "drop"), materialize(found.where("__sim_stays").drop("__sim_stays"), "again")
    same = (docs["doc_id"].cast("long") == F.col("__sim_id")) & (text == F.col("__sim_text"))
    one = docs.join(sized(again), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(sized(told), same, "left_anti").unionByName(one)
