"""Token counts by a separator scan of flat token files.

A flat file holds little-endian 16-bit token ids and nothing else: documents follow each other, each ended by a
separator id. Files are read in blocks that know nothing of documents. Every block reports its separators' places; a
prefix scan over the blocks' totals (their separators' number and the last one's place, a narrow row a block) tells each
block how many documents end before it and where the open one began, and every document gets its number and token count.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm.common import materialize, read, table_path

#: The vocabulary file (ranks of byte strings); ids below 65,536. Its id 50,256 is free and ends documents.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256
#: Fixed value: how the vocabulary's makers cut text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK_BYTES = 1 << 20
#: Code points that are encoded together; longer texts are cut where the vocabulary's pieces end in any case.
TOGETHER = 1_000_000
SEAM = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
WIDTH = 2


#: Schemes that Hadoop has under other names.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str):
    """The file system of a URI and the path in it; executors write and read token files through it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith(("/", "file:")):
        uri = f"file://{uri}"
    scheme, at, rest = uri.partition("://")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + at + rest)


def ranks_of(vocabulary: str, separator: int = SEPARATOR) -> dict[bytes, int]:
    """The vocabulary's ids, read where this is called; ValueError for ids that don't fit 16 bits, or a separator that is taken."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max([separator, *ranks.values()]) >= 1 << 8 * WIDTH or separator in ranks.values():
        raise ValueError("ids have to be under 65,536 and the separator's id has to be free")
    return ranks


def encoder(vocabulary: str | dict[bytes, int]):
    """A function from text to token ids, with the vocabulary's merges and no special tokens."""
    import tiktoken

    ranks = ranks_of(vocabulary) if isinstance(vocabulary, str) else vocabulary
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def parts(text: str) -> Iterator[str]:
    """text in parts of some TOGETHER code points: a space between letters begins a piece, so cuts there change no id."""
    at = 0
    while len(text) - at > TOGETHER:
        seam = SEAM.search(text, at + TOGETHER)
        if not seam:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """(file, number, doc_id): the order of docs (doc_id, text) in the flat files that this writes to folder.

    Every task writes a file of its own, under a new name at each attempt: only names that this table holds count, so a
    task that is run again leaves at most a file that nobody reads. A null text has no tokens, only its separator.
    The table must be materialized once, as each evaluation writes files. The vocabulary is read here and sent to the
    tasks, which need no such path.
    """
    ranks = ranks_of(vocabulary, separator)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (store, where) = encoder(ranks), filesystem(folder)
        store.create_dir(where, recursive=True)
        name, number, out = f"{uuid.uuid4().hex}.u16", 0, None
        try:
            for batch in batches:
                out = out or store.open_output_stream(f"{where}/{name}")
                for t in batch.column(1):
                    for part in parts(t.as_py() or ""):
                        out.write(np.array(encode(part), "<u2").tobytes())
                    out.write(np.array([separator], "<u2").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(number, number + n)), batch.column(0)], ["file", "number", "doc_id"])
                number += n
        finally:
            if out:
                out.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "file string, number long, doc_id long")


def scan(files: DataFrame, folder: str, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, number, start, n_tokens) of each document of the flat files in folder that files (file) names.

    number counts a file's documents from 0, start is the token offset of the document's first token, n_tokens excludes
    the separator. Tokens after the last separator are a document too; an empty file has none. Blocks hold whole ids
    (block_bytes is rounded down to an even number).
    """
    block = block_bytes // WIDTH * WIDTH

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = filesystem(folder)
        for batch in batches:
            found = [store.get_file_info(f"{where}/{n.as_py()}").size for n in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["file", "bytes"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = filesystem(folder)
        for batch in batches:
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{where}/{name}") as f:
                    ids = np.frombuffer(f.read_at(block, k * block), "<u2")
                at = np.flatnonzero(ids == separator) + k * (block // WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.string()), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "n", "ends"],
                )

    sized = files.select("file").distinct().mapInArrow(sizes, "file string, bytes long").where("bytes >= 2")
    parts = sized.select("file", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block}L)")).alias("block")).repartition("file", "block")
    found = materialize(parts.mapInArrow(blocks, "file string, block long, n long, ends array<long>"), "separators")
    # The prefix scan, over the blocks' totals only: documents that end in earlier blocks, and the last separator before this block.
    totals = found.select("file", "block", "n", F.size("ends").alias("found"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = totals.select(
        "file", "block", F.coalesce(F.sum("found").over(before), F.lit(0)).cast("long").alias("number"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("long")).alias("open"), F.lead("block").over(order).isNull().alias("final"),
    )
    stitched = found.join(scanned.hint("merge"), ["file", "block"]).withColumn("total", F.col("block") * (block // WIDTH) + F.col("n"))
    # A last block that ends without a separator closes the open document itself.
    tail = F.expr("final and (case when size(ends) > 0 then element_at(ends, -1) + 1 else open end) < total")
    ends = F.when(tail, F.concat("ends", F.array("total"))).otherwise(F.col("ends"))
    cut = stitched.select("file", "number", "open", ends.alias("ends"))
    starts = F.expr("transform(ends, (e, i) -> if(i = 0, open, ends[i - 1] + 1))")
    cut = cut.select("file", "number", F.posexplode(F.arrays_zip("ends", starts.alias("starts"))).alias("i", "doc"))
    return cut.select("file", (F.col("number") + F.col("i")).alias("number"), F.col("doc.starts").alias("start"), (F.col("doc.ends") - F.col("doc.starts")).alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, file, number, start) of each row of docs (doc_id, text), by writing token files and scanning them.

    Null and empty texts have 0 tokens. Repeated rows stay; other columns are ignored. No rows: no rows.
    """
    folder = table_path(docs.sparkSession, "tokens")
    order = materialize(write_token_files(docs, folder, vocabulary), "token-order")
    # Both sides have a row a document; the hint keeps Spark from broadcasting the one whose files are small.
    return order.join(scan(order, folder).hint("merge"), ["file", "number"]).select("doc_id", "n_tokens", "file", "number", "start")


def op8_separator_scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files have names that differ from run to run, so only the documents' counts are returned."""
    return count_tokens(read(spark, sf_dir, "documents")).select("doc_id", "n_tokens")
