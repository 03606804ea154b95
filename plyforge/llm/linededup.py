"""Line dedup: a segment-partition join of lines within an edit distance.

Lines are near if they are within one edit for each CHARS_PER_EDIT code points of the shorter one, MAX_EDITS at most; so
lines of fewer code points are near only if equal. A line that may have t edits is cut into t + 1 segments. Two near lines
share a segment of the shorter one, at a place that the lengths and the edits left bound: a line files its own segments
under keys of (length, segment number, hash) and probes, for its own length and each shorter one in reach, the few
substrings that can match. Substring
hashes come from prefix sums of a polynomial, all lines of a batch at once. A first pass finds the keys in which two
lines meet (counts that are combined before they are shuffled, so that a frequent segment costs no task of its own); a
second one takes the rows of these keys. The lines of a key are compared in tasks: pairs are thinned by a signature (the
parities of the code points' counts: an edit changes two at most), those already connected are skipped, the others are
verified on the texts by a banded bit-parallel edit distance, and of the links a spanning forest leaves the task. So what
is kept grows with the lines and not with the pairs of a group. Links give classes; of each class the first line stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import components, dealt, forest, materialize, pairs_in_blocks, read, sized, whole_blocks

#: Edits between near lines: one for each CHARS_PER_EDIT code points of the shorter line, MAX_EDITS at most.
MAX_EDITS, CHARS_PER_EDIT = 2, 10
#: Code points whose prefix sums are held together; a longer text is a group of its own.
TOGETHER = 1_000_000
#: Pairs that are verified before those that the links found connect are skipped.
VERIFIED = 256
BLANK = "\x20\t\n\x0b\x0c\r"

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1; up to TOGETHER twice they are kept."""
    have = POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[:1] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * TOGETHER:
            POWERS[base] = have
    return have[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit words (the finaliser of a public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edits_of(length):
    """The edits that a line of this length, or an array of lengths, may have."""
    return np.minimum(MAX_EDITS, length // CHARS_PER_EDIT)


def segments(length: np.ndarray, i: int, edits: int = MAX_EDITS) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines: equal parts, the longer ones last."""
    short, longer = length // (edits + 1), length % (edits + 1)
    plain = edits + 1 - longer  # segments of the shorter kind
    return short * i + np.maximum(0, i - plain), short + (i >= plain)


#: A code point's bit in the signature, of those below 65,536.
BITS = np.uint64(1) << (scramble(np.arange(1 << 16, dtype=np.uint64)) & np.uint64(63))


def line_ids(lines: list[str]) -> list[bytes]:
    """A line's identity: the 128-bit hash of its UTF-8 text, the same as in lines_of."""
    return [hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for x in lines]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, id): the lines of docs (doc_id, text) with a word, numbered from 0 with the others."""
    every = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return every.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("id", F.unhex(F.md5("text")))


class Prefixes:
    """Prefix sums over some lines: substring hashes, and each line's signature."""

    def __init__(self, lines: list[str]) -> None:
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(codes)), out=self.sums[1:])
        self.back = powers(INVERSE, len(codes) + 1)
        bits = np.take(BITS, codes) if codes.max(initial=0) < len(BITS) else np.uint64(1) << (scramble(codes.astype(np.uint64)) & np.uint64(63))
        self.signature = np.bitwise_xor.reduceat(bits, self.starts)

    def key(self, at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        """Of the substrings at the places at: their hash, mixed with the filed line's length and the segment's number."""
        h = (self.sums[at + size] - self.sums[at]) * self.back[at]
        return scramble(h ^ scramble(length.astype(np.uint64) * np.uint64(MAX_EDITS + 1) + np.uint64(i)))


def keys_of(p: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line index, key, filed): every line that may have edits under its own segments, and where it probes.

    It probes where a line of the same length or shorter, within the edits that this one may have, can have left a
    segment whole. Of t + 1 segments, segment i has i before it and t - i after: if it is the first match from the left,
    its shift is within i; if the last from the right, it is within t - i of the difference of the lengths. Filed rows are
    also probes of the line's own length without a shift.
    """
    every, index, keys, filed = np.arange(len(p.lengths)), [], [], []
    for edits in range(1, MAX_EDITS + 1):
        for less in range(edits + 1):
            target = p.lengths - less
            mine = edits_of(target) == edits
            for i in range(edits + 1):
                at, size = segments(target, i, edits)
                for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                    ok = mine & (at + shift >= 0) & (at + shift + size <= p.lengths)
                    index.append(every[ok])
                    keys.append(p.key((p.starts + at + shift)[ok], size[ok], target[ok], i))
                    filed.append(np.full(len(index[-1]), less == shift == 0))
    return np.concatenate(index), np.concatenate(keys), np.concatenate(filed)


def _grouped(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """The different lines with a word that may have edits, of some TOGETHER code points of lines at a time."""
    lines: dict[str, None] = {}
    size = 0
    for text in texts:
        for line in text.split("\n") if text else ():
            if len(line) >= CHARS_PER_EDIT and line not in lines and line.strip(BLANK):
                lines[line] = None
                size += len(line)
                if size >= TOGETHER:
                    yield list(lines)
                    lines, size = {}, 0
    if lines:
        yield list(lines)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, filed); id is a 64-bit hash here, which only tells whether two lines of a key differ."""
    for batch in batches:
        for lines in _grouped(t.as_py() for t in batch.column(0)):
            p = Prefixes(lines)
            index, keys, filed = keys_of(p)
            ids = p.key(p.starts, p.lengths, p.lengths, 0)
            yield pa.RecordBatch.from_arrays([_signed(keys), _signed(ids[index]), pa.array(filed)], ["key", "id", "filed"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, filed, signature, chars) of the same rows, under the lines' identities."""
    for batch in batches:
        for lines in _grouped(t.as_py() for t in batch.column(0)):
            p = Prefixes(lines)
            index, keys, filed = keys_of(p)
            ids = pa.array(line_ids(lines), pa.binary()).take(pa.array(index))
            cols = [_signed(keys), ids, pa.array(filed), _signed(p.signature[index]), pa.array(p.lengths[index])]
            yield pa.RecordBatch.from_arrays(cols, ["key", "id", "filed", "signature", "chars"])


def edit_distance(a: str, b: str, most: int = MAX_EDITS) -> int:
    """The edit distance of a and b if it is at most most, else most + 1, by a banded bit-parallel table.

    What both begin and end with is taken off. Of the rest, a band of 2 most + 1 diagonals is computed a column at a
    time: bit d of the words stands for row j - most + d of column j, and the differences between neighbouring cells
    are kept as bits (up: one more than the cell above, down: one less). The lowest diagonal's value is followed to the
    last row and from there along that row.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n, shorter = 0, min(len(a), len(b))
    while n < shorter and a[n] == b[n]:
        n += 64 if n + 64 <= shorter and a[n : n + 64] == b[n : n + 64] else 1
    a, b = a[n:], b[n:]
    n, shorter = 0, min(len(a), len(b))
    while n < shorter and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    rows, columns = len(a), len(b)
    if rows <= most:  # the band is the whole table
        line = list(range(rows + 1))
        for j, y in enumerate(b, 1):
            over, line[0] = line[0], j
            for i, x in enumerate(a, 1):
                over, line[i] = line[i], min(line[i] + 1, line[i - 1] + 1, over + (x != y))
        return min(line[rows], most + 1)
    width = 2 * most + 1
    mask = (1 << width) - 1
    up, down, score = mask & mask << most, 0, most
    for j in range(1, columns + 1):
        equal = 0
        for i in range(max(1, j - most), min(rows, j + most) + 1):
            if a[i - 1] == b[j - 1]:
                equal |= 1 << i - j + most
        flat = (((equal & up) + up ^ up) | equal | down) & mask  # no more than the cell up and to the left
        right_up, right_down = (down | ~(flat | up)) & mask, flat & up
        if j <= rows - most:
            score += not flat >> width - 1
            if score > 3 * most:  # so is every cell of the band over most
                return most + 1
        else:
            d = rows - j + most
            score += (right_up >> d & 1) - (right_down >> d & 1)
        up, down = (right_down | ~(flat >> 1 | right_up)) & mask, flat >> 1 & right_up
    return min(score, most + 1)


def near(a: str, b: str) -> bool:
    return edit_distance(a, b) <= edits_of(min(len(a), len(b)))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks of keys, links (a, b) of near lines that connect what all links in the block connect."""
    for table in whole_blocks(batches):
        ids = table.column("id").combine_chunks().dictionary_encode()
        node, text = ids.indices.to_numpy(), table.column("text")
        signature, label = table.column("signature").to_numpy().view(np.uint64), np.arange(len(ids.dictionary))
        a, b = [], []
        for i, j in pairs_in_blocks(table.column("key").to_numpy(), table.column("block").to_numpy(), table.column("filed").to_numpy(zero_copy_only=False)):
            alike = np.bitwise_count(signature[i] ^ signature[j]) <= 2 * MAX_EDITS
            i, j = i[alike], j[alike]
            while len(i := i[apart := label[node[i]] != label[node[j]]]):
                j = j[apart]
                # Some at a time, so that links found leave fewer to verify.
                links = [(x, y) for x, y in zip(i[:VERIFIED].tolist(), j[:VERIFIED].tolist()) if near(text[x].as_py(), text[y].as_py())]
                i, j = i[VERIFIED:], j[VERIFIED:]
                if links:
                    x, y = np.array(links).T
                    taken, label = forest(label, node[x], node[y])
                    a += node[x[taken]].tolist()
                    b += node[y[taken]].tolist()
        yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(x, pa.int64())) for x in (a, b)], ["a", "b"])


def near_lines(docs: DataFrame) -> DataFrame:
    """Links (a, b) of the ids of different near lines of docs (doc_id, text).

    They connect whatever the links of all pairs connect, and every line with a link is in one; a key gives fewer than
    it has lines.
    """
    texts = docs.select("text")
    met = texts.mapInArrow(_keys, "key long, id long, filed boolean").groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("filed").alias("any"))
    met = materialize(met.where("any and lo <> hi").select("key"), "line-keys")
    members = texts.mapInArrow(_members, "key long, id binary, filed boolean, signature long, chars long").join(sized(met), "key")
    members = materialize(members.distinct(), "line-members")
    wanted = materialize(members.select("id").distinct(), "line-ids")
    lines = lines_of(docs).select("id", "text").join(sized(wanted), "id", "left_semi").dropDuplicates(["id"])
    lines = materialize(lines, "line-texts").hint("merge")
    return dealt(members, F.col("chars"), lines).drop("chars").mapInArrow(_forests, "a binary, b binary")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, n_linked) of each doc_id of docs (doc_id, text).

    Lines are the \\n-separated parts of a text that hold more than ASCII's white space. Near lines are linked (see above),
    and equal lines of any length; classes follow links. Of a class the line with
    the least (doc_id, number) stays and the others are dropped: dropped lists their numbers, from 0 and blank lines
    included in the count. n_linked counts the document's lines that are linked to a different text. Null texts have no
    lines. A null doc_id comes before all others; rows with equal ids count as one document, lines with equal numbers
    in it as several.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = materialize(lines_of(slim).select("doc_id", "line", "id"), "lines")
    links = materialize(near_lines(slim), "links")
    roots = materialize(components(links, "lines"), "line-classes").withColumnRenamed("root", "class")
    of = lines.join(sized(roots), "id", "left").select("doc_id", "line", F.col("class").isNotNull().alias("linked"), F.coalesce("class", "id").alias("class"))
    # Only classes of several lines lose any; their first line is found with partial sums, whatever their size.
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"), "line")
    several = materialize(of.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first"), "line-firsts")
    told = of.join(sized(several), "class", "left").withColumn("drop", F.col("first").isNotNull() & (place != F.col("first")))
    counted = told.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("drop").cast("long")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.when(F.col("drop"), F.col("line")))).alias("dropped"), F.sum(F.col("linked").cast("long")).alias("n_linked"),
    )
    ids = slim.select("doc_id").distinct()
    out = ids.join(counted.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_dropped", zero).alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), F.coalesce("n_linked", zero).alias("n_linked"),
    )


def without_dropped(docs: DataFrame) -> DataFrame:
    """docs with dropped lines taken out of text. Null texts stay null; other columns are kept; equal rows are treated alike."""
    plan = deduplicated(docs).select(F.col("doc_id").alias("__line_doc"), F.col("dropped").alias("__line_drop"))
    parts = F.expr("filter(split(text, '\n'), (x, i) -> not array_contains(__line_drop, i))")
    joined = docs.join(plan, docs["doc_id"].cast("long").eqNullSafe(F.col("__line_doc")))
    return joined.select(*(F.array_join(parts, "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns))


def op7_segment_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicated on all documents; nulls, repeats, ties and an empty table as there."""
    return deduplicated(read(spark, sf_dir, "documents"))
