"""Benchmark decontamination: size-partitioned MinHash containment search, native expressions only.

An item with n shingles is contained at threshold t if a document has at least need = ceil(t n) of them, so a document
that contains it misses at most n - need. Of the n - need + 1 shingles with the least hashes (the item's bottom-k
MinHash sketch) it then has at least one. Items are partitioned by size class: powers of two of n, and a class for
each shorter length of shingle. Each class has a bound, the largest hash in its sketches, and a least document, which
has words enough for its smallest member. A document probes with those of its hashes that lie under the bound of a class
that it is large enough for and whose bit is set in a bitmap of the sketches' hashes; so short items, of which a
single hash is the sketch, add their bits and don't open the search for long ones. Documents aren't sketched to a fixed
length: an item of 20 shingles in a document of 20,000 has a Jaccard similarity of 0.001, which no affordable signature
resolves. So the search loses nothing; candidates are then verified by counting equal shingles as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import materialize, read, sized

SHINGLE = 5
THRESHOLD = 0.8
#: Words of a document that are set side by side at a time.
CHUNK = 4096
#: Tasks that write what is kept of the items.
ITEM_TASKS = 32
#: Bits of the bitmap at most (a power of two), and for each hash in it.
MOST_BITS, BITS_EACH = 1 << 18, 64
#: Fixed value: what separates words.
SEPARATOR = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR), "")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _rows(table: DataFrame, key: str, alias: str) -> DataFrame:
    """(alias, alias_text, w): rows that have words; the text's hash tells rows with equal ids apart."""
    return table.select(F.col(key).cast("long").alias(alias), _text_hash(F.col("text")).alias(f"{alias}_text"), words(F.col("text")).alias("w")).where("size(w) > 0")


def side_by_side(rows: DataFrame, shingle: int) -> DataFrame:
    """rows without w, once for each word of w: it and those after it as w1, w2, ..., null beyond the end.

    Long texts are taken CHUNK words at a time with the first of the next ones, so that some words come twice.
    """
    kept = [c for c in rows.columns if c != "w"]
    chunks = rows.select(*kept, F.explode(F.expr(f"transform(sequence(1, size(w), {CHUNK}), i -> slice(w, i, {CHUNK + shingle - 1}))")).alias("w1"))
    moved = chunks.select("*", *(F.expr(f"slice(w1, {k}, size(w1))").alias(f"w{k}") for k in range(2, shingle + 1)))
    return moved.select(*kept, F.inline(F.arrays_zip(*(f"w{k}" for k in range(1, shingle + 1)))))


def _first(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def class_bounds(sketches: DataFrame) -> dict[int, list[tuple[int, int, int]]]:
    """For each shingle length, (least words of a document, largest hash, hashes) of its size classes: some dozens of rows."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    found = sketches.groupBy("k", "size_class").agg(F.min("least_words").alias("least"), F.max("h").alias("bound"), F.count("*").alias("n"))
    for r in sorted(found.collect()):
        out.setdefault(r.k, []).append((r.least, r.bound, r.n))
    return out


def bitmap(sketches: DataFrame, hashes: int) -> list[int]:
    """A power of two of 64-bit words with the bit of each hash in sketches set (its lowest bits are the place); bounded by MOST_BITS."""
    n = max(64, min(MOST_BITS, BITS_EACH * hashes))
    n = 1 << (n - 1).bit_length()
    bits = sketches.groupBy(F.expr(f"shiftright(h & {n - 1}L, 6)").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63L as int)))").alias("bits"))
    out = [0] * (n // 64)
    for r in bits.collect():
        out[r.word] = r.bits
    return out


def _sketches(item_words: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(item_id, item_id_text, k, size_class, least_words, h): an item of fewer than shingle words is one shingle of all."""
    k = F.least(F.size("w"), F.lit(shingle))
    all_ = F.expr(f"transform(sequence(1, greatest(size(w) - {shingle - 1}, 1)), i -> array_join(slice(w, i, {shingle}), ' '))")
    hashed = item_words.select("item_id", "item_id_text", k.alias("k"), F.explode(F.array_distinct(all_)).alias("s")).withColumn("h", F.xxhash64(F.split("s", " ")))
    hashed = hashed.groupBy("item_id", "item_id_text", "k").agg(F.array_sort(F.collect_set("h")).alias("h")).withColumn("n", F.size("h"))
    need = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    return hashed.select(
        "item_id", "item_id_text", "k", F.floor(F.log2("n")).cast("int").alias("size_class"), (need + F.col("k") - 1).alias("least_words"),
        F.explode(F.slice("h", F.lit(1), F.col("n") - need + 1)).alias("h"),
    )


def probes_of(docs: DataFrame, bounds: dict[int, list[tuple[int, int, int]]], bits: list[int], shingle: int) -> DataFrame:
    """(doc_id, doc_id_text, n_words, k, h) of the documents' shingles that a sketch can hold; see the module's text."""
    rows = _rows(docs, "doc_id", "doc_id").withColumn("n_words", F.size("w"))
    for k, classes in bounds.items():
        most = F.lit(-(1 << 63)).cast("long")
        for least, bound, _ in classes:
            most = F.greatest(most, F.when(F.col("n_words") >= least, F.lit(bound).cast("long")).otherwise(F.lit(-(1 << 63)).cast("long")))
        rows = rows.withColumn(f"most{k}", most)
    rows = side_by_side(rows, shingle)
    # A shingle that runs over the end has no hash, and no row.
    hashes = [F.struct(F.lit(k).alias("k"), F.when(F.col(f"w{k}").isNotNull(), F.xxhash64(*_first(k))).alias("h"), F.col(f"most{k}").alias("most")) for k in bounds]
    if len(hashes) == 1:
        rows = rows.select("doc_id", "doc_id_text", "n_words", *(hashes[0][x].alias(x) for x in ("k", "h", "most")))
    else:
        rows = rows.select("doc_id", "doc_id_text", "n_words", F.inline(F.array(*hashes)))
    place = f"get(array({', '.join(f'{b}L' if b > -(1 << 63) else 'bigint(-9223372036854775808)' for b in bits)}), cast(shiftright(h & {64 * len(bits) - 1}L, 6) as int))"
    is_set = F.expr(f"shiftrightunsigned({place}, cast(h & 63L as int)) & 1L = 1L")
    return rows.where(F.col("h").isNotNull() & (F.col("h") <= F.col("most")) & is_set).drop("most")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, doc_text, n_item, n_shared) of each document row and item where n_shared >= threshold * n_item.

    docs (doc_id, text), items (item_id, text); n_item counts an item's distinct shingles, n_shared those in the
    document. An item with fewer words than a shingle is one shingle of all its words, which is found wherever a document
    has these words in a row; texts without words, and null ones, contain and
    are contained in nothing. Rows that repeat an id with another text are judged by themselves, repeated rows once;
    doc_text is the text's hash, which tells them apart. Null ids are kept as null. Other columns are ignored.
    """
    # Items are few beside documents: some files hold them.
    item_words = _rows(items, "item_id", "item_id").dropDuplicates(["item_id", "item_id_text"])
    sketches = materialize(_sketches(item_words, threshold, shingle).coalesce(ITEM_TASKS), "sketches")
    bounds = class_bounds(sketches)
    if not bounds:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, doc_text long, n_item long, n_shared long")
    bits = bitmap(sketches, sum(n for classes in bounds.values() for *_, n in classes))
    probes = probes_of(docs, bounds, bits, shingle)
    found = probes.join(sized(sketches.drop("size_class")), ["k", "h"]).where("n_words >= least_words").select("doc_id", "doc_id_text", "item_id", "item_id_text")
    candidates = materialize(found.distinct(), "candidates")

    # Only the candidates' documents are cut into words again.
    which = candidates.select(F.col("doc_id").alias("__item_doc"), F.col("doc_id_text").alias("__item_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__item_doc")) & (_text_hash(docs["text"]) == F.col("__item_text"))
    again = side_by_side(_rows(docs.join(sized(which), same, "left_semi"), "doc_id", "doc_id"), shingle)
    strings = F.array(*(F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", *_first(k))) for k in bounds))
    doc_shingles = again.select("doc_id", "doc_id_text", F.explode(strings).alias("s")).where("s is not null")
    all_ = F.expr(f"array_distinct(transform(sequence(1, greatest(size(w) - {shingle - 1}, 1)), i -> array_join(slice(w, i, {shingle}), ' ')))")
    item_shingles = item_words.select("item_id", "item_id_text", all_.alias("all")).select("item_id", "item_id_text", F.size("all").cast("long").alias("n_item"), F.explode("all").alias("s"))
    pair = ["doc_id", "doc_id_text", "item_id", "item_id_text"]
    # Only shingles that some item has are shuffled; the distinct takes repeats in a text and repeated rows together.
    matches = doc_shingles.join(sized(materialize(item_shingles.coalesce(ITEM_TASKS), "items")), "s").select(*pair, "n_item", "s").distinct()
    shared = matches.groupBy(*pair).agg(F.max("n_item").alias("n_item"), F.count("*").alias("n_shared"))
    # Pairs that share shingles but that the sketches didn't propose are below the threshold by construction.
    c = candidates.select(*(F.col(x).alias(f"c_{x}") for x in candidates.columns))
    kept = shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9))).join(
        sized(c),
        F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("doc_id_text") == F.col("c_doc_id_text"))
        & F.col("item_id").eqNullSafe(F.col("c_item_id")) & (F.col("item_id_text") == F.col("c_item_id_text")),
        "left_semi",
    )
    return kept.select("doc_id", "item_id", F.col("doc_id_text").alias("doc_text"), "n_item", "n_shared")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document id and item id of contained_items on whole tables; nulls and repeats as there, ids' best figures."""
    found = contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))


ORACLE = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda v: v <> '') as w from documents
), i as (
  select item_id, w, least(len(w), 5) as k
  from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda v: v <> '') as w from benchmark)
  where len(w) > 0
), ds as (
  select distinct doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) as s
  from d cross join (select distinct k from i) where len(w) >= k
), items as (
  select distinct item_id, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) as s from i
), sizes as (select item_id, count(*) as n_item from items group by item_id),
shared as (select doc_id, item_id, count(*) as n_shared from ds join items using (s) group by all)
select doc_id, item_id, n_item, n_shared from shared join sizes using (item_id) where n_shared * 10 >= n_item * 8
"""


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that contain a benchmark item go. Rows with one id are told apart by their texts, equal rows go or stay together.

    Null texts contain nothing and stay; other columns are kept, whatever their names; an empty table gives no rows.
    """
    found = contained_items(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__bad_id"), F.col("doc_text").alias("__bad_text")).distinct()
    found = materialize(found, "contaminated")
    text = F.xxhash64(F.col("text").cast("string"))
    return docs.join(sized(found), docs["doc_id"].cast("long").eqNullSafe(F.col("__bad_id")) & (text == F.col("__bad_text")), "left_anti")
