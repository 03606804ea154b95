"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a fixed-length window and classified by a
softmax layer. A whole text is cut into consecutive windows; its probabilities are the mean of its windows', weighted
by their bytes. For prediction, embedding and filters are folded into tables of byte pairs, so that a window costs two
look-ups a byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import read, sized

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 8, 6
#: Documents of each language that the network is trained on at most; of all together, while that leaves each language SAMPLE_LEAST;
#: windows of each document, from its first code points. Every language is learned, however many there are.
SAMPLE, SAMPLE_ALL, SAMPLE_LEAST, SAMPLE_WINDOWS, SAMPLE_CHARS = 600, 6000, 20, 6, 8_000
EPOCHS, BATCH, RATE = 12, 64, 0.02
LETTER = re.compile(r"[^\W\d_]")
#: Windows that go through the network together.
TOGETHER = 512

TAPS = max(WIDTHS)
#: mask[k, f]: filter f has a weight for the byte k places on.
MASK = np.array([[k < w for w in WIDTHS for _ in range(FILTERS)] for k in range(TAPS)], np.float32)


def has_letter(text: str) -> bool:
    """Whether a text has a character of the letter categories (some numerals pass the pattern, but are none)."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW + TAPS - 1) bytes: consecutive windows, each with the bytes that its last filters reach into; zeros at the end."""
    n = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(n * WINDOW + TAPS - 1, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW + TAPS - 1)[::WINDOW]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, n_classes: int, seed: int = 7) -> dict:
    """Weights from windows x and classes y, by Adam on the cross-entropy; deterministic for a seed."""
    rng = np.random.default_rng(seed)
    n_filters = MASK.shape[1]
    par = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "conv": rng.normal(0, 0.5, (TAPS, EMBED, n_filters)).astype(np.float32) * MASK[:, None, :],
        "bias": np.zeros(n_filters, np.float32),
        "dense": rng.normal(0, 0.3, (n_filters, n_classes)).astype(np.float32),
        "out": np.zeros(n_classes, np.float32),
    }
    m, v = ({k: np.zeros_like(a) for k, a in par.items()} for _ in range(2))
    i = 0
    filters = np.arange(n_filters)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            data = x[rows]
            tables = np.einsum("be,kef->kbf", par["embed"], par["conv"])
            act = sum(tables[k][data[:, k : k + WINDOW]] for k in range(TAPS)) + par["bias"]
            place = act.argmax(1)  # (rows, filters)
            top = np.take_along_axis(act, place[:, None, :], 1)[:, 0]
            pooled = np.maximum(top, 0)
            p = softmax(pooled @ par["dense"] + par["out"])
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ par["dense"].T) * (top > 0)
            table_grad = np.zeros_like(tables)
            for k in range(TAPS):
                hit = data[np.arange(len(rows))[:, None], place + k]
                np.add.at(table_grad[k], (hit, filters[None, :].repeat(len(rows), 0)), back)
            table_grad *= MASK[:, None, :]
            grads = {
                "embed": np.einsum("kbf,kef->be", table_grad, par["conv"]),
                "conv": np.einsum("kbf,be->kef", table_grad, par["embed"]),
                "bias": back.sum(0),
                "dense": pooled.T @ p,
                "out": p.sum(0),
            }
            i += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                par[k] -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)
    return par


class Network:
    """The trained network, folded for prediction."""

    def __init__(self, par: dict) -> None:
        tables = np.einsum("be,kef->kbf", par["embed"], par["conv"])
        # Index of a pair: the first byte is the low one, as in a little-endian 16-bit view.
        self.pairs = [(tables[k][None, :, :] + tables[k + 1][:, None, :]).reshape(1 << 16, -1) for k in range(0, TAPS, 2)]
        self.bias, self.dense, self.out = par["bias"], par["dense"], par["out"]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows."""
        out = []
        for at in range(0, len(x), TOGETHER):
            data = x[at : at + TOGETHER].astype(np.int32)
            pair = data[:, :-1] + (data[:, 1:] << 8)
            act = np.take(self.pairs[0], pair[:, :WINDOW], 0)
            for k in range(1, len(self.pairs)):
                act += np.take(self.pairs[k], pair[:, 2 * k : 2 * k + WINDOW], 0)
            out.append(softmax(np.maximum(act.max(1) + self.bias, 0) @ self.dense + self.out))
        return np.concatenate(out)


def train(docs: DataFrame, learns, sample: int = SAMPLE) -> tuple[list[str], dict | None]:
    """The languages and weights, from at most sample rows of each lang among those for which learns (a Column) holds.

    These are the rows of the least hashes of id and text; many languages get fewer each. No such row: no languages.
    """
    rows = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return [], None
    sample = min(sample, max(SAMPLE_LEAST, SAMPLE_ALL // len(counts)))
    # The hash of a lang's row is spread over [0, 1): the k least of n lie near k / n, so their rank is their hash times n.
    h = (F.xxhash64(F.lit("langid"), "doc_id", "text").cast("double") / 2.0**64) + 0.5
    share = rows.sparkSession.createDataFrame(list(counts.items()), "lang string, n long")
    picked = rows.join(sized(share), "lang").withColumn("at", h * F.col("n")).where(F.col("at") < sample + 6 * sample**0.5 + 20)
    picked = picked.select("doc_id", "lang", "at", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    got = picked.orderBy("at").limit(int(sample + 6 * sample**0.5 + 20) * 2 * len(counts)).toPandas()  # bounded: see SAMPLE
    got = got.sort_values(["lang", "at", "doc_id", "text"]).groupby("lang").head(sample)
    names = sorted(set(got.lang))
    if not names:
        return [], None
    rng = np.random.default_rng(11)
    x, y = [], []
    for text, lang in zip(got.text, got.lang, strict=True):
        if has_letter(text):
            w = windows(text.encode("utf-8", "surrogatepass"))
            w = w[rng.permutation(len(w))[:SAMPLE_WINDOWS]]
            x.append(w)
            y += [names.index(lang)] * len(w)
    if not x:
        return [], None
    return names, fit(np.concatenate(x), np.array(y), len(names))


def identify(docs: DataFrame, names: list[str], par: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text).

    A null text, or one without a letter, is und with score 0, as is everything where nothing was learned. A tie goes
    to the language that comes first by name. Repeated rows stay; other columns are not read. No rows: no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(par) if par else None
        for batch in batches:
            p = np.zeros((batch.num_rows, max(1, len(names))))
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush() -> None:
                if held:
                    doc = np.repeat([i for i, _, _ in held], [len(w) for _, w, _ in held])
                    np.add.at(p, doc, network(np.concatenate([w for _, w, _ in held])) * np.concatenate([n for _, _, n in held])[:, None])
                    held.clear()

            size = 0
            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                if not network or not text or not has_letter(text):
                    continue
                data = text.encode("utf-8", "surrogatepass")
                w, share = windows(data), np.minimum(WINDOW, len(data) - np.arange(0, len(data), WINDOW))
                for at in range(0, len(w), 8 * TOGETHER):
                    held.append((i, w[at : at + 8 * TOGETHER], share[at : at + 8 * TOGETHER]))
                    size += len(held[-1][1])
                    if size > 8 * TOGETHER:
                        flush()
                        size = 0
            flush()
            total = p.sum(1)
            best, known = p.argmax(1), total > 0
            score = np.where(known, p.max(1) / np.where(known, total, 1), 0.0)
            langs = [names[k] if there else "und" for k, there in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 3 == 1, F.lit(False))


def op10_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify on all documents, learned from those not held out; nulls, repeats and an empty table as there."""
    docs = read(spark, sf_dir, "documents")
    names, par = train(docs, ~held_out() & F.col("doc_id").isNotNull())
    return identify(docs, names, par).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
