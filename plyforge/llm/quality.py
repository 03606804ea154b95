"""Quality rules: a linear-chain conditional random field marks a text's lines as content or boilerplate.

The model has two labels, a weight a feature for either label and one a pair of neighbouring labels. It is fitted on
a bounded sample of labelled documents: a document's quality label stands for its lines at first; then the lines are
relabelled by the model's own marginals, held to the document's label by a prior, and the model is fitted again.
Texts are decoded by the Viterbi algorithm, all documents of a batch at once. A document is kept if enough of its
words are in content lines and the base rules don't fail it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import least_hashes, read, word_pieces

#: Labelled documents that the model is fitted on, of either quality, at most.
SAMPLE = 1500
#: Lines of a sample document that the fit takes, and code points of the sample's texts; decoding has no such bound.
SAMPLE_LINES, SAMPLE_CHARS = 64, 20_000
#: Share of a text's words that must be in content lines.
CONTENT_SHARE = 0.5
#: Characters that count as symbols, and words that mark a line as a notice or a page's furniture.
SYMBOLS = "#*$%&|<>"
CUES = re.compile(r"(?i)\b(licen[sc]ed?|copyright|rights reserved|cookies?|subscribe|sign up|log ?in|click here|terms of|privacy policy|javascript)\b")
UPPER, DIGIT, MARK = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[!?=_~^]")

FEATURES = ["bias", "symbols", "some symbols", "upper", "digits", "marks", "short", "middling", "unended", "repeated line", "repeated words", "cue", "long words"]
#: Used where there are no labelled documents: (content weights, boilerplate weights) and transitions.
DEFAULT = {
    "emit": [[0.0] * len(FEATURES), [-2.0, 4.0, 1.0, 2.0, 1.0, 2.0, 0.3, 0.1, 0.3, 1.5, 2.5, 3.0, 0.5]],
    "step": [[0.7, -0.7], [-0.7, 0.7]],
}


def repeated(w: np.ndarray, distinct: int) -> np.ndarray:
    """For each word, given by a number below distinct, whether it lies in a 3-word window that the text has twice or more."""
    n = len(w)
    out = np.zeros(n, bool)
    if n < 4:
        return out
    if distinct < 1 << 21:
        key = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
    else:
        pair = np.unique((w[:-1] << 32) | w[1:], return_inverse=True)[1].astype(np.int64)
        key = (pair[:-1] << 32) | w[2:]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    at = np.concatenate((order[same], order[same + 1]))
    for k in range(3):
        out[at + k] = True
    return out


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """A text's base figures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), its lines' features and word counts."""
    text = text or ""
    ids: dict[bytes, int] = {}
    numbers = [np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words)) for words in word_pieces(text.encode("utf-8", "surrogatepass"))]
    again = repeated(np.concatenate(numbers), len(ids))
    lines = text.split("\n")
    counts = np.fromiter((len(x.encode("utf-8", "surrogatepass").split()) for x in lines), np.int64, len(lines))
    keep = np.flatnonzero(counts)
    counts = counts[keep]
    ends = np.concatenate(([0], np.cumsum(counts)))
    shares = np.concatenate(([0], np.cumsum(again)))
    x = np.zeros((len(keep), len(FEATURES)))
    seen: set[str] = set()
    dups = 0
    for i, j in enumerate(keep):
        line, n = lines[j], counts[i]
        size = len(line)
        symbols = sum(map(line.count, SYMBOLS))
        dup = line in seen
        seen.add(line)
        dups += dup
        end = line.rstrip()[-1:]
        x[i] = (
            1, min(1, 8 * symbols / size), symbols > 0, len(UPPER.findall(line)) / size, len(DIGIT.findall(line)) / size, min(1, 8 * len(MARK.findall(line)) / size),
            n < 4, 4 <= n < 10, end not in ".!?:\"'", dup, (shares[ends[i + 1]] - shares[ends[i]]) / n, CUES.search(line) is not None, size > 12 * n,
        )
    blanks = sum(map(text.count, "\x20\t\n\x0b\x0c\r"))
    return (len(again), len(text) - blanks, sum(map(text.count, SYMBOLS)), dups, int(again.sum())), x, counts


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _sorted(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and the first element of each."""
    order = np.argsort(-lengths, kind="stable")
    return order, (np.cumsum(lengths) - lengths)[order]


def viterbi(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of sequences laid end to end: scores (elements, 2), lengths; ties go to label 0."""
    best, back = scores.copy(), np.zeros(scores.shape, np.int8)
    order, first = _sorted(lengths)
    falling = -lengths[order]
    longest = int(lengths.max(initial=0))
    for t in range(1, longest):
        at = first[: np.searchsorted(falling, -t, "left")] + t  # sequences longer than t
        over = best[at - 1][:, :, None] + step
        back[at] = over.argmax(1)
        best[at] += over.max(1)
    labels = np.zeros(len(scores), np.int8)
    for t in range(longest - 1, -1, -1):
        alive = np.searchsorted(falling, -t, "left")
        at = first[:alive] + t
        ended = np.searchsorted(falling, -t - 1, "left")  # from here on, sequences whose last element this is
        labels[at[ended:]] = best[at[ended:]].argmax(1)
        labels[at[:ended]] = back[at[:ended] + 1, labels[at[:ended] + 1]]
    return labels


def marginals(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of each element and the summed P(pair of neighbours), by forward-backward on all sequences at once."""
    order, first = _sorted(lengths)
    falling = -lengths[order]
    longest = int(lengths.max(initial=0))
    a, b = scores.copy(), np.zeros_like(scores)
    for t in range(1, longest):
        at = first[: np.searchsorted(falling, -t, "left")] + t
        a[at] += np.logaddexp.reduce(a[at - 1][:, :, None] + step, axis=1)
    pairs = np.zeros((2, 2))
    z = np.zeros(len(scores))
    for t in range(longest - 1, -1, -1):
        alive, ended = np.searchsorted(falling, -t, "left"), np.searchsorted(falling, -t - 1, "left")
        at = first[:alive] + t
        z[at[ended:]] = np.logaddexp.reduce(a[at[ended:]], axis=1)
        on = at[:ended]
        if len(on):
            z[on] = z[on + 1]
            after = (scores[on + 1] + b[on + 1])[:, None, :] + step
            b[on] = np.logaddexp.reduce(after, axis=2)
            pairs += np.exp(a[on][:, :, None] + after - z[on][:, None, None]).sum(0)
    return np.exp(a + b - z[:, None]), pairs


def fit(x: np.ndarray, lengths: np.ndarray, bad: np.ndarray, rounds: int = 3, steps: int = 120) -> dict:
    """emit (2, features) and step (2, 2) from sequences of lines; bad: 1 for sequences of documents of low quality.

    Hidden line labels: the first targets are the documents' labels; then posteriors under the model with a prior of
    19 to 1 for the document's label, so that a notice in a good text, or a clean line in junk, can change sides.
    """
    bad = np.repeat(bad.astype(float), lengths)
    prior = np.where(bad > 0, 0.95, 0.05)
    target = prior
    w, step = np.array(DEFAULT["emit"]), np.array(DEFAULT["step"])
    n = max(1, len(x))
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    inner = np.flatnonzero(inner)
    for _ in range(rounds):
        soft = np.stack([1 - target, target], 1)
        want, want_pairs = soft.T @ x, soft[inner].T @ soft[inner + 1] if len(inner) else np.zeros((2, 2))
        m, v = [np.zeros_like(w), np.zeros_like(step)], [np.zeros_like(w), np.zeros_like(step)]
        for i in range(1, steps + 1):
            p, pairs = marginals(x @ w.T, lengths, step)
            for k, (par, g) in enumerate(((w, (want - p.T @ x) / n - 1e-4 * w), (step, (want_pairs - pairs) / n - 1e-3 * step))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                par += 0.1 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        p, _ = marginals(x @ w.T + np.log(np.stack([1 - prior, prior], 1)), lengths, step)
        target = p[:, 1]
    return {"emit": w.tolist(), "step": step.tolist()}


def train(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE) -> dict:
    """The model from at most sample documents of either quality, those of the least hashes of their id; DEFAULT without both."""
    if labels is None:
        return DEFAULT
    judged = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    have = {r.quality: r.n for r in judged.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(have) < 2:
        return DEFAULT
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text"))
    # Ids are chosen before texts are read; rows that repeat an id come with it, so the rows are bounded once more.
    ids = [least_hashes(judged.where(F.col("quality") == q).select("doc_id", "quality", F.xxhash64(F.lit("sample"), "doc_id").alias("h")), sample) for q in (0, 1)]
    if not all(map(len, ids)):
        return DEFAULT
    chosen = docs.sparkSession.createDataFrame(pd.concat(ids))
    got = texts.join(F.broadcast(chosen), "doc_id").orderBy("h").limit(4 * sample).toPandas().sort_values(["doc_id", "text"])  # bounded: see SAMPLE
    parts = list(zip(got.text, got.quality, strict=True))
    parts = [(measure(t)[1][:SAMPLE_LINES], q) for t, q in parts]
    parts = [(x, q) for x, q in parts if len(x)]
    if len({q for _, q in parts}) < 2:
        return DEFAULT
    return fit(np.concatenate([x for x, _ in parts]), np.array([len(x) for x, _ in parts]), np.array([q == 0 for _, q in parts]))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, text_hash long"
#: Rows that are decoded together.
TOGETHER = 512


def _decided(texts: pa.Array, emit: np.ndarray, step: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base figures (rows, 5), base_failed, kept and content_share of texts."""
    found = [measure(t.as_py()) for t in texts]
    base = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
    lengths = np.array([len(f[1]) for f in found], np.int64)
    labels = viterbi(np.concatenate([f[1] for f in found]) @ emit.T, lengths, step)
    content = np.bincount(np.repeat(np.arange(len(found)), lengths), np.concatenate([f[2] for f in found]) * (labels == 0), len(found))
    failed = np.array([base_failed(a, b) for a, b in zip(base[:, 0].tolist(), base[:, 4].tolist())], bool)
    shares = content / np.maximum(base[:, 0], 1)
    return base, failed, ~failed & (shares >= share), shares


def judge(docs: DataFrame, model: dict, share: float = CONTENT_SHARE) -> DataFrame:
    """A row of SCHEMA for each row of docs (doc_id, text).

    content_share is the share of words in lines decoded as content (lines without a word have no label); null
    without words. Null and empty texts have no words: base_failed, not kept. Repeated rows stay. Other columns are
    ignored; text_hash tells rows with one id apart. An empty table gives no rows.
    """
    emit, step = np.array(model["emit"]), np.array(model["step"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(k, TOGETHER)
                base, failed, kept, shares = _decided(batch.column(1), emit, step, share)
                cols = [batch.column(0), *(pa.array(base[:, c]) for c in range(5)), pa.array(failed), pa.array(kept), pa.array(shares, mask=base[:, 0] == 0), batch.column(2)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(rows, SCHEMA)


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge on all documents; nulls, empty texts, repeated rows and an empty table as there."""
    docs = read(spark, sf_dir, "documents")
    return judge(docs, train(docs, read(spark, sf_dir, "labels"))).drop("text_hash")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that op1 doesn't keep go, as judge decides. Rows are decided where the text is; nothing is shuffled."""
    model = train(docs, read(spark, sf_dir, "labels"))
    emit, step = np.array(model["emit"]), np.array(model["step"])
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(k, TOGETHER)
                yield batch.filter(pa.array(_decided(batch.column(at), emit, step, CONTENT_SHARE)[2]))

    return docs.mapInArrow(rows, docs.schema)
