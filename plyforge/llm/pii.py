"""Personal data: base patterns and a skip-chain conditional random field over the tokens that can hold any.

Tokens without a digit or @ are taken as plain text, which cuts a document's chain into short pieces; the others are
nodes with a label each (none, email, ip, card, phone). Neighbouring nodes share chain potentials. Nodes whose tokens
are equal, or similar (numbers that end in the same digits, addresses of one user and host), share skip potentials
wherever they stand in the document, each with the first and the last one before it of its kind, so that a number that
is a phone number in one place is one in another. Labels are inferred by loopy message passing, all documents of a batch at once.

The weights are fitted by pseudo-likelihood on a bounded sample of documents and on rewritten copies of them, in which
spans that the base patterns find are given other forms or mentioned again in part, so that the patterns miss them
while their label is known, and numbers of the same forms that mention nothing are mixed in. The method only adds
spans: base spans stay as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import join_labels, least_hashes, read

KINDS = ["email", "ip", "card", "phone"]
#: Documents with a digit or @ that the weights are fitted on at most, and the code points that each gives to the fit.
SAMPLE, SAMPLE_CHARS = 4000, 8_000
#: Rewritten copies of the sample texts that have base spans, about, evenly; one each at least.
COPIES = 2400
#: The summed weight in the fit of tokens that are no personal data, as a multiple of that of the others, at most.
OTHERS = 0.1
#: Bytes of texts whose nodes are held together, edges that are worked on together. A text is never cut: one alone needs
#: some 200 bytes for each token with a digit or @.
TOGETHER, EDGES = 4_000_000, 1 << 16
#: Rounds of message passing at least, the share of the old message that stays, and the least probability of an added span's surest node.
ROUNDS, DAMPING, SURE = 8, 0.3, 0.9

#: The base patterns. Possessive digits and look-behinds change no match; they keep long runs linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A document's messages have converged when none changes by more.
SETTLED = 1e-6
NODE = re.compile(r"[0-9@]")
BLANK = frozenset("\x20\t\n\x0b\x0c\r")
TOKEN_END = re.compile(r"[\x20\x09-\x0D]|\Z")
WORDS_BETWEEN = re.compile(r"[\x20\x09-\x0D]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches: an address starts where the run of local characters before its @ does."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            low = found.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans (kind, start, end), by start and then kind; ends are exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    first = re.search("[0-9]", text)
    if first:
        for m in IP.finditer(text, first.start()):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text, first.start()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append(("phone", m.start(), m.end()))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def nodes(text: str) -> list[tuple[int, int]]:
    """The tokens (white space is ASCII's) with a digit or @."""
    out, at = [], 0
    while m := NODE.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in BLANK:
            start -= 1
        at = TOKEN_END.search(text, m.end()).start()
        out.append((start, at))
    return out


FEATURES = [
    "bias", "@", "@ inside", "@ and dotted", "4 numbers", "4 bytes", "1-2 digits", "3-4 digits", "5-6 digits", "7-8 digits", "9-11 digits", "12-19 digits",
    "20 digits", "digits only", "digits and signs", "letters and digits", "plus", "bracket", "luhn", "after plus", "after bracket", "before bracket", "before digits", "= or quote", "ends in stop",
]
#: Digits of an added number in several tokens, at most.
MOST_DIGITS = {"card": 19, "phone": 15}
TRIM = ".,;:!?\"'()[]<>"
SIGNS = re.compile(r"[^0-9().+\[\]-]")


def features(text: str, at: list[tuple[int, int]], i: int) -> bytes:
    token = text[at[i][0] : at[i][1]]
    core = token.strip(TRIM)
    digits = re.sub("[^0-9]", "", core)
    n = len(digits)
    parts = re.split(r"[.\[\]-]+", core, maxsplit=4)
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    left, _, right = core.partition("@")
    near_left = i > 0 and WORDS_BETWEEN.fullmatch(text, at[i - 1][1], at[i][0])
    near_right = i + 1 < len(at) and WORDS_BETWEEN.fullmatch(text, at[i][1], at[i + 1][0])
    signs = bool(core) and not SIGNS.search(core)
    only = core.isascii() and core.isdigit()
    return bytes(
        (
            True, "@" in core, bool(left and right), bool(left and re.search(r".\..", right)), four, four and all(len(p) <= 4 and int(p) <= 255 for p in parts),
            1 <= n <= 2, 3 <= n <= 4, 5 <= n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 19, n >= 20, only, signs and not only,
            any(c.isalpha() for c in core), token[0] == "+", token[0] == "(", 12 <= n <= 19 and signs and luhn(digits),
            bool(near_left) and text[at[i - 1][0]] == "+", bool(near_left) and text[at[i - 1][0]] == "(", bool(near_right) and text[at[i + 1][0]] == "(", bool(near_right), "=" in token or '"' in token, token[-1:] in ".,",
        )
    )


def key(text: str, span: tuple[int, int]) -> str | bytes | None:
    """What makes nodes similar: a number's last seven digits, an address's user and host in lower case, else the token."""
    core = text[span[0] : span[1]].strip(TRIM)
    user, at, host = core.lower().partition("@")
    out = user + at + host.split(".", 1)[0] if at else "=" + core if core else None
    if core and not at and not SIGNS.search(core):
        digits = re.sub("[^0-9]", "", core)
        out = digits[-7:] if len(digits) >= 7 else out
    return out if out is None or len(out) < 64 else hashlib.md5(out.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


class Graph:
    """The nodes of some texts end to end, with chain edges (kind 0) and skip edges (kind 1)."""

    def __init__(self, texts: list[str | None]) -> None:
        x, doc, span, edges, kinds = bytearray(), array("q"), array("q"), array("q"), array("b")
        for d, text in enumerate(texts):
            at = nodes(text) if text else []
            ends: dict[str | bytes, tuple[int, int]] = {}  # the first and the last node of a kind so far
            base = len(doc)
            for i, here in enumerate(at):
                x += features(text, at, i)
                doc.append(d)
                span.extend(here)
                chained = i > 0 and WORDS_BETWEEN.fullmatch(text, at[i - 1][1], here[0])
                if chained:
                    edges.extend((base + i - 1, base + i))
                    kinds.append(0)
                if (k := key(text, here)) is not None:
                    first, last = ends.get(k, (base + i, base + i))
                    for other in {first, last} - {base + i, base + i - 1 if chained else -1}:
                        edges.extend((other, base + i))
                        kinds.append(1)
                    ends[k] = first, base + i
        self.x = np.frombuffer(x, np.uint8).reshape(-1, len(FEATURES))
        self.doc, self.span = np.array(doc, np.int64), np.array(span, np.int64).reshape(-1, 2)
        self.edges, self.kinds = np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


def labels_of(graph: Graph, spans: list[list[Span]]) -> np.ndarray:
    """The label of each node: the kind of the last span of its text that it overlaps, else 0."""
    y = np.zeros(len(graph.doc), np.int64)
    first = np.searchsorted(graph.doc, np.arange(len(spans) + 1))
    for d, found in enumerate(spans):
        starts, ends = graph.span[first[d] : first[d + 1]].T
        for kind, a, b in found:
            y[first[d] + np.searchsorted(ends, a, "right") : first[d] + np.searchsorted(starts, b, "left")] = 1 + KINDS.index(kind)
    return y


def infer(graph: Graph, model: dict, known: np.ndarray | None = None) -> np.ndarray:
    """P(label) of each node by sum-product messages in both directions of every edge, in rounds, with damping.

    Nodes with a label in known (0: none) are held at it. Rounds go on, connected part by connected part, until its
    messages have settled; on trees the result is then exact, however long they are. Loops that never settle end after
    ROUNDS and four rounds a node of their part.
    """
    emit = np.array(model["emit"]).T
    score = np.concatenate([np.zeros((0, emit.shape[1])), *(graph.x[at : at + EDGES] @ emit for at in range(0, len(graph.x), EDGES))])
    k = score.shape[1]
    if known is not None:
        held = np.flatnonzero(known)
        score[held] = -1e4
        score[held, known[held]] = 0
    a, b = graph.edges[:, 0], graph.edges[:, 1]
    pair = np.array(model["pair"])
    forth, back = np.zeros((len(a), k)), np.zeros((len(a), k))
    belief = score.copy()
    part = join_labels(np.arange(len(score)), a, b)
    most = ROUNDS + 4 * np.bincount(part, minlength=len(score))
    on, done = np.arange(len(a)), 0
    while len(on):
        moved = np.zeros(len(on))
        news = []
        for at in range(0, len(on), EDGES):
            e = on[at : at + EDGES]
            i, j, step = a[e], b[e], pair[graph.kinds[e]]
            to_b = np.logaddexp.reduce((belief[i] - back[e])[:, :, None] + step, axis=1)
            to_a = np.logaddexp.reduce((belief[j] - forth[e])[:, None, :] + step, axis=2)
            to_b -= np.logaddexp.reduce(to_b, axis=1)[:, None]
            to_a -= np.logaddexp.reduce(to_a, axis=1)[:, None]
            moved[at : at + EDGES] = np.maximum(np.abs(to_b - forth[e]).max(1), np.abs(to_a - back[e]).max(1))
            news.append((to_b, to_a))
        to_b, to_a = (np.concatenate(x) for x in zip(*news))
        forth[on], back[on] = DAMPING * forth[on] + (1 - DAMPING) * to_b, DAMPING * back[on] + (1 - DAMPING) * to_a
        i, j = a[on], b[on]
        touched = np.unique(np.concatenate([i, j]))
        belief[touched] = score[touched]
        np.add.at(belief, j, forth[on])
        np.add.at(belief, i, back[on])
        done += 1
        if done >= ROUNDS:
            change = np.zeros(len(score))
            np.maximum.at(change, part[i], moved)
            on = on[(change[part[i]] > SETTLED) & (done < most[part[i]])]
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


def forms(kind: str, found: str, rng: random.Random) -> tuple[str, str]:
    """Another form of a span's text, and a partial mention of it; most of neither kind are base spans."""
    d = re.sub("[^0-9]", "", found)
    if kind == "email":
        user, _, host = found.partition("@")
        return f"{user}@{host.split('.')[0]}", f"{user}@{host.split('.')[0]}"
    if kind == "ip":
        sign = rng.choice(["[.]", "[.]", "-"] if len(d) < 12 else ["[.]"])  # twelve digits with dashes may pass for a card
        return found.replace(".", sign), found.replace(".", sign)
    if kind == "card":
        groups = [d[k : k + 4] for k in range(0, len(d), 4)]
        return ".".join(groups), rng.choice([d[-8:], f"{d[-8:-4]}-{d[-4:]}", ".".join(groups)])
    d = d[-10:].zfill(10)
    whole = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {}.{}"]).format(d[:3], d[3:6], d[6:])
    return whole, rng.choice([f"{d[3:6]}-{d[6:]}", f"{d[3:6]}.{d[6:]}", d[3:], whole])


def rewritten(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """A copy of text with other forms of its spans, later mentions in part, spans run together, and unrelated numbers
    like these, some repeated; and the copy's known spans."""
    gaps = [m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)]
    gaps = [g for g in gaps if not any(a < g < b for _, a, b in spans)]
    edits: list[tuple[int, int, str, str | None]] = []  # (start, end, new text, kind of the new text)
    kept, end = [], 0
    for kind, a, b in spans:
        if a < end:
            continue
        end = b
        found = text[a:b]
        if kind != "email" and rng.random() < 0.3:
            edits.append((a, b, forms(kind, found, rng)[0], kind))
        else:
            kept.append((kind, a, b))
            if kind == "phone" and rng.random() < 0.5:
                k, x, y = rng.choice(spans)
                edits.append((b, b, " " + text[x:y], k))
        for g in rng.choices([g for g in gaps if g > b], k=rng.choice([0, 1, 1, 2])) if gaps and gaps[-1] > b else ():
            edits.append((g, g, " " + forms(kind, found, rng)[1], kind))
        if gaps and kind != "email":
            # A whole number that nothing else mentions is personal data all the same; these aren't.
            other = re.sub("[0-9]", lambda _: str(rng.randrange(10)), forms(kind, found, rng)[1] if kind != "ip" else rng.choice(["99.9", "9.9.9", "99", "2099", "9999-99"]))
            n = len(re.sub("[^0-9]", "", other))
            if n < 9 or n >= 12 and not luhn(re.sub("[^0-9]", "", other)):
                edits += [(g, g, " " + other, None) for g in rng.choices(gaps, k=rng.choice([1, 1, 2, 3]))]
    edits.sort(key=lambda x: x[:2])
    out, known, at, size = [], [], 0, 0
    for a, b, new, kind in edits:
        out += [text[at:a], new]
        size += a - at
        if kind:
            known.append((kind, size + len(new) - len(new.lstrip()), size + len(new)))
        size += len(new)
        at = b
    copy = "".join([*out, text[at:]])
    for kind, a, b in kept:
        moved = sum(len(new) - (y - x) for x, y, new, _ in edits if x < a)
        known.append((kind, a + moved, b + moved))
    return copy, known + base_spans(copy)


def fit(texts: list[str], steps: int = 600, seed: int = 5) -> dict:
    """emit (labels, features) and pair (edge kinds, labels, labels), symmetric, by pseudo-likelihood and Adam.

    Skip potentials are one weight for equal labels, so that a repeat alone speaks for no kind.

    Trained on texts and on some COPIES rewritten copies of those with base spans. A node's label is the kind of a base
    span, or of a form or mention that rewriting put there, that it overlaps. Nodes without one that are similar to a
    node with one are left out: whether they are the same entity is what the skip edges are to tell.
    """
    rng = random.Random(seed)
    bases = [base_spans(t) for t in texts]
    each = -(-COPIES // max(1, sum(map(bool, bases))))
    copies = [rewritten(t, spans, rng) for t, spans in zip(texts, bases) if spans for _ in range(each)]
    graph = Graph([*texts, *(t for t, _ in copies)])
    k = 1 + len(KINDS)
    y = labels_of(graph, [*bases, *(spans for _, spans in copies)])
    used = np.ones(len(y), bool)
    for (a, b), kind in zip(graph.edges, graph.kinds):
        if kind == 1 and (y[a] == 0) != (y[b] == 0):
            used[a if y[a] == 0 else b] = False
    prior = np.stack([np.zeros((k, k)), 2 * np.eye(k)])
    emit, pair = np.zeros((k, len(FEATURES))), prior.copy()
    if not len(y):
        return {"emit": emit.tolist(), "pair": pair.tolist()}
    a, b = graph.edges[:, 0], graph.edges[:, 1]
    m, v = [np.zeros_like(emit), np.zeros_like(pair)], [np.zeros_like(emit), np.zeros_like(pair)]
    one, x = np.eye(k)[y], graph.x.astype(float)
    # A mention missed counts as much as the more numerous other tokens.
    weight = used * np.where(y == 0, min(1.0, OTHERS * (used & (y > 0)).sum() / max(1, (used & (y == 0)).sum())), 1.0)
    n = max(1.0, weight.sum())
    for t in range(1, steps + 1):
        score = x @ emit.T
        np.add.at(score, a, pair[graph.kinds, :, y[b]])
        np.add.at(score, b, pair[graph.kinds, y[a], :])
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (one - p) * weight[:, None]
        g_pair = np.zeros_like(pair)
        np.add.at(g_pair, (graph.kinds, slice(None), y[b]), off[a])
        np.add.at(g_pair.transpose(0, 2, 1), (graph.kinds, slice(None), y[a]), off[b])
        g_pair = (g_pair + g_pair.transpose(0, 2, 1)) / 2
        g_pair[1] = np.eye(k) * np.trace(g_pair[1])  # one skip weight, for equal labels whichever they are
        for i, (par, g) in enumerate(((emit, off.T @ x / n - 1e-5 * emit), (pair, g_pair / n - 1e-5 * (pair - prior)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            par += 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return {"emit": emit.tolist(), "pair": pair.tolist()}


def added_spans(texts: list[str | None], bases: list[list[Span]], model: dict) -> list[list[Span]]:
    """For each text the spans beyond its base spans: nodes that no base span touches and whose likeliest label is a kind.

    A number in several tokens is one span, up to as many digits as its kind has. One node of a span has to be SURE.
    """
    graph = Graph(texts)
    held = labels_of(graph, bases)
    p = infer(graph, model, held)
    label = p.argmax(1)
    out: list[list[Span]] = [[] for _ in texts]
    runs: list[list[int]] = []
    for i in np.flatnonzero((label > 0) & (held == 0)).tolist():
        if runs and runs[-1][-1] == i - 1 and label[i - 1] == label[i] and graph.doc[i - 1] == graph.doc[i]:
            text, start, (s, e) = texts[graph.doc[i]], graph.span[runs[-1][0]][0], graph.span[i]
            digits = sum(map(text[start:e].count, "0123456789"))
            if digits <= MOST_DIGITS.get(KINDS[label[i] - 1], 0) and WORDS_BETWEEN.fullmatch(text, graph.span[i - 1][1], s):
                runs[-1].append(i)
                continue
        runs.append([i])
    for run in runs:
        if p[run, label[run[0]]].max() < SURE:
            continue
        d, s, e = int(graph.doc[run[0]]), int(graph.span[run[0]][0]), int(graph.span[run[-1]][1])
        text = texts[d]
        while text[s] in TRIM and text[s] != "(" and s + 1 < e:
            s += 1
        while text[e - 1] in TRIM and e - 1 > s:
            e -= 1
        out[d].append((KINDS[label[run[0]] - 1], s, e))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from at most sample rows of docs with a digit or @: those of the least hashes of id and text.

    Each gives its first SAMPLE_CHARS code points to the fit; spans are looked for in whole texts, see find.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    rows = rows.select(F.xxhash64(F.lit("pii"), "doc_id", "text").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    return fit([t for t in least_hashes(rows, sample).text if NODE.search(t)])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, model: dict) -> DataFrame:
    """A row of SCHEMA for each row of docs (doc_id, text).

    The counts and base_sha256 are of the base spans, spans holds all. Null and empty texts have none. Repeated rows
    stay; other columns are not read. No rows: no rows.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(size // TOGETHER)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            texts: list[str | None] = [t.as_py() for t in batch.column(1)]
            texts = [t if t and NODE.search(t) else None for t in texts]
            base = [base_spans(t) if t else [] for t in texts]
            more = added_spans(texts, base, model)
            counts = [[sum(s[0] == k for s in spans) for spans in base] for k in KINDS]
            cols = [
                batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()),
                pa.array([joined(ordered(s + m)) for s, m in zip(base, more, strict=True)], pa.string()),
                pa.array([len(m) for m in more], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find on all documents; nulls, empty texts, repeated rows and an empty table as there."""
    docs = read(spark, sf_dir, "documents")
    return find(docs, train(docs))
