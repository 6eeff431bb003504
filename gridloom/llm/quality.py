"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good (1) or bad (0). Line scores are linear in features of the line and of its neighbours; pairs of
neighbouring lines have scores of their own. Forward and backward sums give each line's marginal of being good; the
document's quality is the mean of the marginals, weighted by the lines' length. Training takes the document's label for
all its lines and climbs the conditional log-likelihood, with pair scores held within PAIR_BOUND at every step (labels of
whole documents never change within one, so that unbounded pair scores would outweigh all lines). It uses at most
``max_docs`` labelled documents with at most ``max_lines`` lines in all (by hash of doc_id, so that the sample does not
depend on the input's order); everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table

MAX_DOCS = 4000
MAX_LINES = 400_000
#: Largest score of a pair of neighbouring states, in training and after it.
PAIR_BOUND = 2.0
#: Lines of a chain in training; a longer document gives several chains.
CHAIN = 128
#: Bytes of text handled at once.
PIECE = 2 << 20
OWN = (
    "length", "upper", "digit", "mark", "bang", "symbol", "bar", "space", "other", "word_length", "ends", "capital",
    "repeat", "long_word", "echo",
)
NAMES = ("bias", *OWN, *(f"before_{x}" for x in OWN), *(f"after_{x}" for x in OWN), "first", "last")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[np.frombuffer(chars, np.uint8)] = 1
    return out


UPPER, DIGIT, MARK, BANG, SYMBOL, BAR = (
    _class(c) for c in (bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?'\"()-", b"!", b"#*$%&<>@~^", b"|")
)
BLANK = _class(b" \t\r\x0b\x0c")
OTHER = (np.arange(256) >= 128).astype(np.uint8)


def features(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end, each closed by a line break at ``ends``: the feature matrix of their lines, the lines'
    lengths in bytes, and the first line of each text (with the number of lines at the end)."""
    breaks = np.flatnonzero(buffer == 10)
    starts = np.concatenate(([0], breaks[:-1] + 1))
    length = (breaks - starts).astype(np.float64)
    first = np.concatenate(([0], np.searchsorted(breaks, ends, side="right")))
    share = lambda t: np.add.reduceat(t[buffer], starts, dtype=np.int64) / np.maximum(length, 1)
    blank = BLANK[buffer]
    blank[breaks] = 1
    gap = np.flatnonzero(blank)
    words = np.diff(np.concatenate(([-1], gap))) - 1
    per_line = np.searchsorted(gap, breaks, side="right")
    at = np.concatenate(([0], per_line[:-1]))
    n_words = np.maximum(np.add.reduceat((words > 0).astype(np.int64), at), 1)
    space = np.add.reduceat(blank, starts, dtype=np.int64) - 1
    # A running sum of mixed bytes tells lines apart; equal lines of one text have equal sums.
    mixed = np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _scatter(len(buffer), starts, breaks))
    code = mixed[breaks] - np.where(starts > 0, mixed[starts - 1], np.uint64(0))
    text = np.searchsorted(ends, breaks)
    order = np.lexsort((np.arange(len(code)), code, text))
    again = np.zeros(len(code))
    same = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    again[order[1:][same]] = 1.0
    again[length == 0] = 0.0
    # Words equal to the word before them in the line.
    at_word = gap[words > 0]
    size_word = words[words > 0]
    word_code = mixed_words(buffer, at_word, size_word)
    line_of = np.searchsorted(breaks, at_word)
    twice = np.flatnonzero((word_code[1:] == word_code[:-1]) & (line_of[1:] == line_of[:-1])) + 1
    echo = np.bincount(line_of[twice], minlength=len(breaks)) / n_words
    tail = buffer[np.maximum(breaks - 1, starts)]
    head = buffer[starts]
    own = np.stack(
        [
            np.log1p(length) / 6,
            share(UPPER),
            share(DIGIT),
            share(MARK),
            share(BANG),
            share(SYMBOL),
            share(BAR),
            space / np.maximum(length, 1),
            share(OTHER),
            (length - space) / n_words / 8,
            np.isin(tail, np.frombuffer(b".?", np.uint8)),
            UPPER[head],
            again,
            np.minimum(np.maximum.reduceat(words, at), 60) / 30,
            echo,
        ],
        axis=1,
    ).astype(np.float64)
    is_first = np.zeros(len(breaks), bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(len(breaks), bool)
    is_last[first[1:] - 1] = True
    before = np.where(is_first[:, None], 0.0, np.roll(own, 1, 0))
    after = np.where(is_last[:, None], 0.0, np.roll(own, -1, 0))
    return np.hstack([np.ones((len(own), 1)), own, before, after, is_first[:, None], is_last[:, None]]), length, first


def mixed_words(buffer: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A code for each word, from the bytes and their places before its end."""
    if not len(ends):
        return np.zeros(0, np.uint64)
    place = np.repeat(ends, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) - 1
    back = (np.repeat(ends, size) - place).astype(np.uint64)
    z = (buffer[place].astype(np.uint64) + np.uint64(1)) * (back * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(z, np.cumsum(size) - size)


def _scatter(n: int, starts: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Odd weights by the place in the line."""
    place = np.arange(n, dtype=np.uint64) - np.repeat(starts.astype(np.uint64), breaks - starts + 1)
    z = place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z | np.uint64(1)


def forward_backward(
    emit: np.ndarray, pair: np.ndarray, first: np.ndarray, with_pairs: bool = False
) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1 for chains laid end to end; expected pair counts and the log-sum of all chains where asked.

    ``emit``: score of state 1 against 0 by line; ``pair``: 2 x 2 scores; ``first``: starts of the chains and the end.
    Chains run side by side, longest first, so that each step is one vector operation over those still running.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(steps), side="left")
    lse = lambda a, b: np.logaddexp(a, b)
    alpha = np.zeros((len(emit), 2))
    for t in range(steps):
        k = running[t]
        at = start[:k] + t
        if t:
            a = alpha[at - 1]
            alpha[at, 0] = lse(a[:, 0] + pair[0, 0], a[:, 1] + pair[1, 0])
            alpha[at, 1] = lse(a[:, 0] + pair[0, 1], a[:, 1] + pair[1, 1]) + emit[at]
        else:
            alpha[at, 1] = emit[at]
    beta = np.zeros((len(emit), 2))
    for t in range(steps - 2, -1, -1):
        k = running[t + 1]
        at = start[:k] + t
        b0, b1 = beta[at + 1, 0], beta[at + 1, 1] + emit[at + 1]
        beta[at, 0] = lse(pair[0, 0] + b0, pair[0, 1] + b1)
        beta[at, 1] = lse(pair[1, 0] + b0, pair[1, 1] + b1)
    both = alpha + beta
    marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    if not with_pairs:
        return marginal, np.zeros((2, 2)), 0.0
    z = lse(both[:, 0], both[:, 1])
    inner = np.ones(len(emit), bool)
    inner[first[1:] - 1] = False
    i = np.flatnonzero(inner)
    e = np.stack([np.zeros(len(i)), emit[i + 1]], 1)
    joint = np.exp(
        np.clip(alpha[i][:, :, None] + pair[None] + (beta[i + 1] + e)[:, None, :] - z[i][:, None, None], -500, 0)
    )
    return marginal, joint.sum(0), float(z[first[1:] - 1].sum())


def train(
    x: np.ndarray,
    first: np.ndarray,
    labels: np.ndarray,
    *,
    rounds: int = 300,
    rate: float = 0.08,
    decay: float = 1e-4,
    pair_bound: float = PAIR_BOUND,
) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the log-likelihood, every document with the same weight; pair weights are projected back within
    ``pair_bound`` after each step. Returns line and pair weights."""
    cut = np.concatenate([np.arange(a, b, CHAIN) for a, b in zip(first[:-1], first[1:], strict=True)] + [[first[-1]]])
    y = np.repeat(labels, np.diff(first)).astype(np.float64)
    per_doc = np.repeat(1 / np.diff(first), np.diff(first))
    scale = per_doc / per_doc.sum()
    spread = np.maximum(x.std(0), 0.01)
    spread[0] = 1.0
    x = x / spread
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(y), bool)
    inner[cut[1:] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.array(
        [
            [((1 - y[i]) * (1 - y[i + 1])).sum(), ((1 - y[i]) * y[i + 1]).sum()],
            [(y[i] * (1 - y[i + 1])).sum(), (y[i] * y[i + 1]).sum()],
        ]
    )
    for step in range(1, rounds + 1):
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, _ = forward_backward(x @ w, pair, cut, True)
        g = np.concatenate([x.T @ ((y - p) * scale), ((seen - pairs) / max(1, len(i))).ravel()]) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -pair_bound, pair_bound)
    return theta[:-4] / spread, theta[-4:].reshape(2, 2)


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each closed by a line break; an empty text is one empty line."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    return buffer, np.cumsum([len(t) + 1 for t in texts]) - 1


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) with about PIECE bytes in each."""
    rows, size, at = [], 0, 0
    for i, t in enumerate(batch.column(1)):
        t = (t.as_py() or "").encode()
        rows.append(t)
        size += len(t)
        if size >= PIECE:
            yield at, rows
            rows, size, at = [], 0, i + 1
    if rows:
        yield at, rows


def score_texts(
    texts: list[bytes], w: np.ndarray, pair: np.ndarray, adjust: tuple[float, float]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts; with the marginals of all lines and the first line of each text."""
    x, length, first = features(*_laid(texts))
    p, _, _ = forward_backward(x @ w, pair, first)
    weight = length + 1
    mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    logit = np.log(np.clip(mean, 1e-9, 1 - 1e-9)) - np.log(np.clip(1 - mean, 1e-9, 1 - 1e-9))
    return 1 / (1 + np.exp(-(adjust[0] + adjust[1] * logit))), p, first


def fit(
    docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES
) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Line weights, pair weights, and the (offset, slope) that set a document's mean marginal against its label.

    ``labels``: doc_id, quality (0 or 1). Rows with a null in either, and held-out ids, are not used. Without labels of
    both kinds, or without documents, all scores are 0.5. What reaches the driver is max_lines rows of features at most:
    documents whose lines would exceed it are passed over.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = each.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(max_docs)
    # The sample has max_docs rows at most, so that it may be broadcast.
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text")).join(
        F.broadcast(sample.select(F.col("doc_id").alias("id"), "quality")), "id"
    ).select("quality", F.coalesce("text", F.lit("")).alias("text"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows in _pieces(b):
                x, length, first = features(*_laid(rows))
                blobs = [x[a:z].astype(np.float32).tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                sizes = [length[a:z].astype(np.float32).tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                part = b.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(0), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())],
                    names=["id", "quality", "x", "length"],
                )

    # At most max_docs ids and their lines, in one window.
    lines = texts.groupBy("id").agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1).alias("lines"))
    upto = F.sum("lines").over(
        Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    short = lines.where(
        F.col("lines") <= max_lines // 8
    ).withColumn("upto", upto).where(F.col("upto") <= max_lines).select("id")
    texts = texts.join(F.broadcast(short), "id").select("quality", "text", "id")
    got = texts.mapInArrow(
        run, "id long, quality int, x binary, length binary"
    ).orderBy("id", "x").toArrow().to_pydict()
    y = np.array(got["quality"], np.float64)
    if len(set(got["quality"])) < 2:
        return np.zeros(len(NAMES)), np.zeros((2, 2)), (0.0, 1.0)
    parts = [np.frombuffer(b, np.float32).reshape(-1, len(NAMES)) for b in got["x"]]
    x, first = np.vstack(parts).astype(np.float64), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    w, pair = train(x, first, y)
    p, _, _ = forward_backward(x @ w, pair, first)
    weight = np.concatenate([np.frombuffer(b, np.float32) for b in got["length"]]).astype(np.float64) + 1
    mean = np.clip(np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 1e-9, 1 - 1e-9)
    return w, pair, _logistic(np.log(mean / (1 - mean)), y)


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        h = p * (1 - p) + 1e-6
        grad = np.array([(y - p).sum() - 1e-2 * a, ((y - p) * z).sum() - 1e-2 * (b - 1)])
        hess = np.array([[h.sum() + 1e-2, (h * z).sum()], [(h * z).sum(), (h * z * z).sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -1, 1))
    return a, max(b, 0.05)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, tuple[float, float]]) -> DataFrame:
    """All rows of ``docs`` with their columns in a struct ``row``, score and predicted; null texts count as empty, which
    is one empty line. Very long texts are one chain of all their lines. Repeated rows keep a row each, empty tables give
    no rows, columns may have any names."""
    w, pair, adjust = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows in _pieces(b):
                s, _, _ = score_texts(rows, w, pair, adjust)
                yield pa.RecordBatch.from_arrays(
                    [b.slice(at, len(rows)).column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    names=["row", "score", "predicted"],
                )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    schema = [
        T.StructField("row", rows.schema["row"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    ]
    return rows.mapInArrow(run, T.StructType(schema))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = docs.select("doc_id", "text")
    got = score(rows, model)
    return got.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
