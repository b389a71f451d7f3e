"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are laid out in blocks of 8. Channels of a block are its bytes' learned embeddings and, for each of a few
distances, how many of its bytes repeat the byte that far back, which is what repeated words look like to a filter. Learned
filters 4 blocks wide slide over all blocks; chunks of 64 positions that overlap by half are max-pooled, and a text's chunks,
by their mean and their maximum, give one probability. Chunks cover the whole text, whatever its length; texts are laid out one after
another, so that one matrix product serves many, and a long text is run through in pieces that overlap by a chunk.

Training is the one step on a bounded sample: at most `per_class` labelled documents of each class, those of the smallest
hashes, and of a document beyond `TRAIN_BYTES` one piece placed by hash. Classes are weighted back to their shares among all
labelled training rows, so that scores are probabilities. Scoring covers every row and every byte.

Null and empty texts have one all-padding chunk and get the score the network gives that. Without labels of both classes every
score is their mean, or 0.5 without any. Repeated labels of a document count once, by their minimum; null labels do not count. Repeated
documents are scored each. An empty table gives no rows. Only id and text are read from documents, id and label from labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import fold
from vitalgrid.llm.labelled import labelled_sample

BLOCK, WIDTH, HALF = 8, 4, 32
DIMENSIONS, FILTERS = 6, 24
LAGS = tuple(range(2, 18))
PIECE = BLOCK * HALF
#: The sample's bounds: documents of a class, bytes of a document.
PER_CLASS, TRAIN_BYTES = 900, 1 << 15
EPOCHS, BATCH, RATE, SEED = 8, 32, 4e-3, 7
#: Bytes put through the network at once.
AT_ONCE = 1 << 19


@dataclass
class Network:
    embedding: np.ndarray  # (256, DIMENSIONS)
    filters: np.ndarray    # (WIDTH, channels, FILTERS)
    shift: np.ndarray      # (FILTERS,)
    head: np.ndarray       # (2 * FILTERS + 1,)

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        channels = BLOCK * DIMENSIONS + len(LAGS)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(256, DIMENSIONS, scale=0.5), draw(WIDTH, channels, FILTERS, scale=1 / np.sqrt(WIDTH * channels)), np.zeros(FILTERS, np.float32),
                   draw(2 * FILTERS + 1, scale=0.1))

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.shift, self.head]


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros by at least the filters' overhang to whole half chunks; first half chunk of each."""
    overhang = BLOCK * (WIDTH - 1)
    halves = np.array([-(-(len(t) + overhang) // PIECE) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(halves)])
    flat = np.zeros(int(starts[-1]) * PIECE, np.uint8)
    for t, s in zip(texts, starts):
        flat[s * PIECE: s * PIECE + len(t)] = np.frombuffer(t, np.uint8)
    return flat, starts


def channels(net: Network, flat: np.ndarray) -> np.ndarray:
    out = np.empty((len(flat) // BLOCK, BLOCK * DIMENSIONS + len(LAGS)), np.float32)
    out[:, : BLOCK * DIMENSIONS] = net.embedding[flat].reshape(-1, BLOCK * DIMENSIONS)
    used = flat != 0
    same = np.zeros(len(flat), bool)
    for i, lag in enumerate(LAGS):
        np.equal(flat[lag:], flat[:-lag], out=same[lag:])
        same[:lag] = False
        same &= used
        out[:, BLOCK * DIMENSIONS + i] = np.bitwise_count(same.view(np.uint64)) * (1 / BLOCK)
    return out


def half_maxima(net: Network, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters' maxima over each half chunk, at least 0, and the channels."""
    x = channels(net, flat)
    n = len(x)
    y = x @ net.filters[0]
    for j in range(1, WIDTH):
        y[: n - j] += x[j:] @ net.filters[j]
    y += net.shift
    ends = starts[1:] * HALF
    for j in range(1, WIDTH):
        y[ends - j] = 0  # windows that would reach into the next text start in its padding
    return y, x


def pooled(halves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, 2 * FILTERS): mean and maximum over the overlapping chunks of each text."""
    chunk = halves.copy()
    inner = np.ones(len(halves), bool)
    inner[starts[1:] - 1] = False  # the last half chunk of a text has no successor
    at = np.flatnonzero(inner)
    chunk[at] = np.maximum(halves[at], halves[at + 1])
    mean = np.add.reduceat(chunk, starts[:-1], axis=0) / np.diff(starts)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunk, starts[:-1], axis=0)], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def probability(net: Network, features: np.ndarray) -> np.ndarray:
    return _sigmoid(features @ net.head[:-1] + net.head[-1])


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities of whole texts, in bounded memory."""
    out = np.empty(len(texts))
    group: list[int] = []
    size = 0

    def flush() -> None:
        flat, starts = lay_out([texts[i] for i in group])
        y, _ = half_maxima(net, flat, starts)
        halves = np.maximum(y.reshape(-1, HALF, FILTERS).max(1), 0)
        out[group] = probability(net, pooled(halves, starts))

    for i, text in enumerate(texts):
        if len(text) > 4 * AT_ONCE:
            out[i] = _score_long(net, text)
            continue
        group.append(i)
        size += len(text) + PIECE
        if size >= AT_ONCE:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out


def _score_long(net: Network, text: bytes) -> float:
    """One text in pieces; each piece sees what filters and distances need from its neighbours, so the result is that of the whole."""
    halves, before, after = [], PIECE, PIECE
    step = AT_ONCE // PIECE * PIECE
    for start in range(0, len(text), step):
        low = max(0, start - before)
        flat, starts = lay_out([text[low: start + step + after]])
        y, _ = half_maxima(net, flat, starts)
        got = np.maximum(y.reshape(-1, HALF, FILTERS).max(1), 0)
        skip = (start - low) // PIECE
        last = start + step >= len(text)
        halves.append(got[skip:] if last else got[skip: skip + step // PIECE])
    joined = np.concatenate(halves)
    return float(probability(net, pooled(joined, np.array([0, len(joined)])))[0])


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    flat, starts = lay_out(texts)
    y, x = half_maxima(net, flat, starts)
    y = y.reshape(-1, HALF, FILTERS)
    best = y.argmax(1)
    halves = np.maximum(np.take_along_axis(y, best[:, None], 1)[:, 0], 0)
    features = pooled(halves, starts)
    off = ((probability(net, features) - labels) * weights / len(texts)).astype(np.float32)
    g_head = np.concatenate([features.T @ off, [off.sum()]]).astype(np.float32)
    g_mean, g_max = off[:, None] * net.head[None, :FILTERS], off[:, None] * net.head[None, FILTERS:-1]
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    # Gradients of chunks, then of the half chunk that gave each chunk its maximum.
    chunk_from = np.repeat(np.arange(len(halves))[:, None], FILTERS, 1)
    nxt = np.minimum(np.arange(len(halves)) + 1, len(halves) - 1)
    inner = np.append(text_of[1:] == text_of[:-1], False)
    takes = inner[:, None] & (halves[nxt] > halves)
    chunk_from[takes] += 1
    chunk = np.where(takes, halves[nxt], halves)
    g_chunk = (g_mean / np.diff(starts)[:, None])[text_of]
    top = chunk == np.maximum.reduceat(chunk, starts[:-1], axis=0)[text_of]
    before = np.cumsum(top, axis=0) - top
    top &= before == before[starts[:-1]][text_of]  # of a text's equal chunks the first
    g_chunk = g_chunk + np.where(top, g_max[text_of], 0)
    g_half = np.zeros_like(halves)
    columns = np.broadcast_to(np.arange(FILTERS), chunk_from.shape)
    np.add.at(g_half, (chunk_from, columns), g_chunk)
    g_half *= halves > 0
    place = best + HALF * np.arange(len(halves))[:, None]
    g_filters, g_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    blocks = flat.reshape(-1, BLOCK)
    for f in range(FILTERS):
        rows = np.flatnonzero(g_half[:, f])
        if not len(rows):
            continue
        p, g = place[rows, f], g_half[rows, f]
        for j in range(WIDTH):
            q = np.minimum(p + j, len(x) - 1)
            g_filters[j, :, f] = g @ x[q]
            back = net.filters[j, : BLOCK * DIMENSIONS, f].reshape(BLOCK, DIMENSIONS)
            per_byte = np.zeros((BLOCK, 256), np.float32)
            for b in range(BLOCK):
                per_byte[b] = np.bincount(blocks[q, b], weights=g, minlength=256)
            g_embedding += per_byte.T @ back
    return [g_embedding, g_filters, g_half.sum(0), g_head]


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the weighted logistic loss; same sample, same network."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            at = order[s: s + BATCH]
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for p, g, m, v in zip(net.parts(), _gradients(net, [texts[i] for i in at], labels[at], weights[at]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


# --- jobs ---------------------------------------------------------------------------------------------------------------------

def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Network | float:
    """A trained network, or the constant score where labels do not have both classes."""
    sample, shares = labelled_sample(docs, labels, label, per_class, TRAIN_BYTES, id_col, text_col)
    held = sample["label"].value_counts().to_dict()
    if set(held) != {0, 1}:
        return 0.5 if not shares else float(sum(c * n for c, n in shares.items()) / sum(shares.values()))
    y = sample["label"].to_numpy(np.float32)
    weight = {c: shares[c] / sum(shares.values()) * len(sample) / held[c] for c in (0, 1)}
    return train([t.encode() for t in sample["text"]], y, np.where(y == 1, weight[1], weight[0]).astype(np.float32))


def score(docs: DataFrame, model: Network | float, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if isinstance(model, float):
                scores = np.full(len(batch), model)
            else:
                scores = score_texts(model, [t.encode() for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInPandas(read, "doc_id string, score double")
    return scored.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
