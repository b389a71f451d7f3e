"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Fitting takes a bounded sample (`PER_CLASS` labelled documents of each class). A document's terms are its words and their
beginnings of 4 to 6 letters; terms whose presence depends on the label by a chi-squared test make the vocabulary, so vectors
say what matters and a long clean text does not drown a few telling words. Vectors are (1 + log tf) * idf, of unit length.

The index keeps examples in the order of their heaviest term, in blocks of 256 that all posting lists share, with the largest
weight of each list in each block. A query's bound for a block is the dot product with those maxima; blocks are scored in the
order of their bounds until none can still enter the k nearest. The result is exactly the k nearest (ties: smaller place in the index).

Votes are weighted by similarity: the k neighbours' (+1 toxic, -1 clean) * cosine, over k. A logistic curve fitted on the sample
itself, each example without its own vote and classes weighted back to their shares, makes probabilities of votes.

Each row is scored over its whole text. Null and empty texts, and texts without a term of the vocabulary, get the curve's value
at no votes. Without labels of both classes every score is their mean, or 0 without any. Repeated documents are scored each. An
empty table gives no rows. Only id and text are read from documents, id and label from labels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import fold
from vitalgrid.llm.labelled import labelled_sample

#: The sample's bounds: documents of a class, characters of a document.
PER_CLASS, TRAIN_CHARS = 2500, 1 << 15
#: Bounds of the vocabulary: terms, examples a term occurs in at least, chi-squared.
TERMS, MIN_EXAMPLES, MIN_CHI = 8192, 3, 30.0
STEMS = (4, 5, 6)
NEAREST, BLOCK = 15, 256
#: Distinct words a worker remembers.
MEMORY = 500_000
#: ASCII capitals to small letters, other ASCII but letters and digits to spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def terms_of(word: bytes) -> list[str]:
    w = word.decode()
    return [w, *[w[:k] + "*" for k in STEMS if len(w) > k]]


@dataclass
class Index:
    terms: dict[str, int]
    idf: np.ndarray
    ids: list           # document of each place, in index order
    toxic: np.ndarray
    starts: np.ndarray  # (terms, blocks + 1): where a list's block begins
    places: np.ndarray
    weights: np.ndarray
    tops: np.ndarray    # (terms, blocks): largest weight
    block: int = BLOCK

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights, of unit length."""
        at = np.fromiter(counts, np.int64, len(counts))
        w = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.idf[at]
        return at, w / np.sqrt((w * w).sum())

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, nearest first."""
        bounds, lists = w @ self.tops[at], self.starts[at]
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(scores) == k and bounds[b] + 1e-9 < scores[-1]:
                break
            parts = [(slice(s, e), x) for s, e, x in zip(lists[:, b].tolist(), lists[:, b + 1].tolist(), w) if s < e]
            inside = np.concatenate([self.places[p] for p, _ in parts]) - b * self.block
            block = np.bincount(inside, weights=np.concatenate([self.weights[p] * x for p, x in parts]), minlength=self.block)
            if without >= 0 and without // self.block == b:
                block[without % self.block] = 0
            hit = np.flatnonzero(block)
            places, scores = np.concatenate([places, hit + b * self.block]), np.concatenate([scores, block[hit]])
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
        return places, scores


def _vocabulary(texts: list[str], labels: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Terms by chi-squared against the label, and how many examples hold each."""
    held: tuple[Counter, Counter] = (Counter(), Counter())
    known: dict[bytes, list[str]] = {}
    for text, label in zip(texts, labels):
        seen: set[str] = set()
        for word in set(words_of(text)):
            if word not in known:
                known[word] = terms_of(word)
            seen.update(known[word])
        held[label].update(seen)
    n = [int((labels == c).sum()) for c in (0, 1)]
    chosen = []
    for term in held[0].keys() | held[1].keys():
        a, b = held[1][term], held[0][term]
        if a + b < MIN_EXAMPLES:
            continue
        cross = a * (n[0] - b) - b * (n[1] - a)
        chi = sum(n) * cross * cross / ((a + b) * max(sum(n) - a - b, 1) * n[0] * n[1])
        if chi >= MIN_CHI:
            chosen.append((-chi, term, a + b))
    chosen.sort()
    return {term: i for i, (_, term, _) in enumerate(chosen[:TERMS])}, np.array([df for _, _, df in chosen[:TERMS]], np.float64)


def _counted(words: list[bytes], terms: dict[str, int], known: dict[bytes, tuple[int, ...]]) -> Counter:
    counts: Counter = Counter()
    for word in words:
        at = known.get(word)
        if at is None:
            if len(known) >= MEMORY:
                known.clear()
            known[word] = at = tuple(terms[t] for t in terms_of(word) if t in terms)
        if at:
            counts.update(at)
    return counts


def build_index(ids: list, texts: list[str], labels: np.ndarray, block: int = BLOCK) -> tuple[Index, list[Counter]]:
    """Index of all examples that hold a term; term counts of every example."""
    terms, df = _vocabulary(texts, labels)  # texts are split one at a time, twice: the words of all do not fit a small driver
    known: dict[bytes, tuple[int, ...]] = {}
    counts = [_counted(words_of(t), terms, known) for t in texts]
    index = Index(terms, np.log((1 + len(texts)) / (1 + df)) + 1, [], np.zeros(0, bool), *[np.zeros(0)] * 4, block)
    vectors = {i: index.vector(c) for i, c in enumerate(counts) if c}
    order = sorted(vectors, key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), i))
    blocks = -(-len(order) // block)
    term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
    weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
    by = np.lexsort((place, term))
    term, place, weight = term[by], place[by], weight[by]
    cell = term * (blocks + 1) + place // block
    index.starts = np.searchsorted(cell, np.arange(len(terms) * (blocks + 1))).reshape(len(terms), blocks + 1)
    index.tops = np.zeros((len(terms), blocks))
    np.maximum.at(index.tops, (term, place // block), weight)
    index.ids, index.toxic, index.places, index.weights = [ids[i] for i in order], labels[order].astype(bool), place, weight
    return index, counts


@dataclass
class Judge:
    """An index with the curve from votes to probabilities."""

    index: Index
    slope: float
    level: float

    def vote(self, counts: Counter, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        if not counts:
            return 0.0, np.zeros(0, np.int64), np.zeros(0)
        places, scores = self.index.nearest(*self.index.vector(counts), without=without)
        return float((scores * np.where(self.index.toxic[places], 1, -1)).sum() / NEAREST), places, scores

    def probability(self, vote: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * vote + self.level))))


def _curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of one feature, by Newton steps with a slight pull of the slope towards 0."""
    slope, level = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * votes + level, -30, 30)))
        off, h = weights * (p - labels), weights * p * (1 - p)
        g = np.array([(off * votes).sum() + 1e-2 * slope, off.sum() + 1e-3 * level])
        matrix = np.array([[(h * votes * votes).sum() + 1e-2, (h * votes).sum()], [(h * votes).sum(), h.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(matrix, g), -2, 2)
        slope, level = slope - step[0], level - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(level)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Judge | float:
    """The judge, or the constant score where labels do not have both classes."""
    sample, shares = labelled_sample(docs, labels, label, per_class, TRAIN_CHARS, id_col, text_col)
    held = sample["label"].value_counts().to_dict()
    if set(held) != {0, 1}:
        return 0.0 if not shares else float(sum(c * n for c, n in shares.items()) / sum(shares.values()))
    y = sample["label"].to_numpy(np.int64)
    index, counts = build_index(sample["_chosen"].tolist(), sample["text"].tolist(), y)
    judge = Judge(index, 0.0, 0.0)
    place = {d: i for i, d in enumerate(index.ids)}
    votes = np.array([judge.vote(c, place.get(d, -1))[0] for c, d in zip(counts, sample["_chosen"].tolist())])
    weight = np.array([shares[c] / sum(shares.values()) * len(y) / held[c] for c in (0, 1)])[y]
    judge.slope, judge.level = _curve(votes, y.astype(float), weight)
    return judge


def score(docs: DataFrame, model: Judge | float, threshold: float = 0.5, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, telling, kept columns): evidence has the nearest examples, telling the terms found."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple[int, ...]] = {}
        names = [] if isinstance(model, float) else list(model.index.terms)
        for batch in batches:
            scores, evidence, telling = [], [], []
            for text in batch.pop("text"):
                if isinstance(model, float):
                    counts, (vote, places, near) = Counter(), (0.0, [], [])
                    scores.append(model)
                else:
                    counts = _counted(words_of(text), model.index.terms, known)
                    vote, places, near = model.vote(counts)
                    scores.append(model.probability(vote))
                evidence.append([{"doc_id": str(model.index.ids[p]), "similarity": float(s), "toxic": bool(model.index.toxic[p])} for p, s in zip(places, near)])
                telling.append(sorted(names[t] for t in counts))
            yield batch.assign(score=scores, evidence=evidence, telling=telling)

    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), *keep).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    flat = rows.select("_row.*", "text")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.drop("text").schema)
    scored = flat.mapInPandas(read, f"{columns}, score double, evidence array<struct<doc_id: string, similarity: double, toxic: boolean>>, telling array<string>")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "telling", *keep)


def without_toxic(docs: DataFrame, model: Judge | float, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""

    @F.pandas_udf("boolean")
    def rejected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, tuple[int, ...]] = {}
        for texts in batches:
            scores = [model if isinstance(model, float) else model.probability(model.vote(_counted(words_of(t), model.index.terms, known))[0]) for t in texts]
            yield pd.Series(np.array(scores) >= threshold)

    return docs.where(~rejected(F.coalesce(F.col(text_col), F.lit(""))))
