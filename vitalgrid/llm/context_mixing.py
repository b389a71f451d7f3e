"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words, then an end. It first names its class, one of a few mixtures of words fitted on all
training texts, each whole (the class that likes the text best; naming it costs its share). Each word is then spelt bit by bit, from
its first byte to the space behind it; the end is one byte of its own. A byte's bits are those of a prefix code made from the
most frequent words, so common bytes take few. Predictors see the last 2, 3 or 4 bytes of the word or all of it so far, with or
without the class. The three short ones look their context and the bits of the current byte up in hashed tables of fixed size, filled with the
zeros and ones of all training tokens. The counts of the whole word so far are exact and of all training words, however many there
are: words are sorted into ranges, and a range has all words of its prefixes but those its ends share with other ranges, which
are summed apart. The log-odds are mixed by weights that two gates
choose, the place in the word and which is the longest context known and how well, and a map from mixed odds to observed
frequencies refines the result. Weights and map are learned before scoring, in small steps, on all training words, each
predicted as if one occurrence of it had not been counted, and do not change while texts are scored. Every range learns from its own
words; what ranges learned is averaged by how much each saw.

A word's probability so depends on word and class only; it is worked out once, into a table of all words. Within a text a last predictor adapts: a
word seen before in the text is also expected by its share of the words so far, by a weight that follows how often words have come again.

Training counts are counted over all training tokens: words are counted per task, then summed by key. Bit tables have a fixed
size; they are filled from the counted words in as many tasks as Spark likes and summed in a tree. Counts and probabilities of the
most frequent words, a bounded number, travel to all tasks; those of all others are joined.

Null texts count as empty, which is an end and no word. Repeated rows are learned and scored each; a null id hashes as an empty
text and is kept. Very long texts are scored whole. Without training documents every token has base score 0 and predictors know
nothing. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import cut_lineage, discard, fold

END = b"\n"
#: Per predictor, from short to long: bytes that it sees (0: the whole word so far), whether it sees the class, bits of its table's slots.
#: In jobs the last one has exact counts in place of its table.
PREDICTORS = ((2, True, 18), (3, True, 19), (4, False, 20), (0, True, 21))
M, WHOLE = len(PREDICTORS), 3
STARTS = [sum(1 << b for _, _, b in PREDICTORS[:m]) for m in range(len(PREDICTORS) + 1)]
SLOTS, CHUNK, PIECES = STARTS[-1], 1 << 12, 4
#: Most frequent words of classes whose counts and probabilities travel to all tasks; partial tables summed at once.
FREQUENT, FAN_IN = 1 << 17, 64
#: Bytes of words in a range; bits of them that are worked on at once.
RANGE, PIECE = 1 << 19, 1 << 16
#: Classes; most frequent words that they tell apart and that they begin from; texts looked at together.
CLASSES, CLASS_WORDS, SEED_WORDS, CLASS_BATCH = 8, 4096, 256, 1000
#: Words counted before a task passes its counts on; tokens read before it passes their texts on.
COUNTED, FRAME = 1 << 18, 1 << 17
PLACES, SURE, BUCKETS, BLOCK, EPOCHS, RATE = 16, 5, 33, 4096, 2, 0.01
#: Steps of the mixed log-odds to which final probabilities are tabulated.
STEP = 1 / 32
_U = np.uint64
_K1, _K2, _R = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0x100000001B3)


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, each with its closing byte; each byte's word and place in it."""
    parts = [w if w == END else w + b" " for w in words]
    lengths = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
    return flat, owner, np.arange(len(flat)) - starts[owner]


@dataclass
class Code:
    """A prefix code of the bytes: the tree nodes that each byte passes and the bits it takes there."""

    lengths: np.ndarray  # (256,)
    begin: np.ndarray    # (256,): where a byte's nodes begin
    nodes: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, weights: np.ndarray) -> Code:
        """Huffman's code of 256 positive weights."""
        heap = [(float(w), i, None, None) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        number = 256
        while len(heap) > 1:
            one, two = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (one[0] + two[0], number, one, two))
            number += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        below = [(heap[0], [])]
        while below:
            (_, name, left, right), path = below.pop()
            if left is None:
                paths[name] = path
            else:
                below += [(left, [*path, (name - 256, 0)]), (right, [*path, (name - 256, 1)])]
        lengths = np.array([len(x) for x in paths])
        flat = [x for path in paths for x in path]
        return cls(lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.array([n for n, _ in flat], _U), np.array([b for _, b in flat], np.int8))

    def spelt(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each bit of all bytes: which byte it belongs to, and its place among the codes' nodes."""
        lengths = self.lengths[flat]
        ends = np.cumsum(lengths)
        kind = np.int32 if not len(ends) or ends[-1] < 1 << 31 else np.int64
        owner = np.repeat(np.arange(len(flat), dtype=kind), lengths)
        return owner, np.arange(len(owner), dtype=kind) + np.repeat((self.begin[flat] - ends + lengths).astype(kind), lengths)


def contexts(flat: np.ndarray, place: np.ndarray, kind: np.ndarray, chosen: Iterable[int] = range(M), at: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
    """Per chosen predictor a hash of each byte's context, of the bytes `at`; `kind` is the class of each of those bytes' word."""
    wide, sees = flat.astype(_U) + _U(1), [PREDICTORS[m][0] for m in chosen]
    last, seen = {}, np.zeros(len(flat), _U)
    for back in range(1, max(sees) + 1):
        before = np.zeros(len(flat), _U)
        inside = np.flatnonzero(place >= back)
        before[inside] = wide[inside - back]
        seen = (seen + before) * _K1
        seen ^= seen >> _U(29)
        if back in sees:
            last[back] = seen[at]
    if 0 in sees:
        # All of the word so far: sums of powers, so that any length takes the same few steps.
        power = np.multiply.accumulate(np.full(int(place.max(initial=0)) + 1, _R, _U))
        sums = np.concatenate([[_U(0)], np.cumsum((wide * _K2 ^ (wide << _U(7))) * power[place], dtype=_U)])
        whole = ((sums[:-1] - sums[np.arange(len(flat)) - place]) * _K1 + place.astype(_U))[at]
    out = []
    for m in chosen:
        n, by_class, _ = PREDICTORS[m]
        h = ((last[n] if n else whole ^ (whole >> _U(31))) + _U(m + 1) + (kind.astype(_U) << _U(40) if by_class else _U(0))) * _K2
        out.append(h ^ (h >> _U(32)))
    return out


def slots(hashes: list[np.ndarray], owner: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """Per predictor the table slot of each bit."""
    spread = nodes * _K1
    return [((h[owner] + spread) * _K2 >> _U(64 - bits)).astype(np.int64) + STARTS[m] for m, (h, (_, _, bits)) in enumerate(zip(hashes, PREDICTORS))]


def pieces(n: int) -> Iterator[slice]:
    """Slices of at most PIECE bits: what is worked out per bit takes many times the memory of what is kept."""
    return (slice(s, s + PIECE) for s in range(0, n, PIECE))


def whole_keys(whole: np.ndarray, owner: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each bit's whole-word context and node."""
    return (whole[owner] ^ (nodes + _U(1)) * _K1) * _K2


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of a one in 256ths of a unit, above three bits that tell how much was counted (0: nothing)."""
    odds = np.rint(np.clip(np.log((ones + 0.1) / (zeros + 0.1)), -14, 14) * 256).astype(np.int32)
    return np.where(zeros + ones > 0, odds * 8 + sureness(zeros + ones), 0).astype(np.int16)


def sureness(n: np.ndarray) -> np.ndarray:
    """0 for nothing, up to SURE - 1."""
    return np.searchsorted([0.5, 1.5, 3.5, 15.5], n)


def gates(cells: list[np.ndarray]) -> np.ndarray:
    """The longest known context, from 1 (0: none), and how well it is known."""
    gate = np.zeros(len(cells[0]), np.int16)
    for m, cell in enumerate(cells):
        sure = cell & 7
        gate = np.where(sure > 0, (m + 1) * SURE + sure, gate)
    return gate.astype(np.int64)


@dataclass
class Mixer:
    """Weights by gate and the refining map, over the predictors' packed tables."""

    code: Code
    tables: np.ndarray    # (SLOTS,) int16
    by_place: np.ndarray  # (PLACES, predictors)
    by_known: np.ndarray  # ((predictors + 1) * SURE, predictors)
    refined: np.ndarray   # (predictors + 1, BUCKETS): log-odds
    weights: list[np.ndarray] = field(default_factory=list)  # per predictor (PLACES * gates,): both gates' weights together
    final: np.ndarray = field(default_factory=lambda: np.zeros(0))  # (2, predictors + 1, steps): log10 of a zero's and a one's probability

    @classmethod
    def fresh(cls, code: Code, tables: np.ndarray) -> Mixer:
        grid = np.tile(np.linspace(-12, 12, BUCKETS), (M + 1, 1))
        return cls(code, tables, np.zeros((PLACES, M)), np.full(((M + 1) * SURE, M), 1.5 / M), grid)

    def learn(self, x: np.ndarray, place: np.ndarray, gate: np.ndarray, bits: np.ndarray, weight: np.ndarray, rate: float, seen: list[np.ndarray]) -> None:
        """One online step over a few bits; `seen` sums the weight that each row of `parts` met."""
        both = place * len(self.by_known) + gate  # a cell of both gates: sums over places and over gates come from one count
        z = np.clip(np.einsum("im,im->i", (self.by_place[:, None] + self.by_known).reshape(-1, M)[both], x), -11.99, 11.99)
        off = (bits - 1 / (1 + np.exp(-z))) * weight
        cell = gate // SURE * BUCKETS + np.rint((z + 12) * ((BUCKETS - 1) / 24)).astype(np.int64)

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(both, weights=values, minlength=PLACES * len(self.by_known)).reshape(PLACES, -1)

        mass, flat = summed(weight), self.refined.reshape(-1)
        met = [mass.sum(1), mass.sum(0), np.bincount(cell, weights=weight, minlength=flat.size)]
        pull = np.stack([summed(off * x[:, m]) for m in range(M)], axis=-1)
        for weights, way, mass in zip((self.by_place, self.by_known), (1, 0), met):
            weights += rate * pull.sum(way) / np.sqrt(1 + mass)[:, None]
        miss = np.bincount(cell, weights=(bits - (1 / (1 + np.exp(-flat)))[cell]) * weight, minlength=flat.size)
        flat += 0.5 * miss / (1 + met[2])
        for total, mass in zip(seen, met):
            total += mass

    def parts(self) -> list[np.ndarray]:
        """What is learned, as rows: views of both gates' weights and of the map."""
        return [self.by_place, self.by_known, self.refined.reshape(-1, 1)]

    def settle(self) -> Mixer:
        """Tabulate what scoring needs: summed weights, and final probabilities as the mean of mixed and refined ones."""
        both = self.by_place[:, None] + self.by_known[None]
        self.weights = [(both[:, :, m].reshape(-1) / 256).astype(np.float32) for m in range(M)]
        z = np.arange(-int(12 / STEP), int(12 / STEP) + 1) * STEP
        at = np.clip((z + 12) * ((BUCKETS - 1) / 24), 0, BUCKETS - 1.0001)
        low, part = at.astype(np.int64), at - at.astype(np.int64)
        r = self.refined[:, low] * (1 - part) + self.refined[:, low + 1] * part
        p = np.clip(0.5 / (1 + np.exp(-z)) + 0.5 / (1 + np.exp(-r)), 1e-6, 1 - 1e-6)
        self.final = np.log10(np.stack([1 - p, p]))
        return self

    def log10_bits(self, flat: np.ndarray, place: np.ndarray, kind: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each bit its byte and log10 of the probability it was given; `whole` has the whole-word cells if the tables have not."""
        return self.log10_steps(flat, place, contexts(flat, place, kind, range(M if whole is None else WHOLE)), whole)

    def log10_steps(self, flat: np.ndarray, place: np.ndarray, hashes: list[np.ndarray], whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same of bytes whose contexts are at hand."""
        owner, at = self.code.spelt(flat)
        spot, logs = np.minimum(place, PLACES - 1), np.empty(len(owner))
        for p in pieces(len(owner)):
            cells = [self.tables[s] for s in slots(hashes, owner[p], self.code.nodes[at[p]])]
            if whole is not None:
                cells.append(whole[p])
            gate = gates(cells)
            cell = spot[owner[p]] * len(self.by_known) + gate
            z = np.zeros(len(cell), np.float32)
            for weights, c in zip(self.weights, cells):
                z += weights[cell] * (c >> 3)
            level = np.rint(np.clip(z, -12, 12) * (1 / STEP)).astype(np.int64) + int(12 / STEP)
            logs[p] = self.final[self.code.bits[at[p]], gate // SURE, level]
        return owner, logs


#: A bit to learn from: its predictors' cells, gate, place and value, and its word.
BIT = np.dtype([("cells", np.int16, M), ("gate", np.int8), ("place", np.int8), ("bit", np.int8), ("", np.int8), ("word", np.int32)])


def fit_range(mixer: Mixer, zeros: np.ndarray, ones: np.ndarray, held: RangeCounts, n: np.ndarray, seed: int = 5, last: bool = False) -> list[np.ndarray]:
    """Learning in small steps over the bits of a range's words; each word is predicted from counts without one occurrence of its own.

    Gives the weight that each row of the mixer's parts met. `zeros` and `ones` are the short predictors' counts. With `last` the
    range's own counts are let go once each bit's look is known.
    """
    seen = [np.zeros(len(part)) for part in mixer.parts()]
    learned = np.flatnonzero((n > 0)[held.word])
    if not len(learned):
        return seen
    # What a step's bits look like is worked out once; then each byte of a word takes a copy of its step's bits.
    flat, place = held.flat[held.first], np.minimum(held.place[held.first], PLACES - 1)
    owner, at = mixer.code.spelt(flat)
    hashes = contexts(held.flat, held.place, held.kinds[held.word[held.first]], range(WHOLE), held.first)
    looks = np.empty(len(at), BIT)
    for p in pieces(len(at)):
        byte, here, key = owner[p], mixer.code.bits[at[p]].astype(np.int64), held.step_of[p]
        counts = [(zeros[s], ones[s]) for s in slots(hashes, byte, mixer.code.nodes[at[p]])]
        counts.append((held.zeros[key], held.ones[key]))
        found = [packed(np.maximum(z - (1 - here), 0), np.maximum(o - here, 0)) for z, o in counts]
        looks["cells"][p], looks["gate"][p], looks["place"][p], looks["bit"][p] = np.stack(found, axis=-1), gates(found), place[byte], here
    del owner, at, hashes, flat, place, byte, here, key, counts, found
    if last:
        held.forget()
    rows = np.empty(int(mixer.code.lengths[held.flat[learned]].sum()), BIT)
    start = 0
    for s in range(0, len(learned), -(-PIECE // 4)):  # a byte has a few bits, and each takes a whole BIT
        bytes_ = learned[s: s - (-PIECE // 4)]
        i, owner = held.spread(bytes_)
        here = looks[i]
        here["word"] = held.word[bytes_][owner]
        rows[start: start + len(i)], start = here, start + len(i)
    del looks, learned, bytes_, i, owner, here
    mean = n[n > 0].mean()
    weight = np.minimum(n / mean, 50.0)  # of a word's bits: a step of the online rule, not a share of the loss
    rng = np.random.default_rng(seed)
    step, steps, whole = 0, EPOCHS * -(-len(rows) // BLOCK), rows.view(np.complex128)  # 16 bytes that are fetched at once
    order = np.empty(len(rows), np.int32 if len(rows) < 1 << 31 else np.int64)
    for _ in range(EPOCHS):
        for p in pieces(len(rows)):
            order[p] = np.arange(p.start, min(p.stop, len(rows)))
        rng.shuffle(order)
        for s in range(0, len(order), BLOCK):
            here = whole[order[s: s + BLOCK]].view(BIT)
            x = (here["cells"] >> 3) * np.float32(1 / 256)
            mixer.learn(x, here["place"].astype(np.int64), here["gate"].astype(np.int64), here["bit"], weight[here["word"]], RATE * (1 - step / steps), seen)
            step += 1
    return [mass * (mean / EPOCHS) for mass in seen]


# --- classes of texts ---------------------------------------------------------------------------------------------------------

@dataclass
class Classes:
    """A mixture of word distributions."""

    words: dict[bytes, int]
    logs: np.ndarray    # (words, classes): log-probabilities
    prior: np.ndarray   # (classes,): log of shares

    def of(self, tokens: list[bytes]) -> int:
        return self.of_ids([i for i in map(self.words.get, tokens) if i is not None])

    def of_ids(self, at: list[int] | np.ndarray) -> int:
        return int((self.logs[at].sum(0) + self.prior).argmax()) if len(at) else int(self.prior.argmax())


Counted = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def counted_words(ids: list[np.ndarray], n: list[np.ndarray]) -> Counted:
    """Of all texts' (word ids, counts): each entry's text, word and count, and the number of texts."""
    return np.repeat(np.arange(len(ids)), [len(i) for i in ids]), np.concatenate(ids).astype(np.int64), np.concatenate(n).astype(float), len(ids)


def words_in(text: str, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text's known words, and how often each occurs."""
    return np.unique(np.array([i for i in map(words.get, tokens_of(text)) if i is not None], np.int32), return_counts=True)


def by_share(counted: Counted, share: np.ndarray, size: int) -> np.ndarray:
    """(classes, words): counts of all texts' words, dealt out to classes by the texts' shares."""
    owner, ids, n, _ = counted
    return np.stack([np.bincount(ids, weights=n * share[owner, c], minlength=size) for c in range(share.shape[1])])


def together(counted: Counted, size: int) -> np.ndarray:
    """(words, words): texts that have both of two words, of the first `size` words."""
    owner, ids, _, texts = counted
    has = np.zeros((texts, size), np.float32)
    first = ids < size
    has[owner[first], ids[first]] = 1
    return (has.T @ has).astype(float)


def holding(counted: Counted, seeds: list[int], size: int) -> np.ndarray:
    """Counts of the words of texts that hold each seed, then of all texts; after them how many texts those are."""
    owner, ids, _, texts = counted
    share = np.ones((texts, len(seeds) + 1))
    for c, seed in enumerate(seeds):
        share[:, c] = np.bincount(owner, weights=ids == seed, minlength=texts)
    return np.concatenate([by_share(counted, share, size).reshape(-1), share.sum(0)])


def expected(counted: Counted, logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Words' counts and texts by class, as the texts' shares in classes deal them out, and the log-likelihood of all texts."""
    owner, ids, n, texts = counted
    z = np.stack([np.bincount(owner, weights=n * row[ids], minlength=texts) for row in logs], axis=1) + prior
    top = z.max(1, keepdims=True)
    share = np.exp(z - top)
    total = share.sum(1, keepdims=True)
    share /= total
    return np.concatenate([by_share(counted, share, logs.shape[1]).reshape(-1), share.sum(0), [(top + np.log(total)).sum()]])


def fitted(top: list[bytes], total: Callable[[Callable[[Counted], np.ndarray]], np.ndarray], k: int, rounds: int) -> Classes:
    """Expectation-maximisation from frequent words that are least often together; `total` sums a function's arrays over all texts.

    It ends early once a round explains the texts no better.
    """
    size = len(top)
    if not size:
        return Classes({}, np.zeros((0, k)), np.log(np.full(k, 1 / k)))
    first = min(SEED_WORDS, size)
    pairs = total(lambda counted: together(counted, first).reshape(-1)).reshape(first, first)
    unit = pairs / np.linalg.norm(pairs, axis=1, keepdims=True)
    seeds, near = [0], np.zeros(first)
    for _ in range(k - 1):
        near = np.maximum(near, unit @ unit[seeds[-1]])
        seeds.append(int(np.round(near, 9).argmin()))
    held = total(lambda counted: holding(counted, seeds, size))
    means = held[: -k - 1].reshape(k + 1, size) / held[-k - 1:, None]
    logs = np.log(means[:k] + means[k] + 1e-3)
    logs -= np.log(np.exp(logs).sum(1, keepdims=True))
    prior, texts, before = np.log(np.full(k, 1 / k)), held[-1], -math.inf
    for _ in range(rounds):
        here = total(lambda counted, logs=logs, prior=prior: expected(counted, logs, prior))
        logs = np.log(here[: k * size].reshape(k, size) + 0.05)
        logs -= np.log(np.exp(logs).sum(1, keepdims=True))
        prior = np.log((here[k * size: -1] + 1) / (texts + k))
        if here[-1] - before <= 1e-6 * abs(here[-1]):
            break
        before = here[-1]
    return Classes({w: i for i, w in enumerate(top)}, np.round(logs.T, 9), np.round(prior, 9))


def fit_classes(texts: list[str], k: int = CLASSES, rounds: int = 25) -> Classes:
    """Classes of a few texts at hand; `class_fit` has the same of a table."""
    totals: Counter = Counter()
    for text in texts:
        totals.update(tokens_of(text))
    top = sorted(totals, key=lambda w: (-totals[w], w))[:CLASS_WORDS]
    found = [words_in(text, {w: i for i, w in enumerate(top)}) for text in texts]
    found = [f for f in found if len(f[0])]
    return fitted(top if found else [], lambda f: f(counted_words(*map(list, zip(*found)))), k, rounds)


def adapted(ids: np.ndarray, logs: np.ndarray) -> float:
    """log10 of a text's probability: words by the mixer, or again from the text so far. The last token is the end."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    earlier = np.empty(n)
    earlier[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    before = np.arange(n)
    again = np.cumsum(earlier > 0) - (earlier > 0)
    weight = 0.5 * (again + 0.1) / (before + 1)
    return float(np.log10((1 - weight) * 10.0 ** logs + weight * earlier / np.maximum(before, 1)).sum()) if logs.min() > -280 else \
        float(np.logaddexp(np.log(1 - weight) + logs * math.log(10), np.log(np.maximum(weight * earlier / np.maximum(before, 1), 1e-300))).sum() / math.log(10))


# --- jobs ---------------------------------------------------------------------------------------------------------------------

def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def class_fit(train: DataFrame, counted: DataFrame, k: int = CLASSES, rounds: int = 25) -> Classes:
    """Classes of all training texts, each whole; `counted` has all training words as (word, total)."""
    ranked = counted.where(F.col("word") != F.lit(END)).orderBy(F.desc("total"), "word").limit(CLASS_WORDS).select("word").toPandas()
    top = [bytes(w) for w in ranked["word"]]
    words = {w: i for i, w in enumerate(top)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), CLASS_BATCH):
                found = [words_in(text, words) for text in batch["text"].iloc[s: s + CLASS_BATCH]]
                found = [(i.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()) for i, n in found if len(i)]
                yield pd.DataFrame(found, columns=["ids", "n"])

    texts = cut_lineage(train.select("text").mapInPandas(count, "ids binary, n binary"), "class-words") if top else None

    def total(f: Callable[[Counted], np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = None
            for batch in batches:
                for s in range(0, len(batch), CLASS_BATCH):
                    part = batch.iloc[s: s + CLASS_BATCH]
                    here = f(counted_words(*[[np.frombuffer(x, np.int32) for x in part[c]] for c in ("ids", "n")]))
                    out = here if out is None else out + here
            if out is not None:
                yield pd.DataFrame({"at": np.arange(len(out)), "value": out})

        sums = texts.mapInPandas(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # one row per place of the array
        return sums.sort_values("at")["value"].to_numpy()

    fit = fitted(top, total, k, rounds)
    if texts is not None:
        discard(texts)
    return fit


def token_counts(texts: DataFrame, classes: Classes) -> DataFrame:
    """(kind, word, n): every token of all texts of a class, the end included, and how often it occurs where `learned`."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: list[Counter] = [Counter() for _ in range(CLASSES)]

        def passed() -> Iterator[pd.DataFrame]:
            for kind, held in enumerate(counts):
                if held:
                    yield pd.DataFrame({"kind": kind, "word": list(held.keys()), "n": list(held.values())})
                    held.clear()

        for batch in batches:
            for text, learned in zip(batch["text"], batch["learned"]):
                tokens = tokens_of(text)
                held = counts[classes.of(tokens)]
                tokens.append(END)
                if learned:
                    held.update(tokens)
                else:
                    for w in tokens:
                        held.setdefault(w, 0)
                if sum(map(len, counts)) >= COUNTED:
                    yield from passed()
        yield from passed()

    return texts.select("text", "learned").mapInPandas(count, "kind int, word binary, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def bit_tables(counted: DataFrame, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the short predictors' slots over all counted words."""
    size = STARTS[WHOLE]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(size * 2, np.float32)
        task, any_ = TaskContext.get().partitionId(), False
        for batch in batches:
            for s in range(0, len(batch), 4096):
                part = batch.iloc[s: s + 4096]
                flat, word, place = spelled([bytes(w) for w in part["word"]])
                owner, at = code.spelt(flat)
                n, bits, any_ = part["n"].to_numpy(np.float32)[word[owner]], code.bits[at], True
                for slot in slots(contexts(flat, place, part["kind"].to_numpy()[word], range(WHOLE)), owner, code.nodes[at]):
                    np.add.at(table, slot * 2 + bits, n)
        if any_:
            blocks = table.reshape(-1, CHUNK * 2)
            for b in np.flatnonzero(blocks.any(1)).tolist():
                yield pd.DataFrame({"chunk": [b], "task": [task], "counts": [blocks[b].tobytes()]})

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK * 2)
        for c in group["counts"]:
            total += np.frombuffer(c, np.float32)
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "task": [group["task"].iloc[0] // FAN_IN], "counts": [total.astype(np.float32).tobytes()]})

    form = "chunk long, task long, counts binary"
    parts = cut_lineage(counted.mapInPandas(fill, form), "bit-counts")
    last = parts.agg(F.max("task").alias("t")).first()["t"]
    zeros, ones = np.zeros(size, np.float32), np.zeros(size, np.float32)
    if last is None:
        return zeros, ones
    while True:
        parts = parts.groupBy("chunk", F.floor(F.col("task") / FAN_IN).alias("_group")).applyInPandas(lambda g: summed(g), form)
        last //= FAN_IN
        if last == 0:
            break
        parts = cut_lineage(parts, "bit-counts")
    parts = cut_lineage(parts.select("chunk", "counts"), "bit-table")
    for piece in range(PIECES):  # at most one row per chunk of the fixed-size tables, a part of them at a time
        for b, counts in parts.where(F.col("chunk") % PIECES == piece).toPandas().itertuples(index=False):
            pair = np.frombuffer(counts, np.float32).reshape(-1, 2)
            zeros[b * CHUNK: (b + 1) * CHUNK], ones[b * CHUNK: (b + 1) * CHUNK] = pair[:, 0], pair[:, 1]
    return zeros, ones


def word_ranges(words: DataFrame) -> DataFrame:
    """(part, kind, word, n): words dealt into ranges of their order, of about RANGE bytes each."""
    total = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)).alias("n")).first()["n"]
    return words.repartitionByRange(total // RANGE + 1, "kind", "word").select(F.spark_partition_id().alias("part"), "kind", "word", "n")


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in `known`, a sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key, in order, occurs, and the number of each place's key."""
    order = np.argsort(keys)
    held = keys[order]
    fresh = np.concatenate([[True], held[1:] != held[:-1]])[: len(keys)]
    number = np.empty(len(keys), np.int32 if len(keys) < 1 << 31 else np.int64)
    number[order] = np.cumsum(fresh, dtype=number.dtype) - 1
    return order[fresh], number


class RangeCounts:
    """Bits of a range's words and the counts of their whole-word contexts within it.

    Words share their beginnings: a context and the byte behind it are one step, however many words take it, and only the bits of
    steps are looked up and counted.
    """

    def __init__(self, code: Code, group: pd.DataFrame) -> None:
        self.words, self.kinds = [bytes(w) for w in group["word"]], group["kind"].to_numpy(np.int64)
        self.flat, self.word, self.place = spelled(self.words)
        self.context, self.code = contexts(self.flat, self.place, self.kinds[self.word], (WHOLE,))[0], code
        self.first, self.step = distinct((self.context ^ (self.flat.astype(_U) + _U(1)) * _K2) * _K1)
        owner, at = code.spelt(self.flat[self.first])
        self.begin = np.concatenate([[0], np.cumsum(code.lengths[self.flat[self.first]])]).astype(at.dtype)
        every, whole = np.empty(len(at), _U), self.context[self.first]
        for p in pieces(len(at)):
            every[p] = whole_keys(whole, owner[p], code.nodes[at[p]])
        first, self.step_of = distinct(every)
        self.keys, bits = every[first], code.bits[at]
        del every, first, at, whole  # each is as long as all bits: what comes next takes their place
        n = np.bincount(self.step, weights=group["n"].to_numpy(float)[self.word], minlength=len(self.first))[owner]
        del owner
        self.ones = np.bincount(self.step_of, weights=n * bits, minlength=len(self.keys))
        n *= 1 - bits
        self.zeros = np.bincount(self.step_of, weights=n, minlength=len(self.keys))

    def spread(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each bit of the chosen bytes: its place among the steps' bits, and which chosen byte it belongs to."""
        lengths = self.code.lengths[self.flat[chosen]]
        owner = np.repeat(np.arange(len(chosen), dtype=self.begin.dtype), lengths)
        return np.arange(len(owner), dtype=self.begin.dtype) + np.repeat((self.begin[self.step[chosen]] - np.cumsum(lengths) + lengths).astype(self.begin.dtype), lengths), owner

    @property
    def of(self) -> np.ndarray:
        """The key of each bit of all words."""
        return self.step_of[self.spread(np.arange(len(self.flat)))[0]]

    def ends(self) -> np.ndarray:
        """Which keys other ranges may share: those of contexts on the way to the first or the last word."""
        order = list(zip(self.kinds.tolist(), self.words))
        first, last = min(range(len(order)), key=order.__getitem__), max(range(len(order)), key=order.__getitem__)
        shared = np.zeros(len(self.keys), bool)
        met = among(self.context, np.unique(self.context[(self.word == first) | (self.word == last)]))
        shared[self.step_of[np.repeat(met[self.first], np.diff(self.begin))]] = True
        return shared

    def forget(self) -> None:
        """Let all go that is not needed to spread steps' bits over words."""
        del self.context, self.place, self.step_of, self.keys, self.zeros, self.ones

    def replace(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        """Take the counts over all ranges for some of the keys."""
        at = np.searchsorted(self.keys, keys)
        self.zeros[at], self.ones[at] = zeros, ones


def shared_counts(ranges: DataFrame, code: Code, wanted: np.ndarray) -> DataFrame:
    """(part, key, zeros, ones, edge): per range the counts of contexts that others may share, and of `wanted` ones (sorted keys)."""
    told = ranges.sparkSession.sparkContext.broadcast((code, wanted))  # bounded: the sample's contexts

    def count(group: pd.DataFrame) -> pd.DataFrame:
        spelling, keys = told.value
        held = RangeCounts(spelling, group)
        edge = held.ends()
        i = np.flatnonzero(edge | among(held.keys, keys))
        return pd.DataFrame({"part": group["part"].iloc[0], "key": held.keys[i].view(np.int64), "zeros": held.zeros[i], "ones": held.ones[i], "edge": edge[i]})

    return ranges.groupBy("part").applyInPandas(count, "part int, key long, zeros double, ones double, edge boolean")


def word_scores(ranges: DataFrame, edges: DataFrame, mixer: Mixer) -> DataFrame:
    """(kind, word, n, log): log10 of each word's probability within its class; `edges` has (part, key, zeros, ones) over all ranges."""
    told = ranges.sparkSession.sparkContext.broadcast(mixer)  # bounded: fixed-size tables

    def weigh(group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        model = told.value
        held = RangeCounts(model.code, group)
        held.replace(shared["key"].to_numpy(np.int64).view(_U), shared["zeros"].to_numpy(float), shared["ones"].to_numpy(float))
        hashes = contexts(held.flat, held.place, held.kinds[held.word[held.first]], range(WHOLE), held.first)
        owner, logs = model.log10_steps(held.flat[held.first], held.place[held.first], hashes, packed(held.zeros, held.ones)[held.step_of])
        steps = np.bincount(owner, weights=logs, minlength=len(held.first))
        out = group[["kind", "word", "n"]].copy()
        out["log"] = np.bincount(held.word, weights=steps[held.step], minlength=len(group))
        return out

    return ranges.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(weigh, "kind int, word binary, n long, log double")


def learned_mixer(ranges: DataFrame, edges: DataFrame, code: Code, zeros: np.ndarray, ones: np.ndarray) -> Mixer:
    """Weights and map of all training words: each range learns from its own, and averages by what each met come to the driver."""
    tables = np.empty(len(zeros), np.int16)
    for s in range(0, len(tables), 1 << 16):  # piece by piece, for the driver's memory
        tables[s: s + (1 << 16)] = packed(zeros[s: s + (1 << 16)], ones[s: s + (1 << 16)])
    told = ranges.sparkSession.sparkContext.broadcast((code, zeros, ones))  # bounded: fixed-size tables

    def learn(group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        spelling, no, yes = told.value
        held = RangeCounts(spelling, group)
        held.replace(shared["key"].to_numpy(np.int64).view(_U), shared["zeros"].to_numpy(float), shared["ones"].to_numpy(float))
        mixer = Mixer.fresh(spelling, np.zeros(0, np.int16))
        seen = fit_range(mixer, no, yes, held, group["n"].to_numpy(float), last=True)
        mass = np.concatenate([np.repeat(m, part.shape[1]) for m, part in zip(seen, mixer.parts())])
        return pd.DataFrame({"at": np.arange(len(mass)), "mass": mass, "value": mass * np.concatenate([part.reshape(-1) for part in mixer.parts()])})

    mixer = Mixer.fresh(code, tables)
    sums = (ranges.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(learn, "at int, mass double, value double")
            .groupBy("at").agg(F.sum("mass").alias("mass"), F.sum("value").alias("value")).where("mass > 0").toPandas())  # one row per weight
    flat = np.concatenate([part.reshape(-1) for part in mixer.parts()])
    flat[sums["at"].to_numpy(np.int64)] = np.round((sums["value"] / sums["mass"]).to_numpy(), 9)
    for part, values in zip(mixer.parts(), np.split(flat, np.cumsum([part.size for part in mixer.parts()])[:-1])):
        part[:] = values.reshape(part.shape)
    told.unpersist()
    return mixer.settle()


def byte_weights(by_class: DataFrame) -> np.ndarray:
    """How often each byte occurs in all training words, one more for all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256)
        for batch in batches:
            flat, word, _ = spelled([bytes(w) for w in batch["word"]])
            total += np.bincount(flat, weights=batch["n"].to_numpy(float)[word], minlength=256)
        yield pd.DataFrame({"byte": np.arange(256), "n": total})

    weight = np.ones(256)
    for byte, n in by_class.select("word", "n").mapInPandas(count, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        weight[byte] += n
    return weight


def text_score(ids: np.ndarray, logs: np.ndarray, c: np.ndarray, prior: float) -> tuple[int, float, float]:
    """Tokens known, the sum of their counts' logs, and the text's score, of each token's word, log-probability and count."""
    return int((c > 0).sum()), float(np.log10(c[c > 0] + 0.5).sum()), adapted(ids, logs) + prior


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row; fold `held_out` is not learned from."""
    plain = _plain(docs, id_col, text_col).withColumn("learned", fold(F.col("doc_id")) != held_out)
    everything = Classes({}, np.zeros((0, 1)), np.zeros(1))
    counted = cut_lineage(token_counts(plain.where("learned"), everything).select("word", F.col("n").alias("total")), "token-counts")
    totals = counted.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(totals["n"]), int(totals["v"])
    classes = class_fit(plain.where("learned"), counted)
    words = cut_lineage(token_counts(plain, classes), "class-words")  # counted once: ranges read them more than once
    ranges = cut_lineage(word_ranges(words), "class-counts")
    discard(words)
    by_class = ranges.where("n > 0")
    code = Code.of(byte_weights(by_class))
    shared = cut_lineage(shared_counts(ranges, code, np.zeros(0, _U)), "shared-counts")
    summed = shared.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    edges = cut_lineage(shared.where("edge").select("part", "key").join(summed, "key"), "shared-sums")
    mixer = learned_mixer(ranges, edges, code, *bit_tables(by_class, code))
    scores = word_scores(ranges, edges, mixer).join(counted, "word", "left").select("kind", "word", "n", "log", F.coalesce("total", F.lit(0)).alias("total"))
    scores = cut_lineage(scores, "word-scores")
    top = scores.orderBy(F.desc("n"), "word", "kind").limit(FREQUENT).toPandas()
    # Words by number, those that tell classes apart first, and each one's row in every class (-1: none; the last line is for words without number).
    names, rows = dict(classes.words), []
    for w in top["word"]:
        rows.append(names.setdefault(bytes(w), len(names)))
    places = np.full((len(names) + 1, CLASSES), -1, np.int32)
    places[rows, top["kind"].to_numpy(np.int64)] = np.arange(len(top))
    told = docs.sparkSession.sparkContext.broadcast((classes, names, places, top["log"].to_numpy(float), top["total"].to_numpy(np.int64)))  # bounded: FREQUENT words
    del top, names, places, rows

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, names, places, known_logs, known_totals = told.value
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            start, out, held = 0, [], 0

            def frame() -> pd.DataFrame:
                made = pd.DataFrame(out, columns=["row", "n_tokens", "size", "n_known", "log_known", "score", "kind", "ids", "prior", "rare"])
                made["n_known"] = made["n_known"].astype("Int64")
                made.insert(0, "doc_id", batch["doc_id"].iloc[start: start + len(out)].array)
                return made

            for text in batch["text"].tolist():
                tokens = tokens_of(text)
                size = sum(map(len, tokens)) + len(tokens) + len(END)
                tokens.append(END)
                at = np.fromiter(map(names.get, tokens, repeat(-1)), np.int32, len(tokens))
                kind = groups.of_ids(at[(at >= 0) & (at < len(groups.words))])
                ids, rare, prior = places[at, kind], {}, float(groups.prior[kind]) / math.log(10)
                for i in np.flatnonzero(ids < 0).tolist():  # words that are joined: -1, -2, ... by first place
                    ids[i] = -1 - rare.setdefault(tokens[i], len(rare))
                if not rare:
                    out.append((task * (1 << 33) + row, len(ids), size, *text_score(ids, known_logs[ids], known_totals[ids], prior), kind, None, prior, []))
                else:
                    out.append((task * (1 << 33) + row, len(ids), size, None, None, None, kind, zlib.compress(ids.tobytes(), 1), prior, list(rare)))
                row, held = row + 1, held + len(ids)
                if len(out) >= 1024 or held >= FRAME:
                    yield frame()
                    start, out, held = start + len(out), [], 0
            if out:
                yield frame()

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, _, known_logs, known_totals = told.value
        for batch in batches:
            out = []
            for packed_ids, prior, place, log, total in zip(*[batch[x] for x in ("ids", "prior", "at", "log", "total")]):
                ids = np.frombuffer(zlib.decompress(packed_ids), np.int32)
                own_logs, own_totals = np.zeros(len(place)), np.zeros(len(place), np.int64)
                own_logs[place], own_totals[place] = log, total
                at, rare = np.maximum(ids, 0), np.flatnonzero(ids < 0)
                logs, counts = known_logs[at], known_totals[at]
                logs[rare], counts[rare] = own_logs[-1 - ids[rare]], own_totals[-1 - ids[rare]]
                out.append(text_score(ids, logs, counts, prior))
            frame = batch[["doc_id", "n_tokens", "size"]].copy()
            frame[["n_known", "log_known", "score"]] = pd.DataFrame(out, columns=["n_known", "log_known", "score"], index=frame.index)
            yield frame

    kind = docs.schema[id_col].dataType
    done = "n_tokens long, size long, n_known long, log_known double, score double"
    form = f"doc_id string, row long, {done}, kind int, ids binary, prior double, rare array<binary>"
    scored = cut_lineage(plain.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(read, form), "scored")
    rare = scored.where("ids IS NOT NULL").select("row", "kind", F.posexplode("rare").alias("at", "word"))
    looked = rare.join(scores.select("kind", "word", "log", "total"), ["kind", "word"]).groupBy("row").agg(F.collect_list(F.struct("at", "log", "total")).alias("found"))
    late = scored.where("ids IS NOT NULL").drop("rare").join(looked, "row").select(
        "doc_id", "n_tokens", "size", "ids", "prior", *[F.col(f"found.{x}").alias(x) for x in ("at", "log", "total")])
    columns = ["doc_id", "n_tokens", "size", "n_known", "log_known", "score"]
    whole = scored.where("ids IS NULL").select(columns).unionByName(late.mapInPandas(finish, f"doc_id string, {done}"))
    unknown = F.col("n_tokens") - F.col("n_known")
    base = F.col("log_known") + unknown * math.log10(0.5) - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))
    doc_id = F.col("doc_id").cast(kind)
    return whole.select(doc_id.alias("doc_id"), (fold(doc_id) == held_out).alias("held_out"), "n_tokens", "n_known",
                        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("size")).alias("bits_per_byte"))
