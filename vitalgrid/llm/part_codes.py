"""Codes of vectors by a codebook for each of 16 parts, nearest entries found by slicing sorted coordinates and intersecting bit masks.

A component x counts as the integer floor(256 * x). Each part has up to 64 entries, so a set of entries is one 64-bit mask. Per part and
coordinate the entries are sorted by that coordinate, and `prefix[k]` is the mask of the first k. For a vector:

1. the entry next to it along the part's widest coordinate gives an initial radius, its distance; nothing nearest is farther;
2. in every coordinate, two binary searches give the range of entries within the radius, whose mask is the difference of two prefixes;
3. the AND of these masks holds every entry within the radius, the nearest and all ties among them; their exact squared distances decide, ties
   to the lower index.

Codebooks start as the parts of the 64 smallest kept ids, ascending (ties by the vector, null ids last). A round assigns all parts,
then moves each entry to its parts' componentwise floor(sum / count); unused entries stay. Sums are of all vectors, added up within tasks first; what the
driver holds is one codebook and its sums, 16 x 64 entries, whatever the table's size.

Vectors that are null, empty, or hold a null or non-finite component are left out; so are those whose length is not that of the smallest kept
id, or no multiple of 16. With fewer than 64 vectors the codebooks are that much shorter. Repeated rows give repeated codes and count
repeatedly. An empty table gives no rows. Components too large for 64-bit distances take Python's integers, sums travel in limbs; a
row's error beyond a long is reported as the largest long, and so is a label's. Further columns, also of clashing names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import cut_lineage, null_safe_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers below this have exact 64-bit distances in parts of up to 2^13 components.
PLAIN = 1 << 24
LONG_MAX = (1 << 63) - 1
#: Sums travel as limbs of this many bits, each with the sum's sign.
LIMB = 40
#: Rows worked on at a time.
AT_ONCE = 8192
_U = np.uint64


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite floats: 64-bit integers where `PLAIN` holds for all, Python's otherwise."""
    values = values.astype(np.float64)
    if not len(values) or np.abs(values).max() < PLAIN / SCALE - 1:
        return np.floor(values * SCALE).astype(np.int64)
    flat = [math.floor(v * SCALE) if abs(v) < 2.0 ** 52 else int(v) * SCALE for v in values.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(values.shape)


class Sliced:
    """The entries of one part, sorted along each coordinate, with prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, width = entries.shape
        self.order = [np.argsort(entries[:, d], kind="stable") for d in range(width)]
        self.sorted = [entries[o, d] for d, o in enumerate(self.order)]
        bits = _U(1) << np.arange(n, dtype=_U)
        self.prefix = [np.concatenate([np.zeros(1, _U), np.bitwise_or.accumulate(bits[o])]) for o in self.order]
        spread = [int(s[-1]) - int(s[0]) for s in self.sorted]
        self.widest = spread.index(max(spread))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry."""
        n, w = len(self.entries), self.widest
        if points.dtype != self.entries.dtype:
            points = points.astype(object)
        along = self.sorted[w]
        at = np.searchsorted(along, points[:, w])
        low, high = np.maximum(at - 1, 0), np.minimum(at, n - 1)
        distance = lambda i, rows: ((points[rows] - self.entries[i]) ** 2).sum(axis=1)
        every = np.arange(len(points))
        first = np.minimum(distance(self.order[w][low], every), distance(self.order[w][high], every))
        # A whole number at least the root of the distance.
        radius = np.array([math.isqrt(int(d)) + 1 for d in first], dtype=object) if first.dtype == object else np.ceil(np.sqrt(first.astype(np.float64))).astype(np.int64) + 1
        mask = np.full(len(points), ~_U(0) if n == 64 else (_U(1) << _U(n)) - _U(1), _U)
        for d, prefix in enumerate(self.prefix):
            left = np.searchsorted(self.sorted[d], points[:, d] - radius, "left")
            right = np.searchsorted(self.sorted[d], points[:, d] + radius, "right")
            mask &= prefix[right] ^ prefix[left]
        held = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(held)  # by row, then by entry
        far = distance(entry, row)
        starts = np.searchsorted(row, every)
        if far.dtype == object:
            best = np.array([min(far[a:b]) for a, b in zip(starts, [*starts[1:], len(far)])], dtype=object)
        else:
            best = np.minimum.reduceat(far, starts)
        hit = np.flatnonzero(far == best[row])
        first_hit = hit[np.searchsorted(row[hit], every)]
        return entry[first_hit], best


def _sliced(book: np.ndarray) -> list[Sliced]:
    return [Sliced(part) for part in book]


def assign(book: list[Sliced], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry indexes and squared distances, rows x parts."""
    cut = points.reshape(len(points), len(book), -1)
    found = [part.nearest(cut[:, p]) for p, part in enumerate(book)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def kept(table: DataFrame, vector_col: str = "embedding") -> Column:
    """Whether a row's vector is there and all its components are finite."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False))


def _points(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers) of slices of a batch."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for s in range(0, len(values), AT_ONCE):
        yield s, integers(values[s: s + AT_ONCE])


def _limbs(v: int) -> list[tuple[int, int]]:
    """(place, signed limb) of a whole number; the first limb is always there."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v or not out:
        out.append((len(out), sign * (v & ((1 << LIMB) - 1))))
        v >>= LIMB
    return out


def _update(rows: DataFrame, book: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = _sliced(shared.value)
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, points in _points(batch, 0, width):
                chosen, _ = assign(sliced, points)
                cut = points.reshape(len(points), PARTS, -1)
                for p in range(PARTS):
                    order = np.argsort(chosen[:, p], kind="stable")
                    entries, starts = np.unique(chosen[order, p], return_index=True)
                    totals, counts = np.add.reduceat(cut[order, p], starts, axis=0), np.diff([*starts, len(order)])
                    for e, t, c in zip(entries.tolist(), totals, counts.tolist()):
                        held = sums.setdefault((p, e), [0, [0] * len(t)])
                        held[0] += c
                        held[1] = [a + int(b) for a, b in zip(held[1], t)]
        rows = [(p, e, c, d, *limb) for (p, e), (c, total) in sums.items() for d, v in enumerate(total) for limb in _limbs(v)]
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "n", "place", "limb", "value"])

    parts = rows.select("_vector").mapInArrow(read, "part long, entry long, n long, place long, limb long, value long")
    counts = F.sum(F.when(F.col("limb") == 0, F.col("n"))).alias("n")
    summed = parts.groupBy("part", "entry", "place", "limb").agg(counts, F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    totals: dict[tuple, int] = {}
    numbers: dict[tuple, int] = {}
    for r in summed.collect():  # at most one row per entry, place and limb
        at = (r["part"], r["entry"], r["place"])
        totals[at] = totals.get(at, 0) + (int(r["value"]) << LIMB * r["limb"])
        numbers[at] = numbers.get(at, 0) + (r["n"] or 0)
    new = book.astype(object)
    for at, total in totals.items():
        new[at] = total // numbers[at]
    return new.astype(np.int64) if all(abs(v) < PLAIN for v in new.ravel()) else new


def fit(rows: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray | None:
    """Codebooks (part, entry, place) of the table's vectors; none without vectors."""
    vectors = rows.where(kept(rows, vector_col)).select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(1).collect()
    if not first or len(first[0]["_vector"]) % PARTS:
        return None
    width = len(first[0]["_vector"])
    vectors = vectors.where(F.size("_vector") == width)
    start = vectors.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(ENTRIES).collect()
    book = integers(np.array([r["_vector"] for r in start], np.float64)).reshape(len(start), PARTS, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        book = _update(vectors, book, width)
    return book


def digest(book: np.ndarray | None) -> str:
    """sha256 of all components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if book is None else book.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, book: np.ndarray | None, keep: tuple[str, ...] = ("vec_id",), vector_col: str = "embedding") -> DataFrame:
    """The columns `keep`, `code` (an array of 16 entry indexes) and `error` of each kept vector."""
    width = 0 if book is None else book.shape[0] * book.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast(book)
    names = [f"k{i}" for i in range(len(keep))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = _sliced(shared.value)
        for batch in batches:
            for s, points in _points(batch, batch.num_columns - 1, width):
                chosen, far = assign(sliced, points)
                errors = [min(v, LONG_MAX) for v in far.astype(object).sum(axis=1).tolist()]
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, chosen.size + 1, PARTS, dtype=np.int32)), pa.array(chosen.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([c.slice(s, len(points)) for c in batch.columns[:-1]] + [codes, pa.array(errors, pa.int64())], [*names, "code", "error"])

    fits = rows.where(kept(rows, vector_col) & (F.size(vector_col) == width)) if width else rows.where(F.lit(False))
    chosen = fits.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(vector_col).alias("_vector"))
    schema = ", ".join([*[f"{n} {chosen.schema[n].dataType.simpleString()}" for n in names], "code array<int>", "error long"])
    return chosen.mapInArrow(read, schema).toDF(*keep, "code", "error")


def decode(encoded: DataFrame, book: np.ndarray, code_col: str = "code", name: str = "approximation") -> DataFrame:
    """All columns, and the vector that the code stands for, in the vectors' own scale."""
    tables = [F.array(*[F.array(*[F.lit(float(v) / SCALE) for v in entry]) for entry in part]) for part in book.tolist()]
    parts = [tables[p][F.col(code_col)[p]] for p in range(len(book))]
    return encoded.withColumn(name, F.concat(*parts))


def compress(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept vector; codes as two hex digits a part."""
    book = fit(rows, id_col=id_col, vector_col=vector_col)
    coded = cut_lineage(encode(rows, book, (id_col, label_col), vector_col).toDF("vec_id", "label", "code", "error"), "codes")
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    totals = totals.select("label", F.least("total", F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error"))
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return null_safe_join(coded, totals, ["label"]).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
