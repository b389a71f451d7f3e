"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Equal vectors are indexed once, with the smallest ids that can matter, so a vector shared by a third of all rows is one entry.
Vectors get one more component that makes the largest inner product the nearest point. Trees are fitted on a bounded sample:
each node splits its points at the median along the difference of two of them. Every distinct vector is then put into its leaf
of every tree.

A query's leaves of all trees share one priority queue, ordered by the squared distance to the splitting planes that were
crossed on the way; it takes leaves from the queue until it has `probes` of them, and enough candidates. Rows and queries of a leaf meet in a task, in
blocks of bounded size; all candidates of a leaf are scored exactly, in double precision on the original vectors, and the best
of a block go on. Recall depends on the share of leaves that is taken, not on the number of rows.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, as do null ids.
Repeated rows count once; further rows of a query's own id are no candidates for it. Ties go to the smaller id. Fewer
candidates than `k` are all returned. An empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import cut_lineage

TREES, DEPTH, SEED = 5, 6, 11
#: Share of all leaves that a query visits.
SHARE = 0.26
#: The sample that trees are fitted on; rows and queries that meet in one task.
SAMPLE, ROW_BLOCK, QUERY_BLOCK = 20_000, 8192, 2048
K = 20


@dataclass
class Forest:
    planes: np.ndarray      # (trees, nodes, dimensions + 1), nodes of a tree in level order
    thresholds: np.ndarray  # (trees, nodes)
    reach: float            # largest norm

    @property
    def depth(self) -> int:
        return (self.planes.shape[1] + 1).bit_length() - 1

    def lifted(self, vectors: np.ndarray, as_query: bool) -> np.ndarray:
        """Points in which nearness is the inner product: all on one sphere, queries without the extra component."""
        norms = np.linalg.norm(vectors, axis=1)
        if as_query:
            return np.column_stack([vectors / norms[:, None], np.zeros(len(vectors))])
        x = vectors / self.reach
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (norms / self.reach) ** 2))])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each vector."""
        points, rows = self.lifted(vectors, False), np.arange(len(vectors))
        out = np.empty((len(vectors), len(self.planes)), np.int64)
        for t, (planes, thresholds) in enumerate(zip(self.planes, self.thresholds)):
            margin, node = points @ planes.T - thresholds, np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (margin[rows, node] > 0)
            out[:, t] = node - len(thresholds)
        return out

    def queue(self, vectors: np.ndarray, probes: int, sizes: np.ndarray, enough: int) -> list[np.ndarray]:
        """Per vector the first leaves of the shared queue, numbered tree by tree: `probes` of them, and more until one tree's hold `enough` entries."""
        points, costs = self.lifted(vectors, True), []
        for planes, thresholds in zip(self.planes, self.thresholds):
            margin = points @ planes.T - thresholds
            cost, first = np.zeros((len(vectors), 1)), 0
            for level in range(self.depth):
                m = margin[:, first: first + 2 ** level]
                cost = np.stack([cost + np.maximum(m, 0) ** 2, cost + np.minimum(m, 0) ** 2], axis=2).reshape(len(vectors), -1)
                first += 2 ** level
            costs.append(cost)
        order = np.argsort(np.concatenate(costs, axis=1), axis=1, kind="stable")
        held = np.zeros(order.shape)
        for t in range(len(self.planes)):
            held = np.maximum(held, np.cumsum(np.where(order // 2 ** self.depth == t, sizes[order], 0), axis=1))
        taken = np.maximum(probes, (held < min(enough, int(sizes.sum()) // len(self.planes))).sum(1) + 1)
        return [row[:n] for row, n in zip(order, taken)]


def grow(sample: np.ndarray, reach: float, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    rng, nodes = np.random.default_rng(seed), 2 ** depth - 1
    forest = Forest(np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)), reach)
    points = forest.lifted(sample, False)
    for t in range(trees):
        inside = {0: np.arange(len(points))}
        for node in range(nodes):
            at = inside.pop(node)
            a, b = points[rng.choice(at, 2)] if len(at) else points[rng.choice(len(points), 2)]
            plane = a - b if np.any(a != b) else rng.standard_normal(points.shape[1])
            plane /= np.linalg.norm(plane)
            height = points[at] @ plane
            forest.planes[t, node], forest.thresholds[t, node] = plane, np.median(height) if len(at) else 0.0
            inside[2 * node + 1], inside[2 * node + 2] = at[height <= forest.thresholds[t, node]], at[height > forest.thresholds[t, node]]
    return forest


# --- jobs ---------------------------------------------------------------------------------------------------------------------

def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct (vec_id, vector) that take part; vectors as arrays of double."""
    vector = F.col(vector_col).cast("array<double>")
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(fine)
    lengths = kept.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return kept.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def distinct_vectors(kept: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(rep, vector, ids, asked): each vector with its smallest ids, one more than a query can need, and whether a query has it."""
    # Both steps use one shuffle; the limit is applied before it, so a frequent vector sends few rows.
    pairs = kept.groupBy("vector", "vec_id").agg(F.max(is_query).alias("asks"))
    asked = pairs.where("asks").groupBy("vector").agg(F.lit(True).alias("asked"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = pairs.select("vector", "vec_id", place.alias("place")).where(F.col("place") <= k + 1)
    listed = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return listed.join(asked, "vector", "left").select(F.element_at("ids", 1).alias("rep"), "vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def search(rows: DataFrame, is_query: Column | None = None, k: int = K, trees: int = TREES, depth: int = DEPTH, share: float = SHARE,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row; by default queries are the ids divisible by 20."""
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    kept = usable(rows, id_col, vector_col)
    known = cut_lineage(distinct_vectors(kept, is_query, k), "vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    reach = known.agg(F.max(norm).alias("reach")).first()["reach"]
    out = "query_id long, rank int, vec_id long, score double"
    if reach is None:
        return rows.sparkSession.createDataFrame([], out)
    sample = known.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas()
    # A small table gets fewer leaves, so that some of them hold k rows.
    depth = min(depth, max(0, int(np.log2(len(sample) / (4 * (k + 1))))) if len(sample) > 4 * (k + 1) else 0)
    forest = grow(_matrix(sample["vector"]), reach, trees, depth)
    probes = max(1, round(share * trees * 2 ** depth))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells = forest.leaves(_matrix(batch["vector"])) + np.arange(trees) * 2 ** depth
                yield batch.assign(cells=list(cells))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.iloc[s: s + 1024]
                yield part.assign(cells=forest.queue(_matrix(part["vector"]), probes, entries_of, k + 1))

    form = "rep long, vector array<double>, cells array<long>"
    entries = known.select("rep", "vector").mapInPandas(place, form).select("rep", "vector", F.explode("cells").alias("cell"))
    entries_of = np.zeros(trees * 2 ** depth)  # of each leaf of each tree, a fixed number of them
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():
        entries_of[r["cell"]] = r["n"]
    asks = known.where("asked").select("rep", "vector").mapInPandas(ask, form).select("rep", "vector", F.explode("cells").alias("cell"))
    # Blocks of a cell: as many as its rows and its queries need.
    sizes = entries.groupBy("cell").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("row_blocks"))
    sizes = sizes.join(asks.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("query_blocks")), "cell")
    sizes = cut_lineage(sizes, "cells")
    row_block, query_block = F.pmod(F.xxhash64("rep"), F.col("row_blocks")), F.pmod(F.xxhash64("rep"), F.col("query_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = entries.join(sizes, "cell").withColumn("row_block", row_block).withColumn("query_block", every("query_blocks"))
    right = asks.join(sizes, "cell").withColumn("query_block", query_block).withColumn("row_block", every("row_blocks"))

    def meet(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if entry.empty or query.empty:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        entry = entry.sort_values("rep")
        x, reps, parts = _matrix(entry["vector"]).T, entry["rep"].to_numpy(), []
        for s in range(0, len(query), 256):
            part = query.iloc[s: s + 256]
            scores = _matrix(part["vector"]) @ x
            n = min(k + 1, scores.shape[1])
            # The n best, and with them all ties of the last.
            least = -np.partition(-scores, n - 1, axis=1)[:, n - 1: n]
            q, e = np.nonzero(scores >= least)
            order = np.lexsort((e, -scores[q, e], q))
            q, e = q[order], e[order]
            first = np.searchsorted(q, np.arange(len(part)))
            best = np.arange(len(q)) - first[q] < n
            q, e = q[best], e[best]
            parts.append(pd.DataFrame({"query": part["rep"].to_numpy()[q], "rep": reps[e], "score": scores[q, e]}))
        return pd.concat(parts)

    keys = ["cell", "row_block", "query_block"]
    met = left.select(*keys, "rep", "vector").groupBy(*keys).cogroup(right.select(*keys, "rep", "vector").groupBy(*keys)).applyInPandas(meet, "query long, rep long, score double")
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = met.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
    spread = found.join(known.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = spread.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1)
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    lists = cut_lineage(lists, "lists")
    queries = kept.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    queries = queries.join(known.select(F.col("rep").alias("query"), "vector"), "vector").select("query_id", "query")
    answers = queries.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    flat = answers.select("query_id", F.posexplode("near").alias("at", "n"))
    return flat.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
