"""Ordered look-ups over long per-key histories, without one task per key.

A plain ``Window.partitionBy(target).orderBy(ts)`` sends all of one target's rows to
one task, however large that target is. The operators here window inside
``(key, time chunk)`` instead and carry the last value of earlier chunks across the
chunk border. The carry comes from a pre-aggregated edge table with one row per
``(key, chunk)``, so the only per-key window left runs over chunk counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
CHUNK = "_chunk"


def with_chunk(df: DataFrame, at: str, chunk_seconds: int) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(at) / F.lit(chunk_seconds)).cast("long"))


def _edge_carry(edges: DataFrame, keys: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """Latest non-null edge value of all chunks before (after, when descending) each chunk."""
    order = F.col(CHUNK).desc() if descending else F.col(CHUNK)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(*keys, CHUNK, F.last(value, ignorenulls=True).over(w).alias("_carry"))


def previous_row(df: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], *,
                 prefix: str = "prev_", chunk_seconds: int = DAY) -> DataFrame:
    """Add ``prefix + c`` for each column: its value in the key's previous row by ``at``.

    ``(keys, at)`` must be unique, as snapshots of one target are.
    """
    chunked = with_chunk(df, at, chunk_seconds)
    w = Window.partitionBy(*keys, CHUNK).orderBy(at)
    columns = list(columns)
    carried = [at, *[c for c in columns if c != at]]
    near = chunked.withColumn("_near", F.lag(F.struct(*carried)).over(w))
    # One plain aggregate per column keeps the partial aggregation hash-based.
    edges = (chunked.groupBy(*keys, CHUNK)
             .agg(*[F.max_by(c, at).alias(c) for c in carried])
             .select(*keys, CHUNK, F.struct(*carried).alias("_last")))
    carry = _edge_carry(edges, keys, "_last")
    joined = near.join(carry, [*keys, CHUNK], "left").withColumn("_prev", F.coalesce("_near", "_carry"))
    return joined.select(*df.columns, *[F.col("_prev")[c].alias(prefix + c) for c in columns])


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], probe: Column, right_at: str,
         columns: Sequence[str], *, prefix: str = "base_", chunk_seconds: int = DAY,
         nearest_within: int | None = None) -> DataFrame:
    """Attach the newest ``right`` row with ``right_at <= probe`` to every ``left`` row.

    With ``nearest_within`` the closest row on either side is taken instead, if it is
    at most that many seconds away (the earlier one on a tie). Probes and right rows
    are laid on one time line and filled in one pass, so the cost is linear; no range
    join produces candidate pairs.
    """
    columns = list(columns)
    payload = F.struct(F.col(right_at).alias("_at"), *columns)
    kept = list(left.columns)
    probes = left.select(*keys, probe.cast("long").alias("_t"), F.lit(1).alias("_tag"),
                         F.struct(*kept).alias("_left"))
    facts = right.select(*keys, F.col(right_at).cast("long").alias("_t"), F.lit(0).alias("_tag"),
                         payload.alias("_right"))
    line = with_chunk(probes.unionByName(facts, allowMissingColumns=True), "_t", chunk_seconds)

    edge = line.groupBy(*keys, CHUNK).agg(
        F.max_by("_right", F.when(F.col("_tag") == 0, F.col("_t"))).alias("_last"),
        F.min_by("_right", F.when(F.col("_tag") == 0, F.col("_t"))).alias("_first"))
    w = (Window.partitionBy(*keys, CHUNK).orderBy("_t", "_tag")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = line.withColumn("_near", F.last("_right", ignorenulls=True).over(w))
    if nearest_within is not None:
        back = (Window.partitionBy(*keys, CHUNK).orderBy(F.col("_t").desc(), F.col("_tag").desc())
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        filled = filled.withColumn("_after", F.last("_right", ignorenulls=True).over(back))
    filled = filled.where(F.col("_tag") == 1)
    filled = (filled.join(_edge_carry(edge, keys, "_last"), [*keys, CHUNK], "left")
              .withColumn("_hit", F.coalesce("_near", "_carry")).drop("_carry"))
    if nearest_within is not None:
        late = _edge_carry(edge, keys, "_first", descending=True)
        filled = filled.join(late, [*keys, CHUNK], "left").withColumn("_after", F.coalesce("_after", "_carry"))
        before = F.col("_t") - F.col("_hit")["_at"]
        after = F.col("_after")["_at"] - F.col("_t")
        take_before = (before <= nearest_within) & (after.isNull() | (before <= after))
        filled = filled.withColumn("_hit", F.when(take_before, F.col("_hit"))
                                   .when(after <= nearest_within, F.col("_after")))
    return filled.select(*[F.col("_left")[c].alias(c) for c in kept],
                         *[F.col("_hit")[c].alias(prefix + c) for c in columns])


def carried(df: DataFrame, keys: Sequence[str], at: str, *, totals: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
            maxima: dict[str, Column] | None = None, chunk_seconds: int = DAY) -> DataFrame:
    """Add running totals, last known values and running maxima along ``at``, the row itself included.

    Both run inside ``(key, time chunk)``; what earlier chunks add comes from one row per chunk. ``(keys, at)`` must be unique.
    """
    totals, lasts, maxima = totals or {}, lasts or {}, maxima or {}
    chunked = with_chunk(df, at, chunk_seconds).withColumns({f"_v_{n}": v for n, v in {**totals, **lasts, **maxima}.items()})
    w = Window.partitionBy(*keys, CHUNK).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = chunked.withColumns({**{f"_n_{n}": F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)) for n in totals},
                                **{f"_n_{n}": F.last(f"_v_{n}", ignorenulls=True).over(w) for n in lasts}, **{f"_n_{n}": F.max(f"_v_{n}").over(w) for n in maxima}})
    known = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.col(at))
    edges = chunked.groupBy(*keys, CHUNK).agg(F.count("*").alias("_rows"), *[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in totals],
                                              *[F.max_by(f"_v_{n}", known(n)).alias(f"_e_{n}") for n in lasts], *[F.max(f"_v_{n}").alias(f"_e_{n}") for n in maxima])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"),
                         *[F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in totals],
                         *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts], *[F.max(f"_e_{n}").over(before).alias(f"_c_{n}") for n in maxima])
    same = F.col(CHUNK) == F.col("_k_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = near.join(edges, same, "left")
    return joined.select(*df.columns, *[(F.col(f"_n_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in totals],
                         *[F.coalesce(f"_n_{n}", f"_c_{n}").alias(n) for n in lasts], *[F.greatest(f"_n_{n}", f"_c_{n}").alias(n) for n in maxima])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each key. Spark prunes to k rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def counter_delta(before: Column | str, after: Column | str) -> Column:
    """after - before; NULL when the counter went backwards (a reset) or has no start."""
    b = F.col(before) if isinstance(before, str) else before
    a = F.col(after) if isinstance(after, str) else after
    return F.when(a >= b, a - b)


def per_second(before: Column | str, after: Column | str, seconds: Column | str) -> Column:
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(s > 0, F.try_divide(counter_delta(before, after).cast("double"), s.cast("double")))


def counter_ratio(num_a, num_b, den_a, den_b) -> Column:
    """num / (num + den) over the window; NULL on a reset or an empty window."""
    n, d = counter_delta(num_a, num_b), counter_delta(den_a, den_b)
    return F.try_divide(n.cast("double"), (n + d).cast("double"))
