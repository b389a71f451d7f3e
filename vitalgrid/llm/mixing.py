"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Per source, document rates r minimise sum(r log r - r + 1) under sum(size * r) = target and 0 <= r <= cap. The dual has one
unknown per source, the tilt t: r = min(cap, exp(t * size / mean size)), and its gradient is the source's token surplus.
Newton steps, kept inside a bracket, solve all sources at once. They run over (source, size) counts: documents of one size
have one rate, so this loses nothing and shrinks the input of every step. Rates become copies by systematic rounding along
decreasing sizes; of 32 starting points the one nearest the target is taken per source.

Sums that steer decisions are sums of whole numbers (rates and surpluses in fixed point), so they do not depend on the order
in which tasks deliver rows, and reruns agree.

Null or empty texts have size 0 and are taken 0 words. Repeated rows are separate documents; a null id sorts first. A null
source is a source of its own, last in code-point order. Of an empty table nothing is mixed. Further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import SPACED_WORD, cut_lineage, null_safe_join, positions

#: Copies no document and no source may exceed.
CAP = 3.0
#: Weights by the source's place, repeating.
WEIGHTS = (1, 2, 3)
#: Fixed-point units: of a rate, of a word.
RATE_UNIT, WORD_UNIT = 1 << 24, 1 << 12
#: Rounding starts tried per source.
STARTS = 32
#: Documents summed in one window group.
CHUNK = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size) of each row; size counts runs of anything but ASCII white space."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       size_of(F.col(text_col)).alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target): shares by weight of the whole, none above `cap` times the source's own size."""
    sources = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    named = positions(sources, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int")).cast("long")
    weighted = cut_lineage(named.select("source", "source_size", "n_docs", weight.alias("weight")), "weights")
    whole = weighted.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    # Sources reach their cap in the order of size per weight; the first that stays below fixes the level for the rest.
    by_level = positions(weighted, [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()],
                         {"_full": F.col("source_size"), "_used": F.col("weight")})
    level = (F.col("_all") - cap * F.col("_full")) / (F.col("_weights") - F.col("_used"))
    one = by_level.crossJoin(F.broadcast(whole)).withColumn("_level", level)  # one row of totals
    first = one.where(cap * F.col("source_size") >= F.col("_level") * F.col("weight")).agg(F.min_by("_level", "pos").alias("_level"))
    capped = weighted.crossJoin(F.broadcast(first))  # one row again
    return capped.select("source", "source_size", "n_docs",
                         F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight")).cast("double").alias("target"))


def _at_cap(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    return tilt * size / mean >= math.log(cap)


def _rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.when(_at_cap(tilt, size, mean, cap), F.lit(cap)).otherwise(F.exp(tilt * size / mean))


def _staged(state: DataFrame) -> tuple[DataFrame, int]:
    """The state as a written table, and how many sources are not done."""
    seen = Observation()
    written = cut_lineage(state.observe(seen, F.sum((~F.col("done")).cast("long")).alias("left")), "tilt")
    return written, seen.get["left"] or 0


def balance(counts: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = 1e-5, steps: int = 80) -> DataFrame:
    """(source, source_size, target, mean, tilt) with sum(n * size * rate) = target per source.

    `counts` has (source, size, n) with positive sizes. A source whose target is its cap gets the tilt at which its
    smallest document reaches the cap. Both ends of the bracket are exact bounds, so the steps cannot leave it.
    """
    ends = counts.groupBy("source").agg(F.min("size").alias("least"), F.sum("n").alias("filled"))
    sources = null_safe_join(targets.where("source_size > 0"), ends, ["source"])
    mean = F.col("source_size") / F.col("filled")
    want = F.col("target") / F.col("source_size")
    full = F.log(F.lit(cap)) * F.col("mean") / F.col("least") * 1.0000001
    state = sources.withColumn("mean", mean).withColumn("full", full).select(
        "source", "source_size", "target", "mean",
        F.when(want < 1, F.log(want) * F.col("mean") / F.col("least")).otherwise(F.lit(0.0)).alias("low"),
        F.when(want < 1, F.lit(0.0)).otherwise(F.col("full")).alias("high"),
        F.when(want >= cap, F.col("full")).otherwise(F.log(want)).alias("tilt"), (want >= cap).alias("done"))
    state, left = _staged(state)
    for _ in range(steps):
        if not left:
            break
        open_ = state.where(~F.col("done"))
        rows = null_safe_join(counts, open_, ["source"])
        rate, x = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap), F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * rate * WORD_UNIT
        slope = F.when(~_at_cap(F.col("tilt"), F.col("size"), F.col("mean"), cap), words * x).otherwise(F.lit(0.0))
        # A source's state comes along with its sums, which spares the driver a join, and sources that are done stay as they are.
        sums = [F.sum(F.round(v).cast("decimal(38,0)")).cast("double").alias(n) for v, n in ((words, "_words"), (slope, "_slope"))]
        moved = rows.groupBy("source").agg(*sums, *[F.first(c).alias(c) for c in state.columns if c not in ("source", "done")])
        over = F.col("_words") / WORD_UNIT - F.col("target")
        low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - over * WORD_UNIT / F.when(F.col("_slope") > 0, F.col("_slope"))
        inside = (newton > low) & (newton < high)
        near = F.abs(over) <= tolerance * F.col("target") + 0.1
        stuck = (high - low) <= 1e-13 * F.greatest(F.abs(high), F.abs(low))
        state, left = _staged(moved.select(
            "source", "source_size", "target", "mean",
            low.alias("low"), high.alias("high"), F.when(near, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
            (near | stuck).alias("done")).unionByName(state.where("done")))
    return state.select("source", "source_size", "target", "mean", "tilt")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP,
        weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of each row."""
    return mix_sizes(sized(docs, id_col, text_col, source_col), cap, weights)


def mix_sizes(sizes: DataFrame, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`mix` over (doc_id, source, size) and any further columns, which are kept."""
    extra = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    sizes = cut_lineage(sizes, "sizes")
    # What tells rows apart, so that rows without an id are not one chunk.
    told = ["doc_id", "size", *[n for n, t in sizes.dtypes if n in extra and t in ("bigint", "string")]]
    targets = cut_lineage(source_targets(sizes, weights, cap), "targets")
    counts = cut_lineage(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    tilts = balance(counts, targets, cap)
    band = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")
    chunks = counts.groupBy("source", band.alias("band")).agg(F.ceil(F.sum("n") / CHUNK).alias("_chunks"))
    per_band = cut_lineage(null_safe_join(tilts, chunks, ["source"]), "bands")

    filled = sizes.where("size > 0").withColumn("band", band)
    rated = null_safe_join(filled, per_band, ["source", "band"])
    rate = F.round(_rate(F.col("tilt"), F.col("size"), F.col("mean"), cap) * RATE_UNIT).cast("long")
    rated = cut_lineage(rated.select("doc_id", "source", "size", *extra, "source_size", "target", "band",
                                     F.pmod(F.xxhash64(*told), F.col("_chunks")).alias("chunk"), rate.alias("_rate")), "rated")
    totals = rated.groupBy("source", "band", "chunk").agg(F.sum("_rate").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy(F.desc("band"), "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(totals.select("source", "band", "chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")), "starts")
    inside = Window.partitionBy("source", "band", "chunk").orderBy(F.desc("size"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rated.withColumn("_cum", F.sum("_rate").over(inside))
    placed = null_safe_join(summed, starts, ["source", "band", "chunk"])
    placed = cut_lineage(placed.select("doc_id", "source", "size", *extra, "source_size", "target", "_rate",
                                       (F.col("_cum") + F.col("_start")).alias("_cum")), "placed")

    def copies(start: str) -> str:
        upto = f"floor((_cum + {start}) / {RATE_UNIT})"
        return f"least({upto} - floor((_cum - _rate + {start}) / {RATE_UNIT}), {int(cap)})"

    offsets = [(2 * k + 1) * RATE_UNIT // (2 * STARTS) for k in range(STARTS)]
    tried = placed.groupBy("source").agg(F.first("target").alias("target"), *[F.expr(f"sum({copies(str(o))} * size) AS _{k}") for k, o in enumerate(offsets)])
    ranked = ", ".join(f"named_struct('off', abs(_{k} - target), 'start', {o}L)" for k, o in enumerate(offsets))
    best = cut_lineage(tried.selectExpr("source", f"array_min(array({ranked})).start AS _best"), "best")
    chosen = null_safe_join(placed, best, ["source"])
    full = chosen.select("doc_id", "source", "size", *extra, "source_size", "target", (F.col("_rate") / RATE_UNIT).alias("rate"), F.expr(copies("_best")).cast("long").alias("copies"))
    blank = null_safe_join(sizes.where("size = 0"), targets, ["source"])
    empty = blank.select("doc_id", "source", "size", *extra, "source_size", "target", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    return full.unionByName(empty).withColumn("taken", F.col("copies") * F.col("size"))
