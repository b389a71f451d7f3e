"""How well the catalog supports dropping an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.text import identity_parts, search_terms
from vitalgrid.plans.rules import cold

SNAP = ["target_id", "snapshot_id"]
KEY = [*SNAP, "schema", "index"]


def index_reports(indexes: DataFrame, unused: DataFrame, redundant: DataFrame, objects: DataFrame,
                  windows: DataFrame | None = None) -> DataFrame:
    """Grade every unused, redundant or invalid index.

    An invalid or redundant one is proven by the catalog. A zero-scan index is inconclusive in a
    cold window and for any kind a column search cannot settle; otherwise the code must be searched.
    ``redundant`` holds every redundant index with the oldest index that covers it.
    """
    u = unused.select(*KEY, F.lit(True).alias("is_unused"))
    r = redundant.select(*KEY, "covered_by", F.col("bytes").alias("r_bytes"))
    parts = identity_parts("identity")
    inv = (objects.where((F.col("kind") == "index") & F.col("invalid"))
           .select(*SNAP, parts.alias("p")).where(F.col("p.name") != "")
           .select(*SNAP, F.col("p.schema").alias("schema"), F.col("p.name").alias("index"), F.col("p.table").alias("i_table"), F.lit(True).alias("is_invalid")))
    flagged = u.join(r, KEY, "full_outer").join(inv, KEY, "full_outer")
    stats = indexes.select(*KEY, "table", "columns", "method", "is_unique", "is_partial", "is_expression", "scans", "bytes")
    j = flagged.join(stats, KEY, "left")
    if windows is not None:
        j = j.join(windows.select(*SNAP, "window_age_seconds", "stats_window_days", "collected_at"), SNAP, "left")
    else:
        for n, t in (("window_age_seconds", "long"), ("stats_window_days", "double"), ("collected_at", "long")):
            j = j.withColumn(n, F.lit(None).cast(t))
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    grade = (F.when(flag("is_invalid"), "catalog_proven").when(F.col("covered_by").isNotNull(), "catalog_proven")
             .when(cold(), "inconclusive").when(~F.coalesce("method", F.lit("")).isin("", "btree"), "inconclusive")
             .when(flag("is_expression") | flag("is_partial"), "inconclusive").otherwise("needs_code_check"))
    reason = (F.when(flag("is_invalid"), "invalid").when(F.col("covered_by").isNotNull(), "redundant").when(cold(), "cold_window")
              .when(~F.coalesce("method", F.lit("")).isin("", "btree"), "other_method")
              .when(flag("is_expression"), "expression").when(flag("is_partial"), "partial").otherwise("zero_scans"))
    j = j.withColumn("grade", grade).withColumn("reason", reason)
    return j.select(
        *KEY, F.coalesce("table", "i_table").alias("table"), "grade", "reason", "covered_by",
        F.coalesce("bytes", "r_bytes", F.lit(0)).alias("size_bytes"), "scans", (F.col("grade") == "inconclusive").alias("do_not_drop"),
        F.when(F.col("grade") == "needs_code_check", search_terms(F.coalesce("columns", F.array().cast("array<string>")))).alias("search_terms"),
        "window_age_seconds", "stats_window_days", "collected_at", _guard().alias("guard"))


def _guard() -> Column:
    """The guard each grade carries: (id, kind)."""
    return (F.when(F.col("reason") == "invalid", "correlate.invalid_no_build").when(F.col("reason") == "redundant", "correlate.redundant_covering")
            .when(F.col("grade") == "inconclusive", "correlate.inconclusive").otherwise("correlate.needs_code_check"))


def grade_rank() -> Column:
    return F.when(F.col("grade") == "catalog_proven", 0).when(F.col("grade") == "needs_code_check", 1).otherwise(2)


def report_order(reports: DataFrame) -> DataFrame:
    """Reports with their place in their snapshot's listing: surest grade first, then largest, then by name.

    Ranked within (snapshot, grade); what the grades before it hold comes from one small count, so no window holds a whole catalog.
    """
    snap = ["target_id", "snapshot_id"]
    graded = reports.withColumn("_grade", grade_rank())
    counts = graded.groupBy(*snap, "_grade").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*snap).orderBy("_grade").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*snap, "_grade", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*snap, "_grade").orderBy(F.col("size_bytes").desc(), "schema", "index")
    placed = graded.withColumn("_place", F.row_number().over(inside)).join(counts, [*snap, "_grade"])
    return placed.withColumn("place", (F.col("_before") + F.col("_place")).cast("long")).drop("_grade", "_before", "_place")


def attach_verdicts(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Carry stored code-search verdicts forward. A stale one is context, never corroboration.

    ``verdicts`` has one row per (target, schema, index); see ``latest_verdicts``.
    """
    v = verdicts.select("target_id", "schema", "index", "verdict", "checked_at", F.col("stats_window_days").alias("verdict_window_days"))
    j = reports.join(v, ["target_id", "schema", "index"], "left")
    age = F.greatest((F.col("collected_at") - F.col("checked_at")).cast("double") / 86_400, F.lit(0.0))
    window = F.coalesce("stats_window_days", F.col("window_age_seconds").cast("double") / 86_400)
    stale = F.when(F.col("verdict").isNotNull(), F.coalesce(age > window, F.lit(True)))
    fresh_miss = (F.col("grade") == "needs_code_check") & (F.col("verdict") == "not_found_in_code") & (F.col("reason") != "invalid")
    note = F.when(fresh_miss & stale, "stale").when(fresh_miss, F.when(
        F.col("stats_window_days") > F.col("verdict_window_days"), "corroborated_longer").otherwise("corroborated"))
    return j.withColumn("verdict_age_days", F.floor(age + 0.5)).withColumn("verdict_stale", stale).withColumn("verdict_note", note)


def code_search_rows(reports: DataFrame) -> DataFrame:
    """One row per index and spelling to search for."""
    return reports.where(F.col("grade") == "needs_code_check").select(
        *KEY, F.posexplode("search_terms").alias("pos", "term")).withColumn("pos", (F.col("pos") + 1).cast("long"))
