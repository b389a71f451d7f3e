"""Findings straight from context documents.

A document holds everything its rules need, so nothing is joined: sections are exploded with
the facts they depend on, and the only shuffle is the aggregation of evidence to findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import epoch_seconds
from vitalgrid.plans import rules as R
from vitalgrid.sources import contexts as X

SNAP = ["target_id", "snapshot_id"]

VACUUM_SETTINGS = {"vacuum_threshold": "autovacuum_vacuum_threshold", "vacuum_scale": "autovacuum_vacuum_scale_factor",
                   "analyze_threshold": "autovacuum_analyze_threshold", "analyze_scale": "autovacuum_analyze_scale_factor"}
THRESHOLDS = ("unused_index_min_bytes", "dead_ratio_warn", "replica_lag_warn_sec")


def _tables(t: DataFrame) -> DataFrame:
    """Table entries of a document in the layout of the table statistics."""
    return (t.withColumns({n: epoch_seconds(n) for n in ("last_analyze", "last_autoanalyze", "last_vacuum", "last_autovacuum")})
            .withColumns({"updates": F.coalesce("updates", F.lit(0)), "hot_updates": F.coalesce("hot_updates", F.lit(0)),
                          "rel_autovacuum_enabled": F.when(F.col("autovacuum_disabled"), "off")})
            .withColumnsRenamed({"analyze_scale_override": "rel_analyze_scale", "analyze_threshold_override": "rel_analyze_threshold",
                                 "vacuum_scale_override": "rel_vacuum_scale", "vacuum_threshold_override": "rel_vacuum_threshold"}))


def _written_tables() -> Column:
    """Names of the document's tables with many changes since analyze (of at most thirty)."""
    heavy = F.filter("tables.top", lambda t: t["mods_since_analyze"] > R.WRITE_HEAVY_MODS)
    return F.coalesce(F.transform(heavy, lambda t: F.concat_ws(".", t["schema"], t["table"])), F.array().cast("array<string>"))


def _evidence(docs: DataFrame, thresholds: DataFrame | None) -> DataFrame:
    tuned: dict[str, Column] = {}
    if thresholds is not None:
        t = thresholds.withColumnRenamed("target_id", "fingerprint")
        docs = docs.join(t, "fingerprint", "left")
        tuned = {n: F.col(n) for n in THRESHOLDS if n in thresholds.columns}
    context = X.snapshot_context()

    def rows(table: str, **more: Column) -> DataFrame:
        return X.section_rows(docs, table, {**context, **tuned, **more})

    vacuum = {a: X.setting(n).try_cast("double") for a, n in VACUUM_SETTINGS.items()}
    unused = rows("unused_indexes", written=_written_tables()).withColumnsRenamed({"partial": "is_partial", "expression": "is_expression"})
    parts = [
        R.table_rows(_tables(rows("tables", **vacuum))),
        R.partition_rows(rows("partitioned").withColumn("root", F.concat_ws(".", "schema", "table"))),
        R.unused_index_rows(unused.withColumn("heavy", F.array_contains("written", F.concat_ws(".", "schema", "table")))),
        R.redundant_rows(rows("redundant_indexes")), R.fk_rows(rows("unindexed_fks")),
        R.sequence_rows(rows("sequences").withColumnRenamed("sequence", "name")), R.narrow_rows(rows("narrow_identity")),
        R.checksum_rows(rows("checksum_failures").withColumnRenamed("count", "failures")),
        R.replica_lag_rows(rows("replicas", wal_bytes_per_sec=F.col("wal.bytes_per_sec")).withColumnRenamed("application_name", "app_name")),
    ]
    columns = [*R.ROW, *R.CONTEXT]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def context_rows(docs: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Evidence rows of every row rule. ``thresholds`` may hold per-target overrides."""
    return _evidence(docs, thresholds).select(*R.ROW)


def context_findings(docs: DataFrame, thresholds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, evidence rows) of all documents, every rule included."""
    rows = _evidence(docs, thresholds)
    queries = (X.section_rows(docs, "wait_queries", {"total": F.when(F.col("wait_profile.available"), F.col("wait_profile.samples"))})
               .withColumn("window_id", F.col("snapshot_id")).withColumnRenamed("count", "samples"))
    findings = R.union_findings(
        R.fact_findings(X.context_facts(docs, R.setting_names())), R.row_findings(rows),
        R.slot_findings(X.section_rows(docs, "slots")), R.subscription_findings(X.section_rows(docs, "subscriptions")),
        R.horizon_findings(X.section_rows(docs, "horizon")), R.prepared_findings(X.section_rows(docs, "horizon")),
        R.lock_contention_findings(queries))
    return findings, rows.select(*R.ROW)
