"""The library's front door: telemetry tables in, findings and reports out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators import baseline, catalog, changes, deltas, evidence, fleet, policy, rates, waits
from vitalgrid.plans import families
from vitalgrid.plans import rules as R
from vitalgrid.plans.context_findings import context_findings
from vitalgrid.sources.contexts import ingest_contexts, read_contexts


class TableSource:
    """Telemetry tables by name, in the shape the finding families ask for.

    Optional tables refine the rules: ``thresholds`` (per target, see ``policy.threshold_columns``)
    and ``windows`` (per snapshot: window_age_seconds, replication_in_use, ...).
    """

    # Tables that may stand in for one that is not given.
    STAND_INS = {"session_params": "params", "index_table_stats": "table_stats"}

    def __init__(self, tables: dict[str, DataFrame], spark: SparkSession | None = None, baselines: Callable[[], DataFrame] | None = None):
        self.tables, self.spark = dict(tables), spark
        self.shared_baselines = baselines

    def __getattr__(self, name: str) -> Callable[[], DataFrame]:
        if name == "vacuum_settings" and name not in self.tables and "params" in self.tables:
            return lambda: families.vacuum_settings(self.tables["params"])
        if name == "baselines" and self.shared_baselines is not None:
            return self.shared_baselines
        for candidate in (name, self.STAND_INS.get(name)):
            if candidate in self.tables:
                return lambda: self.tables[candidate]
        raise AttributeError(f"no telemetry table named {name!r}")

    def has(self, *names: str) -> bool:
        return all(n in self.tables or self.STAND_INS.get(n) in self.tables for n in names)


# The tables each family reads.
FAMILY_TABLES = {
    "instances": ("instances", "params"), "health": ("db_counters",), "activity": ("activity", "lock_waits", "session_params"), "waits": ("ash",),
    "tables": ("table_stats",), "partitions": ("partition_edges", "partition_leaves"), "unused": ("indexes", "index_table_stats"), "redundant": ("indexes",),
    "fks": ("foreign_keys", "indexes"), "invalid": ("schema_objects", "progress"), "sequences": ("sequences",), "narrow": ("narrow_columns",),
    "checksums": ("checksum_failures",), "replicas": ("replicas",), "slots": ("slots",), "subscriptions": ("subscriptions",), "horizon": ("horizon",),
    "slowdowns": ("statements",),
}


def _with_database(df: DataFrame) -> DataFrame:
    return df if "database" in df.columns else df.withColumn("database", F.lit(""))


class Fleet:
    """All databases of a fleet and all their snapshots, as one set of tables.

    Methods return DataFrames and collect no telemetry. Partition trees are followed in jobs of their own, and documents are
    landed, when the frames that need them are made; all else is lazy.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.source = TableSource({}, spark)
        self.documents: DataFrame | None = None

    def from_tables(self, tables: dict[str, DataFrame]) -> Fleet:
        self.source = TableSource(tables, self.spark, self.baselines)
        return self

    def from_contexts(self, path: str, landing: str, *, lines: bool = False) -> Fleet:
        """Exported context documents, landed once as columns below ``landing``."""
        self.documents = ingest_contexts(read_contexts(self.spark, path, lines=lines), landing)
        return self

    def families(self) -> list[str]:
        """Finding families the given tables can feed."""
        return [f for f, needed in FAMILY_TABLES.items() if self.source.has(*needed)]

    # --- measurements ---

    def rates(self) -> DataFrame:
        return rates.health_rates(self.source.db_counters())

    def wait_profile(self) -> DataFrame:
        return waits.wait_by_type(self.source.ash())

    def wait_queries(self) -> DataFrame:
        return waits.wait_by_query(self.source.ash())

    # --- comparisons ---

    def heads(self) -> DataFrame | None:
        """All snapshots of all targets: the table ``snapshots`` if given, else those that any telemetry table knows."""
        names = ("snapshots",) if self.source.has("snapshots") else ("instances", "db_counters", "statements", "table_stats", "replicas")
        known = [getattr(self.source, n)() for n in names if self.source.has(n)]
        return deltas.heads_of(*known) if known else None

    def _split(self) -> tuple[DataFrame, DataFrame] | None:
        heads = self.heads()
        if heads is None:
            return None
        if not self.source.has("db_counters"):
            chosen = deltas.delta_baselines(heads)
            return chosen, chosen.where(F.lit(False)).withColumns({"reason": F.lit(""), "resets": F.lit(0).cast("long")})
        return deltas.split_baselines(heads, self.source.db_counters())

    def baselines(self) -> DataFrame:
        """What each snapshot is compared with: one baseline for all measures, none across a reset or restart."""
        split = self._split()
        return self.spark.createDataFrame([], "target_id long, snapshot_id long, base_snapshot_id long, base_at long") if split is None else split[0]

    def suppressed_deltas(self) -> DataFrame:
        """Snapshots that are compared with nothing because counters began anew since their baseline, and why."""
        split = self._split()
        return self.spark.createDataFrame([], "target_id long, snapshot_id long, base_snapshot_id long, base_at long, reason string, resets long") if split is None else split[1]

    def deltas(self) -> DataFrame:
        """Material changes of each snapshot against its baseline."""
        parts, has, chosen = [], self.source.has, self.baselines()
        if has("statements"):
            parts.append(deltas.query_deltas(self.source.statements(), chosen))
        if has("table_stats"):
            parts.append(deltas.table_deltas(R.dead_ratio(self.source.table_stats()), chosen))
        if has("replicas"):
            r = self.source.replicas()
            parts.append(deltas.standby_gone(r, chosen.join(r.select("target_id", "snapshot_id").distinct(), ["target_id", "snapshot_id"], "left_semi")))
            lags = r.groupBy("target_id", "snapshot_id").agg(F.max("replay_lag_sec").alias("receiver_lag_sec"))
            parts.append(deltas.receiver_lag_deltas(_with_database(deltas.against_base(lags, chosen, "receiver_lag_sec"))))
        if has("db_counters"):
            h = self.source.db_counters()
            named = h.select("target_id", "snapshot_id", *[n for n in ("database", "db_size_bytes") if n in h.columns], F.col("numbackends").alias("connections"))
            parts.append(deltas.connection_deltas(_with_database(deltas.against_base(named, chosen, "connections"))))
            if "db_size_bytes" in h.columns:
                parts.append(deltas.size_deltas(_with_database(deltas.against_base(named, chosen, "db_size_bytes"))))
        if has("table_stats") and not (has("db_counters") and "db_size_bytes" in self.source.db_counters().columns):
            # The database's own size is not known; that of its tables is.
            sizes = self.source.table_stats().groupBy("target_id", "snapshot_id").agg(F.sum("total_bytes").alias("db_size_bytes"))
            parts.append(deltas.size_deltas(_with_database(deltas.against_base(sizes, chosen, "db_size_bytes"))))
        if has("instances") and "failed_count" in self.source.instances().columns:
            parts.append(deltas.archiver_deltas(deltas.against_base(self.source.instances().select("target_id", "snapshot_id", "failed_count"), chosen, "failed_count")))
        return deltas.all_deltas(*parts, spark=self.spark)

    def events(self) -> DataFrame:
        parts = []
        if self.source.has("schema_objects"):
            parts.append(changes.schema_events(self.source.schema_objects()))
        if self.source.has("settings_history"):
            parts.append(changes.config_events(self.source.settings_history()))
        if self.source.has("db_counters"):
            parts.append(changes.lifecycle_events(_with_database(self.source.db_counters())))
        return deltas.all_deltas(*parts, spark=self.spark, schema=deltas.EVENT)

    # --- findings ---

    def _graded(self, thresholds: DataFrame | None) -> TableSource:
        return self.source if thresholds is None else TableSource({**self.source.tables, "thresholds": thresholds}, self.spark, self.baselines)

    def evidence(self, only: Iterable[str] | None = None, thresholds: DataFrame | None = None) -> DataFrame:
        """One row per object of every aggregate finding, graded by the same thresholds as the findings."""
        if self.documents is not None:
            return context_findings(self.documents, thresholds)[1]
        rows = {"tables", "partitions", "unused", "redundant", "fks", "invalid", "sequences", "narrow", "checksums", "replicas"} & set(self.families())
        ids = [i for f in rows for i in families.FAMILIES[f] if i in families.ROW_RULE_IDS and (only is None or i in set(only))]
        return families.evidence_rows(self._graded(thresholds), ids)

    def findings(self, *, only: Iterable[str] | None = None, thresholds: DataFrame | None = None, rules: DataFrame | None = None,
                 severities: DataFrame | None = None, now: str | None = None) -> DataFrame:
        """Numbered findings. Order is fixed before severities are remapped and rules applied."""
        if self.documents is not None:
            found, rows = context_findings(self.documents, thresholds)
            if only is not None:
                found = found.where(F.col("id").isin(*only))
        else:
            found, rows = families.fleet_findings(self._graded(thresholds), only, self.families()), None
        found = fleet.order_findings(found)
        if severities is not None:
            found = policy.remap_severity(found, severities)
        if rules is not None:
            rows = self.evidence(only, thresholds) if rows is None else rows
            found, _ = policy.apply_ignores(found, rows, rules, F.current_timestamp() if now is None else now)
        return found

    def totals(self, **kwargs) -> DataFrame:
        """Active findings per severity of each snapshot."""
        return fleet.findings_total(self.findings(**kwargs))

    def rollup(self, **kwargs) -> DataFrame:
        """How often and on how many targets each finding occurs."""
        return fleet.fleet_rollup(self.findings(**kwargs))

    def scores(self, **kwargs) -> DataFrame:
        return fleet.health_score(self.findings(**kwargs))

    def index_reports(self, verdicts: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
        ix = self.source.indexes()
        reports = evidence.index_reports(ix, catalog.unused_indexes(ix), catalog.redundant_indexes(ix), self.source.schema_objects(), windows)
        return reports if verdicts is None else evidence.attach_verdicts(reports, baseline.latest_verdicts(verdicts, ["target_id", "schema", "index"]))
