"""Exported context documents: reading them, taking them apart, writing them.

A context describes one database at one moment. Sections that were not collected are
absent; unknown keys are ignored, so documents of newer minor versions load too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import epoch_seconds
from vitalgrid.sources.arrays import array_elements

# The published document layout (section and field names).
_INDEX = ("schema string, table string, index string, scans bigint, bytes bigint, definition string, columns array<string>, "
          "method string, unique boolean, primary boolean, partial boolean, expression boolean")
_TABLE = ("schema string, table string, total_bytes bigint, live_tuples bigint, dead_tuples bigint, dead_ratio double, seq_scans bigint, "
          "index_scans bigint, mods_since_analyze bigint, updates bigint, hot_updates bigint, last_analyze timestamp, last_autoanalyze timestamp, "
          "analyze_scale_override double, analyze_threshold_override double, autovacuum_count bigint, autovacuum_disabled boolean, "
          "vacuum_scale_override double, vacuum_threshold_override double, last_vacuum timestamp, last_autovacuum timestamp")


def _s(fields: str) -> str:
    """``name type`` pairs to a struct type in the form nested types need."""
    depth, out, part = 0, [], ""
    for ch in fields + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"`{name}`:{kind.strip()}")
            part = ""
        else:
            part += ch
    return f"struct<{', '.join(out)}>"


def _a(fields: str) -> str:
    return f"array<{_s(fields)}>"


SECTIONS = {
    "server": _s("version_num bigint, version_text string, database string, provider string, in_recovery boolean, uptime_seconds bigint, extensions array<string>"),
    "window": _s("sample_seconds double, stats_reset_at timestamp, postmaster_start_at timestamp, window_age_seconds bigint, stats_window_days double"),
    "health": _s("exactness string, reason string, connections bigint, tps double, commits_per_sec double, rollbacks_per_sec double, rollback_ratio double, "
                 "cache_hit_ratio double, cache_blocks_sampled bigint, deadlocks_per_min double, temp_bytes_per_sec double, tuples_returned_per_sec double, tuples_written_per_sec double"),
    "activity": _s("exactness string, total bigint, active bigint, idle bigint, idle_in_transaction bigint, waiting bigint, by_state map<string,bigint>, wait_events map<string,bigint>, "
                   "longest_xact_sec double, longest_active_sec double, connections " + _a("app_name string, user string, state string, count bigint")
                   + ", autovacuum_workers bigint, autovacuum_max_age_sec double"),
    "locks": _s("exactness string, blocked_count bigint, chains " + _a("blocked_pid bigint, blocking_pids array<bigint>, wait_event string, wait_seconds double, blocked_query string")),
    "queries": _s("exactness string, enabled boolean, total_exec_ms double, pgss_dealloc bigint, pgss_count bigint, pgss_max bigint, top "
                  + _a("queryid bigint, query string, calls bigint, total_ms double, mean_ms double, max_ms double, rows bigint, cache_hit double, wal_bytes bigint")),
    "tables": _s("exactness string, db_size_bytes bigint, top " + _a(_TABLE) + ", partitioned "
                 + _a("schema string, table string, partitions bigint, total_bytes bigint, live_tuples bigint, seq_scans bigint, index_scans bigint")),
    "indexes": _s("exactness string, total bigint, scanned bigint, unused " + _a(_INDEX) + ", largest " + _a(_INDEX) + ", redundant "
                  + _a("schema string, table string, index string, covered_by string, bytes bigint") + ", unindexed_fks "
                  + _a("schema string, table string, constraint string, columns string, child_bytes bigint")),
    "wal": _s("exactness string, bytes_per_sec double, records_per_sec double, buffers_full bigint, dir_bytes bigint, dir_files bigint"),
    "io": _s("exactness string, checkpoints_timed bigint, checkpoints_requested bigint, buffers_written_per_sec double, backend_fsyncs bigint"),
    "replication": _s("is_replica boolean, receiver_lag_sec double, replicas "
                      + _a("client_addr string, application_name string, state string, sync_state string, replay_lag_sec double, replay_lag_bytes bigint")
                      + ", slots " + _a("name string, type string, active boolean, database string, retained_bytes bigint, wal_status string")
                      + ", subscriptions " + _a("name string, worker_running boolean, last_msg_age_sec double")),
    "settings": _s("overrides map<string,string>, params map<string,string>"),
    "limits": _s("exactness string, connections_used bigint, connections_max bigint, max_xid_age bigint, max_mxid_age bigint"),
    "horizon": _s("holders " + _a("source string, holder string, xmin_age bigint, age_s double, detail string")),
    "sequences": _s("items " + _a("schema string, sequence string, last_value bigint, ceiling bigint, pct_used double, owned_by string")
                    + ", narrow_identity " + _a("schema string, table string, column string, type string")),
    "progress": _s("operations " + _a("pid bigint, operation string, relation string, phase string, pct double")),
    "archiver": _s("archived_count bigint, last_archived_time timestamp, failed_count bigint, last_failed_time timestamp, stats_reset timestamp, has_archive_command boolean"),
    "checksums": _s("failures " + _a("database string, count bigint, last_failure timestamp")),
    "standby": _s("confl_tablespace bigint, confl_lock bigint, confl_snapshot bigint, confl_bufferpin bigint, confl_deadlock bigint"),
    "wait_profile": _s("available boolean, samples bigint, window_seconds double, buckets " + _a("type string, count bigint, share double, events " + _a("event string, count bigint, share double"))
                       + ", by_query " + _a("query_id bigint, sample_text string, count bigint, share double, lock_share double, io_share double, top_type string, top_event string")),
    "delta_suppressed_reason": "string",
    "config_warnings": "array<string>",
    "events": _a("kind string, object string, before string, after string, occurred_after timestamp, occurred_before timestamp, confidence double"),
    "deltas": _s("against timestamp, changes " + _a("id string, subject string, severity string, before double, after double, pct_change double, first_observed timestamp, note string")),
    "findings": _a("id string, object string, severity string, title string, evidence array<string>, objects array<string>, confidence double, impact "
                   + _s("score double, dimension string") + ", suppressed boolean, preexisting boolean, caveats array<string>"),
}

CONTEXT_SCHEMA = "schema_version string, profile string, collected_at timestamp, fingerprint string, " + ", ".join(f"{k} {v}" for k, v in SECTIONS.items())


def read_contexts(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Context documents from JSON arrays or single documents, of any file size, or from JSON lines."""
    if lines:
        return spark.read.schema(CONTEXT_SCHEMA).json(path)
    return parse_contexts(array_elements(spark, path), "element")


def parse_contexts(texts: DataFrame, column: str = "document") -> DataFrame:
    return texts.select(F.from_json(column, CONTEXT_SCHEMA).alias("c")).select("c.*")


def _by_day(df: DataFrame) -> DataFrame:
    """Few, even files per day: small days are merged and a day that holds much is split."""
    return df.hint("rebalance", "date")


DOCUMENT_KEY = ["fingerprint", "collected_at"]


def ingest_contexts(contexts: DataFrame, path: str) -> DataFrame:
    """Land usable documents as columns, partitioned by day, and return the landed table.

    A document is landed once: its key is fingerprint and collection time, and what is there already is not written again, so a
    landing that is repeated or cut off halfway can simply be run again. Of documents that share a key within one landing
    the one with the most content stays. Documents without a key go to ``rejected_contexts`` with the reason.
    Every later job reads only the sections it names; JSON would be parsed again for each.
    """
    spark = contexts.sparkSession
    usable, rejected = split_contexts(contexts)
    dated = usable.withColumn("date", F.to_date("collected_at"))
    landed = _landed(spark, dated.schema, path)
    if landed is not None:
        days = dated.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
        there = landed.where(F.col("date").between(F.lit(days["first"]), F.lit(days["last"]))).select(*DOCUMENT_KEY)
        dated = dated.join(there, DOCUMENT_KEY, "left_anti")
    content = F.to_json(F.struct(*[c for c in contexts.columns if c not in DOCUMENT_KEY]))
    packed = dated.select(*DOCUMENT_KEY, F.struct(F.length(content).alias("size"), F.xxhash64(content).alias("mark"), F.struct(*dated.columns).alias("document")).alias("_d"))
    # Keys that come once, nearly all, need no comparison of documents.
    once = packed.groupBy(*DOCUMENT_KEY).agg(F.max_by("_d", F.struct("_d.size", "_d.mark")).alias("_d")).select("_d.document.*")
    _by_day(once).write.mode("append").partitionBy("date").parquet(path)
    _land_rejected(rejected, path)
    return spark.read.schema(dated.schema).parquet(path)


def _landed(spark: SparkSession, schema, path: str) -> DataFrame | None:
    """What is there already, if the folder has been written to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


def _rejects_folder(path: str) -> str:
    return path.rstrip("/") + "_rejected"


def _land_rejected(rejected: DataFrame, path: str) -> None:
    document = F.to_json(F.struct(*rejected.columns))
    rows = rejected.select(F.md5(document).alias("mark"), reject_reason().alias("reason"), document.alias("document")).dropDuplicates(["mark"])
    there = _landed(rejected.sparkSession, rows.schema, _rejects_folder(path))
    rows = rows if there is None else rows.join(there.select("mark"), "mark", "left_anti")
    rows.write.mode("append").parquet(_rejects_folder(path))


def rejected_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(mark, reason, document) of documents that were not landed below ``path``."""
    return spark.read.schema("mark string, reason string, document string").parquet(_rejects_folder(path))


def reject_reason() -> Column:
    """Why a document cannot be landed; NULL if it can."""
    return (F.when(F.coalesce("fingerprint", F.lit("")) == "", "no fingerprint").when(F.col("collected_at").isNull(), "no collection time")
            .when(F.coalesce("schema_version", F.lit("")) == "", "no schema version"))


def keyed(contexts: DataFrame) -> DataFrame:
    """Add the (target_id, snapshot_id) key every job uses."""
    at = epoch_seconds("collected_at")
    return contexts.withColumn("target_id", F.col("fingerprint")).withColumn("snapshot_id", at).withColumn("collected_at_s", at)


def split_contexts(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable documents, rejected ones): a document needs a fingerprint, a time and a schema version."""
    return contexts.where(reject_reason().isNull()), contexts.where(reject_reason().isNotNull())


# Where each table of the data model lives in a document.
TABLES = {
    "tables": "tables.top", "partitioned": "tables.partitioned", "unused_indexes": "indexes.unused", "largest_indexes": "indexes.largest",
    "redundant_indexes": "indexes.redundant", "unindexed_fks": "indexes.unindexed_fks", "statements": "queries.top",
    "lock_chains": "locks.chains", "connection_groups": "activity.connections", "replicas": "replication.replicas", "slots": "replication.slots",
    "subscriptions": "replication.subscriptions", "horizon": "horizon.holders", "sequences": "sequences.items", "narrow_identity": "sequences.narrow_identity",
    "progress": "progress.operations", "checksum_failures": "checksums.failures", "wait_buckets": "wait_profile.buckets",
    "wait_queries": "wait_profile.by_query", "deltas": "deltas.changes", "findings": "findings", "events": "events",
}


def section_rows(contexts: DataFrame, table: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """One typed table out of the documents; only its own section is read from the source.

    ``carry`` adds facts of the same document to every row, which saves joining them later.
    """
    along = [v.alias(n) for n, v in (carry or {}).items()]
    return keyed(contexts).select("target_id", "snapshot_id", *along, F.inline(TABLES[table]))


def setting_rows(contexts: DataFrame) -> DataFrame:
    k = keyed(contexts)
    def one(kind: str, c: str) -> DataFrame:
        return k.select("target_id", "snapshot_id", F.lit(kind).alias("kind"), F.explode(c).alias("name", "value"))
    return one("override", "settings.overrides").unionByName(one("tuning", "settings.params"))


def _count_if(arr: str, cond) -> Column:
    return F.when(F.col(arr).isNotNull(), F.size(F.filter(arr, cond)).cast("long")).otherwise(F.lit(0).cast("long"))


def snapshot_context() -> dict[str, Column]:
    """Facts of a document that the row rules refer to, computed inside the row."""
    slowed = lambda d: (d["id"] == "query.mean_ms") & (d["before"] > 0) & (d["after"] >= 10) & (d["after"] / d["before"] >= 2)
    yes = lambda x: F.coalesce(x, F.lit(False))
    return {
        "window_age_seconds": F.col("window.window_age_seconds"),
        "build_running": yes(F.exists("progress.operations", lambda o: o["operation"] == "create_index")),
        "replication_in_use": yes(F.size("replication.replicas") > 0) | yes(F.col("replication.is_replica")),
        "horizon_pinned": yes(F.get("horizon.holders", F.lit(0))["xmin_age"] >= 1_000_000),
        "slowdown_present": yes(F.exists("deltas.changes", slowed)),
        "hypopg": yes(F.array_contains("server.extensions", "hypopg")),
    }


def setting(name: str) -> Column:
    return F.element_at("settings.params", name)


def context_facts(contexts: DataFrame, setting_names: list[str]) -> DataFrame:
    """Fact row per document, for the fact rules. Everything is computed inside the row: no shuffle."""
    c = F.col
    k = keyed(contexts)
    waits = "wait_profile.buckets"
    bucket = lambda t: F.get(F.filter(waits, lambda b: b["type"] == t), F.lit(0))
    lw, io = bucket("LWLock"), bucket("IO")
    top_lw = F.get(lw["events"], F.lit(0))
    moved = F.filter("deltas.changes", lambda d: (d["id"] == "query.mean_ms") & (d["before"] > 0) & (d["after"] >= 10) & (d["after"] / d["before"] >= 2))
    worst = F.array_max(F.transform(moved, lambda d: F.struct((d["after"] / d["before"]).alias("f"), d["before"].alias("b"), d["after"].alias("a"), d["subject"].alias("s"))))
    gone = F.get(F.filter("deltas.changes", lambda d: d["id"] == "replication.standby_gone"), F.lit(0))
    fails = F.get(F.filter("deltas.changes", lambda d: d["id"] == "archiver.failed_count"), F.lit(0))
    profile = c("wait_profile.available")
    facts = {
        "collected_at": c("collected_at_s"), "provider": c("server.provider"), "is_replica": F.coalesce("replication.is_replica", F.lit(False)),
        "replica_count": F.coalesce(F.size("replication.replicas"), F.lit(0)).cast("long"),
        "sync_count": _count_if("replication.replicas", lambda r: r["sync_state"].isin("sync", "quorum")),
        "blocked": c("locks.blocked_count"), "max_wait_s": F.array_max(F.transform("locks.chains", lambda x: x["wait_seconds"])),
        "autovacuum_workers": c("activity.autovacuum_workers"), "autovacuum_max_age_s": c("activity.autovacuum_max_age_sec"),
        "idle_in_transaction": c("activity.idle_in_transaction"), "longest_xact_s": c("activity.longest_xact_sec"),
        "cache_hit_ratio": c("health.cache_hit_ratio"), "cache_blocks": c("health.cache_blocks_sampled"), "rollback_ratio": c("health.rollback_ratio"),
        "tps": c("health.tps"), "temp_bytes_per_sec": c("health.temp_bytes_per_sec"), "deadlocks_per_min": c("health.deadlocks_per_min"),
        "sample_seconds": c("window.sample_seconds"), "window_age_seconds": c("window.window_age_seconds"), "stats_window_days": c("window.stats_window_days"),
        "connections_used": c("limits.connections_used"), "connections_max": c("limits.connections_max"),
        "max_xid_age": c("limits.max_xid_age"), "max_mxid_age": c("limits.max_mxid_age"),
        "wal_bytes_per_sec": c("wal.bytes_per_sec"), "wal_dir_bytes": c("wal.dir_bytes"),
        "checkpoints_req": c("io.checkpoints_requested"), "checkpoints_timed": c("io.checkpoints_timed"),
        "last_archived_at": epoch_seconds("archiver.last_archived_time"), "last_failed_at": epoch_seconds("archiver.last_failed_time"),
        "failed_increase": (fails["after"] - fails["before"]).cast("long"),
        "conflicts": sum((F.coalesce("standby." + n, F.lit(0)) for n in ("confl_tablespace", "confl_lock", "confl_snapshot", "confl_bufferpin", "confl_deadlock")), F.lit(0)),
        "statements_enabled": c("queries.enabled"), "statements_dealloc": F.coalesce("queries.pgss_dealloc", F.lit(0)),
        "statements_count": F.coalesce("queries.pgss_count", F.lit(0)), "statements_max": F.coalesce("queries.pgss_max", F.lit(0)),
        "wait_samples": F.when(profile, c("wait_profile.samples")), "io_share": F.coalesce(io["share"], F.lit(0.0)),
        "lwlock_share": F.coalesce(top_lw["share"], lw["share"], F.lit(0.0)), "lwlock_event": F.coalesce(top_lw["event"], F.lit("LWLock")),
        "standby_gone": gone["subject"], "slowdown_factor": worst["f"], "slowdown_before": worst["b"], "slowdown_after": worst["a"],
        "slowdown_query": F.regexp_extract(F.coalesce(worst["s"], F.lit("")), r"(-?\d+)$", 1).try_cast("long"),
        **{"p_" + n: F.coalesce(setting(n), F.lit("")) for n in setting_names},
    }
    return k.select("target_id", "snapshot_id", *[v.alias(n) for n, v in facts.items()])


def build_contexts(parts: dict[str, Column], base: DataFrame) -> DataFrame:
    """Documents from already nested columns; absent sections stay absent."""
    return base.select(*[col.alias(name) for name, col in parts.items()])


def write_contexts(contexts: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines partitioned by day, ready for ``read_contexts(lines=True)`` and partition pruning."""
    _by_day(contexts.withColumn("date", F.to_date("collected_at"))).write.mode(mode).partitionBy("date").json(path)


def export_target(contexts: DataFrame, fingerprint: str) -> DataFrame:
    """All documents of one target in time order."""
    return contexts.where(F.col("fingerprint") == fingerprint).orderBy("collected_at")


def drop_target(contexts: DataFrame, fingerprint: str) -> DataFrame:
    """Everything but one target; write it out to replace the history."""
    return contexts.where(F.col("fingerprint") != fingerprint)


def append_events(events: DataFrame, path: str) -> None:
    """Append change events to the event log, partitioned by day."""
    day = F.to_date(F.timestamp_seconds("occurred_before"))
    _by_day(events.withColumn("date", day)).write.mode("append").partitionBy("date").parquet(path)
