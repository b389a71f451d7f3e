"""Telemetry tables laid over the analytics test tables.

Each function maps given parquet tables to one telemetry table of the data model, so
every operator runs on data that grows with the input. ``oracle.views`` states the
same mappings in SQL.

Two fleets are described: targets 0..24 (activity, counters, statements, tables,
indexes, catalogs) and one target per customer, numbered from 1000 (limits, archiving,
settings and other once-per-instance facts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import epoch_seconds

SLOT = 21_600
DAY = 86_400
INSTANCE_BASE = 1000


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


class Testbed:
    """Lazily built telemetry tables over one directory of test tables."""

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A given table; its files are listed and its schema read once per testbed."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def _events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "event_type", "value",
            epoch_seconds("ts").alias("at"), F.col("user_id").cast("long").alias("user_id"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            (F.col("user_id") % 25).cast("long").alias("target_id"))

    # --- targets and instance facts -----------------------------------------

    def targets(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            (k + INSTANCE_BASE).alias("target_id"),
            F.col("c_nationkey").cast("long").alias("cluster_id"),
            F.concat(F.lit("host"), F.col("c_nationkey").cast("string")).alias("host"),
            F.lit("5432").alias("port"), F.col("c_name").alias("database"),
            F.when(k % 3 != 0, F.concat(F.lit("sys"), F.col("c_nationkey").cast("string"))).otherwise("")
            .alias("system_identifier"),
            F.when(k % 7 == 0, "rds").when(k % 7 == 1, "neon").otherwise("unknown").alias("provider"),
            (k % 5 == 0).alias("is_replica"))

    def instances(self) -> DataFrame:
        """One row per instance: limits, archiver, WAL, checkpoints, statement-store and window facts."""
        o = (self.raw("orders").groupBy("o_custkey").agg(
            F.count("*").alias("n"),
            F.max(F.when(F.col("o_orderstatus") == "F", epoch_seconds("o_orderdate"))).alias("last_archived_at"),
            F.max(F.when(F.col("o_orderstatus") == "P", epoch_seconds("o_orderdate"))).alias("last_failed_at"),
            F.max(epoch_seconds("o_orderdate")).alias("newest"),
            F.count_if(F.col("o_orderstatus") == "P").alias("failed_count"),
            F.count_if(F.substring("o_orderpriority", 1, 1) == "1").alias("urgent"),
            F.sum(cents("o_totalprice")).alias("price")))
        k, b = F.col("c_custkey"), F.abs(cents("c_acctbal"))
        joined = self.raw("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
        n = F.coalesce("n", F.lit(0))
        collected = F.coalesce("newest", F.lit(946_684_800)) + F.lit(2 * DAY) * (k % 3)
        reset = collected - (k % 50) * DAY
        used = (k * 7) % 200
        maxc = F.when(k % 6 == 0, F.lit(500)).otherwise(F.lit(200))
        return joined.select(
            (k + INSTANCE_BASE).alias("target_id"), F.lit(0).cast("long").alias("snapshot_id"),
            collected.cast("long").alias("collected_at"),
            F.col("c_name").alias("database"), F.col("c_nationkey").cast("long").alias("cluster_id"),
            F.when(k % 7 == 0, "rds").when(k % 7 == 1, "neon").otherwise("unknown").alias("provider"),
            (k % 5 == 0).alias("is_replica"),
            (k % 4).alias("replica_count"), (k % 3).alias("sync_count"),
            used.cast("long").alias("connections_used"), maxc.cast("long").alias("connections_max"),
            (b * 2200).cast("long").alias("max_xid_age"), ((b * 1700 + k * 1000) % 2_100_000_000).alias("max_mxid_age"),
            "last_archived_at", "last_failed_at", F.coalesce("failed_count", F.lit(0)).alias("failed_count"),
            F.when(k % 13 == 0, F.coalesce("failed_count", F.lit(0))).otherwise(F.lit(0)).alias("failed_increase"),
            F.when(k % 9 != 0, n.cast("double") * 1.5).alias("wal_bytes_per_sec"),
            F.when(k % 4 != 0, F.coalesce("price", F.lit(0)) * 40).alias("wal_dir_bytes"),
            F.coalesce("urgent", F.lit(0)).alias("checkpoints_req"),
            (n - F.coalesce("urgent", F.lit(0))).alias("checkpoints_timed"),
            (k % 8 != 0).alias("statements_enabled"), (k % 6).alias("statements_dealloc"),
            (4000 + (k * 13) % 1200).alias("statements_count"), F.lit(5000).cast("long").alias("statements_max"),
            F.when(k % 10 != 0, reset.cast("long")).alias("stats_reset_at"),
            (collected - (k % 90) * DAY - 600).cast("long").alias("postmaster_start_at"),
            ((k % 23 == 0).cast("long") * (k % 5)).alias("conflict_snapshot"),
            ((k % 19 == 0).cast("long") * 2).alias("conflict_lock"),
            ((k % 29 == 0).cast("long") * 3).alias("conflict_bufferpin"),
            F.lit(0).cast("long").alias("conflict_deadlock"), F.lit(0).cast("long").alias("conflict_tablespace"))

    def params(self) -> DataFrame:
        """Long-form current settings of every instance."""
        k, b = F.col("c_custkey"), F.abs(cents("c_acctbal"))

        def text(c: Column, unit: str = "") -> Column:
            return F.concat(c.cast("string"), F.lit(unit))

        onoff = {name: F.when(k % p == r, "off").otherwise("on") for name, p, r in (
            ("fsync", 31, 0), ("full_page_writes", 37, 1), ("autovacuum", 41, 2), ("track_io_timing", 5, 3),
            ("data_checksums", 6, 4))}
        values: dict[str, Column] = {
            **onoff,
            "ignore_checksum_failure": F.when(k % 43 == 5, "on").otherwise("off"),
            "archive_mode": F.when(k % 4 == 0, "off").when(k % 4 == 1, "always").otherwise("on"),
            "archive_timeout": F.when(k % 3 == 0, "0").otherwise(text(1 + b % 90, "min")),
            "wal_level": F.when(k % 11 == 0, "minimal").otherwise("replica"),
            "work_mem": text(1 + b % 64, "MB"),
            "effective_cache_size": text(1 + b % 8, "GB"),
            "max_connections": text(F.when(k % 6 == 0, F.lit(500)).otherwise(F.lit(200))),
            "max_wal_size": text(1 + b % 4, "GB"),
            "random_page_cost": text(1 + b % 5),
            "statement_timeout": F.when(b % 2 == 0, "0").otherwise("30s"),
            "synchronous_commit": F.when(k % 5 == 4, "off").when(k % 5 == 3, "remote_apply").otherwise("on"),
            "synchronous_standby_names": F.when(k % 3 == 0, "").when(k % 3 == 1, "ANY 2 (s1, s2, s3)").otherwise("s1"),
            "autovacuum_max_workers": text(1 + b % 3),
            "ssl_key_file": text(b % 7, ".key"),
        }
        rows = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
        # Every row becomes one row per setting: rows are dealt out while they are few, into partitions that are not merged again,
        # so that no task holds all settings of a file to write them to the next exchange.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return (self.raw("customer").repartition(parts, "c_custkey")
                .select((k + INSTANCE_BASE).alias("target_id"), F.inline(rows)))

    def settings_history(self) -> DataFrame:
        names = ["fsync", "autovacuum", "work_mem", "archive_timeout", "statement_timeout", "ssl_key_file",
                 "track_io_timing", "random_page_cost"]
        k, b = F.col("c_custkey"), F.abs(cents("c_acctbal"))
        latest = (self.raw("customer").select(
            F.col("c_nationkey").cast("long").alias("target_id"), (F.floor(k / 8) % 4).cast("long").alias("snapshot_id"),
            F.element_at(F.array(*[F.lit(n) for n in names]), (k % 8 + 1).cast("int")).alias("name"), k.alias("k"), b.alias("b"))
            .groupBy("target_id", "snapshot_id", "name").agg(F.max_by("b", "k").alias("b")))
        b = F.col("b")
        value = (F.when(F.col("name").isin("fsync", "autovacuum", "track_io_timing"),
                        F.when(b % 10 < 3, "off").otherwise("on"))
                 .when(F.col("name") == "work_mem", F.concat((1 + b % 64).cast("string"), F.lit("MB")))
                 .when(F.col("name") == "archive_timeout", F.concat((1 + b % 30).cast("string"), F.lit("min")))
                 .when(F.col("name") == "statement_timeout", F.when(b % 2 == 0, "0").otherwise("30s"))
                 .when(F.col("name") == "ssl_key_file", F.concat(F.lit("/etc/k"), (b % 7).cast("string")))
                 .otherwise((1 + b % 5).cast("string")))
        return latest.select("target_id", "snapshot_id", "name", value.alias("value"))

    # --- counters, sessions, waits ------------------------------------------

    def db_counters(self) -> DataFrame:
        slot = F.floor(F.col("at") / SLOT).cast("long")
        err = F.col("event_type") == "error"
        g = (self._events().select("target_id", slot.alias("slot"), err.alias("err"), cents("value").alias("c"), "k")
             .groupBy("target_id", "slot").agg(
                 F.count("*").alias("numbackends"),
                 (40 * F.count_if(~F.col("err"))).alias("xact_commit"), (40 * F.count_if("err")).alias("xact_rollback"),
                 F.sum("c").alias("blks_hit"), F.sum(20 * F.col("k")).alias("blks_read"),
                 F.sum(F.col("c") * (F.col("target_id") % 4) * 20_000_000).alias("temp_bytes"),
                 F.count_if(F.col("err") & (F.col("c") > 10_000)).alias("deadlocks"),
                 F.sum(F.col("k") * 100).alias("tup_returned"), F.sum("k").alias("tup_written")))
        # Counters run within one reset epoch of 40 slots, so this window is small by construction.
        w = (Window.partitionBy("target_id", "epoch_id").orderBy("slot")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        running = ["xact_commit", "xact_rollback", "blks_hit", "blks_read", "temp_bytes", "deadlocks",
                   "tup_returned", "tup_written"]
        epoch = F.floor(F.col("slot") / 40).cast("long")
        return (g.withColumn("epoch_id", epoch).select(
            "target_id", F.col("slot").alias("snapshot_id"), (F.col("slot") * SLOT).alias("collected_at"), "numbackends",
            *[F.sum(c).over(w).alias(c) for c in running],
            (F.col("epoch_id") * 40 * SLOT).alias("stats_reset_at"),
            (F.floor(F.col("slot") / 80).cast("long") * 80 * SLOT).alias("postmaster_start_at")))

    def cluster_snapshots(self) -> DataFrame:
        """Two runs over every cluster, databases seconds apart; the second run misses every fourth, the third follows on at once."""
        k = F.col("target_id") - INSTANCE_BASE
        late = F.when(F.col("i") == 0, 0).when(F.col("i") == 1, 7200).otherwise(7200 + 200)
        rows = self.targets().select("target_id", "cluster_id", "database", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
        return rows.where((F.col("i") != 1) | (k % 4 != 0)).select(
            "target_id", "cluster_id", "database", (late + F.col("cluster_id") * 7 + k % 50).cast("long").alias("collected_at"))

    def _triples(self) -> DataFrame:
        """Three snapshots, ten minutes apart, for each six-hourly slot with events."""
        slot = F.floor(F.col("at") / SLOT).cast("long")
        rows = self._events().select("target_id", slot.alias("slot"), "k", cents("value").alias("c"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("i"))
        return rows.select("*", (3 * F.col("slot") + F.col("i")).alias("snapshot_id"), (F.col("slot") * SLOT + 600 * F.col("i")).alias("collected_at"))

    def close_counters(self) -> DataFrame:
        """Counters read in triples; they are reset after the first of every third triple, restarts come after the second of every twelfth."""
        reset = (F.floor((F.col("collected_at") - 300) / (3 * SLOT)) * (3 * SLOT) + 300).cast("long")
        started = (F.floor((F.col("collected_at") - 900) / (12 * SLOT)) * (12 * SLOT) + 900).cast("long")
        g = self._triples().groupBy("target_id", "snapshot_id", "collected_at").agg(F.count("*").alias("numbackends"))
        return g.withColumns({"stats_reset_at": reset, "postmaster_start_at": started})

    def close_statements(self) -> DataFrame:
        """Statements of the same snapshots; each is slow at the last of a triple."""
        g = self._triples().groupBy("target_id", "snapshot_id", "collected_at", "i", (F.col("k") % 3).alias("queryid")).agg(F.count("*").alias("n"), F.max(F.col("c") % 30).alias("c"))
        calls = (F.col("i") + 1) * F.col("n")
        return g.select("target_id", "snapshot_id", "collected_at", "queryid", calls.alias("calls"), (calls * 1000 * F.when(F.col("i") == 2, 10 + F.col("c")).otherwise(4)).alias("total_us"))

    def ash(self) -> DataFrame:
        t, m = F.col("event_type"), F.col("user_id") % 5
        busy = t.isin("error", "signup")
        kind = (F.when(t == "click", F.lit(None).cast("string"))
                .when((m == 0) & (busy | (t == "view")), "IO").when((m == 1) & busy, "LWLock")
                .when((m == 2) & busy, "Lock").when(t == "view", "IO").when(t == "purchase", "Client")
                .when(t == "signup", "LWLock").otherwise("Lock"))
        event = (F.when(t == "click", F.lit(None).cast("string"))
                 .when((m == 1) & busy, "BufferMapping").otherwise(t))
        return self._events().select(
            "target_id", F.floor(F.col("at") / 604_800).cast("long").alias("window_id"), F.col("at").alias("sample_at"),
            F.col("event_id").alias("pid"), (F.col("k") % 5 + 1).alias("query_id"),
            kind.alias("wait_event_type"), event.alias("wait_event"))

    def activity(self) -> DataFrame:
        t = F.col("event_type")
        return self._events().select(
            "target_id", F.floor(F.col("at") / DAY).cast("long").alias("snapshot_id"), F.col("event_id").alias("pid"),
            F.when(t.isin("click", "error"), "active").when(t == "view", "idle")
            .when(t == "purchase", "idle in transaction").otherwise("idle in transaction (aborted)").alias("state"),
            F.when(t == "error", "Lock").when(t.isin("view", "purchase"), "Client").otherwise("").alias("wait_event_type"),
            F.when(F.col("k") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("app"), (F.col("k") % 6).cast("string"))).alias("app_name"),
            F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("username"),
            # Autovacuum workers run thirty times longer, so that some pass an hour.
            (3 * F.floor("value") * F.when(F.col("event_id") % 20 == 0, 30).otherwise(1)).cast("long").alias("xact_age_s"),
            F.floor("value").cast("long").alias("query_age_s"),
            F.when(F.col("event_id") % 20 == 0, "autovacuum worker").otherwise("client backend").alias("backend_type"))

    def session_params(self) -> DataFrame:
        """The settings session rules read, for the targets of the activity tables."""
        return self._events().groupBy("target_id").agg(F.count("*").alias("n")).select(
            "target_id", F.lit("autovacuum_max_workers").alias("name"), (F.col("target_id") % 3 + 1).cast("string").alias("value"))

    def lock_waits(self) -> DataFrame:
        e = F.col("event_id")
        return self._events().where((F.col("event_type") == "error") & (F.col("value") > 80)).select(
            "target_id", F.floor(F.col("at") / DAY).cast("long").alias("snapshot_id"), e.alias("blocked_pid"),
            F.array(e % 97, e % 89).alias("blocking_pids"), F.floor("value").cast("long").alias("wait_s"))

    # --- statements, tables, indexes ----------------------------------------

    def statements(self) -> DataFrame:
        l = self.raw("lineitem").select(
            (F.col("l_suppkey") % 25).cast("long").alias("target_id"), F.year("l_shipdate").cast("long").alias("snapshot_id"),
            (F.col("l_partkey") % 40).cast("long").alias("queryid"), "l_partkey", cents("l_extendedprice").alias("c"),
            F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("ln"))
        slow = F.when((F.col("snapshot_id") % 3 == 1) & (F.col("l_partkey") % 3 == 1), 40).otherwise(1)
        g = l.groupBy("target_id", "snapshot_id", "queryid").agg(
            F.count("*").alias("calls"), F.sum(F.col("c") * slow).alias("total_us"), F.sum("q").alias("rows"),
            F.sum("ln").alias("blks_hit"))
        # Cumulative over calendar years: a handful of rows per statement.
        w = (Window.partitionBy("target_id", "queryid").orderBy("snapshot_id")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        run = {c: F.sum(c).over(w).alias(c) for c in ("calls", "total_us", "rows", "blks_hit")}
        q = F.col("queryid")
        text = (F.when(q % 10 == 0, F.concat(F.lit("SET work_mem = "), q.cast("string")))
                .when(q % 10 == 1, F.lit("  begin")).when(q % 10 == 2, F.lit("SELECT * FROM pg_stat_statements"))
                .when(q % 10 == 3, F.concat(F.lit("UPDATE t"), q.cast("string"), F.lit(" SET a = $1")))
                .otherwise(F.concat(F.lit("SELECT a FROM t"), q.cast("string"), F.lit(" WHERE b = $1 AND c > 10"))))
        return (g.select("target_id", "snapshot_id", "queryid", *run.values())
                .withColumn("blks_read", F.col("calls")).withColumn("query", text)
                .withColumn("collected_at", (F.col("snapshot_id") - 1970) * 365 * DAY))

    def table_stats(self) -> DataFrame:
        o = self.raw("orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("snapshot_id"),
                                      "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("prio"),
                                      cents("o_totalprice").alias("c"))
        c = self.raw("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("target_id"))
        j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        k = F.col("c_custkey")
        g = j.groupBy("target_id", "snapshot_id", F.concat(F.lit("t"), (k % 6).cast("string")).alias("table")).agg(
            F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.sum("c").alias("total_bytes"),
            F.sum(F.when(F.col("prio") == "1", 900).otherwise(100)).alias("seq_scans"),
            F.sum(F.when(k % 2 == 0, 60).otherwise(300)).alias("index_scans"), F.sum(k % 2000).alias("mods_since_analyze"),
            F.sum(F.when(F.col("prio") == "5", 2500).otherwise(800)).alias("hot_updates"), F.max(k).alias("mk"))
        mk, at = F.col("mk"), (F.col("snapshot_id") - 1970) * 365 * DAY
        null_l, null_d = F.lit(None).cast("long"), F.lit(None).cast("double")
        return g.select(
            "target_id", "snapshot_id", at.alias("collected_at"), F.lit("public").alias("schema"), "table",
            "total_bytes", (4000 * F.col("n")).alias("live_tuples"), (3000 * F.col("p")).alias("dead_tuples"),
            "seq_scans", "index_scans", "mods_since_analyze", (2500 * F.col("n")).alias("updates"), "hot_updates",
            F.when(mk % 2 != 0, at - 3600).otherwise(null_l).alias("last_vacuum"),
            F.when(mk % 3 != 0, at - 7200).otherwise(null_l).alias("last_autovacuum"),
            F.when(mk % 4 != 0, at - 3600).otherwise(null_l).alias("last_analyze"),
            F.when((mk % 4 != 0) & (mk % 5 == 0), at - 1800).otherwise(null_l).alias("last_autoanalyze"),
            F.when(mk % 41 == 0, "off").otherwise(F.lit(None).cast("string")).alias("rel_autovacuum_enabled"),
            F.when(mk % 10 == 1, F.lit(0.05)).otherwise(null_d).alias("rel_vacuum_scale"),
            F.when(mk % 11 == 1, F.lit(500.0)).otherwise(null_d).alias("rel_vacuum_threshold"),
            F.when(mk % 12 == 1, F.lit(0.02)).otherwise(null_d).alias("rel_analyze_scale"),
            F.when(mk % 13 == 1, F.lit(5000.0)).otherwise(null_d).alias("rel_analyze_threshold"))

    def index_table_stats(self) -> DataFrame:
        """Table statistics at the snapshot of the index tables: each table's newest reading."""
        return (self.table_stats().groupBy("target_id", "schema", "table")
                .agg(F.max_by("mods_since_analyze", "snapshot_id").alias("mods_since_analyze"))
                .withColumn("snapshot_id", F.lit(1).cast("long")))

    def indexes(self) -> DataFrame:
        k = F.col("p_partkey")
        full = F.array((1 + k % 2), (1 + F.floor(k / 7) % 3), (1 + F.floor(k / 3) % 4))
        keys = F.slice(full, F.lit(1), (1 + k % 3).cast("int"))
        names = F.array(*[F.lit(n) for n in ("customerId", "status_code", "createdAt", "HTTPStatus")])
        return self.raw("part").select(
            (F.col("p_size") % 25).cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"),
            F.lit("public").alias("schema"), F.concat(F.lit("t"), (k % 4).cast("string")).alias("table"),
            F.concat(F.lit("ix"), k.cast("string")).alias("index"), k.alias("indexrelid"),
            F.when(k % 11 == 0, "gin").otherwise("btree").alias("method"),
            keys.cast("array<long>").alias("indkey"), F.transform(keys, lambda x: (x * 10).cast("long")).alias("indclass"),
            F.transform(keys, lambda x: F.element_at(names, x.cast("int"))).alias("columns"),
            (k % 17 == 0).alias("is_primary"), (k % 13 == 0).alias("is_unique"), F.lit(False).alias("is_exclusion"),
            (k % 37 == 0).alias("is_replident"), (k % 19 == 0).alias("is_partial"), (k % 23 == 0).alias("is_expression"),
            ((k % 17 == 0) | (k % 13 == 0)).alias("backs_constraint"),
            (k % 29 == 0).alias("is_invalid"), (k % 2 == 0).alias("is_ready"), (k % 31 != 0).alias("is_live"),
            F.when(k % 3 == 0, F.lit(0)).otherwise(k % 1000).cast("long").alias("scans"),
            ((k % 50) * 40_000 + 10_000).alias("bytes"))

    def foreign_keys(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.col("s_nationkey").cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"),
            F.lit("public").alias("schema"), F.concat(F.lit("t"), (k % 4).cast("string")).alias("table"),
            F.concat(F.lit("fk"), k.cast("string")).alias("constraint"),
            F.slice(F.array(1 + k % 3, 1 + k % 2), F.lit(1), (1 + k % 2).cast("int")).cast("array<long>").alias("conkey"),
            (F.abs(cents("s_acctbal")) * 10_000).alias("child_bytes"))

    def _regions(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("target_id"))

    def partition_edges(self) -> DataFrame:
        """Customers below nations, even nations below their region; one target per region."""
        one = F.lit(1).cast("long").alias("snapshot_id")
        nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
        leaf = self.raw("customer").join(self._regions(), "c_nationkey").select(
            "target_id", one, F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), nation.alias("parent"))
        inner = self._regions().where(F.col("c_nationkey") % 2 == 0).select(
            "target_id", one, nation.alias("child"), F.concat(F.lit("r"), F.col("target_id").cast("string")).alias("parent"))
        return leaf.unionByName(inner)

    def partition_leaves(self) -> DataFrame:
        b, k = F.abs(cents("c_acctbal")), F.col("c_custkey")
        return self.raw("customer").join(self._regions(), "c_nationkey").select(
            "target_id", F.lit(1).cast("long").alias("snapshot_id"),
            F.concat(F.lit("c"), k.cast("string")).alias("child"), (b * 1000).alias("total_bytes"),
            (k % 500 * 10).alias("live_tuples"), (k % 97).alias("seq_scans"), (k % 89).alias("index_scans"))

    def schema_objects(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("snapshot_id")
        kinds = F.array(*[F.lit(x) for x in ("index", "table", "column", "constraint")])
        base = self.raw("part").select("p_partkey", "p_brand", "p_type", "p_size",
                                       F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("snapshot_id"))
        return base.where((k * s) % 7 != 3).select(
            (F.col("p_size") % 25).cast("long").alias("target_id"), "snapshot_id", (s * DAY).alias("collected_at"),
            F.element_at(kinds, (k % 4 + 1).cast("int")).alias("kind"),
            F.concat(F.lit("public."), F.col("p_brand"), F.lit(".o"), k.cast("string")).alias("identity"),
            F.concat(F.col("p_type"), F.when((k + s) % 9 == 0, " v2").otherwise("")).alias("definition"),
            ((k % 29 == 0) & (k % 4 == 0)).alias("invalid"), (k % 8 != 0).alias("ready"), (k % 31 != 0).alias("live"),
            F.when((k % 29 == 0) & (k % 4 == 0), (k % 50) * 40_000).otherwise(F.lit(0)).cast("long").alias("bytes"))

    def sequences(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            (F.col("p_size") % 25).cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"),
            F.lit("public").alias("schema"), F.concat(F.lit("sq"), k.cast("string")).alias("name"),
            F.concat(F.lit("t"), (k % 4).cast("string"), F.lit(".id")).alias("owned_by"),
            F.when(k % 3 == 0, "int2").when(k % 3 == 1, "int4").otherwise("int8").alias("type"),
            F.when(k % 53 == 0, F.lit(None).cast("long"))
            .when(k % 3 == 0, (37 * k) % 32767).when(k % 3 == 1, (1_048_573 * k) % 2_147_483_647)
            .otherwise(1_000_003 * k).alias("last_value"),
            F.lit(9_223_372_036_854_775_807).cast("long").alias("max_value"))

    def narrow_columns(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            (F.col("p_size") % 25).cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"),
            F.lit("public").alias("schema"), F.concat(F.lit("t"), (k % 400).cast("string")).alias("table"),
            F.concat(F.lit("c"), k.cast("string")).alias("column"),
            F.when((k % 4 == 0) & (F.col("p_size") % 25 < 5), "int2").when(k % 4 == 1, "int4").otherwise("int8").alias("type"),
            (k % 6 == 0).alias("is_identity"), (k % 5 == 0).alias("owns_sequence"))

    # --- replication, horizon, integrity ------------------------------------

    def slots(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.col("s_nationkey").cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"),
            F.concat(F.lit("slot"), k.cast("string")).alias("name"), F.lit("logical").alias("type"),
            (k % 2 == 0).alias("active"), (F.abs(cents("s_acctbal")) * 10_000).alias("retained_bytes"),
            F.when(k % 17 == 0, "lost").otherwise("extended").alias("wal_status"))

    def replicas(self) -> DataFrame:
        k, s = F.col("s_suppkey"), F.col("snapshot_id")
        base = self.raw("supplier").withColumn("snapshot_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])))
        lag_cents = F.abs(cents("s_acctbal"))
        return base.where((k * s) % 5 != 2).select(
            F.col("s_nationkey").cast("long").alias("target_id"), "snapshot_id", (s * DAY).alias("collected_at"),
            F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("standby"), k.cast("string"))).alias("app_name"),
            F.concat(F.lit("10.0.0."), k.cast("string")).alias("client_addr"),
            F.when(k % 3 == 0, "sync").when(k % 3 == 1, "quorum").otherwise("async").alias("sync_state"),
            F.when(k % 8 != 0, lag_cents / F.lit(2000.0)).alias("replay_lag_sec"),
            F.when(F.col("s_nationkey") % 4 != 0, F.lit(1.0)).alias("wal_bytes_per_sec"))

    def subscriptions(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.col("s_nationkey").cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"),
            F.concat(F.lit("sub"), k.cast("string")).alias("name"), (k % 4 != 0).alias("worker_running"))

    def horizon(self) -> DataFrame:
        k, b = F.col("s_suppkey"), F.abs(cents("s_acctbal"))
        kinds = F.array(*[F.lit(x) for x in ("backend", "replication_slot", "standby_feedback", "prepared_xact")])
        return self.raw("supplier").select(
            F.col("s_nationkey").cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"),
            F.element_at(kinds, (k % 4 + 1).cast("int")).alias("source"), F.concat(F.lit("h"), k.cast("string")).alias("holder"),
            (b * 2000).alias("xmin_age"), F.when(k % 4 == 3, F.floor(b / 100)).otherwise(F.lit(0)).cast("long").alias("age_s"),
            F.lit("").alias("detail"))

    def checksum_failures(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").where(k % 60 == 0).select(
            F.col("c_nationkey").cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"),
            F.when(k % 120 != 0, F.col("c_name")).alias("database"), (k % 7).alias("failures"))

    def progress(self) -> DataFrame:
        k = F.col("s_suppkey")
        ops = F.array(*[F.lit(x) for x in ("vacuum", "create_index", "cluster", "analyze", "basebackup", "copy")])
        return self.raw("supplier").select(
            F.col("s_nationkey").cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"), k.alias("pid"),
            F.element_at(ops, (k % 6 + 1).cast("int")).alias("operation"), F.concat(F.lit("public.t"), (k % 4).cast("string")).alias("relation"),
            F.lit("scanning").alias("phase"), (k % 50).alias("done"), ((k % 5) * 25).alias("total"))

    # --- counters of WAL and checkpoints, history ----------------------------

    def wal_io(self) -> DataFrame:
        g = (self.raw("lineitem").select(
            (F.col("l_suppkey") % 25).cast("long").alias("target_id"), F.year("l_shipdate").cast("long").alias("snapshot_id"),
            cents("l_extendedprice").alias("c"), F.col("l_returnflag").alias("f"))
            .groupBy("target_id", "snapshot_id").agg(
                F.sum("c").alias("wal_bytes"), F.count("*").alias("wal_records"),
                F.count_if(F.col("f") == "A").alias("checkpoints_req"), F.count_if(F.col("f") != "A").alias("checkpoints_timed"),
                F.sum(F.when(F.col("f") == "R", 3).otherwise(1)).alias("buffers_written")))
        w = (Window.partitionBy("target_id").orderBy("snapshot_id")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        run = [F.sum(c).over(w).alias(c) for c in ("wal_bytes", "wal_records", "checkpoints_req", "checkpoints_timed", "buffers_written")]
        return g.select("target_id", "snapshot_id", ((F.col("snapshot_id") - 1970) * 365 * DAY).alias("collected_at"), *run)

    def snapshots(self) -> DataFrame:
        """The snapshot log: one row per event, with a document size."""
        return self._events().select(
            F.col("event_id").alias("snapshot_id"), "target_id", F.col("at").alias("collected_at"),
            (F.length(F.col("event_type")) * 100 + F.col("k")).cast("long").alias("doc_bytes"))

    def hourly(self) -> DataFrame:
        """Distinct (target, hour) snapshots."""
        return (self._events().select("target_id", (F.floor(F.col("at") / 3600).cast("long") * 3600).alias("collected_at"), "k")
                .groupBy("target_id", "collected_at").agg(F.max("k").alias("k")))

    def rule_runs(self) -> DataFrame:
        return (self._events().select("target_id", F.col("event_type").alias("rule"),
                                      F.floor(F.col("at") / DAY).cast("long").alias("run"), "value")
                .groupBy("target_id", "rule", "run").agg((F.max("value") > 120).alias("matched")))

    def sql_text(self) -> DataFrame:
        t = F.col("text")
        return self.raw("documents").select("doc_id", F.concat(
            F.lit("SELECT * FROM t WHERE a = $1 AND b = '"), t, F.lit("' AND n = "), F.col("doc_id").cast("string"),
            F.lit(".5 "), t).alias("query"))


class StreamBed(Testbed):
    """The same mappings over file streams, for the row-wise ones (sessions, samples)."""

    def raw(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        # A pattern, so that a table may be one file or a folder of files.
        return self.spark.readStream.schema(schema).parquet(path[:-1] + "[t]")
