"""Context documents put together from telemetry tables, in the layout that ``contexts`` reads.

Every table becomes rows of (snapshot, section, rank, JSON text); one union and one grouping nest them. A section holds all entries of
its snapshot, the largest first. A caller may ask for short documents: with ``limit`` a section keeps so many entries and says in
``truncated`` how many there were.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.plans.rules import dead_ratio

SNAP = ["target_id", "snapshot_id"]
c = F.col


def _time(name: str) -> Column:
    return F.timestamp_seconds(name).alias(name)


def _if(df: DataFrame, *names: str) -> list[Column]:
    return [c(n) for n in names if n in df.columns]


def _table_fields(df: DataFrame) -> list[Column]:
    off = [(F.coalesce(c("rel_autovacuum_enabled"), F.lit("")) == "off").alias("autovacuum_disabled")] if "rel_autovacuum_enabled" in df.columns else []
    over = {"rel_vacuum_scale": "vacuum_scale_override", "rel_vacuum_threshold": "vacuum_threshold_override", "rel_analyze_scale": "analyze_scale_override",
            "rel_analyze_threshold": "analyze_threshold_override"}
    times = [_time(n) for n in ("last_analyze", "last_autoanalyze", "last_vacuum", "last_autovacuum") if n in df.columns]
    return [*_if(df, "schema", "table", "total_bytes", "live_tuples", "dead_tuples", "dead_ratio", "seq_scans", "index_scans", "mods_since_analyze", "updates", "hot_updates"),
            *times, *off, *[c(a).alias(b) for a, b in over.items() if a in df.columns]]


#: Table, place in the document, what comes first, fields.
LISTS: dict[str, tuple[str, str, Callable[[DataFrame], list[Column]]]] = {
    "table_stats": ("tables.top", "total_bytes", _table_fields),
    "replicas": ("replication.replicas", "replay_lag_sec", lambda d: [c("client_addr"), c("app_name").alias("application_name"), *_if(d, "state", "sync_state", "replay_lag_sec")]),
    "slots": ("replication.slots", "retained_bytes", lambda d: _if(d, "name", "type", "active", "database", "retained_bytes", "wal_status")),
    "subscriptions": ("replication.subscriptions", "name", lambda d: _if(d, "name", "worker_running")),
    "horizon": ("horizon.holders", "xmin_age", lambda d: _if(d, "source", "holder", "xmin_age", "age_s", "detail")),
    "progress": ("progress.operations", "pid", lambda d: _if(d, "pid", "operation", "relation", "phase", "pct")),
    "checksum_failures": ("checksums.failures", "failures", lambda d: [*_if(d, "database"), c("failures").alias("count")]),
    "sequences": ("sequences.items", "pct_used", lambda d: [*_if(d, "schema"), c("name").alias("sequence"), *_if(d, "last_value", "ceiling", "pct_used", "owned_by")]),
    "narrow_columns": ("sequences.narrow_identity", "table", lambda d: _if(d, "schema", "table", "column", "type")),
    "unused_indexes": ("indexes.unused", "bytes", lambda d: _if(d, "schema", "table", "index", "scans", "bytes", "definition", "columns", "method")),
    "redundant_indexes": ("indexes.redundant", "bytes", lambda d: _if(d, "schema", "table", "index", "covered_by", "bytes")),
    "unindexed_fks": ("indexes.unindexed_fks", "child_bytes", lambda d: _if(d, "schema", "table", "constraint", "columns", "child_bytes")),
}


def _settings(params: DataFrame) -> DataFrame:
    """One JSON map per snapshot, of settings known by name."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))
    one = params.groupBy(*SNAP, "name").agg(F.max("value").alias("value"))
    return one.groupBy(*SNAP).agg(pairs.alias("params")).select(*SNAP, F.lit("settings.params").alias("section"), F.lit(1).alias("rank"), F.lit(1).cast("long").alias("total"), F.to_json("params").alias("body"))


def assemble(heads: DataFrame, tables: dict[str, DataFrame], *, limit: int | None = None, version: str = "1.2.0") -> DataFrame:
    """(target_id, snapshot_id, document): a JSON document per snapshot of ``heads`` (target_id, snapshot_id, collected_at, and ``fingerprint`` if known).

    ``tables`` is named as in ``LISTS``, and ``params``. Sections without rows in a snapshot are absent from its document. Lists are whole
    unless ``limit`` says otherwise.
    """
    parts = []
    for name, df in tables.items():
        if name == "params":
            parts.append(_settings(df))
            continue
        section, first, fields = LISTS[name]
        df = dead_ratio(df) if name == "table_stats" and "dead_ratio" not in df.columns else df
        body = F.to_json(F.struct(*fields(df)))
        rows = df.select(*SNAP, F.lit(section).alias("section"), c(first).alias("_order"), body.alias("body"))
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*SNAP).orderBy(c("_order").desc_nulls_last(), "body")))
        if limit is None:
            counted = ranked.withColumn("total", F.lit(None).cast("long"))
        else:
            counted = ranked.where(c("rank") <= limit).join(df.groupBy(*SNAP).agg(F.count("*").alias("total")), SNAP)
        parts.append(counted.select(*SNAP, "section", "rank", "total", "body"))
    every = reduce(DataFrame.unionByName, parts)
    nested = every.groupBy(*SNAP).agg(F.sort_array(F.collect_list(F.struct("section", "rank", "total", "body"))).alias("_rows"))

    def entries(section: str) -> Column:
        return F.filter("_rows", lambda r: r["section"] == section)

    known = sorted({LISTS[n][0] for n in tables if n in LISTS} | ({"settings.params"} if "params" in tables else set()))
    top: dict[str, list[str]] = {}
    for section in known:
        top.setdefault(section.split(".")[0], []).append(section)
    pieces = []
    for name, sections in top.items():
        inner = []
        for section in sections:
            found = F.array_join(F.transform(entries(section), lambda r: r["body"]), ",")
            value = found if section == "settings.params" else F.concat(F.lit("["), found, F.lit("]"))
            inner.append(F.when(F.size(entries(section)) > 0, F.concat(F.lit(f'"{section.split(".")[1]}":'), value)))
        joined = F.concat_ws(",", *inner)
        pieces.append(F.when(joined != "", F.concat(F.lit(f'"{name}":{{'), joined, F.lit("}"))))
    truncated = F.lit(None).cast("string")
    if limit is not None:
        cut = F.array_distinct(F.transform(F.filter("_rows", lambda r: (r["rank"] == 1) & (r["total"] > limit)), lambda r: F.concat(F.lit('"'), r["section"], F.lit('":'), r["total"].cast("string"))))
        truncated = F.when(F.size(cut) > 0, F.concat(F.lit('"truncated":{'), F.array_join(cut, ","), F.lit("}")))
    own = c("fingerprint") if "fingerprint" in heads.columns else c("target_id").cast("string")
    head = F.to_json(F.struct(F.lit(version).alias("schema_version"), own.alias("fingerprint"), F.timestamp_seconds("collected_at").alias("collected_at")))
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.when(F.concat_ws(",", *pieces) != "", ",").otherwise(""), F.concat_ws(",", *pieces, truncated), F.lit("}"))
    placed = heads.join(nested, SNAP, "left").withColumn("_rows", F.coalesce("_rows", F.array().cast(nested.schema["_rows"].dataType)))
    return placed.select(*SNAP, text.alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON lines, as ``read_contexts(lines=True)`` takes them."""
    documents.select("document").write.mode("append").text(path)
