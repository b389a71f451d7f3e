"""Findings and facts as tables other tools read: metrics, scan results, test cases, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import severity_rank
from vitalgrid.functions.text import metric_label
from vitalgrid.operators.fleet import findings_total
from vitalgrid.plans.rule_catalog import GUARDS, rule_catalog

SNAP = ["target_id", "snapshot_id"]

# Metric families in output order, with their help texts; result levels and scores.
FAMILIES = {
    "fleet_finding": "One series per finding.",
    "fleet_findings_total": "Active findings by severity.",
    "fleet_cache_hit_ratio": "Buffer cache hit ratio.",
    "fleet_rollback_ratio": "Transaction rollback ratio.",
    "fleet_tps": "Transactions per second.",
    "fleet_xid_age": "Oldest transaction id age.",
    "fleet_mxid_age": "Oldest multixact id age.",
    "fleet_connections_used": "Connections in use.",
    "fleet_connections_max": "Connection limit.",
    "fleet_wal_dir_bytes": "Size of the log directory.",
    "fleet_replica_lag_seconds": "Replay lag per replica.",
}
GAUGES = {"fleet_cache_hit_ratio": "cache_hit_ratio", "fleet_rollback_ratio": "rollback_ratio", "fleet_tps": "tps", "fleet_xid_age": "max_xid_age",
          "fleet_mxid_age": "max_mxid_age", "fleet_connections_used": "connections_used", "fleet_connections_max": "connections_max",
          "fleet_wal_dir_bytes": "wal_dir_bytes"}
LEVELS = {"critical": ("error", 9.0), "warn": ("warning", 5.5), "info": ("note", 2.0)}


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _bool(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def _labels(**pairs: Column) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit(k + '="'), metric_label(v), F.lit('"')) for k, v in pairs.items()])


def metric_rows(findings: DataFrame, facts: DataFrame, replicas: DataFrame | None = None) -> DataFrame:
    """Long-form metrics: (family, labels, value) per target and snapshot. Unknown gauges are left out."""
    t = F.col("target_id").cast("string")
    destructive = F.col("id").isin(*GUARDS)
    one = findings.select(*SNAP, F.lit("fleet_finding").alias("family"), _labels(
        target=t, id=F.col("id"), severity=F.col("severity"), dimension=F.col("dimension"), object=F.col("object"),
        suppressed=_bool(_flag(findings, "suppressed")), preexisting=_bool(_flag(findings, "preexisting")), destructive=_bool(destructive)).alias("labels"),
        F.lit(1.0).alias("value"))
    totals = findings_total(findings)
    per = totals.select(*SNAP, F.lit("fleet_findings_total").alias("family"), F.stack(
        F.lit(3), *[x for s in ("critical", "warn", "info") for x in (F.lit(s), F.col(s).cast("double"))]).alias("sev", "value"))
    per = per.select(*SNAP, "family", _labels(target=t, severity=F.col("sev")).alias("labels"), "value")
    present = {f: c for f, c in GAUGES.items() if c in facts.columns}
    gauges = facts.select(*SNAP, F.stack(F.lit(len(present)), *[x for f, c in present.items() for x in (F.lit(f), F.col(c).cast("double"))]).alias("family", "value"))
    gauges = gauges.where(F.col("value").isNotNull()).select(*SNAP, "family", _labels(target=t).alias("labels"), "value")
    parts = [one, per, gauges]
    if replicas is not None:
        name = F.when(F.coalesce("app_name", F.lit("")) != "", F.col("app_name")).otherwise(F.col("client_addr"))
        parts.append(replicas.where(F.col("replay_lag_sec").isNotNull()).select(
            *SNAP, F.lit("fleet_replica_lag_seconds").alias("family"), _labels(target=t, replica=name).alias("labels"), F.col("replay_lag_sec").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def metric_text(metrics: DataFrame) -> DataFrame:
    """Exposition lines: a header once per family that has samples, families in fixed order.

    Sorted by range partitions, so the text can be written by many tasks in order.
    """
    order = F.create_map(*[x for i, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(i))])
    help_ = F.create_map(*[x for f, h in FAMILIES.items() for x in (F.lit(f), F.lit(h))])
    fam = F.col("family")
    lines = metrics.select(order[fam].alias("o"), F.lit(2).alias("k"), F.format_string("%s{%s} %s", fam, F.col("labels"), F.col("value").cast("string")).alias("line"))
    heads = metrics.select("family").distinct()
    heads = heads.select(order[fam].alias("o"), F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("# HELP "), fam, F.lit(" "), help_[fam]).alias("line")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("# TYPE "), fam, F.lit(" gauge")).alias("line")))).alias("h")).select("o", "h.k", "h.line")
    return heads.unionByName(lines).orderBy("o", "k", "line").select("line")


def _message(df: DataFrame) -> DataFrame:
    """Attach title - advice and the guards of the finding, those of its state where it is a full record."""
    cat = rule_catalog(df.sparkSession).select("id", "advice", F.col("guards").alias("_guards"))
    j = df.join(F.broadcast(cat), "id")
    guards = F.col("safety") if "safety" in df.columns else F.col("_guards")
    text_of = F.array_join(F.transform(guards, lambda g: F.concat_ws(" ", g["action"], g["kind"], g["text"])), " ")
    text = F.trim(F.concat(F.col("title"), F.lit(" - "), F.col("advice"), F.when(text_of != "", F.concat(F.lit(" SAFETY: "), text_of)).otherwise("")))
    return j.withColumn("message", text).drop("_guards")


def scan_results(findings: DataFrame) -> DataFrame:
    """Result rows for code-scanning uploads; findings already in the base are left out."""
    level = F.create_map(*[x for s, (lv, _) in LEVELS.items() for x in (F.lit(s), F.lit(lv))])
    score = F.create_map(*[x for s, (_, sc) in LEVELS.items() for x in (F.lit(s), F.lit(sc))])
    f = _message(findings.where(~_flag(findings, "preexisting")))
    sup = _flag(f, "suppressed")
    reason = F.nullif(F.col("suppression_reason"), F.lit("")) if "suppression_reason" in f.columns else F.lit(None).cast("string")
    return f.select(*SNAP, F.col("id").alias("rule_id"), level[F.col("severity")].alias("level"), score[F.col("severity")].alias("score"),
                    F.when(F.col("object") == "", "cluster").otherwise(F.col("object")).alias("location"), "message",
                    F.when(sup, F.coalesce(reason, F.lit("suppressed by configuration"))).alias("suppression"))


def scan_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules of the results, with dimension and score of their first severity."""
    f = findings.where(~_flag(findings, "preexisting"))
    g = f.groupBy(F.col("id").alias("rule_id")).agg(F.max(severity_rank("severity")).alias("rank"), F.min("dimension").alias("dimension"))
    return g.select("rule_id", "dimension", F.when(F.col("rank") == 3, 9.0).when(F.col("rank") == 2, 5.5).otherwise(2.0).alias("score"))


def test_cases(findings: DataFrame, fail_on: str = "warn") -> DataFrame:
    """One test case per finding: skipped when suppressed, failed at or above the threshold."""
    floor = {"critical": 3, "warn": 2, "info": 1, "none": 99}[fail_on]
    name = F.when(F.col("object") == "", F.col("id")).otherwise(F.concat_ws(" ", "id", "object"))
    status = (F.when(_flag(findings, "suppressed"), "skipped").when(_flag(findings, "preexisting"), "passed")
              .when(severity_rank("severity") >= floor, "failed").otherwise("passed"))
    return findings.select(*SNAP, name.alias("name"), F.col("dimension").alias("class"), status.alias("status"), "title")


def test_suites(cases: DataFrame) -> DataFrame:
    return cases.groupBy(*SNAP).agg(F.count("*").alias("tests"), F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "skipped").alias("skipped"))


def finding_documents(findings: DataFrame, rows: DataFrame, *, evidence: int = 10, part_size: int = 500) -> DataFrame:
    """Numbered findings nested per snapshot, each with its first ``evidence`` entries.

    The full evidence is the row table; a document only previews it. A snapshot with more
    than ``part_size`` findings becomes several parts, so no array grows without bound.
    """
    from vitalgrid.operators.series import top_k

    key = [*SNAP, "id"]
    first = top_k(rows, key, [F.col("position").desc(), F.col("object"), F.col("evidence")], evidence, "_r")
    ev = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    entry = F.struct("ordinal", "id", "object", "severity", "title", "n_objects", "evidence", "confidence", F.struct("score", "dimension").alias("impact"), "caveats")
    part = F.floor((F.col("ordinal") - 1) / part_size).cast("long")
    return findings.join(ev, key, "left").groupBy(*SNAP, part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("findings"))
