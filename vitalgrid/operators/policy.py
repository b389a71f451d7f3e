"""Severity overrides, ignore rules, and comparison with a base report.

Rules are applied without multiplying findings by rules: exact rules join on
(id, object), blanket rules on id, and glob rules travel as one sorted array per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import severity_rank
from vitalgrid.functions.text import recount_title
from vitalgrid.plans.rule_catalog import KNOWN_IDS

RULE_SCHEMA = "ordinal long, finding string, object string, reason string, expires string"
SNAP = ["target_id", "snapshot_id"]

# Keys that must never appear in a committed configuration, threshold keys, severities.
CREDENTIAL_KEYS = ("dsn", "conn", "connection_string", "url", "password", "user")
THRESHOLDS = {"unused_index_min_size_mb": (0.0, None), "dead_ratio_warn": (0.0, 1.0), "replica_lag_warn_seconds": (0.0, None)}
SEVERITIES = ("critical", "warn", "info")

INLINE_REASON = "inline ignore"


def ignore_rules(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = [(i, r["finding"], r.get("object") or None, r.get("reason") or "", r.get("expires") or None) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def inline_rules(specs: DataFrame, start: int = 1_000_000) -> DataFrame:
    """``finding[:object]`` texts (ordinal, spec) as rules after the configured ones."""
    s = F.trim("spec")
    at = F.instr(s, ":")
    return specs.where(s != "").select(
        (F.col("ordinal") + start).alias("ordinal"), F.when(at > 0, F.substring_index(s, ":", 1)).otherwise(s).alias("finding"),
        F.nullif(F.when(at > 0, s.substr(at + 1, F.length(s))), F.lit("")).alias("object"),
        F.lit(INLINE_REASON).alias("reason"), F.lit(None).cast("string").alias("expires")).where(F.col("finding") != "")


def rule_text() -> Column:
    return F.when(F.coalesce("object", F.lit("")) == "", F.col("finding")).otherwise(F.concat_ws(":", "finding", "object"))


def expired(now: Column | str) -> Column:
    """A rule lasts through the whole UTC day it names; a malformed date never expires."""
    today = F.to_date(F.lit(now)) if isinstance(now, str) else F.to_date(now)
    return F.coalesce(today > F.expr("try_to_date(expires, 'yyyy-MM-dd')"), F.lit(False))


def glob_regex(pattern: Column | str) -> Column:
    """Shell-style pattern to an anchored regex: ``*`` and ``?`` stop at a slash, ``[...]`` is a class."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    outside = r"(?![^\[]*\])"
    p = F.regexp_replace(p, r"([.+(){}|$])" + outside, r"\\$1")
    p = F.regexp_replace(p, r"(?<![\[\\])\^", r"\\^")
    p = F.regexp_replace(p, r"(?<!\\)\?" + outside, "[^/]")
    p = F.regexp_replace(p, r"(?<!\\)\*" + r"(?![^\[]*\])", "[^/]*")
    return F.concat(F.lit(r"\A(?:"), p, F.lit(r")\z"))


def bad_glob(pattern: Column | str) -> Column:
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    return p.rlike(r"(?<!\\)\[\^?\]?[^\]]*$") | p.rlike(r"(?<!\\)(\\\\)*\\$")


def config_warnings(rules: DataFrame, severities: DataFrame, thresholds: DataFrame) -> DataFrame:
    """What is wrong with a configuration, as rows; nothing here stops a run."""
    def warn(df: DataFrame, kind: str, subject: Column, message: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), subject.alias("subject"), message.alias("message"))

    unknown = ~F.col("finding").isin(*KNOWN_IDS)
    parts = [
        warn(rules.where(F.coalesce("finding", F.lit("")) == ""), "ignore", F.col("ordinal").cast("string"), F.lit("rule names no finding")),
        warn(rules.where(unknown & (F.col("finding") != "")), "ignore", F.col("finding"), F.lit("unknown finding id; the rule will never match")),
        warn(rules.where(bad_glob("object")), "ignore", F.col("object"), F.lit("invalid glob; rule ignored")),
        warn(rules.where(F.col("expires").isNotNull() & F.expr("try_to_date(expires, 'yyyy-MM-dd')").isNull()), "ignore", F.col("expires"),
             F.lit("not a YYYY-MM-DD date; treated as no expiry")),
        warn(severities.where(~F.col("id").isin(*KNOWN_IDS)), "severity", F.col("id"), F.lit("unknown finding id; ignored")),
        warn(severities.where(F.col("id").isin(*KNOWN_IDS) & ~F.col("severity").isin(*SEVERITIES)), "severity", F.col("id"), F.lit("unknown severity; ignored")),
        warn(thresholds.where(~F.col("key").isin(*THRESHOLDS)), "threshold", F.col("key"), F.lit("unknown threshold key")),
        warn(thresholds.where(F.col("key").isin(*THRESHOLDS) & ((F.col("value") < 0) | ((F.col("key") == "dead_ratio_warn")
             & ((F.col("value") <= 0) | (F.col("value") > 1))))), "threshold", F.col("key"), F.lit("value out of range")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def threshold_columns(thresholds: DataFrame) -> DataFrame:
    """Per-target (target_id, key, value) overrides as the columns the rules read. Invalid ones are left out."""
    v = F.col("value")

    def of(key: str, ok: Column, value: Column) -> Column:
        return F.max(F.when((F.col("key") == key) & ok, value))

    return thresholds.groupBy("target_id").agg(
        of("unused_index_min_size_mb", v >= 0, F.floor(v * (1 << 20))).alias("unused_index_min_bytes"),
        of("dead_ratio_warn", (v > 0) & (v <= 1), v).alias("dead_ratio_warn"),
        of("replica_lag_warn_seconds", v >= 0, v).alias("replica_lag_warn_sec"))


def refuse_credentials(keys: list[str]) -> None:
    """A configuration is meant to be committed, so a credential in it is fatal."""
    bad = [k for k in keys if k.rsplit(".", 1)[-1].lower() in CREDENTIAL_KEYS]
    if bad:
        raise ValueError(f"configuration holds a credential-shaped key: {bad[0]}")


def hygiene_warnings(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("expires").isNull()).select(rule_text().alias("rule"), F.lit("has no expiry date").alias("message"))


def usable_rules(rules: DataFrame, now: Column | str) -> DataFrame:
    kept = rules.where((F.col("finding") != "") & ~expired(now))
    return kept.where(F.col("object").isNull() | ~bad_glob("object"))


def literal_prefix(pattern: Column | str) -> Column:
    """A glob's text before its first wildcard, class or escape; what it matches begins with it."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_extract(p, r"\A([^*?\[\\]*)", 1)


def _glob_matches(pairs: DataFrame, globs: DataFrame) -> DataFrame:
    """(id, object, _glob) of the distinct pairs that a glob matches, with the earliest such rule.

    Globs meet objects by equality: an object is laid out in its beginnings of exactly the lengths that globs of its id have, and joined on
    (id, beginning). Only what survives is held against the pattern. No list of globs is gathered anywhere, so ten thousand of
    one id cost each object as many look-ups as their prefixes have lengths.
    """
    keyed = globs.select(F.col("finding").alias("id"), literal_prefix("object").alias("_prefix"), F.col("object").alias("_pattern"), glob_regex("object").alias("_rx"), "ordinal", "rule", "reason")
    lengths = keyed.select("id", F.length("_prefix").alias("_n")).distinct()
    laid = pairs.join(lengths, "id").where(F.length("object") >= F.col("_n")).withColumn("_prefix", F.left("object", F.col("_n")))
    hits = laid.join(keyed, ["id", "_prefix"]).where(F.regexp_like("object", F.col("_rx")))
    return hits.groupBy("id", "object").agg(F.min(F.struct("ordinal", "rule", "reason")).alias("_glob"))


def match_rules(df: DataFrame, rules: DataFrame, now: Column | str, *, blanket: bool = True) -> DataFrame:
    """Add ``match`` (spec, ordinal, rule, reason): the most specific active rule of (id, object).

    Exact beats glob beats blanket; ties go to the earliest rule.
    """
    active = usable_rules(rules, now).withColumn("rule", rule_text())
    picked = F.struct("ordinal", "rule", "reason")
    named = active.where(F.coalesce("object", F.lit("")) != "")
    exact = named.groupBy(F.col("finding").alias("id"), "object").agg(F.min(picked).alias("_exact"))
    globs = named.where(F.col("object").rlike(r"[*?\[\\]"))
    matched = _glob_matches(df.select("id", "object").where(F.col("object") != "").distinct(), globs)
    out = df.join(exact, ["id", "object"], "left").join(matched, ["id", "object"], "left")

    def as_match(src: Column, spec: int) -> Column:
        return F.when(src.isNotNull(), F.struct(F.lit(spec).cast("long").alias("spec"), src["ordinal"].alias("ordinal"), src["rule"].alias("rule"), src["reason"].alias("reason")))

    found = [as_match(F.col("_exact"), 3), as_match(F.col("_glob"), 2)]
    if blanket:
        wide = active.where(F.coalesce("object", F.lit("")) == "").groupBy(F.col("finding").alias("id")).agg(F.min(picked).alias("_wide"))
        out = out.join(wide, "id", "left")
        found.append(as_match(F.col("_wide"), 1))
    return out.withColumn("match", F.coalesce(*found)).drop("_exact", "_glob", "_wide")


def explain_rules(questions: DataFrame, rules: DataFrame, now: Column | str) -> DataFrame:
    """For each (id, object): the winning rule, or the first rule of that id and why it did not win."""
    nearest = rules.groupBy(F.col("finding").alias("id")).agg(
        F.min(F.struct("ordinal", rule_text().alias("rule"), F.coalesce("object", F.lit("")).alias("object"), expired(now).alias("expired"))).alias("near"))
    q = match_rules(questions, rules, now).join(nearest, "id", "left")
    why = (F.when(F.col("match").isNotNull(), "suppressed").when(F.col("near").isNull(), "no rule")
           .when(F.col("near.expired"), "rule has expired")
           .when((F.col("near.object") != "") & (F.col("object") == ""), "rule targets an object")
           .when(F.col("near.object") != "", "glob does not match").otherwise("no match"))
    return q.select("id", "object", why.alias("outcome"), F.coalesce("match.rule", "near.rule").alias("rule"))


def remap_severity(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override severities by id and remember the original. The order is not recomputed."""
    o = overrides.where(F.col("id").isin(*KNOWN_IDS) & F.col("severity").isin(*SEVERITIES)).select("id", F.col("severity").alias("_new"))
    j = findings.join(o, "id", "left")
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("severity"))
    return j.withColumn("severity_remapped", F.when(changed, F.col("severity"))).withColumn(
        "severity", F.coalesce("_new", "severity")).drop("_new")


def apply_ignores(findings: DataFrame, rows: DataFrame, rules: DataFrame, now: Column | str) -> tuple[DataFrame, DataFrame]:
    """Suppressed findings keep their row and gain a reason; aggregates lose only matching rows.

    Returns the findings and the evidence rows, the latter with the rule that muted them.
    """
    key = [*SNAP, "id"]
    named_rows = match_rules(rows.where(F.col("object") != ""), rules, now, blanket=False)
    cut = named_rows.where(F.col("match").isNotNull())
    last = F.struct(-F.col("position"), F.col("object"))
    per = cut.groupBy(*key).agg(F.count("*").alias("cut"), F.max_by("match", last).alias("last_cut"),
                                F.max_by("match.reason", F.when(F.col("match.reason") != "", last)).alias("cut_reason"))
    f = match_rules(findings, rules, now).join(per, key, "left")
    aggregate = F.col("n_objects") > 0
    n_cut = F.when(aggregate & (F.coalesce("match.spec", F.lit(0)) != 1), F.coalesce("cut", F.lit(0))).otherwise(F.lit(0))
    whole = F.when(aggregate, (F.coalesce("match.spec", F.lit(0)) == 1)).otherwise(F.col("match").isNotNull())
    all_cut = aggregate & (n_cut > 0) & (n_cut == F.col("n_objects"))
    partial = aggregate & (n_cut > 0) & ~all_cut
    left = F.col("n_objects") - n_cut
    note = F.concat(n_cut.cast("string"), F.when(n_cut == 1, " entry").otherwise(" entries"), F.lit(" suppressed by "), F.col("last_cut.rule"))
    f = (f.withColumn("_left", left).withColumn("_partial", partial)
         .withColumn("suppressed", whole | all_cut)
         .withColumn("suppression_rule", F.when(whole, F.col("match.rule")).when(all_cut, F.col("last_cut.rule")))
         .withColumn("suppression_reason", F.when(whole, F.col("match.reason")).when(all_cut, F.coalesce("cut_reason", F.lit(""))))
         .withColumn("caveats", F.when(F.col("_partial"), F.array_append("caveats", note)).otherwise(F.col("caveats")))
         .withColumn("title", F.when(F.col("_partial"), recount_title("title", "_left")).otherwise(F.col("title")))
         .withColumn("n_objects", F.when(F.col("_partial"), F.col("_left")).otherwise(F.col("n_objects"))))
    marked = named_rows.withColumn("muted_by", F.col("match.rule")).drop("match").unionByName(
        rows.where(F.col("object") == "").withColumn("muted_by", F.lit(None).cast("string")))
    return f.drop("match", "cut", "last_cut", "cut_reason", "_left", "_partial"), marked


def expired_rule_findings(targets: DataFrame, rules: DataFrame, now: Column | str) -> DataFrame:
    """One finding per expired rule and snapshot; the rule list is configuration-sized."""
    r = rules.where(F.col("expires").isNotNull() & expired(now)).select("ordinal", rule_text().alias("rule"), "expires")
    listed = r.agg(F.array_sort(F.collect_list(F.struct("ordinal", "rule", "expires"))).alias("rules"))  # one row
    title = lambda x: F.concat(F.lit("Suppression of "), x["rule"], F.lit(" expired on "), x["expires"].cast("string"))
    notes = F.transform("rules", lambda x: F.struct(x["rule"].alias("rule"), title(x).alias("title")))
    return targets.select(*SNAP).crossJoin(F.broadcast(listed)).select(*SNAP, F.inline(notes)).select(
        *SNAP, F.lit("suppression_expired").alias("id"), F.lit("info").alias("severity"), F.lit(5.0).alias("score"), F.lit(1.0).alias("confidence"), "rule", "title")


def unused_rule_findings(dead: DataFrame) -> DataFrame:
    """One note per (target, run) about rules that stopped matching."""
    return dead.groupBy("target_id", "run").agg(F.count("*").alias("n_rules")).select(
        "target_id", F.col("run").alias("snapshot_id"), F.lit("suppression_unused").alias("id"), F.lit("info").alias("severity"),
        F.lit(5.0).alias("score"), F.lit(0.7).alias("confidence"), "n_rules")


def seed_rules(findings: DataFrame, today: str) -> DataFrame:
    """One proposed rule per distinct (id, object), lasting 90 days."""
    return findings.select("id", "object").distinct().select(
        "id", "object", F.date_add(F.lit(today).cast("date"), 90).cast("string").alias("expires"))


# --- new versus base ----------------------------------------------------------


def identities(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per finding identity: each named evidence row, or the finding itself."""
    whole = findings.where(F.col("n_objects") == 0).select(*SNAP, "id", "object", F.col("object").alias("entry"), severity_rank("severity").alias("rank"))
    heads = findings.where(F.col("n_objects") > 0).select(*SNAP, "id", "object", severity_rank("severity").alias("rank"))
    listed = rows.where(F.col("object") != "").select(*SNAP, "id", F.col("object").alias("entry")).join(heads, [*SNAP, "id"])
    return whole.unionByName(listed.select(*whole.columns))


def mark_preexisting(head: DataFrame, head_rows: DataFrame, base: DataFrame, base_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """A finding is preexisting when every identity was in the base at the same or a higher severity.

    ``pairs`` maps each head (target, snapshot) to its ``base_snapshot_id``.
    """
    b = (identities(base, base_rows).withColumnRenamed("snapshot_id", "base_snapshot_id")
         .join(pairs.select("target_id", "base_snapshot_id", "snapshot_id"), ["target_id", "base_snapshot_id"])
         .groupBy(*SNAP, "id", "entry").agg(F.max("rank").alias("base_rank")))
    h = identities(head, head_rows).join(b, [*SNAP, "id", "entry"], "left")
    old = F.coalesce(F.col("base_rank") >= F.col("rank"), F.lit(False))
    # Several findings may share (id, object), e.g. unnamed per-statement ones; they share identities too.
    verdict = h.groupBy(*SNAP, "id", "object", "rank").agg(F.bool_and(old).alias("preexisting"))
    return (head.withColumn("rank", severity_rank("severity")).join(verdict, [*SNAP, "id", "object", "rank"], "left").drop("rank"))


def base_problems(base: DataFrame, head: DataFrame) -> DataFrame:
    """Targets whose base report must not be compared: no version, other major version, other profile."""
    major = lambda v: F.substring_index(F.col(v), ".", 1)
    j = head.select("target_id", "schema_version", "profile").join(
        base.select("target_id", F.col("schema_version").alias("base_version"), F.col("profile").alias("base_profile")), "target_id")
    why = (F.when(F.coalesce("base_version", F.lit("")) == "", "base has no schema version")
           .when(major("base_version") != major("schema_version"), "schema versions are incompatible")
           .when(F.coalesce("base_profile", F.lit("")) != F.coalesce("profile", F.lit("")), "profiles differ"))
    return j.withColumn("problem", why).where(F.col("problem").isNotNull()).select("target_id", "problem")
