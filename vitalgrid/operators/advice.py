"""Index candidates from stored query plans, and their validation from stored plan pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.text import index_ddl, plain_select
from vitalgrid.operators.series import top_k

# Identifiers the filter patterns can catch by mistake, schemas never advised on, gates.
EQUALITY = r"([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\$\d+"
RANGE = r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:<|>|<=|>=)\s*\$\d+"
KEYWORDS = ("and", "or", "not", "null", "true", "false", "is", "in", "any", "all")
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
MAX_COLUMNS = 4
MIN_IMPROVEMENT = 0.5
CONFIDENCE = 0.6

#: The fields of a plan node that are read, and their names as columns.
_FIELDS = {"node_type": ("Node Type", "string"), "relation": ("Relation Name", "string"), "schema": ("Schema", "string"), "filter": ("Filter", "string"),
           "index_name": ("Index Name", "string"), "total_cost": ("Total Cost", "double")}
DEEPEST = 100_000


def plan_nodes(plans: DataFrame, document: str) -> DataFrame:
    """One row per plan node, with ``is_root``, at any depth.

    The tree is walked level by level by one recursive query over VARIANT values; a level's nodes are spread like any other
    rows. Documents that are no plan give no rows.
    """
    keep = [c for c in plans.columns if c != document]
    kept = ", ".join(f"`{c}`" for c in keep)
    first = lambda x: f"{x}, " if x else ""
    fields = ", ".join(f"try_variant_get(node, \"$['{name}']\", '{kind}') AS {column}" for column, (name, kind) in _FIELDS.items())
    return plans.sparkSession.sql(f"""
        WITH RECURSIVE walk({first(kept)}depth, node) MAX RECURSION LEVEL {DEEPEST} AS (
            SELECT {first(kept)}0, try_variant_get(try_parse_json(`{document}`), '$[0].Plan', 'variant') FROM {{plans}}
            UNION ALL
            SELECT {first(", ".join(f"walk.`{c}`" for c in keep))}depth + 1, below.value
            FROM walk, LATERAL variant_explode(variant_get(node, '$.Plans', 'variant')) AS below)
        SELECT {first(kept)}depth = 0 AS is_root, {fields} FROM walk WHERE node IS NOT NULL LIMIT ALL""", plans=plans)


def filter_columns(text: Column | str) -> Column:
    """Bare columns compared with a parameter: equality first, then ranges, at most four."""
    t = F.col(text) if isinstance(text, str) else text
    every = F.concat(F.regexp_extract_all(t, F.lit(EQUALITY), F.lit(1)), F.regexp_extract_all(t, F.lit(RANGE), F.lit(1)))
    return F.slice(F.array_distinct(F.filter(every, lambda x: ~F.lower(x).isin(*KEYWORDS))), 1, MAX_COLUMNS)


def plan_candidates(plans: DataFrame, document: str = "plan", *, keys: tuple[str, ...] = ("target_id", "queryid")) -> DataFrame:
    """Distinct (table, columns) candidates from every parameterised sequential scan."""
    n = plan_nodes(plans.select(*keys, document), document)
    seq = n.where((F.col("node_type") == "Seq Scan") & (F.coalesce("relation", F.lit("")) != "") & (F.coalesce("filter", F.lit("")) != ""))
    schema = F.when(F.coalesce("schema", F.lit("")) == "", "public").otherwise(F.col("schema"))
    cand = seq.select(*keys, schema.alias("schema"), F.col("relation").alias("table"), filter_columns("filter").alias("columns"))
    return cand.where((F.size("columns") > 0) & ~F.col("schema").isin(*SYSTEM_SCHEMAS)).distinct()


def top_selects(statements: DataFrame, k: int = 15) -> DataFrame:
    """Slowest plain SELECTs per snapshot and their share of all SELECT time."""
    sel = statements.where(F.col("queryid").isNotNull() & (F.col("calls") > 0) & F.col("query").rlike(r"(?i)^\s*select(?![A-Za-z0-9_])"))
    snap = ["target_id", "snapshot_id"]
    total = sel.groupBy(*snap).agg(F.sum("total_us").alias("select_us"))
    top = top_k(sel, snap, [F.col("total_us").desc(), F.col("queryid")], k)
    return top.join(total, snap).withColumn("share_pct", F.try_divide(F.col("total_us").cast("double") * 100, F.col("select_us").cast("double")))


def plan_pairs(pairs: DataFrame) -> DataFrame:
    """Root costs of both plans and whether the second uses the named index.

    ``pairs``: target_id, queryid, schema, table, columns, index_name, plan_before, plan_after.
    """
    key = ["target_id", "queryid", "wanted"]
    p = pairs.withColumnRenamed("index_name", "wanted")
    before = plan_nodes(p.select(*key, "plan_before"), "plan_before").where("is_root").groupBy(*key).agg(F.max("total_cost").alias("cost_before"))
    after = plan_nodes(p.select(*key, "plan_after"), "plan_after").groupBy(*key).agg(
        F.max(F.when(F.col("is_root"), F.col("total_cost"))).alias("cost_after"),
        F.max(F.coalesce(F.col("index_name") == F.col("wanted"), F.lit(False))).alias("used"))
    return p.drop("plan_before", "plan_after").dropDuplicates(key).join(before, key).join(after, key).withColumnRenamed("wanted", "index_name")


def validate_candidates(pairs: DataFrame, min_improvement: float = MIN_IMPROVEMENT) -> DataFrame:
    """Candidates whose plan picks the index and gets cheaper by the required share."""
    p = plan_pairs(pairs)
    good = (F.col("cost_before") > 0) & F.col("used") & (F.col("cost_after") < F.col("cost_before") * (1 - min_improvement))
    return p.where(good).withColumn("improvement_pct", (F.col("cost_before") - F.col("cost_after")) / F.col("cost_before") * 100)


def advice_guards(candidates: DataFrame, table_stats: DataFrame) -> DataFrame:
    """Leave out tables with stale statistics; mark the write-heavy ones.

    ``table_stats`` has one row per (target, schema, table) with analyze times, changes and writes.
    """
    keys = ["target_id", "schema", "table"]
    stale = ((F.col("last_analyze").isNull() & F.col("last_autoanalyze").isNull())
             | (F.col("mods_since_analyze").cast("double") > F.lit(0.2) * F.col("live_tuples").cast("double") + 50))
    heavy = table_stats.where(F.col("writes") > 100_000).select(*keys).distinct().withColumn("write_heavy", F.lit(True))
    return (candidates.join(table_stats.where(stale).select(*keys).distinct(), keys, "left_anti")
            .join(heavy, keys, "left").withColumn("write_heavy", F.coalesce("write_heavy", F.lit(False))))


def recommendations(validated: DataFrame) -> DataFrame:
    """One recommendation per candidate index, credited to the statement with the largest share."""
    key = ["target_id", "schema", "table", "cols"]
    v = validated.withColumn("cols", F.array_join("columns", ","))
    best = F.struct("share_pct", (-F.col("queryid")).alias("q"))
    g = v.groupBy(*key).agg(*[F.max_by(x, best).alias(x) for x in ("queryid", "share_pct", "cost_before", "cost_after", "improvement_pct", "columns")])
    return g.withColumn("ddl", index_ddl("schema", "table", "columns")).withColumn("confidence", F.lit(CONFIDENCE)).drop("cols")


def advice_stats(statements: DataFrame, plans: DataFrame, candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """How many statements, plans and candidates were looked at, per target."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("target_id").agg(F.count("*").alias(name))

    considered = statements.groupBy("target_id").agg(F.count("*").alias("considered"), F.count(plain_select("query")).alias("plannable"))
    out = considered
    for df, name in ((plans, "planned"), (candidates, "candidates"), (kept, "tested")):
        out = out.join(count(df, name), "target_id", "left")
    z = lambda n: F.coalesce(n, F.lit(0))
    return out.select("target_id", "considered", "plannable", z("planned").alias("planned"), z("tested").alias("tested"),
                      (z("candidates") - z("tested")).alias("skipped_stale"))
