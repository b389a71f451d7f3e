"""Catalog checks: index containment, foreign keys, partitions, sequences.

Prefix containment is turned into equality: every index is expanded to its own key
prefixes (at most as many as it has columns), so a covering index is found by a hash
join on the prefix and never by comparing all pairs of a table's indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import effective_ceiling, ratio, round_dp
from vitalgrid.operators.series import top_k

SNAP = ["target_id", "snapshot_id"]
TABLE = [*SNAP, "schema", "table"]

UNUSED_FLOOR_BYTES = 16_384


def _key_text(cols: Column) -> Column:
    return F.array_join(F.transform(cols, lambda x: x.cast("string")), " ")


def _index_key(n: Column) -> Column:
    return F.concat_ws("|", _key_text(F.slice(F.col("indkey"), F.lit(1), n)), _key_text(F.slice(F.col("indclass"), F.lit(1), n)))


def constrained() -> Column:
    return F.col("backs_constraint") | F.col("is_primary") | F.col("is_unique") | F.col("is_exclusion")


def redundant_indexes(indexes: DataFrame) -> DataFrame:
    """Every droppable index whose keys lead a wider one, or repeat an older one.

    ``covered_by`` is the oldest covering index; ``wider_covers`` counts the wider ones.
    """
    return _redundant(indexes).drop("method", "prefix")


def _redundant(indexes: DataFrame) -> DataFrame:
    width = F.size("indkey")
    plain = ~F.col("is_partial") & ~F.col("is_expression")
    group = [*TABLE, "method", "prefix"]
    covers = (indexes.where(plain)
              .select(*TABLE, "method", "index", "indexrelid", width.alias("w"), "indkey", "indclass",
                      F.explode(F.sequence(F.lit(1), width)).alias("n"))
              .select(*TABLE, "method", "index", "indexrelid", _index_key(F.col("n")).alias("prefix"),
                      (F.col("n") < F.col("w")).alias("wider"))
              .groupBy(*group).agg(
                  F.count_if("wider").alias("wider_covers"),
                  F.min(F.when(F.col("wider"), F.struct("indexrelid", "index"))).alias("oldest_wider"),
                  F.min(F.when(~F.col("wider"), F.struct("indexrelid", "index"))).alias("oldest_equal")))
    droppable = indexes.where(plain & ~F.col("is_primary") & ~F.col("is_unique") & ~F.col("is_exclusion") & ~F.col("backs_constraint"))
    narrow = droppable.select(*TABLE, "method", "index", "indexrelid", "bytes", _index_key(width).alias("prefix"))
    equal = F.when(F.col("oldest_equal.indexrelid") < F.col("indexrelid"), F.col("oldest_equal"))
    best = F.array_min(F.array_compact(F.array(F.col("oldest_wider"), equal)))
    return (narrow.join(covers, group).where((F.col("wider_covers") > 0) | equal.isNotNull())
            .select(*group, "index", "indexrelid", "bytes", "wider_covers", best["index"].alias("covered_by")))


def redundant_pairs(indexes: DataFrame, k: int = 50) -> DataFrame:
    """Largest ``k`` (redundant, covering) pairs per snapshot, ties by index age.

    Only the k largest redundant indexes and, for each prefix, its k oldest covers can
    appear among k pairs, so both sides are cut to k before they meet.
    """
    width = F.size("indkey")
    plain = ~F.col("is_partial") & ~F.col("is_expression")
    group = [*TABLE, "method", "prefix"]
    top = top_k(_redundant(indexes), SNAP, [F.col("bytes").desc(), F.col("indexrelid")], k, "_r")
    covers = (indexes.where(plain)
              .select(*TABLE, "method", F.col("index").alias("covering"), F.col("indexrelid").alias("covering_id"),
                      width.alias("w"), "indkey", "indclass", F.explode(F.sequence(F.lit(1), width)).alias("n"))
              .select(*TABLE, "method", "covering", "covering_id", _index_key(F.col("n")).alias("prefix"),
                      (F.col("n") < F.col("w")).alias("wider")))
    # Equal-key covers must be older than the index, so the oldest k of them suffice, like the wider ones.
    covers = top_k(covers, [*group, "wider"], [F.col("covering_id")], k, "_c")
    pairs = top.join(covers, group).where(F.col("wider") | (F.col("covering_id") < F.col("indexrelid")))
    return (top_k(pairs, SNAP, [F.col("bytes").desc(), F.col("indexrelid"), F.col("covering_id")], k)
            .select(*TABLE, "index", F.col("covering").alias("covered_by"), "bytes", "rank"))


def unindexed_fks(fks: DataFrame, indexes: DataFrame) -> DataFrame:
    """Foreign keys that no non-partial index of the child leads with."""
    prefixes = (indexes.where(~F.col("is_partial"))
                .select(*TABLE, "indkey", F.explode(F.sequence(F.lit(1), F.size("indkey"))).alias("n"))
                .select(*TABLE, _key_text(F.slice(F.col("indkey"), F.lit(1), F.col("n"))).alias("key")).distinct())
    want = fks.where(F.size("conkey") > 0).withColumn("key", _key_text(F.col("conkey")))
    return want.join(prefixes, [*TABLE, "key"], "left_anti").drop("key")


def unused_indexes(indexes: DataFrame) -> DataFrame:
    """Every index that no scan used and nothing needs."""
    return indexes.where((F.col("scans") == 0) & (F.col("bytes") > UNUSED_FLOOR_BYTES) & ~constrained() & ~F.col("is_replident"))


def largest_unused(indexes: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` largest unused indexes per snapshot, for views; rules, totals and reports take all."""
    return top_k(unused_indexes(indexes), SNAP, [F.col("bytes").desc(), F.col("indexrelid")], k)


def index_enrichment(stats: DataFrame, catalog: DataFrame, constraints: DataFrame, columns: DataFrame) -> DataFrame:
    """Join index statistics with catalog flags, constraint use and ordered column names.

    ``columns`` holds (target, snapshot, indexrelid, ord, name); an index has few, so
    the ordered list per index is small.
    """
    key = [*SNAP, "indexrelid"]
    backed = constraints.select(*SNAP, F.col("conindid").alias("indexrelid"), F.lit(True).alias("backs_constraint")).distinct()
    names = (columns.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("c"))
             .select(*key, F.transform("c", lambda x: x["name"]).alias("columns")))
    return (stats.join(catalog, key).join(backed, key, "left").join(names, key, "left")
            .withColumn("backs_constraint", F.coalesce("backs_constraint", F.lit(False)))
            .withColumn("columns", F.coalesce("columns", F.array().cast("array<string>"))))


def sequence_usage(sequences: DataFrame, k: int | None = None) -> DataFrame:
    """How full each sequence is, against the lower of its own and its column's ceiling; with ``k`` the fullest per snapshot, ranked."""
    s = sequences.where(F.col("last_value").isNotNull()).withColumn("ceiling", effective_ceiling("max_value", "type"))
    s = s.withColumn("_used", ratio("last_value", F.nullif(F.col("ceiling"), F.lit(0))))
    if k is not None:
        s = top_k(s, SNAP, [F.col("_used").desc_nulls_last(), F.col("name")], k)
    return s.withColumn("pct_used", F.coalesce(round_dp("_used", 4), F.lit(0.0))).drop("_used")


def narrow_identity(columns: DataFrame) -> DataFrame:
    """Two- and four-byte columns fed by an identity or an owned sequence."""
    return columns.where(F.col("type").isin("int2", "int4") & (F.col("is_identity") | F.col("owns_sequence")))


DEEPEST = 100_000


def partition_roots(edges: DataFrame, keys: list[str] = SNAP) -> DataFrame:
    """(keys, child, root) for every child: one recursive query climbs from the inner nodes, leaves join once at the end.

    Nodes that are parents themselves are few; each climbs its own line of ancestors. One on or below a cycle stops where the
    line comes back to itself: it has no root, and its children count under their parent.
    """
    named = ", ".join(f"`{k}`" for k in keys)
    same = " AND ".join(f"e.`{k}` <=> u.`{k}`" for k in keys)
    inner = edges.select(*keys, F.col("parent").alias("child")).distinct()
    up = edges.select(*keys, "child", "parent").join(inner, [*keys, "child"], "left_semi").distinct()
    lines = edges.sparkSession.sql(f"""
        WITH RECURSIVE climb({named}, child, top, line) MAX RECURSION LEVEL {DEEPEST} AS (
            SELECT {named}, child, parent, array(child) FROM {{up}}
            UNION ALL
            SELECT {", ".join(f"u.`{k}`" for k in keys)}, u.child, e.parent, array_append(u.line, e.child)
            FROM climb u JOIN {{up}} e ON {same} AND e.child = u.top AND NOT array_contains(u.line, e.child))
        SELECT {named}, child, top FROM climb LIMIT ALL""", up=up)
    roots = lines.join(up.select(*keys, F.col("child").alias("top")).distinct(), [*keys, "top"], "left_anti")
    roots = roots.select(*keys, F.col("child").alias("parent"), F.col("top").alias("root"))
    return edges.join(roots, [*keys, "parent"], "left").select(*keys, "child", F.coalesce("root", "parent").alias("root"))


def partition_rollup(edges: DataFrame, leaves: DataFrame, keys: list[str] = SNAP) -> DataFrame:
    """Leaf statistics summed at the topmost parent. Sums combine before the shuffle."""
    inner = edges.select(*keys, F.col("parent").alias("child")).distinct()
    leaf_roots = partition_roots(edges, keys).join(inner, [*keys, "child"], "left_anti")
    return leaf_roots.join(leaves, [*keys, "child"]).groupBy(*keys, "root").agg(
        F.count("*").alias("partitions"), *[F.sum(c).alias(c) for c in ("total_bytes", "live_tuples", "seq_scans", "index_scans")])


def relation_schema(objects: DataFrame, relation: str) -> DataFrame:
    """Catalog objects of one relation, from the schema fingerprint."""
    prefix = relation + "."
    return objects.where((F.col("identity") == relation) | F.col("identity").startswith(prefix))


def progress_operations(views: dict[str, DataFrame]) -> DataFrame:
    """Union of the progress views into one (pid, operation, relation, phase, pct) table."""
    from vitalgrid.functions.numbers import progress_pct

    parts = [df.select(*SNAP, "pid", F.lit(op).alias("operation"), "relation", "phase", progress_pct("done", "total").alias("pct"))
             for op, df in views.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def horizon_holders(sources: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """Oldest holders of the vacuum horizon per snapshot, over all holder kinds."""
    parts = [df.select(*SNAP, F.lit(name).alias("source"), "holder", "xmin_age", "age_s", "detail") for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out.where(F.col("xmin_age") > 0), SNAP, [F.col("xmin_age").desc(), F.col("holder")], k)
