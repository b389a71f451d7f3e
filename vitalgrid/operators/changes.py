"""Change events between a target's consecutive snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.text import redact_setting
from vitalgrid.operators.baseline import definition_hash
from vitalgrid.operators.series import DAY, previous_row

INFERRED = 0.5
OBSERVED = 1.0


def _event(df: DataFrame, kind: Column, obj: Column, before: Column, after: Column, low: Column, high: Column,
           confidence: float) -> DataFrame:
    return df.select("target_id", "snapshot_id", kind.alias("kind"), obj.alias("object"), before.cast("string").alias("before"),
                     after.cast("string").alias("after"), low.cast("long").alias("occurred_after"),
                     high.cast("long").alias("occurred_before"), F.lit(confidence).alias("confidence"))


def _pairs(df: DataFrame) -> DataFrame:
    """(target, snapshot) with its predecessor. A first observation has none, so it yields no events."""
    heads = df.groupBy("target_id", "snapshot_id").agg(F.max("collected_at").alias("at"))
    p = previous_row(heads, ["target_id"], "snapshot_id", ["snapshot_id", "at"], chunk_seconds=DAY)
    return p.where(F.col("prev_snapshot_id").isNotNull())


def _consecutive(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer match of each snapshot's rows with its predecessor's.

    The predecessor's rows are relabelled with the snapshot they are compared with, so both
    sides meet on their full key, which is as fine as the rows themselves.
    """
    pairs = _pairs(df).select("target_id", "snapshot_id", "prev_snapshot_id", F.col("at").alias("cur_at"), "prev_at")
    cur = df.select("target_id", "snapshot_id", *keys, *[F.col(v).alias("cur_" + v) for v in values], F.lit(True).alias("in_cur"))
    prev = (df.select("target_id", F.col("snapshot_id").alias("prev_snapshot_id"), *keys,
                      *[F.col(v).alias("old_" + v) for v in values], F.lit(True).alias("in_old"))
            .join(pairs.select("target_id", "prev_snapshot_id", "snapshot_id"), ["target_id", "prev_snapshot_id"])
            .drop("prev_snapshot_id"))
    cur = cur.join(pairs.select("target_id", "snapshot_id"), ["target_id", "snapshot_id"], "left_semi")
    both = cur.join(prev, ["target_id", "snapshot_id", *keys], "full_outer")
    return both.join(pairs.select("target_id", "snapshot_id", "cur_at", "prev_at"), ["target_id", "snapshot_id"])


def schema_events(objects: DataFrame) -> DataFrame:
    """Created, changed and dropped catalog objects. A definition counts by its hash."""
    hashed = objects.withColumn("definition_hash", definition_hash("kind", "identity", "definition"))
    b = _consecutive(hashed, ["kind", "identity"], ["definition", "definition_hash"])
    verb = (F.when(F.col("in_old").isNull(), "created").when(F.col("in_cur").isNull(), "dropped")
            .when(F.col("old_definition_hash") != F.col("cur_definition_hash"), "changed"))
    noun = F.when(F.col("kind") == "", "object").otherwise(F.lower("kind"))
    name = F.when((F.col("verb") == "changed") & (F.col("kind") == "column"), F.lit("schema.column_type_changed")).otherwise(
        F.concat(F.lit("schema."), noun, F.lit("_"), F.col("verb")))
    b = b.withColumn("verb", verb).where(F.col("verb").isNotNull())
    return _event(b, name, F.col("identity"), F.col("old_definition"), F.col("cur_definition"), F.col("prev_at"), F.col("cur_at"), INFERRED)


def config_events(settings: DataFrame) -> DataFrame:
    """Changed, added and removed setting overrides; secret values are masked."""
    b = _consecutive(settings, ["name"], ["value"])
    differs = F.col("in_old").isNull() | F.col("in_cur").isNull() | (F.col("old_value") != F.col("cur_value"))
    return _event(b.where(differs), F.lit("config.changed"), F.col("name"), redact_setting("name", "old_value"),
                  redact_setting("name", "cur_value"), F.col("prev_at"), F.col("cur_at"), OBSERVED * INFERRED)


def lifecycle_events(snapshots: DataFrame, *, chunk_seconds: int = DAY) -> DataFrame:
    """Resets and restarts after the previous run; they carry their own exact time."""
    p = previous_row(snapshots, ["target_id"], "collected_at", ["collected_at"], chunk_seconds=chunk_seconds)
    p = p.where(F.col("prev_collected_at").isNotNull())
    none = F.lit(None).cast("string")

    def one(kind: str, c: str) -> DataFrame:
        hit = p.where(F.col(c) > F.col("prev_collected_at"))
        return _event(hit, F.lit(kind), F.col("database"), none, none, F.col(c), F.col(c), OBSERVED)

    return one("stats.reset", "stats_reset_at").unionByName(one("server.restarted", "postmaster_start_at"))
