"""Runs of a cluster: which snapshots of its databases were collected together.

Databases of one cluster are collected one after another, seconds apart, so no snapshot id or second names the run. A run is
a session of the cluster's snapshots: it ends where nothing was collected for longer than a gap, and where a database
comes again. Sessions are found along chunked time lines, so a cluster with a third of all snapshots is no single window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.series import DAY, carried, previous_row

GAP = 300
CLUSTER = ["cluster_id"]


def cluster_runs(snapshots: DataFrame, *, gap: int = GAP, chunk_seconds: int = DAY) -> DataFrame:
    """Rows with ``run``, the second at which their run began.

    ``snapshots``: cluster_id, database, collected_at and anything else; repeated rows stay in one run.
    """
    times = snapshots.select(*CLUSTER, "collected_at").distinct()
    p = previous_row(times, CLUSTER, "collected_at", ["collected_at"], chunk_seconds=chunk_seconds)
    fresh = p.withColumn("_fresh", (F.col("prev_collected_at").isNull() | (F.col("collected_at") - F.col("prev_collected_at") > gap)).cast("long"))
    sessions = carried(fresh, CLUSTER, "collected_at", totals={"_session": F.col("_fresh")}, chunk_seconds=chunk_seconds).select(*CLUSTER, "collected_at", "_session")
    seen = snapshots.select(*CLUSTER, "database", "collected_at").distinct().join(sessions, [*CLUSTER, "collected_at"])
    # How often a database has come in its session; the most of any database so far numbers the runs of the session.
    times_seen = carried(seen, [*CLUSTER, "_session", "database"], "collected_at", totals={"_nth": F.lit(1)}, chunk_seconds=chunk_seconds)
    nth = times_seen.groupBy(*CLUSTER, "_session", "collected_at").agg(F.max("_nth").alias("_nth"))
    part = carried(nth, [*CLUSTER, "_session"], "collected_at", maxima={"_part": F.col("_nth")}, chunk_seconds=chunk_seconds)
    began = part.groupBy(*CLUSTER, "_session", "_part").agg(F.min("collected_at").alias("run"))
    placed = part.join(began, [*CLUSTER, "_session", "_part"]).select(*CLUSTER, "collected_at", "run")
    return snapshots.join(placed, [*CLUSTER, "collected_at"])
