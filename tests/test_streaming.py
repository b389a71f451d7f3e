"""Streams give what their batch twins give; late rows are dropped, retries change nothing."""

import os

from pyspark.sql import functions as F

from vitalgrid.operators.rates import health_rates
from vitalgrid.operators.waits import wait_rollup_minute
from vitalgrid.streaming.jobs import (CarriedState, counter_rates, drain, finding_transitions, incident_sessions, open_rollup, open_sessions, stream_transitions,
                                      wait_rollup)

COUNTERS = ("target_id long, snapshot_id long, collected_at long, numbackends long, xact_commit long, xact_rollback long, blks_hit long, blks_read long, temp_bytes long, "
            "deadlocks long, tup_returned long, tup_written long, stats_reset_at long, postmaster_start_at long")


def counter(target, at, v):
    return (target, at, at, 1, v, 0, v, v, 0, 0, v, v, 0, 0)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def sorted_rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_counter_rates_over_several_batches(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "run")
    batches = [[counter(1, 10, 100), counter(2, 10, 5)], [counter(1, 20, 300), counter(1, 30, 50)], [counter(2, 40, 65), counter(1, 25, 999)]]
    for b in batches:
        feed(spark, src, b, COUNTERS)
        stream = spark.readStream.schema(COUNTERS).parquet(src)
        counter_rates(stream, root).awaitTermination()
    got = CarriedState(root).results(spark)
    kept = [r for b in batches for r in b if r[2] != 25]  # the sample older than the carried one is late
    want = health_rates(spark.createDataFrame(kept, COUNTERS))
    cols = ["target_id", "snapshot_id", "tps", "exactness", "cache_hit_ratio"]
    assert sorted_rows(got, cols) == sorted_rows(want, cols)


def test_retried_batch_overwrites_itself(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "run")
    feed(spark, src, [counter(1, 10, 100), counter(1, 20, 200)], COUNTERS)
    counter_rates(spark.readStream.schema(COUNTERS).parquet(src), root).awaitTermination()
    before = sorted_rows(CarriedState(root).results(spark), ["target_id", "snapshot_id", "tps"])
    commits = os.path.join(root, "checkpoint", "commits")
    for name in ("0", ".0.crc"):  # as if the driver was lost after writing and before committing
        os.remove(os.path.join(commits, name))
    counter_rates(spark.readStream.schema(COUNTERS).parquet(src), root).awaitTermination()
    assert os.path.exists(os.path.join(commits, "0"))
    assert sorted_rows(CarriedState(root).results(spark), ["target_id", "snapshot_id", "tps"]) == before


def test_wait_rollup_drops_late_rows(spark, tmp_path):
    schema = "target_id long, sample_at long, wait_event_type string, wait_event string"
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    on_time = [(1, 60, "IO", "Read"), (1, 70, "IO", "Read"), (1, 5000, None, None)]
    late, closing = [(1, 61, "IO", "Read")], [(1, 9000, None, None)]
    for rows in (on_time, late, closing):
        feed(spark, src, rows, schema)
        df = wait_rollup(spark.readStream.schema(schema).parquet(src))
        df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = sorted_rows(spark.read.parquet(out), ["bucket_at", "wait_type", "samples"])
    batch = wait_rollup_minute(spark.createDataFrame(on_time, schema)).where("bucket_at < 8000")
    assert got == sorted_rows(batch, ["bucket_at", "wait_type", "samples"]) == [(4980, "CPU", 1), (60, "IO", 2)]


RUNS = "target_id long, run long, id string, object string, severity string"


def test_transitions(spark):
    f = spark.createDataFrame([(1, 1, "a", "", "warn"), (1, 1, "b", "x", "warn"), (1, 2, "a", "", "critical"), (1, 2, "b", "x", "warn"), (1, 3, "", "", "info"), (1, 4, "a", "", "warn")], RUNS)
    got = {(r["run"], r["id"], r["change"]) for r in finding_transitions(f).collect()}
    assert got == {(1, "a", "opened"), (1, "b", "opened"), (2, "a", "escalated"), (3, "a", "closed"), (3, "b", "closed"), (4, "a", "opened")}


def test_stream_transitions_equal_batch(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "run")
    batches = [[(1, 1, "a", "", "warn"), (2, 1, "a", "", "info")], [(1, 2, "a", "", "critical"), (1, 3, "b", "", "warn")], [(2, 5, "a", "", "warn"), (2, 6, "", "", "info")]]
    for b in batches:
        feed(spark, src, b, RUNS)
        stream_transitions(spark.readStream.schema(RUNS).parquet(src), root).awaitTermination()
    want = finding_transitions(spark.createDataFrame([r for b in batches for r in b], RUNS))
    cols = ["target_id", "run", "id", "change"]
    assert sorted_rows(CarriedState(root).results(spark), cols) == sorted_rows(want, cols)


def test_hot_target_is_split_into_chunks(spark):
    """A third of all rows on one target: no window group may hold them together."""
    from vitalgrid.operators.series import with_chunk
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("target_id"), (F.col("id") * 30).alias("at"))
    groups = with_chunk(df, "at", 86_400).groupBy("target_id", "_chunk").count()
    assert groups.agg(F.max("count")).first()[0] <= 1000


SAMPLES = "target_id long, sample_at long, wait_event_type string, wait_event string, query_id long"


def test_an_ended_stream_gives_open_windows_too(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, 60, "IO", "Read", 5), (1, 70, "IO", "Read", 5), (1, 5000, None, None, 5), (2, 5010, "Lock", "tuple", 5), (2, 5100, "Lock", "tuple", 5), (3, 100, "Lock", "tuple", None)]
    feed(spark, src, rows, SAMPLES)
    stream = spark.readStream.schema(SAMPLES).parquet(src)
    cut = drain(wait_rollup(stream), "cut")
    assert cut.agg(F.sum("samples")).first()[0] < len(rows)
    got = sorted_rows(drain(wait_rollup(stream), "whole", open_rollup), ["target_id", "bucket_at", "wait_type", "wait_event", "samples"])
    assert got == sorted_rows(wait_rollup_minute(spark.createDataFrame(rows, SAMPLES)), ["target_id", "bucket_at", "wait_type", "wait_event", "samples"])
    sessions = sorted_rows(drain(incident_sessions(stream), "sessions", open_sessions), ["target_id", "query_id", "started_at", "ended_at", "samples"])
    assert sessions == [(2, 5, 5010, 5220, 2), (3, None, 100, 220, 1)]


def test_a_stream_without_rows_ends_empty(spark, tmp_path):
    spark.createDataFrame([], SAMPLES).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "src"))
    assert drain(wait_rollup(stream), "none", open_rollup).count() == 0


def _written(root, batch):
    folder = os.path.join(root, "state", f"batch_{batch}")
    return sorted(n for n in os.listdir(folder) if n.startswith("bucket=")) if os.path.isdir(folder) else None


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "run")
    run = lambda **k: counter_rates(spark.readStream.schema(COUNTERS).parquet(src), root, **k).awaitTermination()
    feed(spark, src, [counter(t, 10, 100) for t in range(200)], COUNTERS)
    run()
    state = CarriedState(root)
    assert len(_written(root, 0)) > 100
    feed(spark, src, [counter(7, 20, 150)], COUNTERS)
    run()
    bucket = _written(root, 1)
    assert len(bucket) == 1 and state.held(spark, 1)[int(bucket[0].split("=")[1])] == 1
    feed(spark, src, [counter(7, 30, 250)], COUNTERS)
    run()
    assert bucket[0] not in _written(root, 0)  # superseded by batch 1, which is committed
    assert not os.path.isdir(state.manifest(0)) and os.path.isdir(state.manifest(1))
    rates = {(r["target_id"], r["collected_at"]): r["tps"] for r in state.results(spark).collect()}
    assert rates[7, 20] == 5.0 and rates[7, 30] == 10.0


def test_targets_that_fell_silent_are_forgotten(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "run")
    for batch in ([counter(7, 10, 100)], [counter(7, 5000, 150)], [counter(8, 9000, 1)]):
        feed(spark, src, batch, COUNTERS)
        counter_rates(spark.readStream.schema(COUNTERS).parquet(src), root, expire_after=1000).awaitTermination()
    held = CarriedState(root).held(spark, 2)
    assert len(held) == 2  # 7's bucket was not touched by the last batch
    feed(spark, src, [counter(7, 20_000, 200)], COUNTERS)
    counter_rates(spark.readStream.schema(COUNTERS).parquet(src), root, expire_after=1000).awaitTermination()
    rates = {r["collected_at"]: r["tps"] for r in CarriedState(root).results(spark).collect()}
    assert rates[20_000] == 50 / 15_000
