import datetime

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import baseline, catalog, changes, deltas, evidence, fleet, policy, rates, series, sessions, waits

H, D = 3600, 86_400


# --- rates ---------------------------------------------------------------------


def test_counter_pairs(spark):
    df = spark.createDataFrame([(100, 40, 1), (40, 100, 1), (1000, 1600, 1), (1, 2, 0)], "a long, b long, dt long")
    got = [tuple(r) for r in df.select(series.counter_delta("a", "b"), series.per_second("a", "b", "dt")).collect()]
    assert got == [(None, None), (60, 60.0), (600, 600.0), (1, None)]
    ratio = spark.range(1).select(series.counter_ratio(F.lit(0), F.lit(900), F.lit(0), F.lit(100)), series.counter_ratio(F.lit(500), F.lit(500), F.lit(500), F.lit(500)),
                                  series.counter_ratio(F.lit(10), F.lit(5), F.lit(0), F.lit(5))).first()
    assert tuple(ratio) == (0.9, None, None)


COUNTERS = ("target_id long, snapshot_id long, collected_at long, numbackends long, xact_commit long, xact_rollback long, blks_hit long, blks_read long, temp_bytes long, "
            "deadlocks long, tup_returned long, tup_written long, stats_reset_at long, postmaster_start_at long")


def counters(*rows):
    return [(1, i, at, 5, c, r, h, d, t, 0, 0, 0, 0, 0) for i, (at, c, r, h, d, t) in enumerate(rows)]


def test_health_rates_and_reset(spark, rows):
    df = spark.createDataFrame(counters((0, 100, 10, 1000, 100, 0), (10, 190, 20, 1900, 200, 10_485_760), (20, 50, 25, 2000, 210, 0)), COUNTERS)
    got = rows(rates.health_rates(df), "snapshot_id")
    assert got[0]["exactness"] == "unavailable" and got[0]["tps"] is None
    assert (got[1]["tps"], got[1]["commits_per_sec"], got[1]["rollback_ratio"], got[1]["cache_hit_ratio"], got[1]["cache_blocks"]) == (10.0, 9.0, 0.1, 0.9, 1000)
    assert got[1]["temp_bytes_per_sec"] == 1_048_576.0 and got[1]["exactness"] == "sampled"
    assert got[2]["exactness"] == "reset_during_sample" and got[2]["commits_per_sec"] is None and got[2]["temp_bytes_per_sec"] is None
    assert got[2]["cache_hit_ratio"] == 0.9091


def test_own_transactions_are_subtracted_unless_that_fakes_a_reset(spark, rows):
    df = spark.createDataFrame(counters((0, 100, 0, 0, 0, 0), (10, 150, 0, 0, 0, 0)), COUNTERS)
    assert rows(rates.health_rates(df.withColumn("own_txns", F.lit(20))), "snapshot_id")[1]["commits_per_sec"] == 3.0
    assert rows(rates.health_rates(df.withColumn("own_txns", F.lit(60))), "snapshot_id")[1]["commits_per_sec"] == 5.0


def test_first_reset_counts(spark, rows):
    df = spark.createDataFrame([(1, 1, 10, None, 5), (1, 2, 20, 15, 5), (1, 3, 30, 15, 25), (1, 4, 40, 15, 25)],
                               "target_id long, snapshot_id long, collected_at long, stats_reset_at long, postmaster_start_at long")
    got = rows(rates.counter_resets(df), "snapshot_id")
    assert [(g["snapshot_id"], g["reason"], g["age_seconds"]) for g in got] == [(2, "stats_reset", 5), (3, "server_restart", 5)]


def test_stats_window_falls_back_to_start(spark):
    df = spark.createDataFrame([(1, 1, 2 * D, D, 0), (1, 2, 2 * D, None, H)], "target_id long, snapshot_id long, collected_at long, stats_reset_at long, postmaster_start_at long")
    got = {r["snapshot_id"]: r for r in rates.stats_window(df).collect()}
    assert (got[1]["window_age_seconds"], got[1]["stats_window_days"]) == (D, 1.0)
    assert (got[2]["window_age_seconds"], got[2]["stats_window_days"]) == (2 * D - H, None)


# --- series --------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
def test_chunk_size_never_changes_the_previous_row(spark, chunk):
    df = spark.range(200).select((F.col("id") % 3).alias("target_id"), (F.col("id") * F.col("id") % 977).alias("at"), F.col("id").alias("v")).dropDuplicates(["target_id", "at"])
    got = series.previous_row(df, ["target_id"], "at", ["v", "at"], chunk_seconds=chunk)
    from pyspark.sql import Window
    w = Window.partitionBy("target_id").orderBy("at")
    want = df.select("*", F.lag("v").over(w).alias("prev_v"), F.lag("at").over(w).alias("prev_at"))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("chunk", [3, 40, 10_000])
def test_asof_against_brute_force(spark, chunk):
    facts = [(t, at, at * 10 + t) for t in (1, 2) for at in (5, 9, 20, 21, 60, 140, 141)]
    probes = [(t, at) for t in (1, 2) for at in range(0, 200, 7)]
    right = spark.createDataFrame(facts, "k long, at long, v long")
    left = spark.createDataFrame(probes, "k long, p long")
    got = {(r["k"], r["p"]): r["base_v"] for r in series.asof(left, right, ["k"], F.col("p"), "at", ["v"], chunk_seconds=chunk).collect()}
    near = {(r["k"], r["p"]): r["base_v"] for r in series.asof(left, right, ["k"], F.col("p"), "at", ["v"], chunk_seconds=chunk, nearest_within=10).collect()}
    for k, p in probes:
        before = [f for f in facts if f[0] == k and f[1] <= p]
        assert got[(k, p)] == (max(before, key=lambda f: f[1])[2] if before else None)
        close = [f for f in facts if f[0] == k and abs(f[1] - p) <= 10]
        assert near[(k, p)] == (min(close, key=lambda f: (abs(f[1] - p), f[1]))[2] if close else None)


# --- sessions, waits -----------------------------------------------------------


def test_activity_rollup_counts(spark):
    a = [(1, 1, s, w, x, q, b) for s, w, x, q, b in (
        ("active", "Lock", 10, 3, "client backend"), ("active", "", 5, 9, "client backend"), ("idle", "Client", None, 100, "client backend"),
        ("idle in transaction", "Client", 70, 1, "client backend"), ("idle in transaction (aborted)", "Client", 2, 1, "client backend"), ("active", "", 4000, 1, "autovacuum worker"))]
    df = spark.createDataFrame(a, "target_id long, snapshot_id long, state string, wait_event_type string, xact_age_s long, query_age_s long, backend_type string")
    r = sessions.activity_rollup(df).first()
    assert (r["total"], r["active"], r["idle"], r["idle_in_transaction"], r["waiting"]) == (6, 3, 1, 2, 1)
    assert (r["longest_xact_s"], r["longest_active_s"], r["autovacuum_workers"], r["autovacuum_max_age_s"]) == (4000.0, 9.0, 1, 4000.0)


def ash(spark):
    rows = ([("Lock", "transactionid", 1001)] * 44 + [(None, None, 1002)] * 27 + [("IO", "DataFileRead", 1002)] * 21 + [("LWLock", "BufferMapping", 0)] * 8)
    return spark.createDataFrame([(1, 1, 60 + i, *r) for i, r in enumerate(rows)], "target_id long, window_id long, sample_at long, wait_event_type string, wait_event string, query_id long")


def test_wait_profile(spark):
    by_type = {r["wait_type"]: r["share"] for r in waits.wait_by_type(ash(spark)).collect()}
    assert by_type == {"Lock": 0.44, "CPU": 0.27, "IO": 0.21, "LWLock": 0.08}
    q = {r["query_id"]: r for r in waits.wait_by_query(ash(spark)).collect()}
    assert set(q) == {1001, 1002}
    assert q[1001]["lock_share"] == 1.0 and q[1001]["top_event"] == "Lock:transactionid"
    assert q[1002]["top_type"] == "CPU" and q[1002]["samples"] == 48 and q[1002]["io_share"] == 21 / 48


def test_sampler_outcome(spark):
    polls = spark.createDataFrame([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)], "target_id long, window_id long, failed boolean")
    s = spark.createDataFrame([(3, 1, "IO")], "target_id long, window_id long, wait_event_type string")
    assert {r["target_id"]: r["state"] for r in waits.profile_availability(polls, s).collect()} == {1: "unavailable", 2: "idle", 3: "thin"}


def test_rollup_merges_folds_and_keeps_eventless_samples(spark):
    s = spark.createDataFrame([(1, 60 + i, "IO", "Read" if i < 6 else None) for i in range(10)], "target_id long, sample_at long, wait_event_type string, wait_event string")
    m = waits.wait_rollup_minute(s)
    assert {r["wait_event"]: r["samples"] for r in m.collect()} == {"Read": 6, "": 4}
    assert {r["wait_event"]: r["samples"] for r in waits.merge_rollups(m, m).collect()} == {"Read": 12, "": 8}
    now = 60 + 10 * D
    folded = waits.wait_rollup_fold(m, now)
    assert {(r["granularity"], r["bucket_at"], r["samples"]) for r in folded.collect()} == {("hour", 0, 6), ("hour", 0, 4)}
    # Folding again adds nothing, and hours past the horizon disappear.
    assert {r["samples"] for r in waits.wait_rollup_fold(folded, now).collect()} == {6, 4}
    assert waits.wait_rollup_fold(folded, 60 + 100 * D).count() == 0


# --- catalog -------------------------------------------------------------------

INDEX = ("target_id long, snapshot_id long, schema string, table string, index string, indexrelid long, method string, indkey array<long>, indclass array<long>, is_primary boolean, "
         "is_unique boolean, is_exclusion boolean, is_replident boolean, is_partial boolean, is_expression boolean, backs_constraint boolean, scans long, bytes long")


def index(name, oid, key, cls=None, method="btree", table="t", **flags):
    f = {k: flags.get(k, False) for k in ("is_primary", "is_unique", "is_exclusion", "is_replident", "is_partial", "is_expression", "backs_constraint")}
    return (1, 1, "public", table, name, oid, method, key, cls or [10] * len(key), *f.values(), flags.get("scans", 0), flags.get("bytes", 100_000))


def test_redundant_indexes(spark):
    df = spark.createDataFrame([
        index("a", 1, [1]), index("ab", 2, [1, 2]), index("abc", 3, [1, 2, 3]), index("dup", 4, [1, 2, 3]), index("ba", 5, [2, 1]),
        index("gin_a", 6, [1], method="gin"), index("other_class", 7, [1], cls=[99]), index("pk", 8, [1], is_primary=True), index("partial_cover", 9, [5, 6], is_partial=True),
        index("five", 10, [5]), index("elsewhere", 11, [1], table="u"), index("backed", 12, [1], backs_constraint=True), index("expr", 13, [0, 1], is_expression=True)], INDEX)
    got = {r["index"]: (r["covered_by"], r["wider_covers"]) for r in catalog.redundant_indexes(df).collect()}
    assert got == {"a": ("ab", 3), "ab": ("abc", 2), "dup": ("abc", 0)}
    pairs = {(r["index"], r["covered_by"]) for r in catalog.redundant_pairs(df).collect()}
    assert pairs == {("a", "ab"), ("a", "abc"), ("a", "dup"), ("ab", "abc"), ("ab", "dup"), ("dup", "abc")}


def test_redundant_pairs_limit_is_exact(spark):
    """Many equal indexes on one table: the first k pairs are the same as those of all pairs."""
    n, k = 40, 50
    df = spark.createDataFrame([index(f"i{j:02d}", j, [1], bytes=1000 * (j % 7)) for j in range(n)], INDEX)
    every = sorted(((-1000 * (a % 7), a, b) for a in range(n) for b in range(a)))[:k]
    got = [(-r["bytes"], int(r["index"][1:]), int(r["covered_by"][1:])) for r in sorted(catalog.redundant_pairs(df, k).collect(), key=lambda r: r["rank"])]
    assert got == every


def test_unindexed_fks(spark):
    ix = spark.createDataFrame([index("i", 1, [2, 1, 3]), index("p", 2, [4], is_partial=True)], INDEX)
    fk = spark.createDataFrame([(1, 1, "public", "t", n, k, 5) for n, k in (("lead", [2]), ("two", [2, 1]), ("order", [1, 2]), ("partial", [4]), ("none", [9]))],
                               "target_id long, snapshot_id long, schema string, table string, constraint string, conkey array<long>, child_bytes long")
    assert sorted(r["constraint"] for r in catalog.unindexed_fks(fk, ix).collect()) == ["none", "order", "partial"]


def test_unused_indexes_skip_what_something_needs(spark):
    df = spark.createDataFrame([index("idle", 1, [1]), index("used", 2, [1], scans=5), index("tiny", 3, [1], bytes=16_384), index("pk", 4, [1], is_primary=True),
                                index("uq", 5, [1], is_unique=True), index("ri", 6, [1], is_replident=True), index("co", 7, [1], backs_constraint=True)], INDEX)
    assert [r["index"] for r in catalog.unused_indexes(df).collect()] == ["idle"]


@pytest.mark.parametrize("depth", [1, 2, 5, 9])
def test_partition_roots_of_any_depth(spark, depth):
    edges = [(1, 1, f"n{i}", f"n{i + 1}") for i in range(depth)] + [(1, 1, f"leaf{j}", "n0") for j in range(3)]
    e = spark.createDataFrame(edges, "target_id long, snapshot_id long, child string, parent string")
    leaves = spark.createDataFrame([(1, 1, f"leaf{j}", 10, 1, 2, 3) for j in range(3)], "target_id long, snapshot_id long, child string, total_bytes long, live_tuples long, seq_scans long, index_scans long")
    r = catalog.partition_rollup(e, leaves).collect()
    assert [(x["root"], x["partitions"], x["total_bytes"]) for x in r] == [(f"n{depth}", 3, 30)]


def test_sequence_usage(spark):
    s = spark.createDataFrame([(1, 1, "a", "int4", 2_000_000_000, 2**63 - 1), (1, 1, "b", "int8", 5, 10), (1, 1, "c", "int2", None, 100)],
                              "target_id long, snapshot_id long, name string, type string, last_value long, max_value long")
    got = {r["name"]: (r["ceiling"], r["pct_used"]) for r in catalog.sequence_usage(s).collect()}
    assert got == {"a": (2147483647, 0.9313), "b": (10, 0.5)}


# --- history -------------------------------------------------------------------


def snapshots(spark, *times):
    return spark.createDataFrame([(1, i, t, 100) for i, t in enumerate(times)], "target_id long, snapshot_id long, collected_at long, doc_bytes long")


def test_retention(spark):
    now = 200 * D
    hour = now - 8 * D
    hour -= hour % H
    df = snapshots(spark, now - 100 * D, hour + 5, hour + 10, hour + 20, now - H, now - 60)
    assert sorted(r["snapshot_id"] for r in baseline.retention_thin(df, now).collect()) == [3, 4, 5]


def test_retention_keeps_the_last_written_not_the_latest_time(spark):
    now = 200 * D
    hour = now - 8 * D
    hour -= hour % H
    assert [r["snapshot_id"] for r in baseline.retention_thin(snapshots(spark, hour + 50, hour + 10), now).collect()] == [1]


@pytest.mark.parametrize("budget,kept", [(10_000, 10), (500, 5), (1, 1)])
def test_history_budget(spark, budget, kept):
    df = snapshots(spark, *[i * 7000 for i in range(10)])
    got = sorted(r["snapshot_id"] for r in baseline.history_budget(df, budget).collect())
    assert len(got) == {10_000: 10, 500: 4, 1: 1}[budget]
    assert got == list(range(10))[-len(got):]


def test_same_hour_yesterday_takes_the_nearest(spark):
    now = 10 * D
    df = snapshots(spark, now - D - 1700, now - D + 600, now - D + 1801, now)
    got = {r["snapshot_id"]: r["base_snapshot_id"] for r in baseline.same_hour_yesterday(df, ["snapshot_id"]).collect()}
    assert got[3] == 1


def test_baseline_prefers_an_aged_snapshot(spark):
    df = snapshots(spark, 0, 1000, 1060, 1100)
    got = {r["snapshot_id"]: r["base_snapshot_id"] for r in baseline.baseline_choice(df, ["snapshot_id"]).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0}


def test_trend_is_oldest_first_and_whitelisted(spark):
    df = spark.createDataFrame([(1, i, i, None if i == 3 else float(i)) for i in range(6)], "target_id long, snapshot_id long, collected_at long, tps double")
    assert baseline.trend(df, "tps", 3).first()["series"] == [2.0, 4.0, 5.0]
    with pytest.raises(ValueError):
        baseline.trend(df, "password")


def test_dead_rules_reset_on_match(spark):
    runs = [(1, "a", r, r == 3) for r in range(12)] + [(1, "b", r, False) for r in range(4)]
    df = spark.createDataFrame(runs, "target_id long, rule string, run long, matched boolean")
    for chunk in (2, 5, 1000):
        got = {(r["rule"], r["run"]): r["misses"] for r in baseline.dead_rules(df, chunk_runs=chunk).collect()}
        assert got == {("a", 8): 5, ("a", 9): 6, ("a", 10): 7, ("a", 11): 8}


def test_fingerprints_keep_databases_of_a_cluster_apart(spark):
    df = spark.createDataFrame([("h", "1", "a", "sys"), ("h", "1", "b", "sys"), ("x", "9", "a", "sys"), ("h", "1", "a", "")], "h string, p string, d string, s string")
    f = [r[0] for r in df.select(baseline.fingerprint("h", "p", "d", "s")).collect()]
    assert f[0] == f[2] and len({f[0], f[1], f[3]}) == 3 and all(len(x) == 16 for x in f)


# --- deltas, events ------------------------------------------------------------


def test_delta_gates(spark):
    st = spark.createDataFrame([(1, 1, 10, 1, 100, 200_000), (1, 2, 20, 1, 100, 2_000_000), (1, 2, 20, 2, 10, 5000), (1, 1, 10, 3, 100, 400_000), (1, 2, 20, 3, 100, 800_000)],
                               "target_id long, snapshot_id long, collected_at long, queryid long, calls long, total_us long")
    d = deltas.query_deltas(st, deltas.snapshot_baselines(st))
    got = {(r["id"], r["subject"]): r for r in d.collect()}
    assert set(got) == {("query.mean_ms", "queryid 1"), ("query.new", "queryid 2")}  # statement 3 moved by only 4 ms
    m = got[("query.mean_ms", "queryid 1")]
    assert (m["before"], m["after"], m["pct_change"], m["severity"], m["first_observed"]) == (2.0, 20.0, 9.0, "warn", 10)
    w = deltas.worst_slowdown(d).first()
    assert (w["factor"], w["subject"]) == (10.0, "queryid 1")


def test_delta_baselines_skip_runs_in_a_row(spark):
    df = snapshots(spark, 0, 1000, 1060, 1100)
    got = {r["snapshot_id"]: (r["base_snapshot_id"], r["base_at"]) for r in deltas.delta_baselines(df).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0)}
    assert {r["snapshot_id"]: r["base_snapshot_id"] for r in deltas.snapshot_baselines(df).collect()} == {1: 0, 2: 1, 3: 2}


def test_table_deltas(spark):
    t = spark.createDataFrame([(1, 1, 10, "public", "a", 100, 0.02), (1, 2, 20, "public", "a", 5000, 0.30), (1, 1, 10, "public", "b", 100, 0.1), (1, 2, 20, "public", "b", 150, 0.15)],
                              "target_id long, snapshot_id long, collected_at long, schema string, table string, seq_scans long, dead_ratio double")
    got = {r["id"]: (r["before"], r["after"]) for r in deltas.table_deltas(t, deltas.snapshot_baselines(t)).collect()}
    assert got == {"table.seq_scans": (100.0, 5000.0), "table.dead_ratio": (0.02, 0.3)}


def test_schema_and_config_events(spark):
    o = spark.createDataFrame([(1, 1, 10, "index", "public.t.a", "x"), (1, 1, 10, "column", "public.t.c", "int4"), (1, 2, 20, "column", "public.t.c", "int8"), (1, 2, 20, "table", "public.n", "r")],
                              "target_id long, snapshot_id long, collected_at long, kind string, identity string, definition string")
    got = {(r["kind"], r["object"], r["occurred_after"], r["occurred_before"], r["confidence"]) for r in changes.schema_events(o).collect()}
    assert got == {("schema.index_dropped", "public.t.a", 10, 20, 0.5), ("schema.column_type_changed", "public.t.c", 10, 20, 0.5), ("schema.table_created", "public.n", 10, 20, 0.5)}
    s = spark.createDataFrame([(1, 1, 10, "work_mem", "4MB"), (1, 2, 20, "work_mem", "64MB"), (1, 1, 10, "ssl_key_file", "/a"), (1, 2, 20, "ssl_key_file", "/b"), (1, 2, 20, "x", "1")],
                              "target_id long, snapshot_id long, collected_at long, name string, value string")
    ev = {r["object"]: (r["before"], r["after"]) for r in changes.config_events(s).collect()}
    assert ev == {"work_mem": ("4MB", "64MB"), "ssl_key_file": ("«redacted»", "«redacted»"), "x": (None, "1")}


# --- policy --------------------------------------------------------------------

FINDING = "target_id long, snapshot_id long, id string, object string, severity string, dimension string, score double, confidence double, title string, n_objects long, caveats array<string>"
ROWS = "target_id long, snapshot_id long, id string, object string, evidence string, position double, measure double, size long, f1 boolean, f2 boolean, f3 boolean"
NOW = "2026-06-15"


def fks(spark, *tables):
    f = spark.createDataFrame([(1, 1, "fk_unindexed", "", "warn", "latency", 10.0, 0.8, f"{len(tables)} foreign key(s)", len(tables), [])], FINDING)
    r = spark.createDataFrame([(1, 1, "fk_unindexed", f"public.{t}", t, float(-i), None, 0, False, False, False) for i, t in enumerate(tables)], ROWS)
    return f, r


def test_partial_suppression_recounts(spark):
    f, r = fks(spark, "a", "b", "c")
    out, marked = policy.apply_ignores(f, r, policy.ignore_rules(spark, [{"finding": "fk_unindexed", "object": "public.b", "reason": "ok"}]), NOW)
    x = out.first()
    assert (x["suppressed"], x["n_objects"], x["title"], len(x["caveats"])) == (False, 2, "2 foreign key(s)", 1)
    assert {m["object"] for m in marked.collect() if m["muted_by"]} == {"public.b"}


def test_all_rows_cut_suppresses_the_finding(spark):
    f, r = fks(spark, "a", "b")
    out, _ = policy.apply_ignores(f, r, policy.ignore_rules(spark, [{"finding": "fk_unindexed", "object": "public.*", "reason": "later"}]), NOW)
    x = out.first()
    assert (x["suppressed"], x["suppression_rule"], x["suppression_reason"]) == (True, "fk_unindexed:public.*", "later")


def test_precedence_and_expiry(spark):
    rules = policy.ignore_rules(spark, [
        {"finding": "x", "reason": "blanket"}, {"finding": "x", "object": "public.*", "reason": "glob"}, {"finding": "x", "object": "public.t", "reason": "exact"},
        {"finding": "x", "object": "public.t", "reason": "later exact"}, {"finding": "y", "expires": "2026-06-15"}, {"finding": "z", "expires": "2026-06-14"}, {"finding": "w", "expires": "soon"}])
    q = spark.createDataFrame([("x", "public.t"), ("x", "public.u"), ("x", "other"), ("y", ""), ("z", ""), ("w", ""), ("v", "")], "id string, object string")
    got = {(r["id"], r["object"]): r["match"] and r["match"]["reason"] for r in policy.match_rules(q, rules, NOW).collect()}
    assert got == {("x", "public.t"): "exact", ("x", "public.u"): "glob", ("x", "other"): "blanket", ("y", ""): "", ("z", ""): None, ("w", ""): "", ("v", ""): None}
    why = {(r["id"]): r["outcome"] for r in policy.explain_rules(q.where("id in ('z','v')"), rules, NOW).collect()}
    assert why == {"z": "rule has expired", "v": "no rule"}


def test_config_warnings(spark):
    rules = policy.ignore_rules(spark, [{"finding": "nope"}, {"finding": "table_bloat", "object": "[x"}, {"finding": "table_bloat", "expires": "tomorrow"}])
    sev = spark.createDataFrame([("table_bloat", "fatal"), ("zzz", "warn")], "id string, severity string")
    thr = spark.createDataFrame([("dead_ratio_warn", 1.5), ("other", 1.0), ("replica_lag_warn_seconds", 5.0)], "key string, value double")
    got = sorted((r["kind"], r["subject"]) for r in policy.config_warnings(rules, sev, thr).collect())
    assert got == [("ignore", "[x"), ("ignore", "nope"), ("ignore", "tomorrow"), ("severity", "table_bloat"), ("severity", "zzz"), ("threshold", "dead_ratio_warn"), ("threshold", "other")]
    with pytest.raises(ValueError):
        policy.refuse_credentials(["thresholds.x", "db.Password"])
    assert policy.hygiene_warnings(rules).count() == 2


def test_preexisting_needs_every_row_at_no_higher_severity(spark):
    def one(id_, sev, snap, n=0):
        return (1, snap, id_, "", sev, "risk", 1.0, 1.0, "t", n, [])
    base = [one("same", "warn", 1), one("worse", "warn", 1), one("agg", "warn", 1, 3), one("agg2", "warn", 1, 3)]
    head = [one("same", "warn", 2), one("worse", "critical", 2), one("agg", "warn", 2, 4), one("agg2", "info", 2, 3), one("new", "info", 2)]
    f = spark.createDataFrame(base + head, FINDING)
    r = spark.createDataFrame([(1, s, i, f"o{j}", "", 0.0, None, 0, False, False, False) for s, i, n in ((1, "agg", 3), (2, "agg", 4), (1, "agg2", 3), (2, "agg2", 3)) for j in range(n)], ROWS)
    pairs = spark.createDataFrame([(1, 2, 1)], "target_id long, snapshot_id long, base_snapshot_id long")
    out = policy.mark_preexisting(f, r, f, r, pairs).where("snapshot_id = 2")
    assert {x["id"]: x["preexisting"] for x in out.collect()} == {"same": True, "worse": False, "agg": False, "agg2": True, "new": False}


# --- fleet ---------------------------------------------------------------------


def test_scores_and_gates(spark):
    f = spark.createDataFrame([("critical", False, False), ("warn", False, True), ("info", False, False), ("critical", True, False)], "severity string, suppressed boolean, preexisting boolean")
    f = f.withColumn("target_id", F.lit(1)).withColumn("snapshot_id", F.lit(1))
    assert fleet.health_score(f).first()["health_score"] == 100 - 10 - 3 - 1
    assert fleet.gate_verdict(f, "warn").first()["verdict"] == 2
    assert fleet.gate_verdict(f.where("severity <> 'critical'"), "warn").first()["verdict"] == 0
    assert fleet.gate_verdict(f.where("severity <> 'critical'"), "info").first()["verdict"] == 1
    assert fleet.gate_verdict(f, "none").first()["verdict"] == 0
    t = fleet.findings_total(f).first()
    assert (t["critical"], t["warn"], t["info"]) == (1, 0, 1)


def test_order_puts_risk_first(spark):
    rows = [("a", "storage", 99.0, "warn"), ("b", "risk", 10.0, "info"), ("c", "latency", 99.0, "critical"), ("d", "storage", 99.0, "warn")]
    f = spark.createDataFrame([(1, 1, i, "", s, d, sc, 1.0, "", 0, []) for i, d, sc, s in rows], FINDING)
    assert [r["id"] for r in fleet.order_findings(f).orderBy("ordinal").collect()] == ["b", "c", "a", "d"]


def test_cluster_wide_findings_come_from_the_first_database_that_has_them(spark):
    f = spark.createDataFrame([(1, "db1", "checksum_failures"), (1, "db2", "checksum_failures"), (1, "db2", "fsync_off"), (1, "db0", "table_bloat"), (1, "db1", "table_bloat"),
                               (1, "db1", "replication_slot_inactive"), (1, "db1", "replication_slot_inactive")], "cluster_id long, database string, id string")
    f = f.withColumns({"object": F.lit(""), "run": F.lit(1)})
    later = spark.createDataFrame([(1, "db2", "checksum_failures", "", 2)], f.schema)
    assert [r["database"] for r in fleet.cluster_dedupe(f.unionByName(later)).where("run = 2").collect()] == ["db2"]
    got = sorted((r["database"], r["id"], r["object"]) for r in fleet.tag_objects(fleet.cluster_dedupe(f)).collect())
    assert got == [("db0", "table_bloat", "db:db0"), ("db1", "checksum_failures", ""), ("db1", "replication_slot_inactive", ""), ("db1", "replication_slot_inactive", ""),
                   ("db1", "table_bloat", "db:db1"), ("db2", "fsync_off", "")]


# --- evidence ------------------------------------------------------------------


def grades(spark, *idx, invalid=(), age=30 * D):
    df = spark.createDataFrame(list(idx), INDEX).withColumn("columns", F.array(F.lit("customerId")))
    unused = catalog.unused_indexes(df)
    obj = spark.createDataFrame([(1, 1, "index", f"public.t.{n}", True) for n in invalid] or [(1, 1, "table", "public.t", False)], "target_id long, snapshot_id long, kind string, identity string, invalid boolean")
    win = spark.createDataFrame([(1, 1, age, 30.0, 100 * D)], "target_id long, snapshot_id long, window_age_seconds long, stats_window_days double, collected_at long")
    return evidence.index_reports(df, unused, catalog.redundant_indexes(df), obj, win)


def test_index_grades(spark):
    idx = [index("plain", 1, [1]), index("g", 2, [2], method="gin"), index("e", 3, [3], is_expression=True), index("p", 4, [4], is_partial=True), index("r", 5, [6]), index("r2", 6, [6, 7], scans=9),
           index("bad", 7, [8])]
    got = {r["index"]: (r["grade"], r["reason"]) for r in grades(spark, *idx, invalid=["bad", "r"]).collect()}
    assert got == {"plain": ("needs_code_check", "zero_scans"), "g": ("inconclusive", "other_method"), "e": ("inconclusive", "expression"), "p": ("inconclusive", "partial"),
                   "r": ("catalog_proven", "invalid"), "bad": ("catalog_proven", "invalid")}
    cold = {r["index"]: r["grade"] for r in grades(spark, index("plain", 1, [1]), age=60).collect()}
    assert cold == {"plain": "inconclusive"}


def test_stale_verdicts_never_strengthen(spark):
    rep = grades(spark, index("plain", 1, [1]))
    def note(checked, verdict="not_found_in_code", window=10.0):
        v = spark.createDataFrame([(1, "public", "plain", verdict, checked, window)], "target_id long, schema string, index string, verdict string, checked_at long, stats_window_days double")
        r = evidence.attach_verdicts(rep, v).first()
        return r["verdict_stale"], r["verdict_note"], r["grade"]
    assert note(95 * D) == (False, "corroborated_longer", "needs_code_check")
    assert note(95 * D, window=40.0) == (False, "corroborated", "needs_code_check")
    assert note(50 * D) == (True, "stale", "needs_code_check")
    assert note(95 * D, "found_in_code") == (False, None, "needs_code_check")


def test_fixed_dates_are_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.range(1).select(F.timestamp_seconds(F.lit(0))).first()[0] == datetime.datetime(1970, 1, 1)


@pytest.mark.parametrize("chunk", [1, 7, 86_400])
def test_carried_values_do_not_depend_on_chunks(spark, chunk):
    df = spark.createDataFrame([(1, 1, 1, None), (1, 5, None, "a"), (1, 9, 2, None), (1, 30, 4, "b"), (2, 3, 7, None), (None, 4, 1, "z"), (None, 40, 1, None)], "k long, at long, v long, w string")
    got = sorted(map(tuple, series.carried(df, ["k"], "at", totals={"total": F.col("v")}, lasts={"last": F.col("w")}, chunk_seconds=chunk).select("k", "at", "total", "last").collect()), key=str)
    assert got == sorted([(1, 1, 1, None), (1, 5, 1, "a"), (1, 9, 3, "a"), (1, 30, 7, "b"), (2, 3, 7, None), (None, 4, 1, "z"), (None, 40, 2, "z")], key=str)


CLOCKS = "target_id long, snapshot_id long, collected_at long, stats_reset_at long, postmaster_start_at long"


@pytest.mark.parametrize("chunk", [300, 86_400])
def test_no_comparison_across_any_reset(spark, chunk):
    """Snapshots ten minutes apart: the baseline lies before the predecessor, the reset between those two."""
    clocks = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 2, 600, 300, 0), (1, 3, 1200, 300, 0), (1, 4, 1800, 300, 1500), (1, 5, 3600, 300, 1500), (2, 1, 0, None, 0), (2, 2, 2000, None, 0),
                                    (3, 2, 5000, 4000, 0)], CLOCKS)
    epochs = {(r["target_id"], r["snapshot_id"]): (r["epoch"], r["reason"]) for r in rates.reset_epochs(clocks, chunk_seconds=chunk).collect()}
    assert epochs == {(1, 1): (0, None), (1, 2): (1, "stats_reset"), (1, 3): (1, "stats_reset"), (1, 4): (2, "server_restart"), (1, 5): (2, "server_restart"),
                      (2, 1): (0, None), (2, 2): (0, None), (3, 2): (0, None)}
    # Target 3 has a snapshot before its first counters; those began after it.
    heads = clocks.select("target_id", "snapshot_id", "collected_at").union(spark.createDataFrame([(3, 1, 1000), (4, 1, 0), (4, 2, 5000)], "t long, s long, c long"))
    kept, not_compared = deltas.split_baselines(heads, clocks, chunk_seconds=chunk)
    assert sorted((r["target_id"], r["snapshot_id"], r["base_snapshot_id"]) for r in kept.collect()) == [(1, 5, 4), (2, 2, 1), (4, 2, 1)]
    got = sorted((r["target_id"], r["snapshot_id"], r["base_snapshot_id"], r["reason"], r["resets"]) for r in not_compared.collect())
    assert got == [(1, 2, 1, "stats_reset", 1), (1, 3, 1, "stats_reset", 1), (1, 4, 2, "server_restart", 1), (3, 2, 1, "stats_reset", 1)]


@pytest.mark.parametrize("chunk", [60, 86_400])
def test_runs_of_a_cluster(spark, chunk):
    """Databases collected seconds apart are one run; a gap or a database that comes again begins the next."""
    from vitalgrid.operators import runs

    rows = [(1, "app", 100), (1, "analytics", 107), (1, "reports", 131), (1, "app", 150), (1, "analytics", 151), (1, "reports", 155), (1, "analytics", 9000), (2, "app", 104), (2, "app", 104), (None, "x", 5)]
    snaps = spark.createDataFrame(rows, "cluster_id long, database string, collected_at long")
    got = sorted((r["cluster_id"], r["database"], r["collected_at"], r["run"]) for r in runs.cluster_runs(snaps.where("cluster_id IS NOT NULL"), chunk_seconds=chunk).collect())
    assert got == [(1, "analytics", 107, 100), (1, "analytics", 151, 150), (1, "analytics", 9000, 9000), (1, "app", 100, 100), (1, "app", 150, 150), (1, "reports", 131, 100), (1, "reports", 155, 150),
                   (2, "app", 104, 104), (2, "app", 104, 104)]


def test_databases_read_seconds_apart_share_cluster_findings(spark):
    from vitalgrid.operators import runs

    snaps = spark.createDataFrame([(1, "app", 100, 11), (1, "analytics", 107, 12), (1, "app", 7300, 13), (1, "analytics", 7309, 14)], "cluster_id long, database string, collected_at long, snapshot_id long")
    f = spark.createDataFrame([(i, "fsync_off", "critical") for i in (11, 12, 14)] + [(12, "table_bloat", "warn"), (13, "table_bloat", "info")], "snapshot_id long, id string, severity string").withColumn("object", F.lit(""))
    placed = runs.cluster_runs(snaps).join(f, "snapshot_id")
    got = sorted((r["run"], r["database"], r["id"], r["cluster_scoped"]) for r in fleet.cluster_dedupe(placed).collect())
    assert got == [(100, "analytics", "fsync_off", True), (100, "analytics", "table_bloat", False), (7300, "analytics", "fsync_off", True), (7300, "app", "table_bloat", False)]
    healed = placed.where("NOT (run = 7300 AND id = 'fsync_off')")
    assert {r["run"]: r["verdict"] for r in fleet.cluster_gate(healed).collect()} == {100: 2, 7300: 0}
    facts = runs.cluster_runs(snaps).withColumns({"max_xid_age": F.col("collected_at"), "max_mxid_age": F.lit(1), "connections_used": F.lit(10)})
    assert {r["run"]: (r["connections_used"], r["databases"], r["max_xid_age"]) for r in sessions.cluster_limits(facts).collect()} == {100: (20, 2, 107), 7300: (20, 2, 7309)}


def test_plans_of_any_depth_are_walked(spark):
    import json

    from vitalgrid.operators import advice

    def scan(i):
        return {"Node Type": "Seq Scan", "Relation Name": f"t{i}", "Filter": f"(a{i} = $1)", "Total Cost": i + 0.5}

    def plan(depth):
        node = scan(depth)
        for i in reversed(range(depth)):
            node = {"Node Type": "Nested Loop", "Plans": [scan(i), node], "Total Cost": 7}
        return json.dumps([{"Plan": node}])

    plans = spark.createDataFrame([(1, 1, plan(0)), (1, 2, plan(3)), (1, 3, plan(20)), (1, 4, None), (1, 5, "no plan"), (1, 6, "[]")], "target_id long, queryid long, plan string")
    nodes = {(r["queryid"], r["is_root"]): (r["n"], r["c"]) for r in advice.plan_nodes(plans, "plan").groupBy("queryid", "is_root").agg(F.count("*").alias("n"), F.max("total_cost").alias("c")).collect()}
    assert nodes == {(1, True): (1, 0.5), (2, True): (1, 7.0), (2, False): (6, 7.0), (3, True): (1, 7.0), (3, False): (40, 20.5)}
    found = {r["table"] for r in advice.plan_candidates(plans.where("queryid = 3")).collect()}
    assert found == {f"t{i}" for i in range(21)}


def test_pairs_that_come_twice_count_once(spark):
    import json

    from vitalgrid.operators import advice

    before = json.dumps([{"Plan": {"Node Type": "Seq Scan", "Total Cost": 100.0}}])
    after = json.dumps([{"Plan": {"Node Type": "Index Scan", "Index Name": "ix", "Total Cost": 10.0}}])
    row = (1, 5, "public", "t", ["a"], "ix", before, after)
    pairs = spark.createDataFrame([row, row], "target_id long, queryid long, schema string, table string, columns array<string>, index_name string, plan_before string, plan_after string")
    got = advice.validate_candidates(pairs).collect()
    assert len(got) == 1 and got[0]["improvement_pct"] == 90.0


def test_ten_thousand_globs_of_one_id(spark):
    """Each object meets the globs that begin like it; what wins is what a plain search over all globs finds."""
    import fnmatch

    globs = [(i, "table_bloat", f"public.t{i % 5000}_{'*' if i % 2 else '?'}", f"r{i}", None) for i in range(10_000)] + [(10_001, "table_bloat", "*", "all", None), (10_002, "table_bloat", "public.[xy]*", "class", None)]
    rules = spark.createDataFrame(globs, "ordinal long, finding string, object string, reason string, expires string")
    objects = ["public.t7_a", "public.t7_abc", "public.t4999_", "public.x1", "public.none", "other", "public.t7", ""]
    df = spark.createDataFrame([(o, "table_bloat") for o in objects] + [("public.t7_a", "fsync_off")], "object string, id string")
    got = {(r["id"], r["object"]): r["match"] and (r["match"]["spec"], r["match"]["ordinal"]) for r in policy.match_rules(df, rules, "2026-01-01").collect()}
    for o in objects:
        hits = [g[0] for g in globs if o and fnmatch.fnmatchcase(o, g[2])]
        assert got["table_bloat", o] == ((2, min(hits)) if hits else None), o
    assert got["fsync_off", "public.t7_a"] is None
    assert [r[0] for r in spark.createDataFrame([("public.t*",), ("*x",), ("a\\*b",), ("plain",), ("a[b]c?",)], "p string").select(policy.literal_prefix("p")).collect()] == ["public.t", "", "a", "plain", "a"]


@pytest.mark.parametrize("budget", [1, 150, 500, 777, 5000])
def test_history_budget_within_one_second(spark, budget):
    """Many snapshots in one second: the cut falls among their ids."""
    rows = [(i, 1, 100 if i < 40 else 90_000 + i % 3, 10) for i in range(60)]
    df = spark.createDataFrame(rows, "snapshot_id long, target_id long, collected_at long, doc_bytes long")
    total = sum(r[3] for r in rows)
    evict = min(max(-(-60 * (total - budget * 9 // 10) // total), 1), 59) if total > budget else 0
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))[evict:]]
    assert sorted(r["snapshot_id"] for r in baseline.history_budget(df, budget).collect()) == sorted(want)


def test_long_lines_of_partitions(spark):
    edges = spark.createDataFrame([(1, 1, f"n{i}", f"n{i + 1}") for i in range(12)] + [(1, 1, "leaf", "n0"), (2, 1, "n1", "other")], "target_id long, snapshot_id long, child string, parent string")
    got = {(r["target_id"], r["child"]): r["root"] for r in catalog.partition_roots(edges).collect()}
    assert got == {**{(1, f"n{i}"): "n12" for i in range(12)}, (1, "leaf"): "n12", (2, "n1"): "other"}


def test_reports_in_order(spark):
    rows = [(1, 1, "s", "b", "needs_code_check", 10), (1, 1, "s", "a", "needs_code_check", 10), (1, 1, "s", "c", "inconclusive", 99), (1, 1, "s", "d", "catalog_proven", 1), (2, 1, "s", "e", "inconclusive", 1)]
    reports = spark.createDataFrame(rows, "target_id long, snapshot_id long, schema string, index string, grade string, size_bytes long")
    got = {(r["target_id"], r["index"]): r["place"] for r in evidence.report_order(reports).collect()}
    assert got == {(1, "d"): 1, (1, "a"): 2, (1, "b"): 3, (1, "c"): 4, (2, "e"): 1}


def test_findings_are_written_family_by_family(spark, monkeypatch):
    """The driver never plans the joins of all rules at once, and no finding is lost or doubled by that."""
    from vitalgrid.plans import families, workload
    from vitalgrid.sources.testbed import Testbed

    whole, joins = families.fleet_findings, []

    def planned(*a, **b):
        df = whole(*a, **b)
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return df

    monkeypatch.setattr(workload.FM, "fleet_findings", planned)
    bed = Testbed(spark, "/root/testdata/./sf0.001")
    found = workload._found(bed)
    assert max(joins) <= 25, joins
    header = ["target_id", "snapshot_id", "id", "object", "severity", "n_objects"]
    a, b = found.select(header), whole(bed).select(header)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 0
