"""Documents: arrays of any size, landing that can be repeated, rejects."""

import json
import random

from vitalgrid import Fleet
from vitalgrid.sources import contexts as X
from vitalgrid.sources.arrays import array_elements


def _odd_documents(n, seed):
    rng = random.Random(seed)
    tricky = ['{', '}', '[', ']', '"', '\\', ', {"a": 1}', '\\"{', "é{", "\n", "{{{", "}]}"]
    def value(depth):
        kind = rng.randrange(5 if depth < 4 else 2)
        if kind == 0:
            return "".join(rng.choice(tricky) for _ in range(rng.randrange(6)))
        if kind == 1:
            return rng.choice([None, 1, True, {}, []])
        if kind == 2:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {f"k{i}{rng.choice(tricky)}": value(depth + 1) for i in range(rng.randrange(4))}
    return [{"n": i, "v": value(0), "s": "x" * rng.randrange(60)} for i in range(n)]


def _elements(spark, path):
    return sorted((json.loads(r["element"]) for r in array_elements(spark, path).collect()), key=lambda d: d["n"])


def test_arrays_are_read_in_splits(spark, tmp_path):
    """Every border falls somewhere in a document, in strings and at braces as well."""
    docs = _odd_documents(400, 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(docs[:300]))
    (tmp_path / "in" / "two.json").write_text(json.dumps(docs[300:399], indent=1, ensure_ascii=False))
    (tmp_path / "in" / "single.json").write_text(json.dumps(docs[399]))
    (tmp_path / "in" / "none.json").write_text("[]")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in (97, 1000, 10_000_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert _elements(spark, str(tmp_path / "in")) == docs
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        one = spark.read.option("lineSep", "{").text(str(tmp_path / "in" / "one.json"))
        assert one.rdd.getNumPartitions() > 10  # one file, many tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _document(fingerprint, day, **more):
    return {"schema_version": "1.2.0", "fingerprint": fingerprint, "collected_at": f"2026-01-{day:02d}T00:00:00Z", "settings": {"params": {"fsync": "off"}}, **more}


def test_landing_twice_is_landing_once(spark, tmp_path):
    first = [_document("a", 1), _document("a", 2), _document("b", 1), {k: v for k, v in _document("c", 1).items() if k != "fingerprint"}]
    second = [*first, _document("b", 2), _document("b", 2, queries={"enabled": True}), {"schema_version": "1.2.0", "fingerprint": "d"}]
    landing = str(tmp_path / "landed")
    for name, docs in (("one", first), ("again", first), ("more", second), ("more", second)):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "a.json").write_text(json.dumps(docs))
        fl = Fleet(spark).from_contexts(str(tmp_path / name), landing)
    keys = sorted((r["fingerprint"], r["collected_at"].day, r["queries"] is not None) for r in fl.documents.collect())
    assert keys == [("a", 1, False), ("a", 2, False), ("b", 1, False), ("b", 2, True)]
    found = fl.findings(only=["fsync_off"])
    assert found.count() == 4 and found.where("target_id IS NULL").count() == 0
    assert sorted(r["reason"] for r in X.rejected_contexts(spark, landing).collect()) == ["no collection time", "no fingerprint"]


def test_sections_of_later_layouts(spark, tmp_path):
    doc = _document("a", 1, delta_suppressed_reason="stats_reset", config_warnings=["w"], events=[{"kind": "config.changed", "object": "fsync", "before": "on", "after": "off"}])
    (tmp_path / "d.json").write_text(json.dumps([doc]))
    docs = X.read_contexts(spark, str(tmp_path / "d.json"))
    row = docs.select("delta_suppressed_reason", "config_warnings").first()
    assert (row[0], row[1]) == ("stats_reset", ["w"])
    assert [(r["kind"], r["after"]) for r in X.section_rows(docs, "events").collect()] == [("config.changed", "off")]


def test_documents_of_tables_give_the_tables_findings(spark, tmp_path):
    """Written, read again, graded: the same findings, and no list without bound."""
    from pyspark.sql import functions as F

    from vitalgrid.plans import families, rules
    from vitalgrid.sources.assemble import assemble, write_documents

    day = 86_400
    tables = spark.range(12).select(F.lit(7).cast("long").alias("target_id"), F.lit(day).cast("long").alias("snapshot_id"), F.lit("public").alias("schema"), F.concat(F.lit('t"'), "id").alias("table"),
                                    (F.col("id") * 10 ** 9).alias("total_bytes"), F.lit(100_000).cast("long").alias("live_tuples"), F.lit(50_000).cast("long").alias("dead_tuples"),
                                    *[F.lit(5).cast("long").alias(n) for n in ("seq_scans", "index_scans", "mods_since_analyze", "updates", "hot_updates")],
                                    *[F.lit(1).cast("long").alias(n) for n in ("last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze")])
    slots = spark.createDataFrame([(7, day, "s1", False, "lost", 0)], "target_id long, snapshot_id long, name string, active boolean, wal_status string, retained_bytes long")
    params = spark.createDataFrame([(7, day, "fsync", "off"), (8, day, "fsync", "on")], "target_id long, snapshot_id long, name string, value string")
    heads = spark.createDataFrame([(7, day, day), (8, day, day), (9, day, day)], "target_id long, snapshot_id long, collected_at long")
    docs = assemble(heads, {"table_stats": tables, "slots": slots, "params": params}, limit=10)
    whole = {r["target_id"]: json.loads(r["document"]) for r in docs.collect()}
    assert len(whole[7]["tables"]["top"]) == 10 and whole[7]["truncated"] == {"tables.top": 12} and whole[7]["tables"]["top"][0]["table"] == 't"11'
    assert set(whole[9]) == {"schema_version", "fingerprint", "collected_at"} and whole[8]["settings"] == {"params": {"fsync": "on"}}
    write_documents(assemble(heads, {"table_stats": tables, "slots": slots, "params": params}), str(tmp_path / "out"))
    got = Fleet(spark).from_contexts(str(tmp_path / "out"), str(tmp_path / "landed"), lines=True).findings(only=["table_bloat", "replication_slot_inactive", "fsync_off"])
    assert {(r["target_id"], r["id"], r["object"], r["n_objects"]) for r in got.collect()} == {("7", "table_bloat", "", 12), ("7", "replication_slot_inactive", "slot:s1", 0), ("7", "fsync_off", "setting:fsync", 0)}
    plain = rules.row_findings(families.table_evidence(Fleet(spark).from_tables({"table_stats": tables.withColumns({n: F.lit(None).cast("double") for n in (
        "rel_vacuum_threshold", "rel_vacuum_scale", "rel_analyze_threshold", "rel_analyze_scale")}).withColumn("rel_autovacuum_enabled", F.lit(None).cast("string"))}).source))
    assert {(r["id"], r["score"]) for r in plain.collect()} == {(r["id"], r["score"]) for r in got.where("id = 'table_bloat'").collect()}


def test_documents_hold_all_entries_of_a_snapshot(spark, tmp_path):
    from pyspark.sql import functions as F

    from vitalgrid.sources.assemble import assemble, write_documents

    slots = spark.range(1203).select(F.lit(7).cast("long").alias("target_id"), F.lit(86_400).cast("long").alias("snapshot_id"), F.concat(F.lit("s"), "id").alias("name"),
                                     F.lit(False).alias("active"), F.lit("lost").alias("wal_status"), F.col("id").alias("retained_bytes"))
    heads = spark.createDataFrame([(7, 86_400, 86_400)], "target_id long, snapshot_id long, collected_at long")
    docs = assemble(heads, {"slots": slots})
    whole = json.loads(docs.first()["document"])
    assert [s["retained_bytes"] for s in whole["replication"]["slots"]] == list(range(1202, -1, -1)) and "truncated" not in whole
    write_documents(docs, str(tmp_path / "out"))
    got = Fleet(spark).from_contexts(str(tmp_path / "out"), str(tmp_path / "landed"), lines=True).findings(only=["replication_slot_inactive"])
    assert {r["object"] for r in got.collect()} == {f"slot:s{i}" for i in range(1203)}


def test_guards_follow_the_state(spark):
    from vitalgrid.plans.exports import scan_results
    from vitalgrid.plans.records import MEANING, finding_records, record_guards
    from vitalgrid.plans.rule_catalog import KNOWN_IDS

    assert set(MEANING) == set(KNOWN_IDS)
    f = spark.createDataFrame([(1, 1, "index_invalid", "critical"), (1, 2, "index_invalid", "warn"), (1, 1, "fsync_off", "critical"), (1, 1, "checksum_failures", "critical")],
                              "target_id long, snapshot_id long, id string, severity string").selectExpr("*", "'' AS object", "'t' AS title", "50.0D AS score", "'risk' AS dimension")
    context = spark.createDataFrame([(1, 2, True)], "target_id long, snapshot_id long, build_running boolean")
    rows = spark.createDataFrame([(1, 1, "index_invalid", 2048), (1, 1, "index_invalid", 2048), (1, 1, "checksum_failures", 3)], "target_id long, snapshot_id long, id string, size long")
    records = finding_records(f, rows, context)
    got = {(r["snapshot_id"], r["guard_id"]): (r["kind"], r["verify"] is None) for r in record_guards(records).collect()}
    assert got == {(1, "invalid_index.no_build_running"): ("precondition", False), (2, "invalid_index.build_in_progress"): ("prohibition", True),
                   (1, "checksum.no_vacuum_full"): ("prohibition", True), (1, "checksum.no_reindex"): ("prohibition", True)}
    one = {(r["snapshot_id"], r["id"]): r for r in records.collect()}
    assert one[1, "index_invalid"]["impact"]["estimate"] == "2 listed, 4.0 KiB in all" and one[1, "checksum_failures"]["impact"]["estimate"] == "3 failures"
    assert one[1, "fsync_off"]["impact"]["estimate"] == "t" and one[1, "fsync_off"]["cluster_scoped"] and not one[1, "index_invalid"]["cluster_scoped"]
    text = {(r["snapshot_id"], r["rule_id"]): r["message"] for r in scan_results(records).collect()}
    assert "precondition" in text[1, "index_invalid"] and "prohibition" in text[2, "index_invalid"] and "SAFETY" not in text[1, "fsync_off"]
