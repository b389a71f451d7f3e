import pytest
from pyspark.sql import functions as F

from vitalgrid.functions import guc, numbers, text
from vitalgrid.operators.policy import bad_glob, glob_regex


def values(spark, items, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


def test_scrub_removes_literals_and_keeps_placeholders(spark):
    got = values(spark, [
        "SELECT * FROM u WHERE mail = 'a@b.com' AND id = 42", "UPDATE t SET x = $1 WHERE y = $12", "ALTER ROLE a PASSWORD 'it''s' x",
        "DO $$ BEGIN PERFORM 1; END $$;", "DO $tag$ secret $tag$", "-- mail me at joe.x+1@corp.example.org now", "id = 123e4567-e89b-12d3-a456-426614174000",
        "limit 10 offset 2.5", "col1 = t2.c3", "'a' 'b'", "unclosed 'abc 12", "", "'a''b''c"], text.scrub_statement)
    assert got == ["SELECT * FROM u WHERE mail = '?' AND id = ?", "UPDATE t SET x = $1 WHERE y = $12", "ALTER ROLE a PASSWORD '?' x",
                   "DO $REDACTED$;", "DO $REDACTED$", "-- mail me at ? now", "id = ?", "limit ? offset ?", "col1 = t2.c3", "'?' '?'", "unclosed 'abc ?", "", "'?''c"]


def test_scrub_handles_very_long_texts(spark):
    long = "SELECT '" + "x''" * 50_000 + "' , " + "word " * 50_000
    assert values(spark, [long], text.scrub_statement)[0].startswith("SELECT '?' , word")


def test_connection_strings(spark):
    got = values(spark, ["postgres://u:p@h/db", "postgres://u@h/db", "host=h password=x user=y", "PASSWORD = 'a b' z", ""], text.redact_conn_string)
    assert got == ["postgres://u:REDACTED@h/db", "postgres://u@h/db", "host=h password=REDACTED user=y", "PASSWORD = REDACTED z", ""]


def test_session_noise(spark):
    got = values(spark, ["set x", "  BEGIN", "settle accounts", "SELECT 1", "select * from PG_STAT_STATEMENTS", "start transaction", "startle"], text.workload_statement)
    assert got == [False, False, True, True, False, False, True]


def test_plannable_selects(spark):
    got = values(spark, [" select 1; ", "selection", "select 1; drop x", "with a as (select 1) select 1", "SELECT", "", None], text.plain_select)
    assert got == ["select 1", None, None, None, "SELECT", None, None]


def test_durations(spark):
    got = values(spark, ["5min", "1h 30min", "30s", "0", "7", "-1", "+2ms", "1h30min", "5 min", "abc", "", "5x", "1d", "10us", " 3s "], lambda c: guc.duration_micros(c, "s"))
    s = 1_000_000
    assert got == [300 * s, 5400 * s, 30 * s, 0, 7 * s, -1 * s, 2000, 5400 * s, None, None, None, None, 86_400 * s, 10, 3 * s]
    assert values(spark, ["7"], lambda c: guc.duration_micros(c, "ms")) == [7000]


def test_memory(spark):
    got = values(spark, ["4MB", "8192kB", "1GB", "2tb", "16 B", "100", "1.5GB", "x", "", "-1"], guc.memory_bytes)
    assert got == [4 << 20, 8192 << 10, 1 << 30, 2 << 40, 16, 100, None, None, None, -1]


def test_values_that_do_not_fit_are_unknown(spark):
    assert values(spark, ["999999999999999999TB", "99999999999999999999"], guc.memory_bytes) == [None, None]
    assert values(spark, ["999999999999999999d", "99999999999999999999s"], lambda c: guc.duration_micros(c, "s")) == [None, None]


def test_required_standbys(spark):
    got = values(spark, ["", "  ", "s1", "s1, s2", "2 (a, b)", "3(a,b)", "ANY 2 (a, b)", "FIRST 3 (a)", "any", "ANY x", "first 0 (a)", None], guc.required_standbys)
    assert got == [0, 0, 1, 1, 2, 3, 2, 3, 1, 1, 1, 0]


def test_switched_off(spark):
    assert values(spark, ["off", "FALSE", "0", "no", "on", "true", None, ""], guc.switched_off) == [True, True, True, True, False, False, False, False]


def test_size_score_ends(spark):
    got = values(spark, [0, -5, 10**6, 10**11, 10**12, 10**5, 10**8], numbers.size_score, "bigint")
    assert got[:2] == [0.0, 0.0] and got[2] == 0.0 and got[3] == 100.0 and got[4] == 100.0 and got[5] == 0.0
    assert got[6] == pytest.approx(40.0)


def test_rounding_and_ratios(spark):
    assert values(spark, [0.12345, 2.5, -0.00005], lambda c: numbers.round_dp(c, 4), "double") == [0.1235, 2.5, -0.0001]
    assert values(spark, [0, 4], lambda c: numbers.ratio(F.lit(2), c), "bigint") == [None, 0.5]
    assert values(spark, [0, 10], lambda c: numbers.pct_change(c, F.lit(15)), "bigint") == [None, 0.5]


def test_human_figures(spark):
    assert values(spark, [0, 999, 1000, 1_250_000, 2_500_000_000], text.human_count, "bigint") == ["0", "999", "1.0k", "1.2M", "2.5G"]
    assert values(spark, [0, 1023, 1024, 10_496, 5 << 20, 3 << 40], text.human_bytes, "bigint") == ["0 B", "1023 B", "1.0 KiB", "10.2 KiB", "5.0 MiB", "3.0 TiB"]
    assert values(spark, [5, 90, 5400, 200_000], text.short_duration, "bigint") == ["5s", "2m", "2h", "2d"]
    assert values(spark, [-1, 3661, 90_061], text.clock_duration, "bigint") == ["00:00:00", "01:01:01", "1d 01:01:01"]
    assert values(spark, [0, 255, 65_536 + 10, -1], text.query_tag, "bigint") == ["0000", "00ff", "000a", "ffff"]


def test_truncate_and_collapse(spark):
    assert values(spark, ["héllo wörld", "abc"], lambda c: text.truncate(c, 6)) == ["héllo…", "abc"]
    assert values(spark, ["  a \n\t b "], text.collapse_ws) == ["a b"]


def test_first_ten(spark):
    df = spark.createDataFrame([(list("abcdefghijkl"),), (list("ab"),)], "a array<string>")
    got = [r[0] for r in df.select(text.first_ten("a")).collect()]
    assert got == [list("abcdefghij") + ["…"], ["a", "b"]]


def test_identifier_spellings(spark):
    def terms(name):
        df = spark.createDataFrame([([name],)], "c array<string>")
        return df.select(text.search_terms("c")).first()[0]
    assert terms("externalIdNormalized") == ["externalIdNormalized", "external_id_normalized", "ExternalIdNormalized", "EXTERNAL_ID_NORMALIZED"]
    assert terms("customer_id") == ["customer_id", "customerId", "CustomerId", "CUSTOMER_ID"]
    assert terms("___") == ["___"]
    assert terms("status") == ["status", "Status", "STATUS"]
    assert terms("HTTPServer2Go") == ["HTTPServer2Go", "httpServer2Go", "http_server2_go", "HttpServer2Go", "HTTP_SERVER2_GO"]


def test_object_names(spark):
    names = ["", "public.users", "12345", "1.2", "slot:s", "slot:", "setting:fsync", "sub:x", "q:1", "db:a", "plain"]
    assert values(spark, names, text.stable_object) == [True, True, False, False, True, False, True, True, True, True, False]
    assert values(spark, names, text.object_class) == ["cluster", "relation", "cluster", "relation", "slot", "slot", "setting", "sub", "query", "db", "cluster"]


def test_identity_parts(spark):
    got = values(spark, ["s.t.i", "s.a.b.i", "s.i", "i"], text.identity_parts)
    assert [tuple(x) for x in got] == [("s", "t", "i"), ("s", "a.b", "i"), ("s", "", "i"), ("", "", "i")]


def test_quoting(spark):
    assert values(spark, ["ok_1", "Bad", 'q"x', "1a"], text.quote_ident) == ["ok_1", '"Bad"', '"q""x"', '"1a"']


def test_recount_title(spark):
    assert values(spark, ["12 things", "no number", "3"], lambda c: text.recount_title(c, F.lit(2))) == ["2 things", "no number", "2"]


def test_metric_label(spark):
    assert values(spark, ['a"b\\c\nd'], text.metric_label) == ['a\\"b\\\\c\\nd']


@pytest.mark.parametrize("pattern,name,hit", [
    ("public.*", "public.users", True), ("public.*", "public.a/b", False), ("public.t?", "public.t1", True), ("public.t?", "public.t12", False),
    ("public.t[1-3]", "public.t2", True), ("public.t[^1-3]", "public.t2", False), ("a.b", "axb", False), ("slot:*", "slot:x", True), ("*", "", True),
    ("a+b", "a+b", True), ("a(b)|c", "a(b)|c", True), ("x\\*", "x*", True), ("x\\*", "xy", False), ("[*]", "*", True), ("[*]", "a", False)])
def test_globs(spark, pattern, name, hit):
    df = spark.createDataFrame([(pattern, name)], "p string, n string")
    assert df.select(F.regexp_like("n", glob_regex("p"))).first()[0] is hit


def test_bad_globs(spark):
    assert values(spark, ["[a", "a[", "ok[a]", "ok*", "x\\", "x\\\\"], bad_glob) == [True, True, False, False, True, False]


def test_capacity(spark):
    df = spark.createDataFrame([("int2", 2**63 - 1), ("int4", 2**63 - 1), ("int4", 100), ("int8", 50)], "t string, m long")
    assert [r[0] for r in df.select(numbers.effective_ceiling("m", "t")).collect()] == [32767, 2147483647, 100, 50]
    assert values(spark, [0, 50], lambda c: numbers.progress_pct(F.lit(10), c), "bigint") == [None, 20.0]
