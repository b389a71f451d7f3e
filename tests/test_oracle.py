"""Every named query against its SQL statement."""

import pytest

import __spark_entry__ as entry_module
from oracle.compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES = dict(entry_module.QUERIES)
SQL = entry_module.statements()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    n, m, messages = differences(QUERIES[name](spark, SF), con, SQL[name])
    assert not messages, messages
    assert n == m


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["target_id", "snapshot_id", "health_score", "ordinal", "id", "severity", "score", "confidence", "title"]
    assert df.count() > 0


def test_entry_reads_all_families(spark):
    """As many findings of each rule as all families give; rules of tables, indexes, slots and sequences among them."""
    from vitalgrid.plans.families import FAMILIES, fleet_findings
    from vitalgrid.sources.testbed import Testbed

    counts = lambda df: {r["id"]: r["count"] for r in df.groupBy("id").count().collect()}
    got = counts(entry_module.entry(spark))
    bed = Testbed(spark, SF)
    want: dict = {}
    for family in FAMILIES:
        for name, n in counts(fleet_findings(bed, families=[family])).items():
            want[name] = want.get(name, 0) + n
    assert got == want
    assert sum(bool(set(got) & set(ids)) for ids in FAMILIES.values()) > 3
