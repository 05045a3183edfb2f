"""Every query against its SQL on the smallest tables."""

import compare
import pytest

from skeinwork import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(QUERIES[name](spark, SF), SQL[name], con) == ""


def test_names_resolve(spark):
    got = {r.typed: r.name for r in QUERIES["resolve_filename"](spark, SF).collect()}
    assert got == {"small ring": "small ring", "Ring small": "small ring", "red widgett": "red widget", "nothing like it at all": None}
    assert {"red widget", "blue bolt"} <= {r.name for r in QUERIES["extract_entities"](spark, SF).collect()}


def test_names_of_all_parts(spark, tmp_path):
    parts = [(k, f"plain thing {k}") for k in range(1, 201)] + [(201, "red widget"), (90_000, "small ring")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.typed: r.name for r in QUERIES["resolve_filename"](spark, str(tmp_path)).collect()}
    assert got == {"small ring": "small ring", "Ring small": "small ring", "red widgett": "red widget", "nothing like it at all": None}
    assert "red widget" in {r.name for r in QUERIES["extract_entities"](spark, str(tmp_path)).collect()}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", ["multi_hop_imports", "inactive_users", "cleanup_failures", "ask_hybrid"])
def test_some_rows(spark, name):
    assert not QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty()
