"""Numbers with a fixed number of decimals against DuckDB's printf."""

import compare
import pytest
from pyspark.sql import functions as F

from skeinwork import catalogue
from skeinwork.functions import text as T


def test_ties_of_sums(spark, tmp_path):
    sums = [999, 1000, 1049, 1050, 1150, 1250, 1350, 1750, 1950, 1999, 99_950, 2_350_050]
    rows = [(i, f"Brand#{n}", n) for i, n in enumerate(sums)] + [(99, "none", None)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert compare.differences(catalogue.queries()["stat_format"](spark, str(tmp_path)), catalogue.oracle_sql()["stat_format"], con) == ""


@pytest.mark.parametrize("places", [1, 4])
def test_as_printf(spark, places):
    xs = [0.0, -0.0, 0.5, 0.25, -0.75, 1.15, 2.5, 0.99995, 0.12345, 0.00005, -0.00001, 0.03125, 1e15 + 0.25, *(k / 32 for k in range(64)), *(k / 20000 for k in range(1, 2000, 7))]
    got = [r.s for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(T.fixed(F.col("x"), places).alias("s")).collect()]
    assert got == [f"{x:.{places}f}" for x in xs]
