"""Letters are taken apart once for a distinct name, not for each row."""

from skeinwork.operators import names as N


def test_letters_of_distinct_names_alone(spark):
    known = spark.range(100).selectExpr("concat('red ring ', id % 3) as name")
    typed = spark.range(2).selectExpr("concat('rad ring', id) as typed")
    plan = N.resolve(typed, known)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line and "array_sort" in line]
