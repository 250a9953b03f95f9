"""References without targets are counted before they are looked up."""

from folioframe.operators import rules


def test_dangling(spark):
    refs = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,), (None,)], "k long")
    got = rules.dangling(refs, spark.createDataFrame([(1,), (1,), (3,), (None,)], "k long"), "k")
    assert {tuple(r) for r in got.collect()} == {(2, 2), (None, 2)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("count(1)")
