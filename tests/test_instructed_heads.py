"""The heads of the outlines are made once for all rules."""

from folioframe.plans import proofs


def test_rules_read_no_order_lines_again(spark):
    for frame in proofs._instructed(spark, "/root/testdata/sf0.001"):
        assert "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()
