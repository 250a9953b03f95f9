"""Instructions against their paragraphs, without a join of paragraphs with themselves."""

from folioframe.operators import outline
from folioframe.plans import catalogue


def test_index_faults_by_hand(spark):
    rows = [(1, 0, "a", 2, "[x"), (1, 0, "b", 2, "[x"), (1, 2, "a", 2, "  "), (1, 3, "a", 2, None), (1, 3, "a", 2, None), (2, 0, "c", 2, "y")]
    got = outline.index_faults(spark.createDataFrame(rows, "doc_id int, at int, style string, last int, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "excluded"), (1, 0, "excluded"), (1, 0, "two_styles"), (1, 2, "blank"), (1, 3, "out_of_range"), (1, 3, "out_of_range")]
    told = outline.with_text_at(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "d"), (2, 1, "z")], "doc_id int, paragraph_index long, text string"), 2, "there", "last")
    assert sorted(map(tuple, told.select("doc_id", "paragraph_index", "there", "last").collect())) == [(1, 0, None, 3), (1, 1, "d", 3), (1, 3, None, 3), (2, 1, None, 1)]


def test_one_join(spark):
    plan = catalogue.QUERIES["instruction_violations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "REPARTITION_BY_NUM" in plan
