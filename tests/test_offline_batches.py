"""Answers are asked for in small batches of rows, not in those of a pandas function."""

from lattica.operators import assist


def test_plain_function(spark):
    got = assist.answers(spark.createDataFrame([("a",), (None,)], "prompt string"), lambda p: f"<{p}>")
    assert "BatchEvalPython" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.answer for r in got.collect()} == {"<a>", "<None>"}
