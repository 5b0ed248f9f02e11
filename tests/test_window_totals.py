from __spark_entry__ import queries


def test_windows_of_a_day_gather_no_samples(spark):
    plan = queries()["k02_timed_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "sum(" in plan
