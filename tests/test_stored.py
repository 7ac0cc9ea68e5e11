"""Tables that a plan names several times are worked out once."""

from pyspark.sql import functions as F

from rulemeter.operators import isomorphs as N
from rulemeter.operators import programs as P
from rulemeter.plans import exam, programs, rollups


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def test_isomorphs_do_not_double_their_plan_with_each_round(spark):
    items = spark.createDataFrame([(i, [("A", f"{i + 10}"), ("B", f"{i + 20}.5")]) for i in range(20)], "id long, options array<struct<letter:string,text:string>>")
    t = N.isomorphs(items)
    assert leaves(t) <= 4  # the scan and three rounds
    assert t.filter(F.col("state") == "redrawn").count() == 20


def test_a_search_walks_over_stored_features(spark, monkeypatch):
    seen, fit = [], P.fit_search
    monkeypatch.setattr(P, "fit_search", lambda train, *a: seen.append(leaves(train)) or fit(train, *a))
    assert programs.search_fit(spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [1, 1]


def test_queries_that_read_the_trials_several_times_work_them_out_once(spark):
    for query in (exam.QUERIES["census_cells"], exam.QUERIES["census_comparisons"], exam.QUERIES["eligible_bypass"], rollups.trial_marks, rollups.paired_programs):
        assert "l_orderkey" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
