"""The driver's three functions."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"component", "feature", "r", "delta"} <= set(df.columns)


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, tiny):
    from bilateral.plans import fixtures as fx

    plan = fx.table(spark, tiny, "events").where("user_id = 3").select("value")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan and "ReadSchema: struct<user_id:bigint,value:double>" in plan


def test_chained_windows_share_a_shuffle(spark, tiny):
    from bilateral.operators import rescale
    from bilateral.plans import fixtures as fx

    df = rescale.standardize(rescale.min_max(fx.positions(spark, tiny), ["usr", "side"]), ["usr", "side"], "scaled", "z")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1  # numbering the samples and all scaling
