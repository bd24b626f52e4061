import importlib

import pytest

SF = "/root/testdata/sf0.001"


def test_entry_runs_with_stable_schema(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() >= 0
    assert {"quantile_level", "quantile", "value", "model", "n"} <= set(df.columns)


def test_every_oracle_has_a_query_and_names_are_unique():
    entry = importlib.import_module("__spark_entry__")
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    missing = {n for n in set(qs) - set(sql) if not n.startswith("op") and n != "pipeline"}
    assert not missing


def test_every_line_item_is_projected_or_observed(spark):
    from trajens.sources import testdata as T
    lines = T.read(spark, SF, "lineitem").count()
    deaths = T.projections_raw(spark, SF).where("target_variable = 'inc death'").agg({"value": "sum"}).first()[0]
    seen = T.truth_daily(spark, SF).where("target_variable = 'inc death'").agg({"value": "sum"}).first()[0]
    assert round(deaths + seen * T.SHARE) == lines


def test_projections_are_not_shuffled_on_series_keys(spark):
    from trajens.plans import domain as D
    plan = D.results(spark, SF)._jdf.queryExecution().executedPlan().toString()
    series = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line
              and line.split("hashpartitioning(")[1].count("#") == 2 and "target_variable" in line and "location" in line]
    # the only exchange on (location, target_variable) alone is that of the small truth table
    assert len(series) <= 2 and "BroadcastHashJoin" in plan
    # line items are aggregated once; only the season's dates are read again, one column
    assert "l_orderkey" not in plan and "l_quantity" not in plan


def test_population_must_be_unique_per_series(spark):
    import pytest as _pytest

    from trajens.operators import prepare as P
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "x", 3.0)], "location string, target_variable string, population double")
    with _pytest.raises(Exception, match="more than one row"):
        P.one_per_key(df, ["location", "target_variable"]).collect()
    assert P.one_per_key(df.where("population <> 2"), ["location", "target_variable"]).count() == 2


@pytest.mark.parametrize("name", ["weekly_truth", "min_model_filter", "detect_peaks",
                                  "contributors", "path_parse"])
def test_query_smoke(spark, name):
    entry = importlib.import_module("__spark_entry__")
    df = entry.queries()[name](spark, SF)
    assert df.count() >= 0
