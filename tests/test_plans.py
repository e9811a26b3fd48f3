"""Physical plan shape: exchanges, pushdown, no Python in the lightcurve."""

from starlit.plans import lightcurve
from starlit.plans.queries import QUERIES
from starlit.schema import Params
from starlit.sources import adapters

from core_data import SF_SMALL

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def main_plan(df):
    """Executed plan without the subquery subtrees."""
    lines = plan_text(df).splitlines()
    return "\n".join(l for l in lines if not l.lstrip(" +-:").startswith(":") and ":  " not in l)


def test_point_pipeline_one_exchange(spark):
    df = lightcurve.process(adapters.observations(spark, SF_SMALL), "obs", "point", Params(bin_width=0.5))
    text = main_plan(df)
    assert text.count("Exchange hashpartitioning") == 1
    assert not any(p in plan_text(df) for p in PYTHON_NODES)


def test_bin_pipeline_one_exchange(spark):
    df = lightcurve.process(adapters.observations(spark, SF_SMALL), "obs", "bin", Params(bin_width=0.5))
    assert main_plan(df).count("Exchange hashpartitioning") == 1
    assert not any(p in plan_text(df) for p in PYTHON_NODES)


def test_scan_pushdown_and_pruning(spark):
    text = plan_text(QUERIES["scan_parquet"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,50.0)]" in text
    assert "props" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_pipeline_reads_only_needed_columns(spark):
    df = lightcurve.process(adapters.observations(spark, SF_SMALL), "obs", "point", Params(bin_width=0.5))
    for line in plan_text(df).splitlines():
        if "ReadSchema" in line:
            assert "props" not in line


def test_report_lines_scan_the_log_once(spark):
    df = QUERIES["report_lines"](spark, SF_SMALL)
    assert plan_text(df).count("FileScan") == 1
    for key in ("pair_ranking", "fastest_method", "best_pair_by_dataset", "processing_summary"):
        text = plan_text(QUERIES[key](spark, SF_SMALL))
        assert text.count("FileScan") == 1
