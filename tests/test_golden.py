"""The published run log (27 rows) through the analytics must give the published summary tables."""

import math
import os

import pandas as pd

from starlit.operators import analysis, runlog

HERE = os.path.join(os.path.dirname(__file__), "golden")


def load(spark):
    df = runlog.read_run_metrics_csv(spark, os.path.join(HERE, "all_pair_metrics_clean.csv"))
    return runlog.clean_run_log(df)


def expected(name):
    return pd.read_csv(os.path.join(HERE, f"{name}.csv"), encoding="utf-8-sig")


def same(got: pd.DataFrame, exp: pd.DataFrame, keys):
    assert sorted(got.columns) == sorted(exp.columns)
    got = got.sort_values(keys).reset_index(drop=True)
    exp = exp.sort_values(keys).reset_index(drop=True)
    assert len(got) == len(exp)
    for c in exp.columns:
        for a, b in zip(got[c], exp[c]):
            if isinstance(b, float):
                assert math.isclose(float(a), b, rel_tol=1e-12, abs_tol=1e-12), (c, a, b)
            else:
                assert a == b, (c, a, b)


def test_clean_rows(spark):
    assert load(spark).count() == 27


def test_best_pair_by_dataset(spark):
    same(analysis.best_pair_by_dataset(load(spark)).toPandas(), expected("best_pair_by_dataset"), ["dataset"])


def test_best_pair_by_method(spark):
    same(analysis.best_pair_by_method(load(spark)).toPandas(), expected("best_pair_by_processing_method"),
         ["dataset", "processing_method"])


def test_processing_summary(spark):
    same(analysis.processing_summary(load(spark)).toPandas(), expected("processing_method_summary"),
         ["dataset", "processing_method"])


def test_visualization_summary(spark):
    same(analysis.visualization_summary(load(spark)).toPandas(), expected("visualization_method_summary"),
         ["dataset", "visualization_method"])


def test_pair_ranking(spark):
    got = analysis.pair_ranking(load(spark)).toPandas()
    same(got, expected("pair_ranking"), ["rank"])


def test_report_lines(spark):
    lines = {(r.section, r.ord): r for r in analysis.report_lines(load(spark)).collect()}
    assert lines[("overall_best", 1)].subject == "pandas + dash"
    assert math.isclose(lines[("overall_best", 1)].seconds, 0.146792, rel_tol=1e-9)
    assert [lines[("best_pair", i)].detail for i in (1, 2, 3)] == ["pandas + plotly", "pandas + dash", "pandas + dash"]
    assert {lines[("fastest_processing", i)].detail for i in (1, 2, 3)} == {"pandas"}
    assert [lines[("visualization", i)].subject for i in (1, 2, 3)] == ["dash", "plotly", "matplotlib"]
