"""Physical-plan checks: no Python in expression rows, pushdown, no cartesian."""

import pytest

import __spark_entry__ as E
from support import SF_SMALL

H_QUERIES = ["T5_top_terms", "T7_downsample_terms", "W1_leading_context", "C5_corrupt", "N1_candidates",
             "D3_group_split", "P5_margin_top_two", "M2_prf_per_class", "M9_pr_curve", "B1_balance_pairs",
             "A5_kappa_pairs", "X3_max_energy_window", "M8_baselines"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", H_QUERIES)
def test_no_python_and_no_cartesian(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_pushed_to_parquet(spark):
    plan = _plan(E.queries()["B3_real_examples"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,0)]" in plan


def test_column_pruning(spark):
    plan = _plan(E.queries()["T5_top_terms"](spark, SF_SMALL))
    assert "ReadSchema: struct<text:string>" in plan
