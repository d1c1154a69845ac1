"""Registered queries against their SQL oracle. HARROW_ALL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
CORE = [
    "miqr_spikes", "sustained_run_guard", "acu_despike", "interpolate_linear", "forward_fill", "densify_daily",
    "scan_export_csv", "flatten_series_json", "scan_predictions", "sanitize_features", "join_exact_then_carry",
    "join_asof_backward", "join_inner_models", "join_tail_position", "resample_ohlcv_weekly", "pivot_measures",
    "fixed_histogram", "zero_inflation_stats", "lag_lead", "rolling_corr", "ewm_recursive", "run_length", "rsi",
    "cumulative_equity", "rank_fraction", "top_k_features", "parse_extract_json", "date_normalize",
    "label_multiclass_hard", "walkforward_windows", "expanding_cv_folds", "pack_windows", "minmax_scale_train",
    "ccf_static", "ccf_rolling", "pearson_p_value", "auc_roc", "auc_roc_pooled", "pr_auc", "best_f1_threshold",
    "backtest_compare", "signal_threshold", "ewm_adjusted", "macd", "permutation_draws", "sample_k", "scan_series_dir", "scan_bars_csv",
    "check_target_leak", "check_window_shapes", "stack_logistic", "job_coffee_report_features", "join_pred_returns", "join_align_hurdle",
    "walkforward_by_year", "bootstrap_sharpe_ci", "cost_sensitivity", "check_scaler_range",
    "job_fx_features", "job_cpi_features", "job_weather_features", "job_calendar_features",
]
NAMES = sorted(entry.queries()) if os.environ.get("HARROW_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem = oracle.compare(spark, con, name, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1
