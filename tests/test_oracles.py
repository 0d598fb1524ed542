"""Registered queries against their SQL on the smallest tables.

A selection over all parts by default; FACTORLAKE_ALL=1 runs every query.
"""

import os

import pytest
from oracle import compare

from factorlake.plans import load

REG = load()
SOME = """ts_shift ts_return_padded ts_ewm cs_pct_rank case_momentum_vol factor_shift forward_return forward_return_blocks
pooled_ic daily_ic ic_summary layered_ic pair_spearman factor_analyze batch_dedup marginal_gate composite_build oos_composite
review_metrics label_candidates factor_store_status archive_event lake_query lake_compact gap_ranges_edges bars_resample
adj_factor_prepare adj_factor_compat health_stats trade_report drawdown holding_stats pnl_histogram return_curve risk_table
relative_equity minute_grid_ffill topk_portfolio signal_backtest library_size branch_rank error_report_extract
direction_report_extract trajectory_flatten merge_unique plateau_fold_strategy plateau_fold_signal history_scan
storage_stats health_recommend lake_compact_status direction_metadata bars_resample_mixed gap_fill gap_windows min_daily_names daily_topk panel_segments slot_run ts_udf cs_udf rolling_rank_ic_chunks rank_ic_single eval_frame_daily stream_bars stream_gap_alert""".split()


@pytest.mark.parametrize("name", sorted(REG.ORACLES) if os.environ.get("FACTORLAKE_ALL") else SOME)
def test_query_equals_sql(spark, duck, sf, name):
    assert compare(REG.QUERIES[name](spark, sf), duck, REG.ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(REG.ORACLES) <= set(REG.QUERIES)
    assert set(REG.QUERIES) - set(REG.ORACLES) == {
        "admit_candidates",
        "augmented_uplift",
    }


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
