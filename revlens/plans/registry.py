"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Every entry reads the driver's tables (whole tables, no sampling); entries
that materialise a step run it when they are called; the matching DuckDB SQL is in ``revlens.plans.oracle``.
"""

from __future__ import annotations

import functools
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.plans import (channels, customers, derived, geo, operator_queries, orders,
                           products, trend)
from revlens.sources.tables import sales_fact

Query = Callable[[SparkSession, str], DataFrame]


def _on_sales(report, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(sales_fact(spark, sf_dir, columns=report.reads), **params)
    run.__name__ = report.__name__
    run.__doc__ = report.__doc__
    run.__wrapped__ = functools.partial(report, **params) if params else report
    return run


REPORTS: dict[str, Query] = {
    "b01_monthly_trend": _on_sales(trend.monthly_trend),
    "b02_seasonality": _on_sales(trend.seasonality),
    "b03_top_products_revenue": _on_sales(products.top_products_by_revenue),
    "b04_top_products_margin": _on_sales(products.top_products_by_margin),
    "b05_channel_share": _on_sales(channels.channel_share),
    "b06_order_value_distribution": _on_sales(orders.order_value_distribution),
    "b07_customer_ranking": _on_sales(customers.customer_ranking),
    "b08_state_region_revenue": _on_sales(geo.state_region_revenue),
    "b09_channel_margin": _on_sales(channels.channel_margin),
    "b10_rfm_segmentation": _on_sales(customers.rfm_segmentation),
    "b10b_rfm_recency_quantiles": _on_sales(customers.rfm_segmentation,
                                            recency_bounds=(54, 125, 222, 398)),
    "b10c_rfm_high_is_best": _on_sales(customers.rfm_segmentation,
                                       score_direction="high_is_best"),
    "b11_customer_lifetime_value": _on_sales(customers.customer_lifetime_value),
    "b12_yoy_growth": _on_sales(products.yoy_growth),
    "b13_rolling_averages": _on_sales(trend.rolling_averages),
    "b14_channel_product_matrix": _on_sales(channels.channel_product_matrix),
    "b15_state_margin": _on_sales(geo.state_margin),
    "b16_month_year_pivot": _on_sales(trend.month_year_pivot,
                                     years=trend.DATA_PIVOT_YEARS),
    "b17_cost_efficiency": _on_sales(products.cost_efficiency),
    "b18_abc_pareto": _on_sales(products.abc_pareto),
}


DERIVED: dict[str, Query] = {
    "d1_headline_kpis": _on_sales(derived.headline_kpis),
    "d2_region_performance": _on_sales(derived.region_performance),
    "d3_rfm_segment_mix": _on_sales(derived.rfm_segment_mix),
    "d4_product_quadrants": _on_sales(derived.product_quadrants),
    "d5_below_mean_median": _on_sales(derived.below_mean_median),
    "d6_repeat_purchase": _on_sales(derived.repeat_purchase),
    "d7_abc_mix": _on_sales(derived.abc_mix),
}

_oq = operator_queries
OPERATORS: dict[str, Query] = {
    "j_star_enrich": _oq.star_enrich,
    "j06_fanout_check": _oq.fanout_check,
    "q06_unmatched_lookups": _oq.unmatched_lookups,
    "p06_simultaneous_rename": _oq.simultaneous_rename,
    "p07_budget_mask": _oq.budget_mask,
    "p12_bucketize": _oq.bucketize_orders,
    "f06_round_money": _oq.money_rounding,
    "f15_month_boundaries": _oq.month_span,
    "a07_safe_ratio": _oq.safe_ratio,
    "a08_pivot": _oq.pivot_api,
    "a11_median": _oq.order_value_quartiles,
    "w03_global_rank": _oq.global_rank,
    "w04_partitioned_rank": _oq.partitioned_rank,
    "w05_global_ntile": _oq.global_ntile,
    "w08c_range_cumsum": _oq.range_cumsum,
    "o02_topk": _oq.top_customers,
    "o03_preview": _oq.fact_preview,
    "q01_shape": _oq.shapes,
    "q02_nulls": _oq.nulls,
    "q03_duplicates": _oq.duplicates,
    "q04_schema": _oq.schema_info,
    "q05_validate": _oq.validation,
    "q05b_validate_bad_rows": _oq.bad_rows,
    "q06b_orphan_keys": _oq.orphan_keys,
    "j06b_dedupe_lookup": _oq.dedupe_lookup,
    "p01_promote_header": _oq.promoted_regions,
    "s01_sheets": _oq.sheet_catalogue,
    "s04_csv_round_trip": _oq.csv_round_trip,
}


def all_queries() -> dict[str, Query]:
    return {**REPORTS, **DERIVED, **OPERATORS}


def all_oracles() -> dict[str, str]:
    from revlens.plans.oracle import DERIVED_SQL, OPERATOR_SQL, REPORT_SQL
    return {**REPORT_SQL, **DERIVED_SQL, **OPERATOR_SQL}
