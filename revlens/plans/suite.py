"""The whole report catalogue with each grain aggregated once.

Run one report at a time and every report aggregates the fact again: the
per-customer reports each repeat the two-level ``COUNT(DISTINCT order)``
shuffle.  ``run_reports`` instead aggregates the fact to two bases (orders;
products x channels x years), rolls these up to the grains (month, product x
year, customer, channel x product, state x region, order), checkpoints each
in the shared checkpoint folder, and derives every report from its grain —
two passes over the fact for 27 reports.  The results are identical to the
single-report functions (tests/test_suite.py).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterable

from pyspark.sql import DataFrame

from revlens.operators.ordered import materialize
from revlens.plans import channels, customers, derived, geo, orders, products, trend
from revlens.plans.grains import BASES, GRAINS

# report key -> (grains it reads, builder(grain tables, finished reports) -> DataFrame)
Builder = Callable[[dict, dict], DataFrame]
CATALOGUE: dict[str, tuple[tuple[str, ...], Builder]] = {
    "b01_monthly_trend": (("month",), lambda g, r: trend.monthly_trend_from(g["month"])),
    "b02_seasonality": (("month",), lambda g, r: trend.seasonality_from(g["month"])),
    "b03_top_products_revenue": (("product_year",), lambda g, r:
                                 products.top_products_by_revenue_from(g["product_year"])),
    "b04_top_products_margin": (("product_year",), lambda g, r:
                                products.top_products_by_margin_from(g["product_year"])),
    "b05_channel_share": (("channel_product",), lambda g, r:
                          channels.channel_share_from(g["channel_product"])),
    "b06_order_value_distribution": (("order",), lambda g, r:
                                     orders.order_value_distribution_from(g["order"])),
    "b07_customer_ranking": (("customer",), lambda g, r:
                             customers.customer_ranking_from(g["customer"])),
    "b08_state_region_revenue": (("state_region",), lambda g, r:
                                 geo.state_region_revenue_from(g["state_region"])),
    "b09_channel_margin": (("channel_product",), lambda g, r:
                           channels.channel_margin_from(g["channel_product"])),
    "b10_rfm_segmentation": (("customer",), lambda g, r:
                             customers.rfm_segmentation_from(g["customer"])),
    "b10b_rfm_recency_quantiles": (("customer",), lambda g, r: customers.rfm_segmentation_from(
        g["customer"], recency_bounds=(54, 125, 222, 398))),
    "b10c_rfm_high_is_best": (("customer",), lambda g, r: customers.rfm_segmentation_from(
        g["customer"], score_direction="high_is_best")),
    "b11_customer_lifetime_value": (("customer",), lambda g, r:
                                    customers.customer_lifetime_value_from(g["customer"])),
    "b12_yoy_growth": (("product_year",), lambda g, r: products.yoy_growth_from(g["product_year"])),
    "b13_rolling_averages": (("month",), lambda g, r: trend.rolling_averages_from(g["month"])),
    "b14_channel_product_matrix": (("channel_product",), lambda g, r:
                                   channels.channel_product_matrix_from(g["channel_product"])),
    "b15_state_margin": (("state_region",), lambda g, r: geo.state_margin_from(g["state_region"])),
    "b16_month_year_pivot": (("month",), lambda g, r: trend.month_year_pivot_from(
        g["month"], trend.DATA_PIVOT_YEARS)),
    "b17_cost_efficiency": (("product_year",), lambda g, r:
                            products.cost_efficiency_from(g["product_year"])),
    "b18_abc_pareto": (("product_year",), lambda g, r: products.abc_pareto_from(g["product_year"])),
    "d1_headline_kpis": (("channel_product", "customer", "order"), lambda g, r:
                         derived.headline_kpis_from(g["channel_product"], g["customer"],
                                                    g["order"])),
    "d2_region_performance": (("state_region",), lambda g, r:
                              derived.region_performance_from(g["state_region"])),
    "d3_rfm_segment_mix": (("customer",), lambda g, r:
                           derived.rfm_segment_mix_from(r["b10_rfm_segmentation"])),
    "d4_product_quadrants": (("product_year",), lambda g, r:
                             derived.product_quadrants_from(g["product_year"])),
    "d5_below_mean_median": (("customer",), lambda g, r:
                             derived.below_mean_median_from(r["b07_customer_ranking"])),
    "d6_repeat_purchase": (("customer",), lambda g, r:
                           derived.repeat_purchase_from(g["customer"])),
    "d7_abc_mix": (("product_year",), lambda g, r: derived.abc_mix_from(r["b18_abc_pareto"])),
}
# reports other reports are built from
_PREREQUISITES = {"d3_rfm_segment_mix": "b10_rfm_segmentation",
                  "d5_below_mean_median": "b07_customer_ranking",
                  "d7_abc_mix": "b18_abc_pareto"}


def _plan_order(names: Iterable[str] | None) -> tuple[list[str], list[str]]:
    wanted = list(names) if names is not None else list(CATALOGUE)
    unknown = [n for n in wanted if n not in CATALOGUE]
    if unknown:
        raise KeyError(f"unknown reports: {unknown}")
    order: list[str] = []
    for name in wanted:
        pre = _PREREQUISITES.get(name)
        if pre and pre not in order:
            order.append(pre)
        if name not in order:
            order.append(name)
    return wanted, order


def _pool_map(fn, items, parallel: int):
    if parallel <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(fn, items))


def _grains_for(sales: DataFrame, order: list[str], parallel: int) -> dict[str, DataFrame]:
    """The grains that the reports read: rolled up from a base where several
    share it, from the fact where one stands alone."""
    needed = sorted({g for name in order for g in CATALOGUE[name][0]})
    shared = [base for base, grains in BASES.items() if len(set(grains) & set(needed)) > 1]
    bases = _pool_map(lambda base: materialize(base(sales)), shared, parallel)
    source = {g: at for base, at in zip(shared, bases) for g in BASES[base]}
    built = _pool_map(lambda g: materialize(GRAINS[g](source.get(g, sales))), needed, parallel)
    return dict(zip(needed, built))


def run_reports(sales: DataFrame, names: Iterable[str] | None = None,
                parallel: int = 1) -> dict[str, DataFrame]:
    """Every requested report (default: the whole catalogue) as DataFrames;
    the grains they need are rolled up and checkpointed once (``parallel``
    grains at a time: concurrent Spark jobs from driver threads)."""
    wanted, order = _plan_order(names)
    grains = _grains_for(sales, order, parallel)
    built: dict[str, DataFrame] = {}
    for name in order:
        built[name] = CATALOGUE[name][1](grains, built)
    return {name: built[name] for name in wanted}


def execute_reports(sales: DataFrame, action: Callable[[str, DataFrame], object],
                    names: Iterable[str] | None = None, parallel: int = 4) -> dict[str, object]:
    """Build and run reports concurrently: ``action(name, df)`` (collect,
    write, ...) is applied to each report from ``parallel`` driver threads,
    so Spark schedules the small report jobs side by side.  Reports built
    from another report's output run in a second wave."""
    wanted, order = _plan_order(names)
    grains = _grains_for(sales, order, parallel)
    built: dict[str, DataFrame] = {}
    results: dict[str, object] = {}

    def run(name: str):
        df = CATALOGUE[name][1](grains, built)
        built[name] = df
        return name, action(name, df)

    first = [n for n in order if n not in _PREREQUISITES]
    second = [n for n in order if n in _PREREQUISITES]
    for wave in (first, second):
        for name, out in _pool_map(run, wave, parallel):
            results[name] = out
    return {name: results[name] for name in wanted}
