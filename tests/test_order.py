"""Row order of the reports (the driver's hash ignores order, so it is asserted here)."""

import pytest

import __spark_entry__ as entry


def _is_sorted(rows, key, reverse=False):
    keys = [key(r) for r in rows]
    return keys == sorted(keys, reverse=reverse)


NONE_LAST = float("-inf")

ORDERS = {
    "b01_monthly_trend": (lambda r: (r.Year, r.Month), False),
    "b02_seasonality": (lambda r: r.Total_Revenue, True),
    "b03_top_products_revenue": (lambda r: r.Total_Sales_Value, True),
    "b04_top_products_margin": (lambda r: r.Profit_Margin, True),
    "b06_order_value_distribution": (lambda r: r.Total_orders, True),
    "b07_customer_ranking": (lambda r: r.Total_Order_Value, True),
    "b08_state_region_revenue": (lambda r: r.Total_State_Revenue, True),
    "b10_rfm_segmentation": (lambda r: r.Customer, False),
    "b11_customer_lifetime_value": (
        lambda r: NONE_LAST if r.Projected_Annual_CLV_K is None else r.Projected_Annual_CLV_K,
        True),
    "b12_yoy_growth": (lambda r: (r.Product, r.Year), False),
    "b13_rolling_averages": (lambda r: (r.Year, r.Month), False),
    "b14_channel_product_matrix": (lambda r: (r.Channel, r.Margin_Rank_In_Channel), False),
    "b15_state_margin": (lambda r: r.Avg_Margin_Pct, True),
    "b16_month_year_pivot": (lambda r: r.Month_Num, False),
    "b17_cost_efficiency": (lambda r: r.Efficiency_Rank, False),
    "b18_abc_pareto": (lambda r: r.Revenue_M, True),
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_report_order(spark, sf_dir, name):
    key, reverse = ORDERS[name]
    rows = entry.queries()[name](spark, sf_dir).collect()
    assert rows and _is_sorted(rows, key, reverse)


def test_top_lists_have_ten_rows(spark, sf_dir):
    for name in ("b03_top_products_revenue", "b04_top_products_margin", "o02_topk"):
        assert entry.queries()[name](spark, sf_dir).count() == 10
