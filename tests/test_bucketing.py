"""A fact bucketed by customer aggregates per customer without a shuffle."""

from revlens.plans.customers import rfm_segmentation
from revlens.plans.grains import by_customer
from revlens.sources.sinks import save_as_table
from revlens.sources.tables import sales_fact


def test_customer_grain_needs_no_exchange_on_bucketed_fact(spark, sf_dir, scratch):
    fact = sales_fact(spark, sf_dir)
    save_as_table(fact, "sales_by_customer", bucket_by=["customer_name"], buckets=8,
                  path=f"{scratch}/bucketed")
    try:
        bucketed = spark.table("sales_by_customer")
        grain = by_customer(bucketed)
        plan = grain._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        assert sorted(grain.collect()) == sorted(by_customer(fact).collect())
        assert rfm_segmentation(bucketed).collect() == rfm_segmentation(fact).collect()
    finally:
        spark.sql("DROP TABLE IF EXISTS sales_by_customer")
