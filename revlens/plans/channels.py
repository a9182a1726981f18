"""Channel reports: B5 revenue share, B9 mean margin, B14 channel x product
profitability matrix.

All three are functions of per-(channel[, product]) measures; the ``*_from``
forms re-aggregate to their key, so they take either a minimal aggregate of
the fact or the shared ``channel_product`` grain.  B5 is written
aggregate-first: the reference's ``SELECT DISTINCT ..., SUM() OVER (...)``
over raw rows would send every fact row to one partition for the
``OVER ()`` total; here the total is a scalar subquery over the aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.semantics import (MILLION, THOUSAND, pct_label, scale_round,
                                         scale_round_dec, share_pct, snap_round)
from revlens.operators.ordered import materialize, with_rank
from revlens.plans.common import reads
from revlens.plans.grains import by_channel_product, margin_mean


@reads("channel", "revenue")
def channel_share(sales: DataFrame) -> DataFrame:
    """Revenue per channel (millions, 1 dp) and its share of the total,
    computed from the two *rounded* figures as the reference does."""
    return channel_share_from(
        sales.groupBy(F.col("channel").alias("Channel")).agg(F.sum("revenue").alias("_rev")))


def channel_share_from(measures: DataFrame) -> DataFrame:
    # read twice below, computed once
    per = materialize(measures.groupBy("Channel").agg(F.sum("_rev").alias("_rev")))
    total = per.agg(scale_round_dec(F.sum("_rev"), MILLION, 1).cast("double")).scalar()
    rev = scale_round("_rev", MILLION, 1)
    share = snap_round(share_pct(rev, total), 2)
    return per.select("Channel", rev.alias("Total_Revenue"),
                      pct_label(share, " %").alias("Contribution")).orderBy("Channel")


@reads("channel", "profit_margin_pct")
def channel_margin(sales: DataFrame) -> DataFrame:
    """Unweighted mean row margin per channel, as text ('37.9 %')."""
    return channel_margin_from(sales.groupBy(F.col("channel").alias("Channel")).agg(
        F.sum("profit_margin_pct").alias("_margin_sum"),
        F.count("profit_margin_pct").alias("_margin_n")))


def channel_margin_from(measures: DataFrame) -> DataFrame:
    return (measures.groupBy("Channel")
            .agg(pct_label(snap_round(margin_mean(), 1), " %").alias("AVG_Profit_Margin"))
            .orderBy("Channel"))


@reads("channel", "product_name", "revenue", "profit", "profit_margin_pct")
def channel_product_matrix(sales: DataFrame) -> DataFrame:
    """Revenue, profit and mean margin per (channel, product), with the
    margin rank inside the channel (on the unrounded mean)."""
    return channel_product_matrix_from(by_channel_product(sales))


def channel_product_matrix_from(measures: DataFrame) -> DataFrame:
    per = measures.groupBy("Channel", "Product").agg(
        F.sum("_rev").alias("_rev"), F.sum("_profit").alias("_profit"),
        margin_mean().alias("_margin"))
    # rank inside the channel; a channel may hold a large share of the catalogue
    per = with_rank(materialize(per), "_margin", desc=True, name="_rank", partition_by="Channel")
    return per.select(
        "Channel", "Product",
        scale_round("_rev", THOUSAND, 1).alias("Revenue_K"),
        scale_round("_profit", THOUSAND, 1).alias("Profit_K"),
        snap_round("_margin", 2).alias("Avg_Margin_Pct"),
        F.col("_rank").cast("long").alias("Margin_Rank_In_Channel"),
    ).orderBy("Channel", "Margin_Rank_In_Channel", "Product")
