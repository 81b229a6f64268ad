"""Consistency checks of an order-entry schema; each returns the districts that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_order_ids(district: DataFrame, orders: DataFrame, new_orders: DataFrame) -> DataFrame:
    """d_next_o_id - 1 must be the largest o_id, and no open order may be larger than it."""
    last = orders.groupBy(F.col("o_w_id").alias("d_w_id"), F.col("o_d_id").alias("d_id")).agg(F.max("o_id").alias("last_order"))
    waiting = new_orders.groupBy(F.col("no_w_id").alias("d_w_id"), F.col("no_d_id").alias("d_id")).agg(F.max("no_o_id").alias("last_open"))
    joined = district.select("d_w_id", "d_id", "d_next_o_id").join(last, ["d_w_id", "d_id"], "left").join(waiting, ["d_w_id", "d_id"], "left")
    return joined.where((F.col("d_next_o_id") - 1 != F.coalesce("last_order", F.lit(0))) | (F.col("last_open") > F.col("last_order")))


def line_counts(orders: DataFrame, order_line: DataFrame) -> DataFrame:
    """The announced order lines of a district must all be there."""
    announced = orders.groupBy(F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id")).agg(F.sum("o_ol_cnt").alias("announced"))
    found = order_line.groupBy(F.col("ol_w_id").alias("w_id"), F.col("ol_d_id").alias("d_id")).agg(F.count("*").alias("found"))
    return announced.join(found, ["w_id", "d_id"], "full").where(~F.coalesce("announced", F.lit(0)).eqNullSafe(F.coalesce("found", F.lit(0))))


def gapless_new_orders(new_orders: DataFrame) -> DataFrame:
    """The open orders of a district must be numbered without gaps."""
    grouped = new_orders.groupBy("no_w_id", "no_d_id").agg(F.count("*").alias("n"), F.min("no_o_id").alias("low"), F.max("no_o_id").alias("high"))
    return grouped.where(F.col("n") != F.col("high") - F.col("low") + 1)
