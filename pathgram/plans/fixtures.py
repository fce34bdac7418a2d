"""Indicator tables derived from the order tables; inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathgram.spec import ModelSpec

SPEC = ModelSpec(
    constructs={
        "Frequency": ["n_orders", "total_price", "active_months"],
        "Volume": ["n_lines", "qty", "n_supp"],
        "Value": ["revenue", "disc_amt", "tax_amt"],
    },
    paths=[("Frequency", "Volume"), ("Volume", "Value"), ("Frequency", "Value")],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with nine behavioural indicators."""
    orders = table(spark, sf_dir, "orders")
    by_order = orders.groupBy(F.col("o_custkey").alias("k1")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.sum("o_totalprice").alias("total_price"),
        F.countDistinct(F.date_trunc("month", "o_orderdate")).cast("double").alias("active_months"),
    )
    price = F.col("l_extendedprice")
    by_line = (
        table(spark, sf_dir, "lineitem")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("k2"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.countDistinct("l_suppkey").cast("double").alias("n_supp"),
            F.sum(price * (1 - F.col("l_discount"))).alias("revenue"),
            F.sum(price * F.col("l_discount")).alias("disc_amt"),
            F.sum(price * F.col("l_tax")).alias("tax_amt"),
        )
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal")
    )
    return (
        customer.join(by_order, F.col("case_id") == F.col("k1"), "left")
        .join(by_line, F.col("case_id") == F.col("k2"), "left")
        .drop("k1", "k2")
    )


def text_numbers(fx: DataFrame) -> DataFrame:
    """Decimal commas, padding, blanks and unreadable entries."""
    cid = F.col("case_id")
    whole = F.col("n_lines").cast("int").cast("string")
    return fx.select(
        "case_id",
        "segment",
        F.when(cid % 17 == 0, None).when(cid % 23 == 0, "n/a").otherwise(F.concat(whole, F.lit(",5"))).alias("t_lines"),
        F.when(cid % 29 == 0, "")
        .otherwise(F.concat(F.lit(" "), F.col("n_orders").cast("int").cast("string"), F.lit(" ")))
        .alias("t_orders"),
    )


def likert_items(fx: DataFrame) -> DataFrame:
    """Five-point items; ``f1`` holds a few out-of-scale zeros."""

    def item(name: str, width: int):
        return F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col(name) / width).cast("int") + 1))

    return fx.filter(F.col("n_lines").isNotNull()).select(
        "case_id",
        "segment",
        F.when(F.col("case_id") % 97 == 0, 0).otherwise(item("n_orders", 4)).alias("f1"),
        item("active_months", 4).alias("f2"),
        item("n_lines", 16).alias("v1"),
        item("qty", 420).alias("v2"),
    )
