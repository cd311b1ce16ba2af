"""Adapters from the shared test tables to the transaction schema.

They only rename and derive columns so that rows have the shape of the
transaction CSV (``Outlet, Date, Total Sales Amount[, Total Discount]``);
all pipeline work happens in the operators.

* ``retail``       Outlet = customer nation name, Date = ship date,
                   amount = extended price, discount = price * discount rate.
* ``events_type``  Outlet = event type, Date = event day, amount = value.
* ``events_user``  Outlet = user id as text, Date = event day, amount = value
                   (many series: used for forecasts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.functions.columns import day_start
from dailycast.operators.joins import checked_broadcast
from dailycast.schema import DATE, DISCOUNT, OUTLET, TARGET


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey -> Outlet`` through customer and nation.

    The nation dimension is broadcast only after its size is checked; the
    orders-customer join is left to the planner (AQE turns it into a
    broadcast at run time only when the measured side is small)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias(OUTLET))
    cust_outlet = customer.join(checked_broadcast(nation, 10_000),
                                customer.c_nationkey == nation.n_nationkey)
    return orders.join(cust_outlet, orders.o_custkey == cust_outlet.c_custkey) \
        .select("o_orderkey", OUTLET)


def discount_amount():
    """price x discount rate in cents, rounded half-up (exact DECIMAL math)."""
    return F.round(F.col("l_extendedprice").cast("decimal(18,2)")
                   * F.col("l_discount").cast("decimal(18,2)"), 2).cast("double")


def retail_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount")
    oo = order_outlets(spark, sf_dir)
    j = li.join(oo, li.l_orderkey == oo.o_orderkey)
    return j.select(
        F.col(OUTLET),
        F.col("l_shipdate").cast("timestamp_ntz").alias(DATE),
        F.col("l_extendedprice").alias(TARGET),
        discount_amount().alias(DISCOUNT),
    )


def retail_raw_csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail rows in the raw CSV's shape: the used columns plus the twelve
    columns the pipeline drops, and Date as text as a CSV scan yields it."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias(OUTLET))
    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
         .join(customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(checked_broadcast(nation, 10_000), F.col("c_nationkey") == F.col("n_nationkey")))
    price = F.col("l_extendedprice")
    return j.select(
        F.col("l_linenumber").cast("string").alias("SL"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias(DATE),
        F.col("l_orderkey").cast("string").alias("Challan No"),
        F.col("c_name").alias("Customer Name"),
        F.col("c_custkey").cast("string").alias("Customer Code"),
        F.col(OUTLET),
        F.col(OUTLET).alias("Outlet.1"),
        F.date_format("l_shipdate", "MMM").alias("mon"),
        price.alias(TARGET),
        discount_amount().alias(DISCOUNT),
        F.round(price * (1 - F.col("l_discount")), 2).cast("string").alias("Cash Amount"),
        F.lit("0").alias("Card Amount"),
        F.lit("0").alias("MFS Amount"),
        F.lit("0").alias("Credit Amount"),
        F.lit("0").alias("Recovered"),
        F.round(price * F.col("l_tax"), 2).cast("string").alias("Net Credit"),
    )


def event_rows(ev: DataFrame, by: str = "user") -> DataFrame:
    """Events (batch or streaming) as transactions: Outlet = user id text
    (``by='user'``) or event type (``by='type'``), Date = event day."""
    outlet = F.col("user_id").cast("string") if by == "user" else F.col("event_type")
    return ev.select(
        outlet.alias(OUTLET),
        day_start("ts").alias(DATE),
        F.col("value").alias(TARGET),
    )


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(table(spark, sf_dir, "events"), "type")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(table(spark, sf_dir, "events"), "user")


def events_raw_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user events keeping the exact event time (for ``grain='day'``)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias(OUTLET),
                     F.col("ts").cast("timestamp_ntz").alias(DATE),
                     F.col("value").alias(TARGET))


ADAPTERS = {
    "retail": retail_transactions,
    "events_type": events_by_type,
    "events_user": events_by_user,
}


def transactions(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    return ADAPTERS[adapter](spark, sf_dir)


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions of their supplier: the unrounded charge with tax (six decimals)."""
    def exact(c: str, kind: str) -> Column:
        return F.col(c).cast(kind)
    amount = exact("l_extendedprice", "decimal(12,2)") * (1 - exact("l_discount", "decimal(4,2)")) * (1 + exact("l_tax", "decimal(4,2)"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("Outlet"), F.col("l_shipdate").cast("timestamp_ntz").alias("Date"),
        amount.cast("double").alias("Total Sales Amount"), F.lit(0.0).alias("Total Discount"))
