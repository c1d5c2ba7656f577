"""Fact, reference and rule-pack tables derived from the shared Parquet tables.

Facts carry exactly the columns a query needs, so scans read no others, and
the joins behind them follow foreign keys in the order that keeps the large
side moving least.  Money is summed in whole cents: exact in any order, and
far cheaper per row than decimals; the few sums are turned into decimals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Declared types of the shared tables: opening a table then needs no footer job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(SCHEMAS)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast(MONEY)


def cents(name: str) -> Column:
    """An amount with two decimals as whole cents."""
    return F.rint(F.col(name) * 100).cast("long")


def from_cents(total: Column) -> Column:
    return total.cast("decimal(20,0)") * F.lit(Decimal("0.01"))


def yyyymm(name: str) -> Column:
    return F.year(name) * 100 + F.month(name)


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with their regions; Spark broadcasts them if their size allows."""
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("nat"), F.col("r_name").alias("reg")
    )


def buyers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with segment, nation and region."""
    where = places(spark, sf)
    customer = read(spark, sf, "customer")
    return customer.join(where, customer.c_nationkey == where.n_nationkey).select(
        "c_custkey", F.col("c_mktsegment").alias("seg"), "nat", "reg", "c_acctbal"
    )


def balance_class(name: str) -> Column:
    """Balances in thousands."""
    return F.floor(F.col(name) / 1000)


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their length, and the labels; many documents have none."""
    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    return docs, read(spark, sf, "labels").select("doc_id")


def part_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales by brand and type.

    Line items are summed per part before the join: the sum combines on the
    map side and leaves the rows partitioned by the join key.
    """
    per_part = (
        read(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(from_cents(F.sum(cents("l_extendedprice"))).alias("price"))
    )
    part = read(spark, sf, "part")
    return per_part.join(part, per_part.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), "price"
    )


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the dimensions of their buyer.

    Orders and customers both grow with the data: a merge join never collects
    a side, whatever the (overestimated) size of the dimension join looks like.
    """
    orders, who = read(spark, sf, "orders"), buyers(spark, sf)
    return orders.join(who.hint("merge"), orders.o_custkey == who.c_custkey).select(
        "o_orderkey",
        "seg",
        "nat",
        "reg",
        F.col("o_orderpriority").alias("prio"),
        yyyymm("o_orderdate").alias("month"),
        balance_class("c_acctbal").alias("bal"),
    )


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """The wide fact: one row per line item with all dimensions, the price in cents."""
    item, part = read(spark, sf, "lineitem"), read(spark, sf, "part")
    orders = order_facts(spark, sf)
    return (
        item.join(orders.hint("merge"), item.l_orderkey == orders.o_orderkey)
        .join(part, F.col("l_partkey") == part.p_partkey)
        .select(
            "seg",
            "nat",
            "reg",
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("ptype"),
            "prio",
            "month",
            "bal",
            cents("l_extendedprice").alias("price"),
        )
    )


def order_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales by the dimensions of the order; line items are summed per order first."""
    per_order = (
        read(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            from_cents(F.sum(cents("l_extendedprice"))).alias("price"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )
    orders = order_facts(spark, sf)
    return per_order.join(orders.hint("merge"), per_order.l_orderkey == orders.o_orderkey).select(
        "seg", "nat", "reg", "prio", "month", "price", "n_rows"
    )


def rule_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The shared tables in the shape the rule pack expects; premiums are in cents."""
    part, supplier = read(spark, sf, "part"), read(spark, sf, "supplier")
    orders, who, where = read(spark, sf, "orders"), buyers(spark, sf), places(spark, sf)
    col, when, lit = F.col, F.when, F.lit
    trend_key = lambda balance: F.concat_ws(" ", "nat", balance.cast("string"))
    fact = sales(spark, sf).select(
        col("month").alias("AsAt_Month"),
        col("price").alias("Premium"),
        col("seg").alias("Segment"),
        col("reg").alias("Region"),
        col("nat").alias("Nation"),
        col("ptype").alias("ProductType"),
        col("brand").alias("Key_RateChange"),
        trend_key(col("bal")).alias("Key_Trend"),
        col("prio").alias("Key_Pattern_Attr"),
        when(col("prio") != "4-NOT SPECIFIED", col("seg")).alias("Key_Modelling"),
        when(col("ptype") == "MEDIUM", " ").otherwise(col("ptype")).alias("Key_Modelling_Type"),
    )
    mapping = who.select(
        col("seg").alias("Segment"),
        col("reg").alias("Region"),
        col("nat").alias("Nation"),
        trend_key(balance_class("c_acctbal")).alias("Key_Trend"),
        col("seg").alias("Key_Modelling"),
        when(col("c_acctbal") > 0, "POS").otherwise("NEG").alias("Key_Pattern_Attr"),
    ).distinct()
    rate = part.select(
        col("p_brand").alias("Key_RateChange"),
        col("p_type").alias("ProductType"),
        ((col("p_size") - 45) / lit(10.0)).alias("RateChange"),
    )
    rate_pol = part.select(
        col("p_brand").alias("Key_RateChange"), (col("p_size") / lit(10.0)).alias("RateChange")
    )
    trend = supplier.join(where, supplier.s_nationkey == where.n_nationkey).select(
        trend_key(balance_class("s_acctbal")).alias("Key_Trend"),
        F.concat(lit("P"), F.floor(col("s_acctbal") / 1000).cast("string")).alias("Trend_Period"),
        (col("s_acctbal") / lit(20000.0)).alias("Trend_Value"),
    )
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    pattern = (
        orders.groupBy(
            col("o_orderpriority").alias("Key_Pattern_Attr"),
            ((year - 1995) * 12 + month).cast("long").alias("DevM"),
        )
        .agg(
            (
                F.sum(cents("o_totalprice"))
                / lit(100.0)
                / F.count(lit(1)).cast("double")
                / lit(260000.0)
            ).alias("DevPct_Incd_Attr")
        )
    )
    forecast = who.groupBy(
        col("nat").alias("Key_Forecast"),
        col("seg").alias("Key_Modelling"),
        when(col("c_acctbal") >= 0, col("reg")).otherwise("OFFSHORE").alias("Region"),
        col("reg").alias("Area"),
    ).agg(F.sum(cents("c_acctbal")).alias("Forecast_Premium"))
    load = part.select(
        col("p_brand").alias("Key_RateChange"),
        when(col("p_size") == 50, F.concat(lit("EXTRA "), col("p_type")))
        .otherwise(col("p_type"))
        .alias("ProductType"),
        (col("p_size") / lit(12.5)).alias("MinLoad_Attr"),
        col("p_size").cast("string").alias("MinLoad_Large"),
        col("p_name").alias("MinLoad_Note"),
    )
    return {
        "tbl_DetailedData": fact,
        "tbl_Key_Mapping": mapping,
        "tbl_RateChange": rate,
        "tbl_RateChange_Pol": rate_pol,
        "tbl_Trend": trend,
        "tbl_Patterns_Attr": pattern,
        "tbl_Forecast": forecast,
        "tbl_Min_Large_Load": load,
    }
