"""Support-desk frames derived from the star schema, where no domain table has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.sources.tables import table


def customers(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("org_id"), F.col("c_mktsegment").alias("segment"), "n_regionkey")


def tickets(spark: SparkSession, d: str) -> DataFrame:
    """One ticket per order; status, due date and resolution are derived from its key, status and priority."""
    o, r = table(spark, d, "orders"), table(spark, d, "region")
    who = customers(spark, d).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    status = F.when(key % 20 == 0, "escalated").when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").when(key % 5 == 0, "closed").otherwise("resolved")
    digit = F.substring("o_orderpriority", 1, 1)
    priority = F.when(digit == "1", "p1_critical").when(digit == "2", "p2_high").when(digit == "3", "p3_medium").otherwise("p4_low")
    due_days = F.when(digit == "1", 10).when(digit == "2", 20).when(digit == "3", 40).otherwise(60)
    later = lambda days: at + F.make_dt_interval(days)
    return o.join(who, F.col("o_custkey") == F.col("customer_id"), "left").select(
        key.alias("ticket_id"), F.col("o_custkey").alias("customer_id"), "org_id", F.col("r_name").alias("product_line"), F.col("segment").alias("category"),
        status.alias("status"), priority.alias("priority"), at.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", later((key % 97 + 1).cast("int"))).alias("resolved_at"),
        F.when(key % 7 != 0, later(due_days)).alias("sla_due_at"),
    )


def ticket_comments(spark: SparkSession, d: str) -> DataFrame:
    """Line items shipped at or after their order's date."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate").select(F.col("l_orderkey").alias("ticket_id"), F.col("l_shipdate").alias("created_at"))
