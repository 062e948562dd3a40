"""Staging, case and KPI marts. ``as_of`` stands where a clock would be read, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_STATUSES = ("open", "pending_customer", "in_progress", "escalated")
P1 = ("p1_critical", "p1")
COUNTS = ("ticket_count", "open_ticket_count", "p1_ticket_count", "sla_breach_count", "escalation_count")
AVERAGES = ("avg_backlog_age_days", "avg_first_response_minutes", "avg_handle_time_minutes")
RATIOS = {"escalation_rate": ("escalation_count", "ticket_count"), "sla_breach_rate": ("sla_breach_count", "ticket_count"), "first_resolution_rate": ("first_resolution_count", "resolved_ticket_count")}
METRICS = (*COUNTS, *AVERAGES, *RATIOS)
DIMENSIONS = ("product_line", "priority", "org_id", "category")


def micros(later: str | Column, earlier: str | Column) -> Column:
    later, earlier = (F.col(c) if isinstance(c, str) else c for c in (later, earlier))
    return F.unix_micros(later) - F.unix_micros(earlier)


def stg_tickets(tickets: DataFrame, as_of: str, open_statuses: tuple[str, ...] = OPEN_STATUSES) -> DataFrame:
    """Lower-cased status and priority, created_date and the boolean flags; a ticket without due date is never breached."""
    now = F.lit(as_of).cast("timestamp")
    status, priority = F.lower("status"), F.lower("priority")
    return tickets.withColumns({"status": status, "priority": priority}).withColumns(
        {
            "created_date": F.to_date("created_at"),
            "is_open": F.coalesce(F.col("status").isin(*open_statuses), F.lit(False)),
            "is_resolved": F.coalesce(F.col("status") == "resolved", F.lit(False)),
            "is_escalated": F.coalesce(F.col("status") == "escalated", F.lit(False)),
            "is_p1": F.coalesce(F.col("priority").isin(*P1), F.lit(False)),
            "sla_breached": F.coalesce(F.coalesce("resolved_at", now) > F.col("sla_due_at"), F.lit(False)),
        }
    )


def support_cases(stg: DataFrame, customers: DataFrame, comments: DataFrame, as_of: str) -> DataFrame:
    """Tickets with their customer's organisation, first comment and durations in microseconds; comments are reduced to one row per ticket before the join."""
    first = comments.groupBy("ticket_id").agg(F.min("created_at").alias("first_comment_at"))
    org = customers.select("customer_id", F.col("org_id").alias("org_name"))
    now = F.lit(as_of).cast("timestamp")
    return stg.join(org, "customer_id", "left").join(first, "ticket_id", "left").withColumns(
        {
            "first_response_us": micros("first_comment_at", "created_at"),
            "backlog_us": micros(F.coalesce("resolved_at", now), "created_at"),
            "handle_us": micros("resolved_at", "created_at"),
            "is_first_resolution_proxy": F.col("resolved_at").isNotNull() & ~F.col("is_escalated"),
        }
    )


def _rounded_mean(us: str, unit: float) -> Column:
    """Mean of whole microseconds in units, to four places: sums of integers do not depend on their order."""
    return F.round(F.sum(us).cast("double") / F.count(us) / F.lit(unit), 4)


def ticket_activity_daily(cases: DataFrame) -> DataFrame:
    flag = lambda c: F.sum(F.col(c).cast("int")).cast("long")
    keys = [F.col("created_date").alias("activity_date"), *[F.coalesce(c, F.lit("unknown")).alias(c) for c in DIMENSIONS]]
    daily = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ticket_count"), flag("is_open").alias("open_ticket_count"), flag("is_p1").alias("p1_ticket_count"), flag("sla_breached").alias("sla_breach_count"),
        flag("is_escalated").alias("escalation_count"), flag("is_resolved").alias("resolved_ticket_count"), flag("is_first_resolution_proxy").alias("first_resolution_count"),
        _rounded_mean("backlog_us", 86_400e6).alias("avg_backlog_age_days"), _rounded_mean("first_response_us", 60e6).alias("avg_first_response_minutes"), _rounded_mean("handle_us", 60e6).alias("avg_handle_time_minutes"),
    )
    return daily.withColumns({m: ratio(a, b) for m, (a, b) in RATIOS.items()})


def ratio(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.round(a.cast("double") / F.nullif(b, F.lit(0)), 4)


def support_kpi_mart(daily: DataFrame) -> DataFrame:
    """One row per day, dimensions and metric; metrics without a value have no row."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    return daily.select("activity_date", *DIMENSIONS, F.expr(f"stack({len(METRICS)}, {pairs}) as (metric_name, metric_value)")).where("metric_value is not null").withColumnRenamed("activity_date", "metric_date")


def agent_safe_view(mart: DataFrame) -> DataFrame:
    return mart.select("metric_date", "metric_name", *DIMENSIONS, "metric_value").where(F.col("metric_name").isin(*METRICS))


def kpi_rollup(cases: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Extension: totals over every prefix of dims, ratios from their numerators and denominators."""
    flag = lambda c: F.sum(F.col(c).cast("int")).cast("long")
    agg = cases.rollup(*dims).agg(F.count(F.lit(1)).alias("ticket_count"), flag("is_escalated").alias("escalation_count"), flag("sla_breached").alias("sla_breach_count"), F.grouping_id().cast("int").alias("level"))
    return agg.withColumns({"escalation_rate": ratio("escalation_count", "ticket_count"), "sla_breach_rate": ratio("sla_breach_count", "ticket_count")})


def dbt_tests_report(mart: DataFrame) -> DataFrame:
    """Violations per test in one pass: not_null and accepted_values, non-negative metrics, ratios within [0, 1]."""
    n = lambda c: F.count_if(c).cast("long")
    one = mart.agg(
        *[n(F.col(c).isNull()).alias(f"not_null_{c}") for c in ("metric_date", "metric_name", "metric_value")],
        n(~F.col("metric_name").isin(*METRICS)).alias("accepted_values_metric_name"),
        n(F.col("metric_value") < 0).alias("metric_values_non_negative"),
        n(F.col("metric_name").isin(*RATIOS) & ~F.col("metric_value").between(0, 1)).alias("ratio_metrics_between_0_and_1"),
    )
    return one.unpivot([], one.columns, "test_name", "violations")
