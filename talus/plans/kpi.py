"""Governed KPI queries: validation in a fixed order on the driver, then one select over the safe view.

A query selects, filters, sorts and limits; it never aggregates, so leaving out a dimension leaves several rows per day and metric.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.plans.marts import DIMENSIONS, METRICS

ROLES = ("support_ops", "instructor", "admin")
EXPERIMENTAL = frozenset({"first_resolution_rate"})
MAX_DAYS, MAX_LIMIT = 31, 500
SUCCESS = ("tool_contract", "metric_registry", "safe_view", "parameterized_sql")


@dataclass(frozen=True)
class Request:
    actor_role: str
    metrics: Sequence[str]
    date_from: str
    date_to: str
    dimensions: Sequence[str] = ()
    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    actor_org_ids: Sequence[str] = ()
    include_experimental_metrics: bool = False
    limit: int = 100


@dataclass(frozen=True)
class Denial:
    code: str
    policies: tuple[str, ...]


def _date(s: object) -> date | None:
    try:
        return date.fromisoformat(s) if isinstance(s, str) else None
    except ValueError:
        return None


def validate(r: Request) -> Denial | None:
    """The first check that fails decides."""
    base = ("tool_contract", "metric_registry")
    first, last = _date(r.date_from), _date(r.date_to)
    shaped = isinstance(r.actor_role, str) and 1 <= len(r.metrics) <= len(METRICS) and len(r.dimensions) <= len(DIMENSIONS) and 1 <= r.limit <= MAX_LIMIT and first and last
    if not shaped:
        return Denial("SCHEMA_VALIDATION_FAILED", ("tool_contract",))
    checks = (
        (r.actor_role in ROLES, "ROLE_DENIED", (*base, "role_policy")),
        (all(m in METRICS for m in r.metrics), "METRIC_DENIED", base),
        (r.include_experimental_metrics or not EXPERIMENTAL & set(r.metrics), "EXPERIMENTAL_METRIC_NOT_ACKNOWLEDGED", (*base, "experimental_metric_guard")),
        (all(x in DIMENSIONS for x in r.dimensions), "DIMENSION_DENIED", (*base, "dimension_policy")),
        (all(x in DIMENSIONS for x in r.filters), "FILTER_DENIED", (*base, "filter_policy")),
        (r.actor_role != "support_ops" or bool(r.actor_org_ids), "ORG_SCOPE_REQUIRED", (*base, "org_scope_required")),
        (last >= first, "SCHEMA_VALIDATION_FAILED", ("tool_contract",)),
        ((last - first).days <= MAX_DAYS, "WINDOW_TOO_LARGE", (*base, "window_policy")),
    )
    return next((Denial(code, policies) for ok, code, policies in checks if not ok), None)


def policies_applied(r: Request) -> tuple[str, ...]:
    scoped = bool(r.actor_org_ids) and r.actor_role != "admin"
    return (*SUCCESS, *(["org_scope_filter"] if scoped else []), *(["experimental_metric_ack"] if EXPERIMENTAL & set(r.metrics) else []))


def kpi_query(view: DataFrame, r: Request) -> DataFrame:
    """Rows of the safe view; raises PermissionError with the denial's code. All predicates are columns, so they reach the scan."""
    if denial := validate(r):
        raise PermissionError(denial.code)
    rows = view.where(F.col("metric_name").isin(*r.metrics) & F.col("metric_date").between(F.lit(r.date_from).cast("date"), F.lit(r.date_to).cast("date")))
    for c, allowed in r.filters.items():
        rows = rows.where(F.col(c).isin(*allowed))
    if r.actor_org_ids and r.actor_role != "admin":
        rows = rows.where(F.col("org_id").isin(*r.actor_org_ids))
    out = ["metric_date", "metric_name", *r.dimensions]
    return rows.select(*out, "metric_value").orderBy(*out, "metric_value").limit(r.limit)


def fingerprint(r: Request) -> str:
    """sha256 of the request's canonical JSON: equal for equal questions."""
    return hashlib.sha256(json.dumps(asdict(r), sort_keys=True, default=list).encode()).hexdigest()


def response_meta(rows: DataFrame, r: Request) -> DataFrame:
    """One row beside an answer: number of rows, newest day among them, the policies applied and the question's fingerprint."""
    policies, key = F.lit(",".join(policies_applied(r))), F.lit(fingerprint(r))
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.max("metric_date").alias("freshness")).withColumns({"policies": policies, "query_fingerprint": key})
