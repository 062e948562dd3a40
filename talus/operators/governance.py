"""Approval conditions compiled to columns, idempotent replay, backfill gaps."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITY = {"pause_and_notify": 1, "require_approval": 2, "reject": 3}
_TOKEN = re.compile(r"""'[^']*'|"[^"]*"|[=!<>]+|[^\s=!<>'"]+""")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_OPS = {"==": Column.__eq__, "!=": Column.__ne__, ">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__}


def _clause(text: str, columns: Sequence[str]) -> Column:
    """One ``field op literal``; anything else never holds."""
    field, op, literal = [*_TOKEN.findall(text), "", "", ""][:3]
    quoted = literal[:1] in ("'", '"')
    if "".join(text.split()) != "".join((field + op + literal).split()) or not (field.isidentifier() and op in _OPS and (quoted or _NUMBER.fullmatch(literal))):
        return F.lit(False)
    value = F.col(field) if field in columns else F.lit(None)
    if quoted:
        return F.coalesce(_OPS[op](value.cast("string"), F.lit(literal[1:-1])), F.lit(False))
    return _OPS[op](F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(float(literal)))


def compile_condition(text: str, columns: Sequence[str]) -> Column:
    """``field op literal [AND ...]`` as a column; what cannot be parsed never holds, an absent or null number reads as 0."""
    clauses = [_clause(c, columns) for c in re.split(r"\bAND\b", text) if c.strip()]
    return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(False)


def hitl_actions(payloads: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """payloads with the weightiest action whose condition holds (null if none) and the number of matches."""
    hits = [(compile_condition(c, payloads.columns), a) for c, a in rules]
    weight = F.greatest(F.lit(0), F.lit(0), *[F.when(h, PRIORITY.get(a, 0)).otherwise(0) for h, a in hits])
    action = reduce(lambda w, x: w.when(weight == x[1], x[0]), PRIORITY.items(), F.when(F.lit(False), ""))
    return payloads.withColumns({"hitl_action": action, "hitl_matches": reduce(lambda a, b: a + b, [h.cast("int") for h, _ in hits], F.lit(0))})


def idempotent_outcome(requests: DataFrame, seen: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """execute for a new key, replay for the same digest under a known key, conflict for another digest."""
    before = seen.groupBy(*keys).agg(F.min(digest).alias("_digest"))
    outcome = F.when(F.col("_digest").isNull(), "execute").when(F.col("_digest") == F.col(digest), "replay").otherwise("conflict")
    return requests.join(before, list(keys), "left").withColumn("outcome", outcome).drop("_digest")


def apply_policy(rows: DataFrame, level: str, rules: DataFrame, columns: Mapping[str, str], strictest: str) -> DataFrame:
    """rows with each named column kept, replaced by 16 hex digits of its sha256, or dropped to null, as its rule column of the level's row says.

    rules: one row per ``level``; a row whose level is null or unknown falls under the ``strictest`` one. An unknown rule drops.
    """
    known = rules.select(F.col("level").alias("_level"), *[F.col(r).alias(f"_{c}") for c, r in columns.items()])
    named = rules.select(F.col("level").alias("_named")).distinct()
    j = rows.join(named, F.col(level) == F.col("_named"), "left").withColumn("_use", F.coalesce("_named", F.lit(strictest))).join(known, F.col("_use") == F.col("_level"))
    masked = {c: F.when(F.col(f"_{c}") == "keep", F.col(c)).when(F.col(f"_{c}") == "hash", F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 16)) for c in columns}
    return j.withColumns(masked).select(*rows.columns)


def daily_counts(rows: DataFrame, ts: str) -> DataFrame:
    return rows.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


def backfill_gaps(rows: DataFrame, ts: str, expected: DataFrame | None = None) -> DataFrame:
    """Days between the first and the last row that have none; at most one row per day is on one side."""
    counts = daily_counts(rows, ts)
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return (expected if expected is not None else span).join(counts, "day", "left_anti")
