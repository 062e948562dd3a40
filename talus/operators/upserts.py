"""Idempotent writes as joins: what MERGE would do, without a table format.

All operators return the new state; write it with talus.sources.lakehouse, never over a path that is being read. Keys are compared as they
are; rows with a null key are kept where stated. Empty batches leave the state as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], keep_null_keys: bool = True) -> DataFrame:
    """The first row per key in the given order; rows with a null in the last key are kept all, as no two of them are known to be the same."""
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    wanted = F.col("_rank") == 1
    return first.where(wanted | F.col(keys[-1]).isNull() if keep_null_keys else wanted).drop("_rank")


def latest_by(rows: DataFrame, keys: Sequence[str], version: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """As keep_latest, by aggregation: partial maxima are taken before the shuffle, so a key with most of the rows is no hot spot."""
    best = F.max_by(F.struct(*columns), F.struct(*version)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*")


def append_if_absent(state: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of the batch to insert: new keys only, the first in ``order`` of each. Replaying a batch inserts nothing."""
    fresh = batch.join(state.select(*keys).distinct(), list(keys), "left_anti")
    return keep_latest(fresh, keys, [F.col(c) for c in order], keep_null_keys=False)


def partial_upsert(state: DataFrame, batch: DataFrame, key: str, mutable: Sequence[str], order: str) -> DataFrame:
    """First write wins, except for the mutable columns, which take the batch's last non-null value (in the order of ``order``)."""
    others = [c for c in state.columns if c != key and c not in mutable]
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}") for c in mutable]
    first = [F.min_by(c, order).alias(f"_new_{c}") for c in others]
    new = batch.groupBy(key).agg(*first, *last)
    j = state.join(new, key, "full_outer")
    merged = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in mutable} | {c: F.coalesce(F.col(c), F.col(f"_new_{c}")) for c in others}
    return j.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in state.columns])


def load(rows: DataFrame, mode: str, field: str, cursor: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows a load mode reads: full_snapshot and replay all, incremental_cursor and cdc those after the cursor (all without one), backfill those in [start, end).

    The condition is a plain comparison, so it reaches the scan. A row without the field is in full loads only.
    """
    at = F.col(field)
    if mode in ("full_snapshot", "replay"):
        return rows
    if mode in ("incremental_cursor", "cdc"):
        return rows if cursor is None else rows.where(at > F.lit(cursor).cast(rows.schema[field].dataType))
    if mode == "backfill" and start is not None and end is not None:
        kind = rows.schema[field].dataType
        return rows.where((at >= F.lit(start).cast(kind)) & (at < F.lit(end).cast(kind)))
    raise ValueError(f"unknown load mode {mode}, or a backfill without a range")


def max_cursor(rows: DataFrame, source: str, cursor: str) -> DataFrame:
    """Per source the largest cursor, compared as text."""
    return rows.groupBy(source).agg(F.max(F.col(cursor).cast("string")).alias("cursor"))


def incremental_decision(current: DataFrame, previous: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """insert, skip or reparse for each current record, by its fingerprint last time."""
    before = previous.select(key, F.col(fingerprint).alias("_before"))
    decision = F.when(F.col("_before").isNull(), "insert").when(F.col("_before") == F.col(fingerprint), "skip").otherwise("reparse")
    return current.join(before, key, "left").withColumn("decision", decision).drop("_before")
