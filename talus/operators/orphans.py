"""References to records that do not exist.

A rule names the referring columns, the target table and its key columns. References with the same set of non-null columns (the same null
mask) are checked together, by one anti-join on just these columns, under the rule's match semantics:

* ``simple``: a reference with any null column is no reference and holds;
* ``partial``: the non-null columns must agree with some target row; an all-null reference holds;
* ``full``: all columns null holds, some but not all null is the orphan kind ``malformed``.

Every mask is one join whose target side is aggregated to one row per key before the shuffle, so a key with any number of copies costs one
row. The referring side is never grouped: where one key holds a third of all references, the adaptive skew join splits it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.session import stage_table


@dataclass(frozen=True)
class Rule:
    """ref_columns of a referring frame must be found as key_columns of a target table. label names the reference in the result."""

    label: str
    ref_columns: tuple[str, ...]
    target: str
    key_columns: tuple[str, ...]
    match: str = "simple"

    def __post_init__(self) -> None:
        if self.match not in ("simple", "partial", "full") or not self.ref_columns or len(self.ref_columns) != len(self.key_columns):
            raise ValueError(f"not a rule: {self}")


def normal_key(c: Column | str) -> Column:
    """Keys are compared trimmed and lower-cased; a blank key is null."""
    return F.nullif(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), F.lit(""))


def find_orphans(refs: DataFrame, record_id: str, created_at: str, src_table: str, rule: Rule, target: DataFrame, tombstones: DataFrame | None = None, target_created_at: str = "created_at") -> DataFrame:
    """One row (src_table, record_id, created_at, ref_field, ref_key, orphan_kind) per orphan reference of one rule.

    refs: the referring rows; a record delivered more than once counts once per distinct reference, at its earliest created_at. Other columns, also ones named like
    columns of the target, are ignored. tombstones(table_name, record_key, restored_at) apply to rules with one column.
    orphan_kind: ``deleted`` with an unrestored tombstone (target row there or not), else ``missing`` without a target row, else ``late`` if the
    target's created_at is after the referring row's, else ``malformed`` (match full). A null created_at on either side is never late. Null
    references are no case; blank ones count as null. Empty tables give an empty result (empty targets: every reference is missing).
    """
    n = len(rule.ref_columns)
    r = refs.select(
        F.col(record_id).cast("string").alias("record_id"), F.col(created_at).cast("timestamp").alias("created_at"),
        *[normal_key(c).alias(f"k{i}") for i, c in enumerate(rule.ref_columns)],
    )
    r = r.groupBy("record_id", *[f"k{i}" for i in range(n)]).agg(F.min("created_at").alias("created_at"))
    if n > 1:
        r = stage_table(r, "references")  # read by one join per mask
    mask = reduce(lambda a, b: a + b, (F.when(F.col(f"k{i}").isNotNull(), 1 << i).otherwise(0) for i in range(n)))
    t = target.select(*[normal_key(c).alias(f"k{i}") for i, c in enumerate(rule.key_columns)], F.col(target_created_at).cast("timestamp").alias("t_created_at"))
    full = (1 << n) - 1
    # only the masks that occur are joined
    masks = sorted(x.m for x in r.select(mask.alias("m")).distinct().collect() if x.m) if n > 1 else [full]
    parts = []
    for m in masks:
        if m != full and rule.match == "simple":
            continue  # a reference with a null holds
        rows = r.where(mask == m) if n > 1 else r.where(F.col("k0").isNotNull())
        if m != full and rule.match == "full":
            parts.append(rows.withColumn("orphan_kind", F.lit("malformed")))
            continue
        on = [f"k{i}" for i in range(n) if m >> i & 1]
        keys = t.dropna(subset=on).groupBy(*on).agg(F.min("t_created_at").alias("t_created_at"), F.lit(True).alias("there"))
        j = rows.join(keys, on, "left")
        deleted = F.lit(False)
        if tombstones is not None and n == 1:
            dead = (
                tombstones.where((F.col("table_name") == rule.target) & F.col("restored_at").isNull())
                .select(normal_key("record_key").alias("k0")).where(F.col("k0").isNotNull()).distinct().withColumn("dead", F.lit(True))
            )
            j, deleted = j.join(dead, on, "left"), F.coalesce(F.col("dead"), F.lit(False))
        kind = F.when(deleted, "deleted").when(F.col("there").isNull(), "missing").when(F.col("t_created_at") > F.col("created_at"), "late")
        parts.append(j.withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull()))
    out = ["record_id", "created_at", *[f"k{i}" for i in range(n)], "orphan_kind"]
    found = reduce(DataFrame.unionByName, [p.select(*out) for p in parts]) if parts else r.withColumn("orphan_kind", F.lit("")).where(F.lit(False))
    key = F.col("k0") if n == 1 else F.concat_ws("|", *[F.coalesce(F.col(f"k{i}"), F.lit("")) for i in range(n)])
    return found.select(F.lit(src_table).alias("src_table"), "record_id", "created_at", F.lit(rule.label).alias("ref_field"), key.alias("ref_key"), "orphan_kind")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, kind and calendar month of the referring row (null month where the row has no created_at)."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    return orphans.groupBy("src_table", "ref_field", month, "orphan_kind").agg(F.count(F.lit(1)).alias("n_orphans"))


ANCHOR_RULES: Sequence[Rule] = (
    Rule("chunk_id", ("chunk_id",), "document_chunk", ("chunk_id",)),
    Rule("section_id", ("section_id",), "parsed_section", ("section_id",)),
    Rule("doc_id", ("doc_id",), "knowledge_doc", ("doc_id",)),
)
CITATION_RULE = Rule("citations.evidence_id", ("evidence_id",), "evidence_anchor", ("anchor_id",))
COMPOSITE_RULE = Rule("chunk_id|section_id|doc_id", ("chunk_id", "section_id", "doc_id"), "document_chunk", ("chunk_id", "section_id", "doc_id"), "partial")


def support_desk_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All single-column references of evidence_anchor and rag_predictions against their targets."""
    dead = tables["record_tombstone"]
    anchors = [find_orphans(tables["evidence_anchor"], "anchor_id", "created_at", "evidence_anchor", r, tables[r.target], dead) for r in ANCHOR_RULES]
    cited = tables["rag_predictions"].select("trace_id", "created_at", F.explode("citations").alias("c")).select("trace_id", "created_at", "c.evidence_id")
    return reduce(DataFrame.unionByName, [*anchors, find_orphans(cited, "trace_id", "created_at", "rag_predictions", CITATION_RULE, tables["evidence_anchor"], dead)])
