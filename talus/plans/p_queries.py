"""The pN_ queries of the general problems (3 and 5) and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.operators import orphans, schema_drift
from talus.sources.tables import table


def _tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in names}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.support_desk_orphans(_tables(spark, d, "evidence_anchor", "rag_predictions", "document_chunk", "parsed_section", "knowledge_doc", "record_tombstone"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "record_id", "ref_field", "ref_key", "orphan_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p5_composite(spark: SparkSession, d: str) -> DataFrame:
    """Anchors whose (chunk, section, document) triple, as far as it is given, is no triple of document_chunk."""
    t = _tables(spark, d, "evidence_anchor", "document_chunk")
    found = orphans.find_orphans(t["evidence_anchor"], "anchor_id", "created_at", "evidence_anchor", orphans.COMPOSITE_RULE, t["document_chunk"])
    return found.select("src_table", "record_id", "ref_field", "ref_key", "orphan_kind")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, d, "raw_record"))


def p3_tickets(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, d, "raw_record"), "tickets")


def p3_sections(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, d, "raw_record"), "knowledge_section")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found, "p3_tickets": p3_tickets, "p3_sections": p3_sections,
    "p5_found": p5_found, "p5_report": p5_report, "p5_composite": p5_composite,
}

_P5 = """
with refs as (
  select 'evidence_anchor' src_table, anchor_id record_id, 'chunk_id' ref_field, 'document_chunk' tgt, nullif(lower(trim(chunk_id)),'') ref_key, created_at from evidence_anchor
  union all select 'evidence_anchor', anchor_id, 'section_id', 'parsed_section', nullif(lower(trim(section_id)),''), created_at from evidence_anchor
  union all select 'evidence_anchor', anchor_id, 'doc_id', 'knowledge_doc', nullif(lower(trim(doc_id)),''), created_at from evidence_anchor
  union all select 'rag_predictions', trace_id, 'citations.evidence_id', 'evidence_anchor', nullif(lower(trim(c.evidence_id)),''), created_at
            from (select trace_id, created_at, unnest(citations) c from rag_predictions)),
r as (select src_table, record_id, ref_field, tgt, ref_key, min(created_at) created_at from refs where ref_key is not null group by all),
keys as (
  select 'document_chunk' tgt, lower(trim(chunk_id)) k, min(created_at) t from document_chunk group by all
  union all select 'parsed_section', lower(trim(section_id)), min(created_at) from parsed_section group by all
  union all select 'knowledge_doc', lower(trim(doc_id)), min(created_at) from knowledge_doc group by all
  union all select 'evidence_anchor', lower(trim(anchor_id)), min(created_at) from evidence_anchor group by all),
dead as (select distinct table_name tgt, lower(trim(record_key)) k from record_tombstone where restored_at is null),
f as (
  select r.*, case when d.k is not null then 'deleted' when keys.k is null then 'missing' when keys.t > r.created_at then 'late' end orphan_kind
  from r left join keys on keys.tgt = r.tgt and keys.k = r.ref_key left join dead d on d.tgt = r.tgt and d.k = r.ref_key)
"""

ORACLES: dict[str, str] = {
    "p5_found": _P5 + "select src_table, record_id, ref_field, ref_key, orphan_kind from f where orphan_kind is not null",
    "p5_report": _P5 + "select src_table, ref_field, strftime(created_at, '%Y-%m') as month, orphan_kind, count(*)::bigint as n_orphans from f where orphan_kind is not null group by all",
    "p5_composite": """
with a as (
  select anchor_id, nullif(lower(trim(chunk_id)),'') c, nullif(lower(trim(section_id)),'') s, nullif(lower(trim(doc_id)),'') d, min(created_at) t
  from evidence_anchor group by all),
k as (select distinct lower(trim(chunk_id)) c, lower(trim(section_id)) s, lower(trim(doc_id)) d, created_at from document_chunk),
j as (
  select a.*, (select min(k.created_at) from k where k.c = a.c and k.s = a.s and k.d = a.d) m7 from a where c is not null and s is not null and d is not null
  union all select a.*, (select min(k.created_at) from k where k.s = a.s and k.d = a.d) from a where c is null and s is not null and d is not null
  union all select a.*, (select min(k.created_at) from k where k.c = a.c and k.d = a.d) from a where c is not null and s is null and d is not null
  union all select a.*, (select min(k.created_at) from k where k.c = a.c and k.s = a.s) from a where c is not null and s is not null and d is null
  union all select a.*, (select min(k.created_at) from k where k.c = a.c) from a where c is not null and s is null and d is null
  union all select a.*, (select min(k.created_at) from k where k.s = a.s) from a where c is null and s is not null and d is null
  union all select a.*, (select min(k.created_at) from k where k.d = a.d) from a where c is null and s is null and d is not null)
select 'evidence_anchor' as src_table, anchor_id as record_id, 'chunk_id|section_id|doc_id' as ref_field,
  coalesce(c,'')||'|'||coalesce(s,'')||'|'||coalesce(d,'') as ref_key, case when m7 is null then 'missing' else 'late' end as orphan_kind
from j where m7 is null or m7 > t""",
}
