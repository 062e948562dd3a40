"""The pN_ queries of the training-data problems and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import leakage, near_duplicates, neighbours, ocr_repair, packing, pii, reading_level, splitting
from talus.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, d, "document_chunk"), "chunk_id", "content", "ingest_ts", k=3, threshold=0.6, min_words=30)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    g = near_duplicates.similar_groups(table(spark, d, "document_chunk"), "chunk_id", "content", "ingest_ts", k=3, threshold=0.6, min_words=30)
    return g.withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.found_noise(table(spark, d, "parsed_section"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.repaired_sections(table(spark, d, "parsed_section"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "document_chunk"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece_no = 0").select("chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_pii(table(spark, d, "tickets"), "ticket_id", ["subject", "description"], "ingest_ts")
    return found.select("ticket_id", "field_name", "pii_kind", "start_at")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_table(table(spark, d, "tickets"), "ticket_id", ["subject", "description"], b"test key; a deployment passes its own", "ingest_ts")


def p7_nearest(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "knowledge_section"), "section_id", "embedding", k=5, version_col="created_at")
    return near.withColumnsRenamed({"id": "section_id", "neighbour_id": "neighbour_section_id"})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("section_id"), F.col("neighbour_section_id")
    near = p7_nearest(spark, d).where("cosine >= 0.95")
    return near.select(F.least(a, b).alias("section_id_a"), F.greatest(a, b).alias("section_id_b")).distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "rag_golden"), "case_id", ["query", "expected_answer"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).select("doc_id", "case_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.near_passages(table(spark, d, "documents"), table(spark, d, "rag_golden"), "case_id", ["query", "expected_answer"])


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_rating"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_repaired": p2_repaired, "p4_found": p4_found, "p4_pieces": p4_pieces, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_nearest": p7_nearest,
    "p8_containers": p8_containers,
    "p9_found": p9_found, "p9_report": p9_report, "p9_near": p9_near, "p10_levels": p10_levels,
}

ORACLES: dict[str, str] = {
    "p1_found": """
with c as (select chunk_id, regexp_extract_all(lower(arg_max(content, ingest_ts)), '[a-z0-9]+') w from document_chunk where content is not null group by 1),
s as (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from c where len(w) >= 30),
n as (select chunk_id, count(*) n from s group by 1),
p as (select a.chunk_id x, b.chunk_id y, count(*) i from s a join s b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2)
select x as chunk_id_a, y as chunk_id_b from p join n nx on nx.chunk_id = x join n ny on ny.chunk_id = y where i >= 0.6 * (nx.n + ny.n - i)""",
    "p1_groups": """
with recursive c as (select chunk_id, regexp_extract_all(lower(arg_max(content, ingest_ts)), '[a-z0-9]+') w from document_chunk where content is not null group by 1),
k as (select chunk_id, w, min(chunk_id) over (partition by w) class_id from c where len(w) >= 30),
s as (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from k where chunk_id = class_id),
n as (select chunk_id, count(*) n from s group by 1),
p as (select a.chunk_id x, b.chunk_id y, count(*) i from s a join s b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2),
l as (select x, y from p join n nx on nx.chunk_id = x join n ny on ny.chunk_id = y where i >= 0.6 * (nx.n + ny.n - i)),
e as (select x a, y b from l union all select y, x from l), m as (select a, count(*)::bigint n_links from e group by 1),
r(node, root) as (select distinct class_id, class_id from k union select e.b, r.root from r join e on e.a = r.node),
g as (select node, min(root) group_id from r group by 1)
select chunk_id, class_id, coalesce(n_links, 0) as n_links, group_id from k join g on g.node = class_id left join m on m.a = class_id""",
    "p4_found": "select distinct chunk_id from document_chunk where length(content) > 1200",
    "p7_found": """
with v as (select section_id, arg_max(embedding, created_at)::double[] e from knowledge_section
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
p as (select a.section_id a, b.section_id b, list_cosine_similarity(a.e, b.e) c from v a join v b on a.section_id <> b.section_id),
r as (select *, row_number() over (partition by a order by c desc, b) k from p)
select distinct least(a, b) as section_id_a, greatest(a, b) as section_id_b from r where k <= 5 and c >= 0.95""",
    "p9_found": """
with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents),
g as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) g from d where len(w) >= 12),
t as (select case_id, regexp_extract_all(lower(unnest([query, expected_answer])), '[a-z0-9]+') w from rag_golden),
h as (select distinct case_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) g from t where len(w) >= 12)
select distinct doc_id, case_id from g join h using (g)""",
}
