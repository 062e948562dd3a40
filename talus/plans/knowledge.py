"""Queries over the knowledge tables: hybrid retrieval, evaluation, chunk gates and the smaller operators beside them, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import text as X
from talus.operators import chunking, evaluation, governance, indexing, quality, retrieval, upserts
from talus.plans import factory, kpi
from talus.sources import assets, lakehouse
from talus.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- evaluation -----------------------------------------------------------------------------------------------------------------------------


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Cases cite sources: a chunk's evidence is its source, and the source a golden item names is what it expects. The forbidden phrases are stated here; no table has any."""
    c = upserts.latest_by(table(spark, d, "document_chunk"), ["chunk_id"], ["ingest_ts"], ["source_id", "content"]).withColumnRenamed("source_id", "evidence_id")
    g = table(spark, d, "rag_golden").select("case_id", "category", "expected_answer", "expected_keywords", F.array_compact(F.array("source_doc")).alias("expected_ids"), F.array(F.lit("known workaround"), F.lit("guaranteed")).alias("forbidden_phrases"), "should_abstain")
    return evaluation.eval_scores(g, table(spark, d, "rag_predictions"), c)


_TOKENS = """list_concat(regexp_extract_all(lower({0}), '[a-z0-9_]+'), list_concat(regexp_extract_all(lower({0}), '[一-鿿]'),
  list_transform(range(1, greatest(len(regexp_extract_all(lower({0}), '[一-鿿]')), 1)), lambda i: regexp_extract_all(lower({0}), '[一-鿿]')[i] || regexp_extract_all(lower({0}), '[一-鿿]')[i + 1])))"""
_LIMITS = evaluation.THRESHOLDS
_LOW = ", ".join(f"case when not should_abstain and {m} < {t} then '{m}_below_threshold:' || round({m}::decimal(18, 6), 3)::decimal(18, 3)::varchar || '<{t:.3f}' end" for m, t in _LIMITS.items())
_has = lambda c, ws: "(" + " or ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_EVAL = f"""with p as (select case_id, arg_max({{'a': answer, 'r': abstain_reason, 'c': citations, 'x': retrieved_contexts}}, {{'c': created_at, 't': trace_id}}) x from rag_predictions group by 1),
ct as (select chunk_id, arg_max({{'e': source_id, 't': content}}, ingest_ts) x from document_chunk group by 1),
h as (select case_id, generate_subscripts(x.x, 1) i, unnest(x.x).chunk_id chunk_id from p),
ctx as (select case_id, list({{'id': chunk_id, 'e': ct.x.e, 't': coalesce(ct.x.t, '')}} order by i) l from h join ct using (chunk_id) group by 1),
j as (select g.case_id, category, expected_answer e, expected_keywords kw, list_filter([source_doc], lambda z: z is not null) ids, should_abstain, coalesce(p.x.a, '') a, p.x.c cit,
    case when p.case_id is null then 'missing_prediction' else coalesce(p.x.r, '') end r, coalesce(ctx.l, []) ctx from rag_golden g left join p using (case_id) left join ctx using (case_id)),
k as (select *, r <> '' abst, {_TOKENS.format("a")} ta, {_TOKENS.format("e")} te, list_distinct({_TOKENS.format("list_aggregate(list_transform(ctx, lambda z: z.t), 'string_agg', chr(10))")}) tc,
    list_concat(flatten(list_transform(list_filter(coalesce(cit, []), lambda z: z is not null), lambda z: [z.evidence_id, z.chunk_id, z.doc_id])), list_concat(list_transform(ctx, lambda z: z.e), list_transform(ctx, lambda z: z.id))) act from j),
cnt as (select case_id, tok, sum(n) filter (s = 'a') na, sum(n) filter (s = 'e') ne from (select case_id, unnest(ta) tok, 1 n, 'a' s from k union all select case_id, unnest(te), 1, 'e' from k) group by 1, 2),
cos as (select case_id, coalesce(sum(na * ne), 0)::double / greatest(sqrt(coalesce(sum(na * na), 0)::double) * sqrt(coalesce(sum(ne * ne), 0)::double), 1e-9) c from cnt group by 1),
m as (select k.*, case when abst then 0.5 when len(ta) = 0 or len(coalesce(tc, [])) = 0 then 0.0 else round(least(1.0::double, len(list_filter(ta, lambda z: list_contains(tc, z)))::double / len(ta) * 1.8::double), 6) end::double faithfulness,
    round(case when len(kw) > 0 then len(list_filter(kw, lambda w: contains(lower(a), lower(w))))::double / len(kw) else 1 end, 6) answer_relevance,
    case when len(ta) = 0 or len(te) = 0 then 0.0 else round(coalesce(c, 0), 6) end::double semantic_similarity,
    case when len(ctx) = 0 then case when len(ids) > 0 then 0.0 else 1.0 end else round(len(list_filter(ctx, lambda z: coalesce(list_contains(ids, z.e), false) or list_contains(ids, z.id) or len(list_filter(kw, lambda w: contains(lower(concat_ws(' ', z.id, coalesce(z.e, ''), z.t)), lower(w)))) > 0))::double / len(ctx), 6) end::double context_precision,
    case when len(ids) = 0 then should_abstain::int else round(len(list_filter(list_distinct(ids), lambda e2: len(list_filter(act, lambda z: z is not null and contains(z, e2))) > 0))::double / len(list_distinct(ids)), 6) end::double context_recall
  from k left join cos using (case_id)),
n as (select *, round(answer_relevance * 0.65::double + semantic_similarity * 0.35::double, 6) answer_correctness,
    not regexp_matches(a, '\\b1[3-9]\\d{{9}}\\b|\\b\\d{{17}}[\\dXx]\\b|\\b\\d{{12,19}}\\b') and not {_has("lower(a)", ("known workaround", "guaranteed"))} and (not should_abstain or abst or {_has("a", evaluation.REFUSALS)}) safety_pass from m),
s as (select *, list_filter([case when not safety_pass then 'safety_or_compliance_failed' end, case when should_abstain and not abst and not {_has("a", evaluation.ABSTAINING)} then 'expected_abstain' end, {_LOW}], lambda z: z is not null) f from n),
scores as (select case_id, category, faithfulness, answer_relevance, context_precision, context_recall, answer_correctness, semantic_similarity, safety_pass, len(f) = 0 as passed, f as failure_reasons from s) """


@query(_EVAL + "select * exclude (failure_reasons), array_to_string(failure_reasons, ';') as failure_reasons from scores")
def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("failure_reasons", F.array_join("failure_reasons", ";"))


@query(_EVAL + ", r as (select count(*)::bigint cases, round(coalesce(avg(passed::int), 0), 6) pass_rate, round(coalesce(avg(passed::int) filter (category = 'adversarial'), 0), 6) adversarial_pass_rate, count_if(not safety_pass)::bigint unsafe_cases from scores) select *, case when pass_rate < 0.8 or adversarial_pass_rate < 1 or unsafe_cases > 0 then 'fail' else 'pass' end as decision from r")
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.run_gate(_scores(spark, d))


@query(_EVAL + ", w as (select unnest(['happy', 'boundary', 'adversarial', 'multi_hop', 'unseen']) category), g as (select category, count(*)::bigint cases, count_if(passed)::bigint passed from scores group by 1) select category, coalesce(cases, 0) as cases, coalesce(passed, 0) as passed, round(coalesce(passed::double / nullif(cases, 0), 0), 6) as pass_rate from w left join g using (category)")
def eval_category(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.category_breakdown(_scores(spark, d), ["happy", "boundary", "adversarial", "multi_hop", "unseen"])


@query(_EVAL + "select " + ", ".join(f"round(coalesce(avg({m}), 0), 6) as {m}" for m in _LIMITS) + ", round(coalesce(avg(passed::int), 0), 6) as pass_rate, round(coalesce(avg(passed::int) filter (category = 'adversarial'), 0), 6) as adversarial_pass_rate, round(coalesce(avg(safety_pass::int), 0), 6) as safety_pass_rate from scores")
def eval_metric_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metric_means(_scores(spark, d))


_SET = "list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '\\s+'), lambda z: z <> ''))"


@query(f"""with p as (select case_id, arg_max({{'a': answer}}, {{'c': created_at, 't': trace_id}}) x from rag_predictions group by 1), s as (select case_id, {_SET.format("query")} q, {_SET.format("p.x.a")} a from rag_golden join p using (case_id))
  select case_id, case when len(a) = 0 or len(q) = 0 then 0.0 else round(len(list_intersect(q, a))::double / len(q), 6) end::double as relevance from s""")
def older_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The set-based relevance of the older harness: words of the query that the answer has."""
    p = table(spark, d, "rag_predictions").groupBy("case_id").agg(F.max_by("answer", F.struct("created_at", "trace_id")).alias("answer"))
    j = table(spark, d, "rag_golden").join(p, "case_id")
    return j.select("case_id", evaluation.set_overlap(evaluation.word_set("query"), evaluation.word_set("answer")).alias("relevance"))


@query("""with p as (select trace_id, created_at, unnest(case when len(citations) > 0 then citations else [null] end) c from rag_predictions), v as (select trace_id, created_at, unnest([c.evidence_id, c.chunk_id, c.doc_id]) x from p),
  l as (select trace_id, created_at, list_sort(list_distinct(list(x) filter (x is not null and x <> ''))) l from v group by all) select distinct trace_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, coalesce(array_to_string(l, ','), '') as ids from l""")
def citation_sets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "rag_predictions").groupBy("trace_id", "created_at").agg(F.flatten(F.collect_list(F.coalesce("citations", F.expr("filter(citations, x -> false)")))).alias("citations"))
    return p.select("trace_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.array_join(evaluation.citation_ids("citations"), ",").alias("ids"))


# --- hybrid retrieval -----------------------------------------------------------------------------------------------------------------------

_WHERE = {"index_release_id": ["idx-2026.06", "idx-2026.07"], "doc_status": "active", "product_line": "any", "quality_status": "pass"}
_STOP = "[" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_UNIT = "list_transform(range(64), lambda i: ('0x' || substr(sha256({0} || chr(0) || (i // 8)::varchar), ((i % 8) * 8 + 1)::bigint, 8))::bigint / 2147483647.5::double - 1.0::double)"


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    text = upserts.latest_by(table(spark, d, "document_chunk"), ["chunk_id"], ["ingest_ts"], ["content", "quality_status"]).withColumnRenamed("chunk_id", "section_id")
    s = upserts.latest_by(table(spark, d, "knowledge_section"), ["section_id"], ["created_at", "index_release_id"], ["doc_id", "embedding", "index_release_id"])
    s = s.withColumn("embedding", F.when(indexing.usable_vector("embedding", 64), F.col("embedding")))
    docs = upserts.latest_by(table(spark, d, "knowledge_doc"), ["doc_id"], ["ingest_ts", "title"], ["title", "product_line", "doc_status"])
    q = table(spark, d, "rag_golden").select(F.col("case_id").alias("query_id"), "query", X.hash_embedding("query", 64).alias("embedding"))
    return retrieval.hybrid_search(q, s.join(text, "section_id"), docs, table(spark, d, "evidence_anchor"), _WHERE, "query_id", "query")


@query(f"""with ct as (select chunk_id section_id, arg_max({{'t': content, 'q': quality_status}}, ingest_ts) x from document_chunk group by 1),
ks as (select section_id, arg_max({{'d': doc_id, 'e': embedding, 'r': index_release_id}}, {{'c': created_at, 'r': index_release_id}}) x from knowledge_section group by 1),
kd as (select doc_id, arg_max({{'p': product_line, 's': doc_status}}, {{'i': ingest_ts, 't': title}}) x from knowledge_doc group by 1),
base as (select section_id, ct.x.t content, case when len(ks.x.e) = 64 and len(list_filter(ks.x.e, lambda z: z is not null and isfinite(z))) = 64 and len(list_filter(ks.x.e, lambda z: z <> 0)) > 0 then ks.x.e::double[] end e
  from ks join ct using (section_id) join kd on kd.doc_id = ks.x.d where ks.x.r in ('idx-2026.06', 'idx-2026.07') and kd.x.s = 'active' and ct.x.q = 'pass'),
q as (select case_id query_id, {_UNIT.format("query")} v, list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda x: not list_contains({_STOP}, x)) t from rag_golden),
an as (select distinct chunk_id section_id, anchor_id from evidence_anchor where chunk_id is not null and anchor_id is not null),
vs as (select * from (select query_id, section_id, round(list_cosine_similarity(v, e), 6) score, row_number() over (partition by query_id order by round(list_cosine_similarity(v, e), 6) desc, section_id) r from q, base where e is not null) where r <= 20),
a as (select query_id, len(t) n, unnest(t) term from q), dw as (select section_id, regexp_extract_all(lower(content), '[a-z0-9]+') w from base),
tf as (select section_id, l, term, count(*) tf from (select section_id, len(w) l, unnest(w) term from dw) where term in (select term from a) group by all),
lx as (select query_id, section_id, n, l, count(*) f, sum(tf) s from tf join a using (term) group by all having count(*) = n),
ls as (select * from (select query_id, section_id, round(1000.0::double * s / l, 6) score, row_number() over (partition by query_id order by round(1000.0::double * s / l, 6) desc, section_id) r from lx) where r <= 20),
rows as (select leg, query_id, section_id, score, coalesce(anchor_id, section_id) ev, row_number() over (partition by leg, query_id order by score desc, section_id, coalesce(anchor_id, section_id)) rank
  from (select 'v' leg, query_id, section_id, score from vs union all select 'l', query_id, section_id, score from ls) left join an using (section_id)),
f as (select query_id, section_id, round(sum(1.0::double / (60 + rank)), 9) rrf_score, max(score) filter (leg = 'v') vector_score, max(score) filter (leg = 'l') lexical_score, min(rank) filter (leg = 'v') v, min(rank) filter (leg = 'l') l, min(ev) evidence_id from rows where rank <= 20 group by 1, 2),
g as (select *, row_number() over (partition by query_id order by rrf_score desc, v nulls last, l nulls last, section_id)::int rank from f)
select query_id, section_id, evidence_id, vector_score, lexical_score, rrf_score, round(least(1.0, greatest(0.0, rrf_score * 10)), 6)::double as relevance, rank from g where rank <= 10""")
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Vector and lexical leg over the sections that pass the filters, with their document and anchors, fused and clamped."""
    return _hybrid(spark, d)


@query()
def cover_density_topk(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed words, ranked by how densely they stand; no SQL has the stems."""
    return retrieval.cover_top_k(table(spark, d, "rag_golden").withColumnRenamed("case_id", "query_id"), table(spark, d, "documents"), "query_id", "query", "doc_id", "text", 10)


@query(f"""with q as (select case_id, list_transform(range(16), lambda i: ('0x' || substr(sha256(query || chr(0) || (i // 8)::varchar), ((i % 8) * 8 + 1)::bigint, 8))::bigint / 2147483647.5::double - 1.0::double) r from rag_golden),
  u as (select case_id, r, sqrt(list_sum(list_transform(r, lambda z: z * z))) n from q) select case_id, (generate_subscripts(r, 1) - 1)::int as i, round(unnest(list_transform(r, lambda z: z / n)), 9) as x from u""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "rag_golden").select("case_id", X.hash_embedding("query", 16).alias("v"))
    return g.select("case_id", F.posexplode("v").alias("i", "x")).select("case_id", "i", F.round("x", 9).alias("x"))


# --- chunk gate and chunks of sections --------------------------------------------------------------------------------------------------------


def _gate_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks carry the warnings of their section's parser."""
    c = upserts.latest_by(table(spark, d, "document_chunk"), ["chunk_id"], ["ingest_ts"], ["doc_id", "source_id", "section_id", "content", "chunk_strategy_version", "parse_strategy_version", "data_release_id", "anchor_count"])
    s = upserts.latest_by(table(spark, d, "parsed_section"), ["section_id"], ["ingest_ts"], ["parser_capability"])
    cap = F.col("parser_capability")
    codes = F.concat(F.coalesce(cap["warnings"], F.array().cast("array<string>")), F.when(F.coalesce(cap["fallback_used"], F.lit(False)), F.array(F.lit("fallback_parser_used"))).otherwise(F.array().cast("array<string>")))
    return c.join(s.select("section_id", codes.alias("reason_codes")), "section_id", "left"), table(spark, d, "evidence_anchor"), s


_PII = quality.PII_A
_GATE = rf"""with c as (select chunk_id, arg_max({{'d': doc_id, 's': source_id, 'x': section_id, 't': content, 'a': chunk_strategy_version, 'b': parse_strategy_version, 'r': data_release_id, 'n': anchor_count}}, ingest_ts) v from document_chunk group by 1),
s as (select section_id, arg_max(parser_capability, ingest_ts) p from parsed_section group by 1), an as (select distinct chunk_id from evidence_anchor where chunk_id is not null),
j as (select c.chunk_id, v, list_concat(coalesce(p.warnings, []), case when p.fallback_used then ['fallback_parser_used'] else [] end) codes, an.chunk_id is null unanchored, s.section_id is null orphan from c left join s on s.section_id = c.v.x left join an using (chunk_id)),
k as (select *, trim(coalesce(v.t, '')) = '' empty, coalesce(regexp_matches(v.t, '{_PII}'), false) pii, list_contains(codes, 'fallback_parser_used') fallback,
  trim(coalesce(v.d, '')) = '' or trim(coalesce(v.s, '')) = '' or trim(coalesce(v.x, '')) = '' or trim(coalesce(v.a, '')) = '' or trim(coalesce(v.b, '')) = '' or trim(coalesce(v.r, '')) = '' incomplete from j),
l as (select *, coalesce(v.n, 0) > 0 and not empty and not pii allowed, list_sort(list_distinct(case when pii then list_append(codes, 'pii_suspected') else codes end)) all_codes from k) """


@query(_GATE + "select chunk_id, array_to_string(all_codes, ',') as reason_codes, allowed as allowed_for_indexing, case when not allowed then 'fail' when len(all_codes) > 0 then 'warn' else 'pass' end as status from l")
def chunk_indexable(spark: SparkSession, d: str) -> DataFrame:
    c = quality.chunk_checks(*_gate_inputs(spark, d))
    return c.select("chunk_id", F.array_join("reason_codes", ",").alias("reason_codes"), "allowed_for_indexing", "status")


_GATE_ROW = _GATE + """, f as (select count(*)::bigint n_chunks, count_if(empty)::bigint empty_chunks, count_if(unanchored)::bigint unanchored_chunks, count_if(orphan)::bigint orphan_chunks, count_if(incomplete)::bigint incomplete_chunks, count_if(pii)::bigint pii_suspected_chunks, count_if(fallback)::bigint fallback_chunks, count_if(allowed)::bigint allowed_chunks from l),
h as (select count(*)::bigint n_anchors, count_if(chunk_id is null or chunk_id not in (select chunk_id from c))::bigint orphan_anchors, count_if(asset_type = 'pdf' and page_no is null)::bigint pdf_without_page from evidence_anchor),
g as (select *, round((n_chunks - incomplete_chunks)::double / n_chunks, 4) metadata_completeness, round((n_chunks - unanchored_chunks)::double / n_chunks, 4) anchor_coverage,
  list_filter([case when empty_chunks > 0 then 'empty_chunks' end, case when unanchored_chunks > 0 then 'missing_evidence_anchor' end, case when orphan_chunks > 0 then 'orphan_chunks' end, case when orphan_anchors > 0 then 'orphan_anchors' end, case when pdf_without_page > 0 then 'pdf_missing_page_no' end], lambda z: z is not null) e,
  list_filter([case when incomplete_chunks > 0 then 'metadata_incomplete' end, case when fallback_chunks > 0 then 'fallback_parser_used' end, case when pii_suspected_chunks > 0 then 'pii_suspected' end], lambda z: z is not null) w from f, h) """


@query(_GATE_ROW + "select * exclude (e, w), array_to_string(e, ',') as errors, array_to_string(w, ',') as warnings, case when len(e) > 0 then 'fail' when len(w) > 0 then 'warn' else 'pass' end as status from g")
def chunk_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    g = quality.chunk_quality_gate(*_gate_inputs(spark, d)).drop("synthetic_chunks", "blocked_chunks")  # no chunk of these tables can be either
    return g.withColumns({"errors": F.array_join("errors", ","), "warnings": F.array_join("warnings", ",")})


@query(_GATE_ROW + """select round(greatest(0.0, 1 - incomplete_chunks::double / n_chunks), 6) as completeness, round(greatest(0.0, 1 - (empty_chunks + fallback_chunks)::double / n_chunks), 6) as noise, round(greatest(0.0, 1 - unanchored_chunks::double / n_chunks), 6) as evidence,
  case when len(e) > 0 then 0.0 else 1.0 end::double as coherence, case when len(e) > 0 then 'block' when len(w) > 0 then 'warn' else 'pass' end as decision from g""")
def quality_projection(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(quality.chunk_quality_gate(*_gate_inputs(spark, d)))


@query("select chunk_id, doc_id from (select chunk_id, doc_id, chunk_index, row_number() over (partition by doc_id order by chunk_index, chunk_id) n from (select chunk_id, v.d doc_id, v.i chunk_index from (select chunk_id, arg_max({'d': doc_id, 'i': chunk_index}, ingest_ts) v from document_chunk group by 1))) where n <= 5")
def gate_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first five chunks of every document, which a reviewer sees."""
    c = upserts.latest_by(table(spark, d, "document_chunk"), ["chunk_id"], ["ingest_ts"], ["doc_id", "chunk_index"])
    return retrieval.top_k(c.withColumn("_first", -F.col("chunk_index")), "doc_id", "_first", "chunk_id", 5).select("chunk_id", "doc_id")


@query(r"""with s as (select section_id, arg_max({'c': content, 't': section_type, 'p': parser_capability, 'h': section_path, 'd': doc_id}, ingest_ts) v from parsed_section group by 1),
  w as (select section_id, v, regexp_replace(v.c, '^\s+|\s+$', '', 'g') body from s where v.c is not null)
  select section_id, 'chunk-' || left(sha256(section_id || '|0|boundary-v1'), 24) as chunk_id, length(body)::int as n_chars, 'whole_' || coalesce(v.t, 'section') as reason,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(v.p.warnings, []), case when v.p.fallback_used then ['fallback_parser_used'] else [] end))), ',') as reason_codes, left(concat_ws(' | ', v.d, nullif(v.h, '')), 240) as context_prefix
  from w where body <> '' and (length(body) <= 512 or v.t in ('table', 'code', 'image', 'transcript'))""")
def whole_section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sections that stay whole; the cut ones are in section_chunks, which SQL cannot say."""
    c = _section_chunks(spark, d).where(F.col("reason").startswith("whole_"))
    return c.select("section_id", "chunk_id", F.char_length("content").alias("n_chars"), "reason", F.array_join("reason_codes", ",").alias("reason_codes"), "context_prefix")


def _section_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = upserts.latest_by(table(spark, d, "parsed_section"), ["section_id"], ["ingest_ts"], ["doc_id", "section_path", "section_type", "content", "parser_capability"])
    return chunking.chunk_sections(s, "boundary-v1")


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _section_chunks(spark, d).select("chunk_id", "section_id", "section_chunk_index", "span_start", "span_end", "reason")


# --- documents, sources and small operators ---------------------------------------------------------------------------------------------------


@query("""select doc_id, lower(asset_type) as asset_type, lower(pii_level) as pii_level, lower(doc_status) as doc_status, lower(license_tag) as license_tag, created_at::date as created_date, title from
  (select *, row_number() over (partition by doc_id order by ingest_ts desc, title desc) n from knowledge_doc) where n = 1""")
def stg_knowledge_docs(spark: SparkSession, d: str) -> DataFrame:
    k = upserts.latest_by(table(spark, d, "knowledge_doc"), ["doc_id"], ["ingest_ts", "title"], ["asset_type", "pii_level", "doc_status", "license_tag", "created_at", "title"])
    return k.select("doc_id", *[F.lower(c).alias(c) for c in ("asset_type", "pii_level", "doc_status", "license_tag")], F.to_date("created_at").alias("created_date"), "title")


@query("""select record_id, case when regexp_matches(trim(x), '^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?(Z|[+-]\\d{2}:?\\d{2})?)?$') then strftime(try_cast(replace(x, 'Z', '+00:00') as timestamptz) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') end as created_at
  from (select distinct record_id, case when json_valid(payload) then payload->>'$.created_at' end x from raw_record where record_id is not null)""")
def iso_timestamps(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_record").where("record_id is not null").select("record_id", F.when(F.try_parse_json("payload").isNotNull(), F.get_json_object("payload", "$.created_at")).alias("x")).distinct()
    return r.select("record_id", F.date_format(X.iso_time("x"), "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("""with k as (select doc_id, max(title) title from knowledge_doc group by 1), s as (select section_id, arg_max({'d': doc_id, 'p': section_path}, ingest_ts) v from parsed_section group by 1)
  select section_id, left(concat_ws(' | ', nullif(title, ''), nullif(v.p, '')), 240) as prefix, coalesce(len(list_filter(string_split_regex(v.p, '\\s*/\\s*| > '), lambda z: z <> '')), -1)::int as depth from s left join k on k.doc_id = s.v.d""")
def context_prefixes(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "knowledge_doc").groupBy("doc_id").agg(F.max("title").alias("title"))
    s = upserts.latest_by(table(spark, d, "parsed_section"), ["section_id"], ["ingest_ts"], ["doc_id", "section_path"])
    return s.join(k, "doc_id", "left").select("section_id", X.context_prefix("title", "section_path").alias("prefix"), F.coalesce(F.size(X.heading_path("section_path")), F.lit(-1)).alias("depth"))


@query("""select source_id, asset_type, case lower(asset_type) when 'pdf' then 'pdf_baseline' when 'image' then 'ocr_sidecar' when 'audio' then 'transcript' when 'video' then 'transcript' when 'html' then 'html' when 'webpage' then 'html' when 'markdown' then 'markdown' else 'plain' end as parser_backend from raw_doc_asset""")
def asset_routes(spark: SparkSession, d: str) -> DataFrame:
    return assets.route(table(spark, d, "raw_doc_asset")).select("source_id", "asset_type", "parser_backend")


@query("""select source_id, round(avg(case when trim(coalesce(content, '')) <> '' then 1.0 else 0.0 end), 6)::double as text_share, case when avg(case when trim(coalesce(content, '')) <> '' then 1.0 else 0.0 end) > 0.8 then 'text_based' when avg(case when trim(coalesce(content, '')) <> '' then 1.0 else 0.0 end) < 0.2 then 'scanned' else 'hybrid' end as pdf_type
  from parsed_section where asset_type = 'pdf' group by 1""")
def pdf_types(spark: SparkSession, d: str) -> DataFrame:
    return assets.pdf_types(table(spark, d, "parsed_section").where("asset_type = 'pdf'"), "source_id", "content")


@query(r"""with l as (select doc_id, generate_subscripts(x, 1) i, unnest(x) line from (select doc_id, string_split(text, chr(10)) x from documents where text is not null))
  select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as section_index, length(line)::int as n_chars from l where trim(line, ' ') <> ''""")
def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a plain transcript: a section per line that is not blank."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return chunking.transcript_sections(lines, "doc_id", "line", "line_no").select("doc_id", "section_index", F.char_length("content").alias("n_chars"))


@query("select count(*)::bigint as n_sections, count(distinct source_id)::bigint as n_sources, array_to_string(list_sort(list_distinct(flatten(list(coalesce(parser_capability.warnings, []))))), ',') as warnings from parsed_section")
def warning_sets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "parsed_section")
    w = s.select(F.explode("parser_capability.warnings").alias("w")).agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("warnings"))
    return s.agg(F.count(F.lit(1)).alias("n_sections"), F.count_distinct("source_id").alias("n_sources")).crossJoin(w)  # one row each


@query("select doc_id, arg_min(section_path, {'p': coalesce(page_no, 0), 's': section_id, 'i': ingest_ts}) as first_section from parsed_section where section_path is not null group by 1")
def first_sections(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct(F.coalesce("page_no", F.lit(0)), "section_id", "ingest_ts")
    return table(spark, d, "parsed_section").where("section_path is not null").groupBy("doc_id").agg(F.min_by("section_path", order).alias("first_section"))


@query("select arg_min(data_release_id, doc_id) as first_release, strftime(max(ingest_ts), '%Y-%m-%d %H:%M:%S') as newest, (date_diff('day', max(ingest_ts)::date, date '2026-12-31'))::int as age_days from knowledge_doc where data_release_id is not null")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "knowledge_doc").where("data_release_id is not null").agg(F.min_by("data_release_id", "doc_id").alias("first_release"), F.max("ingest_ts").alias("t"))
    return k.select("first_release", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("newest"), F.date_diff(F.lit("2026-12-31").cast("date"), F.to_date("t")).alias("age_days"))


@query("select count(*)::bigint as n_chunks, count_if(s.section_id is null)::bigint as without_section from (select distinct chunk_id, section_id from document_chunk) c left join (select distinct section_id from parsed_section) s using (section_id)")
def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose section cannot be looked up, where a loader would stop."""
    s = table(spark, d, "parsed_section").select("section_id").dropna().distinct().withColumn("there", F.lit(True))
    return table(spark, d, "document_chunk").select("chunk_id", "section_id").distinct().join(s, "section_id", "left").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("there").isNull()).alias("without_section"))


@query("select doc_id, title from (select distinct doc_id, title, product_line, source_id from knowledge_doc) where contains(lower(concat_ws(' ', title, product_line, source_id)), 'edge') and contains(lower(concat_ws(' ', title, product_line, source_id)), 'faq')")
def conjunctive_search(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "knowledge_doc").select("doc_id", "title", "product_line", "source_id").distinct()
    return k.where(X.all_terms_in("Edge FAQ", "title", "product_line", "source_id")).select("doc_id", "title")


@query("select manifest_id, count(*)::bigint as n_assets, min(source_id) as first_source from raw_doc_asset where manifest_id = (select min(manifest_id) from raw_doc_asset) group by 1")
def first_manifest(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "raw_doc_asset")
    first = a.agg(F.min("manifest_id").alias("manifest_id"))
    return a.join(first, "manifest_id").groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n_assets"), F.min("source_id").alias("first_source"))


@query("select source_id, manifest_id, asset_type from raw_doc_asset where manifest_id is not null")
def manifest_assets(spark: SparkSession, d: str) -> DataFrame:
    """The assets as manifests: written as one JSON file per manifest into a scratch folder, read back and exploded."""
    from talus.session import stage_root

    at = f"{stage_root(spark)}/manifests"
    m = table(spark, d, "raw_doc_asset").where("manifest_id is not null").groupBy("manifest_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "asset_type"))).alias("assets"))
    m.select(F.to_json(F.struct("manifest_id", "assets")).alias("value"), F.col("manifest_id").alias("part")).write.mode("overwrite").partitionBy("part").text(at)
    return lakehouse.read_manifests(spark, f"{at}/*", suffix="txt").select("asset.source_id", "manifest_id", "asset.asset_type")


@query("select count_if(o)::bigint as good, count_if(not o)::bigint as bad from (select case when json_valid(payload) then json_type(payload) = 'OBJECT' else false end o from raw_record where trim(payload) <> '')")
def tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw payloads as a file of JSON lines, read tolerantly."""
    from talus.session import stage_root

    at = f"{stage_root(spark)}/lines"
    table(spark, d, "raw_record").where(F.trim("payload") != "").select("payload").write.mode("overwrite").text(at)
    good, bad = lakehouse.read_jsonl(spark, at, "schema_version string")
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad")))  # one row each


_MASKS = {"none": ("keep", "keep"), "low": ("keep", "hash"), "high": ("drop", "hash")}


@query("""select ticket_id, strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') as ingest_ts, case coalesce(pii_level, 'high') when 'none' then subject when 'low' then subject end as subject, case when coalesce(pii_level, 'high') = 'none' then customer_id when customer_id is not null then left(sha256(customer_id), 16) end as customer_id from tickets""")
def masked_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Columns kept, hashed or dropped by a rule table over the ticket's level; an unknown level has the strictest rule."""
    rules = spark.createDataFrame([(k, *v) for k, v in _MASKS.items()], "level string, subject_rule string, customer_rule string")
    t = governance.apply_policy(table(spark, d, "tickets"), "pii_level", rules, {"subject": "subject_rule", "customer_id": "customer_rule"}, "high")
    return t.select("ticket_id", F.date_format("ingest_ts", "yyyy-MM-dd HH:mm:ss").alias("ingest_ts"), "subject", "customer_id")


@query("""with w as (select feed, file_name, line_no, record_id, row_number() over (partition by feed order by file_name, line_no, record_id) n from raw_record where record_id is not null) select feed, file_name, line_no::int as line_no, record_id from w where n <= 3""")
def first_records(spark: SparkSession, d: str) -> DataFrame:
    """The first three records of each feed in file order, as a loader with a limit reads them."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("feed").orderBy("file_name", "line_no", "record_id"))
    return table(spark, d, "raw_record").where("record_id is not null").withColumn("n", n).where("n <= 3").select("feed", "file_name", F.col("line_no").cast("int").alias("line_no"), "record_id")


@query("""select mode, count(*)::bigint as n from (select unnest(['full_snapshot', 'incremental_cursor', 'backfill']) mode) m join raw_doc_asset a on m.mode = 'full_snapshot' or (m.mode = 'incremental_cursor' and a.ingest_ts > timestamp '2026-01-01') or (m.mode = 'backfill' and a.ingest_ts >= timestamp '2025-06-01' and a.ingest_ts < timestamp '2025-07-01') group by 1""")
def load_modes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "raw_doc_asset")
    asked = {"full_snapshot": {}, "incremental_cursor": {"cursor": "2026-01-01"}, "backfill": {"start": "2025-06-01", "end": "2025-07-01"}}
    parts = [upserts.load(a, mode, "ingest_ts", **kw).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n")) for mode, kw in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("n > 0")


# --- runs, contracts and governed responses -----------------------------------------------------------------------------------------------------


@query()
def factory_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The whole dataflow over the tables and the evidence of its checks. SQL could only repeat the statuses, so tests break inputs instead."""
    return factory.run_evidence(spark, {n: table(spark, d, n) for n in factory.INPUTS})[1]


_TICKET_SCHEMA = {
    "required": ["ticket_id", "customer_id", "created_at", "subject"],
    "properties": {
        "ticket_id": {"type": "string", "pattern": "^TKT-[0-9]{8}-[0-9]+$"}, "status": {"enum": ["open", "pending", "in_progress", "resolved", "closed", "escalated"]}, "subject": {"type": "string", "minLength": 10},
        "sla_tier": {"enum": ["enterprise", "professional", "standard", "free"]}, "error_codes": {"type": "array", "maxItems": 2},
    },
}


@query("""select ticket_id, strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') as ingest_ts, array_to_string(list_filter([case when ticket_id is null then 'ticket_id:required' end, case when customer_id is null then 'customer_id:required' end, case when created_at is null then 'created_at:required' end, case when subject is null then 'subject:required' end,
    case when not regexp_matches(ticket_id, '^TKT-[0-9]{8}-[0-9]+$') then 'ticket_id:pattern' end, case when status not in ('open', 'pending', 'in_progress', 'resolved', 'closed', 'escalated') then 'status:enum' end, case when length(subject) < 10 then 'subject:minLength' end,
    case when sla_tier not in ('enterprise', 'professional', 'standard', 'free') then 'sla_tier:enum' end, case when len(error_codes) > 2 then 'error_codes:maxItems' end], lambda z: z is not null), ',') as reasons from tickets""")
def ticket_schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rules compiled from a JSON Schema, all in one pass."""
    rules = quality.schema_rules(_TICKET_SCHEMA)
    return table(spark, d, "tickets").select("ticket_id", F.date_format("ingest_ts", "yyyy-MM-dd HH:mm:ss").alias("ingest_ts"), F.array_join(quality.errors(rules), ",").alias("reasons"))


@query("""with m as (select manifest_id, list({'s': source_id}) a, count(*) n, count(distinct source_id) u, min(asset_type) lo, max(asset_type) hi from raw_doc_asset group by 1)
  select manifest_id, array_to_string(list_filter([case when not (lo in ('pdf', 'html', 'faq')) then 'unknown_modality' end, case when n <> u then 'repeated_source_id' end], lambda z: z is not null), ',') as reasons from m""")
def manifest_rule_errors(spark: SparkSession, d: str) -> DataFrame:
    """The assets' manifests against the manifest rules; a manifest's modality is its first asset type."""
    a = table(spark, d, "raw_doc_asset")
    m = a.groupBy("manifest_id").agg(F.collect_list(F.struct("source_id")).alias("assets"), F.min("asset_type").alias("modality")).withColumns({"source_type": F.col("modality"), "load_mode": F.lit("full_snapshot"), "cursor_field": F.lit(None).cast("string")})
    errors = quality.manifest_errors(m, {k: [k] for k in ("pdf", "html", "faq")}, ["full_snapshot", "incremental_cursor"])
    return m.select("manifest_id", F.array_join(errors, ",").alias("reasons"))


@query("""with v as (select source_id, sum(amount) amount from (select event_type source_id, 1 amount from events) group by 1) select 'metric_not_in_mart' as rule, 'revenue' as detail from v where not exists (select 1 from v where source_id = 'revenue') group by 1, 2
  union all select 'metric_not_registered', source_id from v where source_id not in ('view', 'click', 'error') union all select 'dimension_not_in_view', x from (select unnest(['user_id', 'region']) x) where x not in (select column_name from (describe events))""")
def registry_errors(spark: SparkSession, d: str) -> DataFrame:
    """A registry of metrics and dimensions against a table that holds the metrics by name."""
    return quality.registry_errors(table(spark, d, "events"), "event_type", ["view", "click", "error", "revenue"], ["user_id", "region"])


@query("""select count(*)::bigint as row_count, strftime(max(ts), '%Y-%m-%d') as freshness, 'tool_contract,metric_registry,safe_view,parameterized_sql' as policies from (select ts from events where event_type = 'error' and ts::date between date '2024-01-01' and date '2024-01-05' limit 500)""")
def kpi_response_meta(spark: SparkSession, d: str) -> DataFrame:
    """What accompanies a governed answer, over the events as a day's metric rows."""
    view = table(spark, d, "events").select(F.to_date("ts").alias("metric_date"), F.lit("ticket_count").alias("metric_name"), "value", "event_type").where("event_type = 'error'").withColumnRenamed("value", "metric_value")
    r = kpi.Request("admin", ["ticket_count"], "2024-01-01", "2024-01-05", limit=500)
    return kpi.response_meta(kpi.kpi_query(view, r), r).select("row_count", F.date_format("freshness", "yyyy-MM-dd").alias("freshness"), "policies")
