"""Queries of the reference's own operators, with oracle SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import text as X
from talus.operators import chunking, evaluation, governance, indexing, quality, retrieval, upserts
from talus.plans import kpi, marts
from talus.sources import proxies
from talus.sources.lakehouse import VersionedTable
from talus.session import stage_root
from talus.sources.tables import table
from talus.streaming import jobs

AS_OF = "2001-12-31 00:00:00"
_ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- tickets, cases and marts ---------------------------------------------------------------------------------------------------------

_TICKETS = """
with customers as (select c_custkey customer_id, n_name org_id, c_mktsegment segment, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
tickets as (
  select o_orderkey ticket_id, o_custkey customer_id, org_id, r_name product_line, segment category,
    case when o_orderkey % 20 = 0 then 'escalated' when o_orderstatus = 'O' then 'open' when o_orderstatus = 'P' then 'in_progress' when o_orderkey % 5 = 0 then 'closed' else 'resolved' end status,
    case left(o_orderpriority, 1) when '1' then 'p1_critical' when '2' then 'p2_high' when '3' then 'p3_medium' else 'p4_low' end priority,
    o_orderdate created_at, case when o_orderstatus = 'F' then o_orderdate + to_days((o_orderkey % 97 + 1)::int) end resolved_at,
    case when o_orderkey % 7 <> 0 then o_orderdate + to_days(case left(o_orderpriority, 1) when '1' then 10 when '2' then 20 when '3' then 40 else 60 end) end sla_due_at
  from orders left join customers on o_custkey = customer_id),
stg as (
  select *, created_at::date created_date, status in ('open','pending_customer','in_progress','escalated') is_open, status = 'resolved' is_resolved, status = 'escalated' is_escalated,
    priority = 'p1_critical' is_p1, coalesce(coalesce(resolved_at, timestamp '2001-12-31') > sla_due_at, false) sla_breached from tickets),
first_comments as (select l_orderkey ticket_id, min(l_shipdate) first_comment_at from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate group by 1),
cases as (
  select stg.*, customers.org_id org_name, first_comment_at, epoch_us(first_comment_at) - epoch_us(created_at) first_response_us,
    epoch_us(coalesce(resolved_at, timestamp '2001-12-31')) - epoch_us(created_at) backlog_us, epoch_us(resolved_at) - epoch_us(created_at) handle_us,
    resolved_at is not null and not is_escalated is_first_resolution_proxy
  from stg left join customers using (customer_id) left join first_comments using (ticket_id)),
daily as (
  select created_date activity_date, coalesce(product_line, 'unknown') product_line, coalesce(priority, 'unknown') priority, coalesce(org_id, 'unknown') org_id, coalesce(category, 'unknown') category,
    count(*)::bigint ticket_count, count_if(is_open)::bigint open_ticket_count, count_if(is_p1)::bigint p1_ticket_count, count_if(sla_breached)::bigint sla_breach_count, count_if(is_escalated)::bigint escalation_count,
    count_if(is_resolved)::bigint resolved_ticket_count, count_if(is_first_resolution_proxy)::bigint first_resolution_count,
    round(sum(backlog_us)::double / count(backlog_us) / 86400e6, 4) avg_backlog_age_days, round(sum(first_response_us)::double / count(first_response_us) / 60e6, 4) avg_first_response_minutes,
    round(sum(handle_us)::double / count(handle_us) / 60e6, 4) avg_handle_time_minutes
  from cases group by all),
activity as (
  select *, round(escalation_count::double / nullif(ticket_count, 0), 4) escalation_rate, round(sla_breach_count::double / nullif(ticket_count, 0), 4) sla_breach_rate,
    round(first_resolution_count::double / nullif(resolved_ticket_count, 0), 4) first_resolution_rate from daily),
mart as (
  select activity_date metric_date, product_line, priority, org_id, category, u.metric_name, u.metric_value from activity, lateral (
    select unnest(['ticket_count','open_ticket_count','p1_ticket_count','sla_breach_count','escalation_count','avg_backlog_age_days','avg_first_response_minutes','avg_handle_time_minutes','escalation_rate','sla_breach_rate','first_resolution_rate']) metric_name,
      unnest([ticket_count::double, open_ticket_count::double, p1_ticket_count::double, sla_breach_count::double, escalation_count::double, avg_backlog_age_days, avg_first_response_minutes, avg_handle_time_minutes, escalation_rate, sla_breach_rate, first_resolution_rate]) metric_value) u
  where u.metric_value is not null)
"""


def _stg(spark: SparkSession, d: str) -> DataFrame:
    return marts.stg_tickets(proxies.tickets(spark, d), AS_OF)


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return marts.support_cases(_stg(spark, d), proxies.customers(spark, d), proxies.ticket_comments(spark, d), AS_OF)


def _mart(spark: SparkSession, d: str) -> DataFrame:
    return marts.support_kpi_mart(marts.ticket_activity_daily(_cases(spark, d)))


@query(_TICKETS + "select ticket_id, status, priority, created_date, is_open, is_resolved, is_escalated, is_p1, sla_breached, org_id, product_line, category from stg")
def stg_tickets(spark: SparkSession, d: str) -> DataFrame:
    return _stg(spark, d).select("ticket_id", "status", "priority", "created_date", "is_open", "is_resolved", "is_escalated", "is_p1", "sla_breached", "org_id", "product_line", "category")


@query(_TICKETS + "select ticket_id, org_name, strftime(first_comment_at, '%Y-%m-%d %H:%M:%S') as first_comment_at, first_response_us, backlog_us, handle_us, is_first_resolution_proxy from cases")
def support_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("ticket_id", "org_name", _ts("first_comment_at").alias("first_comment_at"), "first_response_us", "backlog_us", "handle_us", "is_first_resolution_proxy")


@query(_TICKETS + "select * from activity")
def ticket_activity_daily(spark: SparkSession, d: str) -> DataFrame:
    return marts.ticket_activity_daily(_cases(spark, d))


@query(_TICKETS + "select * from mart")
def support_kpi_mart(spark: SparkSession, d: str) -> DataFrame:
    return _mart(spark, d)


@query(_TICKETS + "select metric_date, metric_name, product_line, priority, org_id, category, metric_value from mart")
def agent_safe_view(spark: SparkSession, d: str) -> DataFrame:
    return marts.agent_safe_view(_mart(spark, d))


@query(_TICKETS + "select metric_date, metric_name, metric_value from mart where metric_name in ('ticket_count', 'escalation_rate') and metric_date between date '1996-03-01' and date '1996-03-31' order by 1, 2, 3 limit 200")
def kpi_query_basic(spark: SparkSession, d: str) -> DataFrame:
    r = kpi.Request("instructor", ["ticket_count", "escalation_rate"], "1996-03-01", "1996-03-31", limit=200)
    return kpi.kpi_query(marts.agent_safe_view(_mart(spark, d)), r)


@query(_TICKETS + "select metric_date, metric_name, product_line, priority, metric_value from mart where metric_name = 'avg_handle_time_minutes' and metric_date between date '1997-01-01' and date '1997-02-01' and priority in ('p1_critical', 'p2_high') order by 1, 2, 3, 4, 5 limit 500")
def kpi_query_dims(spark: SparkSession, d: str) -> DataFrame:
    r = kpi.Request("admin", ["avg_handle_time_minutes"], "1997-01-01", "1997-02-01", ["product_line", "priority"], {"priority": ["p1_critical", "p2_high"]}, limit=500)
    return kpi.kpi_query(marts.agent_safe_view(_mart(spark, d)), r)


@query(_TICKETS + "select metric_date, metric_name, org_id, metric_value from mart where metric_name = 'first_resolution_rate' and metric_date between date '1998-05-01' and date '1998-05-31' and org_id in (select distinct n_name from nation where n_nationkey < 3) order by 1, 2, 3, 4 limit 100")
def kpi_query_org_scope(spark: SparkSession, d: str) -> DataFrame:
    orgs = [r[0] for r in table(spark, d, "nation").where("n_nationkey < 3").select("n_name").collect()]
    r = kpi.Request("support_ops", ["first_resolution_rate"], "1998-05-01", "1998-05-31", ["org_id"], actor_org_ids=orgs, include_experimental_metrics=True)
    return kpi.kpi_query(marts.agent_safe_view(_mart(spark, d)), r)


@query(_TICKETS + """select product_line, priority, category, count(*)::bigint as ticket_count, count_if(is_escalated)::bigint as escalation_count, count_if(sla_breached)::bigint as sla_breach_count,
  grouping(product_line, priority, category)::int as level, round(count_if(is_escalated)::double / count(*), 4) as escalation_rate, round(count_if(sla_breached)::double / count(*), 4) as sla_breach_rate
  from cases group by rollup(product_line, priority, category)""")
def kpi_rollup(spark: SparkSession, d: str) -> DataFrame:
    return marts.kpi_rollup(_cases(spark, d), ("product_line", "priority", "category"))


@query()
def kpi_denials(spark: SparkSession, d: str) -> DataFrame:
    ok = dict(actor_role="admin", metrics=["ticket_count"], date_from="1996-01-01", date_to="1996-01-31")
    asked = [
        ok, ok | {"limit": 0}, ok | {"actor_role": "guest"}, ok | {"metrics": ["revenue"]}, ok | {"metrics": ["first_resolution_rate"]}, ok | {"dimensions": ["email"]}, ok | {"filters": {"email": ["x"]}},
        ok | {"actor_role": "support_ops"}, ok | {"date_to": "1995-12-31"}, ok | {"date_to": "1996-02-01"}, ok | {"date_to": "1996-02-02"},
    ]
    found = [kpi.validate(kpi.Request(**a)) for a in asked]
    return spark.createDataFrame([(i, f.code if f else "ok", ",".join(f.policies) if f else "") for i, f in enumerate(found)], "request_no int, code string, policies string")


@query(_TICKETS + """select 'not_null_metric_date' as test_name, count_if(metric_date is null)::bigint as violations from mart
  union all select 'not_null_metric_name', count_if(metric_name is null) from mart union all select 'not_null_metric_value', count_if(metric_value is null) from mart
  union all select 'accepted_values_metric_name', count_if(metric_name not in ('ticket_count','open_ticket_count','p1_ticket_count','sla_breach_count','escalation_count','avg_backlog_age_days','avg_first_response_minutes','avg_handle_time_minutes','escalation_rate','sla_breach_rate','first_resolution_rate')) from mart union all select 'metric_values_non_negative', count_if(metric_value < 0) from mart
  union all select 'ratio_metrics_between_0_and_1', count_if(metric_name like '%_rate' and (metric_value < 0 or metric_value > 1)) from mart""")
def dbt_tests_report(spark: SparkSession, d: str) -> DataFrame:
    return marts.dbt_tests_report(_mart(spark, d))


# --- idempotent writes ------------------------------------------------------------------------------------------------------------------


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("source_id"), F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256).alias("fingerprint"), F.col("ts").alias("ingest_ts"))


_EVENTS = "with e as (select event_id, event_type source_id, sha256(user_id::varchar || '|' || event_type || '|' || props) fingerprint, ts ingest_ts from events) "


@query(_EVENTS + "select source_id, fingerprint, event_id from (select *, row_number() over (partition by source_id, fingerprint order by ingest_ts desc, event_id desc) n from e) where n = 1")
def bronze_dedup_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    latest = upserts.keep_latest(_raw_events(spark, d), ["source_id", "fingerprint"], [F.col("ingest_ts").desc(), F.col("event_id").desc()])
    return latest.select("source_id", "fingerprint", "event_id")


@query(_EVENTS + "select distinct on (source_id, fingerprint) source_id, fingerprint, event_id from e order by source_id, fingerprint, ingest_ts desc, event_id desc")
def bronze_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return upserts.latest_by(_raw_events(spark, d), ["source_id", "fingerprint"], ["ingest_ts", "event_id"], ["event_id"])


_CUT = "2024-01-15"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events before a stated day as what is there, the others as a batch."""
    e, cut = _raw_events(spark, d), F.lit(_CUT).cast("timestamp")
    return e.where(F.col("ingest_ts") < cut), e.where(F.col("ingest_ts") >= cut)


@query(_EVENTS + f""", a as (select distinct source_id, fingerprint from e where ingest_ts < timestamp '{_CUT}')
  select source_id, fingerprint, min(event_id) as event_id from e where ingest_ts >= timestamp '{_CUT}' and not exists (select 1 from a where a.source_id = e.source_id and a.fingerprint = e.fingerprint) group by 1, 2""")
def ingest_append_if_absent(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return upserts.append_if_absent(old, new, ["source_id", "fingerprint"], ["event_id"]).select("source_id", "fingerprint", "event_id")


@query("""with t as (select ticket_id, lower(status) status, priority, org_id, resolved_at, ingest_ts from tickets),
  f as (select ticket_id, min(ingest_ts) a from t group by 1), s as (select ticket_id, min(priority) priority, min(org_id) org_id, arg_min(status, status) filter (true) x from t join f using (ticket_id) where ingest_ts = a group by 1),
  l as (select ticket_id, arg_max(status, ingest_ts) filter (status is not null) status from t group by 1)
  select ticket_id, l.status as status from f join l using (ticket_id)""")
def ticket_partial_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each ticket as state, all later ones as a batch: status is taken over, the rest stays."""
    t = table(spark, d, "tickets").select("ticket_id", F.lower("status").alias("status"), "priority", "org_id", "ingest_ts")
    first = upserts.latest_by(t.withColumn("_v", -F.unix_micros("ingest_ts")), ["ticket_id"], ["_v", "status"], ["status", "priority", "org_id", "ingest_ts"])
    later = t.join(first.select("ticket_id", F.col("ingest_ts").alias("_first")), "ticket_id").where(F.col("ingest_ts") > F.col("_first")).drop("_first")
    return upserts.partial_upsert(first.select("ticket_id", "status", "priority", "org_id"), later, "ticket_id", ["status"], "ingest_ts").select("ticket_id", "status")


@query("select event_type as source_id, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) as cursor from events group by 1")
def source_max_cursor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("source_id"), _ts("ts").alias("at"))
    return upserts.max_cursor(e, "source_id", "at")


@query("""with v as (select doc_id, sha256(coalesce(text, '')) f from documents), p as (select doc_id, f from v where doc_id % 3 <> 0), q as (select doc_id, case when doc_id % 5 = 0 then '' else f end f from p)
  select v.doc_id, case when q.f is null then 'insert' when q.f = v.f then 'skip' else 'reparse' end as decision from v left join q using (doc_id)""")
def incremental_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Last time's fingerprints lack some documents and differ for others (made up here from the ids)."""
    v = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))
    before = v.where("doc_id % 3 <> 0").withColumn("fingerprint", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("fingerprint")))
    return upserts.incremental_decision(v, before, "doc_id", "fingerprint").select("doc_id", "decision")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*)::bigint as n_rows from events group by 1")
def daily_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return governance.daily_counts(table(spark, d, "events"), "ts").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_rows")


@query("""with c as (select distinct ingest_ts::date as d from raw_doc_asset where ingest_ts is not null)
  select strftime(g, '%Y-%m-%d') as day from (select unnest(generate_series((select min(d) from c)::timestamp, (select max(d) from c)::timestamp, interval 1 day)) g) where g::date not in (select d from c)""")
def backfill_gap(spark: SparkSession, d: str) -> DataFrame:
    return governance.backfill_gaps(table(spark, d, "raw_doc_asset"), "ingest_ts").select(F.date_format("day", "yyyy-MM-dd").alias("day"))


# --- data quality -----------------------------------------------------------------------------------------------------------------------


@query("select count(*)::bigint as n_rows, count(distinct ticket_id)::bigint as n_unique, (select count(*) from (select ticket_id from tickets group by 1 having count(*) > 1))::bigint as n_repeated from tickets")
def duplicate_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_summary(table(spark, d, "tickets"), ["ticket_id"])


_NULLABLE = ("page_no", "doc_version", "parser_backend", "section_path", "content")


@query(" union all ".join(f"select '{c}' as field, count(*)::bigint as n_rows, count_if(trim(coalesce({c}::varchar, '')) = '')::bigint as n_blank from parsed_section" for c in _NULLABLE))
def null_rate_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_rates(table(spark, d, "parsed_section"), _NULLABLE)


@query("select 'knowledge_doc' as table_name, count(*)::bigint as n_rows from knowledge_doc union all select 'document_chunk', count(*) from document_chunk union all select 'evidence_anchor', count(*) from evidence_anchor union all select 'tickets', count(*) from tickets")
def row_checks(spark: SparkSession, d: str) -> DataFrame:
    counts = [table(spark, d, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n in ("knowledge_doc", "document_chunk", "evidence_anchor", "tickets")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_STATUSES = ("open", "pending", "in_progress", "resolved", "closed", "escalated")


@query(f"""select ticket_id, strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') as ingest_ts, array_to_string(list_filter([
    case when not starts_with(ticket_id, 'TKT-') then 'ticket_id_prefix' end, case when status not in {_STATUSES} then 'status' end, case when created_at is null then 'created_at' end,
    case when trim(coalesce(subject, '')) = '' then 'subject' end, case when resolved_at < created_at then 'resolved_before_created' end, case when priority is null then 'priority' end], lambda x: x is not null), ',') as errors from tickets""")
def ticket_contract_errors(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tickets")
    rules = {
        "ticket_id_prefix": ~F.col("ticket_id").startswith("TKT-"), "status": quality.one_of("status", _STATUSES), "created_at": F.col("created_at").isNull(),
        "subject": quality.blank("subject"), "resolved_before_created": F.col("resolved_at") < F.col("created_at"), "priority": F.col("priority").isNull(),
    }
    return t.select("ticket_id", _ts("ingest_ts").alias("ingest_ts"), F.array_join(quality.errors(rules), ",").alias("errors"))


@query("""select source_id, list_max([case when raw_object_path is null then 1 else 0 end, case when license_tag is null or license_tag = 'unknown' then 3 else 0 end,
    case when pii_level in ('high', 'suspected') then 2 else 0 end, case when page_count is null then 1 else 0 end])::int as severity from raw_doc_asset""")
def asset_gate_judgment(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "raw_doc_asset")
    level = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name).otherwise("accept")
    judged = quality.worst([
        level(F.col("raw_object_path").isNull(), "warn"), level(F.col("license_tag").isNull() | (F.col("license_tag") == "unknown"), "reject"),
        level(F.col("pii_level").isin("high", "suspected"), "quarantine"), level(F.col("page_count").isNull(), "warn"),
    ])
    return a.select("source_id", (F.array_position(F.array(*[F.lit(s) for s in quality.SEVERITY]), judged) - 1).cast("int").alias("severity"))


@query("select event_id, (props->>'$.k')::int as k from events")
def jsonl_event_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(r"""select 'tickets' as source, count_if(regexp_matches(description, '(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})|(\b\d{3}[-.]?\d{2}[-.]?\d{4}\b)'))::bigint as pii_rows, count_if(regexp_matches(description, '\b1[3-9]\d{9}\b|\b\d{17}[\dXx]\b|\b\d{12,19}\b'))::bigint as number_rows from tickets
  union all select 'documents', count_if(regexp_matches(text, '(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})|(\b\d{3}[-.]?\d{2}[-.]?\d{4}\b)')), count_if(regexp_matches(text, '\b1[3-9]\d{9}\b|\b\d{17}[\dXx]\b|\b\d{12,19}\b')) from documents""")
def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c: table(spark, d, t).agg(F.lit(t).alias("source"), F.count_if(quality.pii_suspected(c)).alias("pii_rows"), F.count_if(quality.pii_numbers(c)).alias("number_rows"))
    return one("tickets", "description").unionByName(one("documents", "text"))


# --- sections, chunks, anchors -------------------------------------------------------------------------------------------------------------


@query(r"""with p as (select doc_id, unnest(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\n\s*\n+')) raw from documents), q as (select doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') content from p)
  select doc_id, left(split_part(content, chr(10), 1), 80) as section_path, length(content)::int as n_chars from q where content <> ''""")
def paragraph_sections(spark: SparkSession, d: str) -> DataFrame:
    s = chunking.paragraph_sections(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", "section_path", F.char_length("content").alias("n_chars"))


@query("""with w as (select doc_id, text, unnest(range(0, length(text), 448)) s from documents where length(text) > 0), p as (select doc_id, s, trim(substr(text, s + 1, 512), ' ') piece from w)
  select doc_id, (s // 448)::int as chunk_index, s::int as span_start, length(piece)::int as n_chars, 'chunk-' || left(sha256(doc_id::varchar || '|' || s::varchar || '|' || piece), 24) as chunk_id from p""")
def sliding_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.sliding_window_chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "span_start", F.char_length("chunk_text").alias("n_chars"), "chunk_id")


@query()
def boundary_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.boundary_chunks(table(spark, d, "parsed_section"), "section_id", "content", "section_type").drop("chunk_text")


@query("""select chunk_id, case when page_no is not null then 'page' when coalesce(section_path, '') <> '' then 'section' else 'fallback' end as anchor_type, coalesce(span_start, 0)::bigint as span_start,
  'anchor-' || left(sha256(coalesce(chunk_id, 'None') || '|' || coalesce(section_id, 'None') || '|' || coalesce(page_no::varchar, 'None') || '|' || coalesce(span_start::varchar, 'None')), 16) as anchor_id from document_chunk""")
def evidence_anchors(spark: SparkSession, d: str) -> DataFrame:
    return chunking.evidence_anchors(table(spark, d, "document_chunk")).select("chunk_id", "anchor_type", "span_start", "anchor_id")


@query("""with n as (select doc_id, count(distinct chunk_id)::bigint c from document_chunk group by 1) select k.doc_id, coalesce(n.c, 0)::bigint as chunk_count from (select distinct doc_id from knowledge_doc) k left join n using (doc_id)""")
def chunk_count_per_doc(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "document_chunk").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("c"))
    return table(spark, d, "knowledge_doc").select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", F.coalesce("c", F.lit(0)).cast("long").alias("chunk_count"))


@query("""with s as (select s_suppkey k, '# ' || s_name || chr(10) || 'def f' || s_suppkey || '(x):' || chr(10) || '    return x' || chr(10) || 'class C' || s_suppkey || ':' || chr(10) || '    name = 1' || chr(10) t from supplier)
  select k as s_suppkey, 'f' || k as symbol, (position('def ' in t) - 1)::bigint as span_start, (position('class ' in t) - 1)::bigint as span_end from s union all select k, 'C' || k, position('class ' in t) - 1, length(t) from s""")
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """A small source file made up of every supplier, as no table holds code."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("# "), "s_name", F.lit("\ndef f"), key, F.lit("(x):\n    return x\nclass C"), key, F.lit(":\n    name = 1\n"))
    return chunking.code_symbols(table(spark, d, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")


@query(r"""with b as (select doc_id, generate_subscripts(x, 1) - 1 i, unnest(x) raw from (select doc_id, string_split_regex(text, '\n\s*\n+') x from documents)), c as (select doc_id, i, trim(raw, ' ') content from b)
  select doc_id, i::int as block_index, case when starts_with(content, '#') then 'heading' when starts_with(content, '|') then 'table' else 'text' end as block_type from c where content <> ''""")
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_blocks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "block_index", "block_type")


# --- retrieval ----------------------------------------------------------------------------------------------------------------------------


@query("""with v as (select vec_id, embedding::double[] e from embeddings), q as (select * from v where vec_id % 20 = 0)
  select query_id, vec_id, score, rank from (select q.vec_id query_id, v.vec_id vec_id, round(list_cosine_similarity(q.e, v.e), 6) score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, v.e), 6) desc, v.vec_id)::int rank from q join v on q.vec_id <> v.vec_id) where rank <= 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The whole search set, every vector whose id is divisible by 20, against all vectors."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.vector_top_k(q, v, "query_id", "vec_id", "embedding", 10)


_STOP = "[" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_LEXICAL = f"""with q as (select case_id query_id, list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda x: not list_contains({_STOP}, x)) t from rag_golden),
a as (select query_id, len(t) n, unnest(t) term from q), dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents),
tf as (select doc_id, l, term, count(*) tf from (select doc_id, len(w) l, unnest(w) term from dw) where term in (select term from a) group by all),
h as (select query_id, doc_id, n, l, count(*) f, sum(tf) s from tf join a using (term) group by all having count(*) = n),
r as (select query_id, doc_id, round(1000.0::double * s / l, 6) score from h), leg as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int rank from r) where rank <= 10) """


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_top_k(table(spark, d, "rag_golden").withColumnRenamed("case_id", "query_id"), table(spark, d, "documents"), "query_id", "query", "doc_id", "text", 10)


@query(_LEXICAL + "select query_id, doc_id, score, rank from leg")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d)


@query()
def context_prune(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "rag_predictions").groupBy("trace_id").agg(F.max_by("retrieved_contexts", "created_at").alias("c")).select("trace_id", F.posexplode("c").alias("rank", "h")).select("trace_id", (F.col("rank") + 1).alias("rank"), F.col("h.chunk_id").alias("chunk_id"))
    text = upserts.latest_by(table(spark, d, "document_chunk"), ["chunk_id"], ["ingest_ts"], ["content"])
    return retrieval.prune_contexts(p.join(text, "chunk_id"), "trace_id", "chunk_id", "content", "rank", token_budget=400)


@query(r"""with q as (select case_id, trim(regexp_replace(query, '\s+', ' ', 'g')) q from rag_golden), t as (select case_id, q, list_sort(list_distinct(list_concat(regexp_extract_all(q, '\b[A-Z]{2,}-[A-Z0-9-]+\b'), list_concat(regexp_extract_all(q, '\b[A-Z]+-\d{3,}(?:-[A-Z0-9]+)?\b'),
    list_filter(['firmware','upgrade','rollback','recovery','boot'], lambda x: contains(lower(q), x)))))) t from q), k as (select *, case when len(t) > 0 then q || ' ' || array_to_string(t, ' ') else q end s from t)
  select case_id, case when contains(lower(q), 'how do i') or contains(q, '如何') then s || ' troubleshooting steps recovery procedure' else s end as semantic_query, coalesce(array_to_string(t, ' '), '') as lexical_terms,
    case when len(t) > 0 then 'hybrid_lexical_guard' when len(string_split(q, ' ')) <= 3 then 'hybrid_short_query' else 'hybrid_default' end as mode, len(t) = 0 and len(string_split(q, ' ')) <= 3 as use_hyde from k""")
def query_rewrite_route(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.query_plans(table(spark, d, "rag_golden"), "case_id", "query")


# --- evaluation and governance ------------------------------------------------------------------------------------------------------------


@query("""with p as (select case_id, arg_max({'a': answer, 'r': abstain_reason}, {'c': created_at, 't': trace_id}) x from rag_predictions group by 1),
  j as (select g.case_id, lower(coalesce(p.x.a, '')) a, expected_keywords k from rag_golden g left join p using (case_id))
  select case_id, round(case when len(k) > 0 then len(list_filter(k, lambda w: contains(a, lower(w))))::double / len(k) else 1 end, 6) as answer_relevance from j""")
def eval_keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "rag_predictions").groupBy("case_id").agg(F.max_by("answer", F.struct("created_at", "trace_id")).alias("answer"))
    j = table(spark, d, "rag_golden").join(p, "case_id", "left")
    return j.select("case_id", X.keyword_coverage("answer", "expected_keywords").alias("answer_relevance"))


@query("""with p as (select row_number() over (order by trace_id, created_at) i, confidence h, round(confidence * 0.8 + 0.1, 6) j from (select distinct trace_id, created_at, confidence from rag_predictions) where confidence is not null),
  q as (select *, round_even(h * 2, 0)::int bh, round_even(j * 2, 0)::int bj from p), n as (select count(*)::double n, count_if(bh = bj) same, sum(abs(h - j)) err from q),
  m as (select sum(a.c * b.c) ab from (select bh l, count(*) c from q group by 1) a join (select bj l, count(*) c from q group by 1) b using (l))
  select n::bigint as sample_count, round(case when coalesce(ab, 0) / (n * n) = 1 then 1.0 else (same / n - coalesce(ab, 0) / (n * n)) / (1.0 - coalesce(ab, 0) / (n * n)) end, 6) as cohen_kappa, round(err / n, 6) as mae from n, m""")
def judge_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Confidences against a judge that is made up here as a linear function of them."""
    p = table(spark, d, "rag_predictions").select("trace_id", "created_at", "confidence").distinct().withColumn("judge", F.round(F.col("confidence") * 0.8 + 0.1, 6))
    p = p.withColumn("item", F.concat_ws("|", "trace_id", _ts("created_at")))
    return evaluation.judge_calibration(p, "confidence", "judge", "item").select("sample_count", "cohen_kappa", "mae")


@query("""with d as (select case when doc_kind = 'faq' then 'a' else 'b' end g, n_chars::double v from documents where doc_kind in ('faq', 'runbook') and n_chars is not null), r as (select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 k from d)
  select count_if(g = 'a')::bigint as n_a, count_if(g = 'b')::bigint as n_b, round(avg(v) filter (g = 'a'), 6) as mean_a, round(avg(v) filter (g = 'b'), 6) as mean_b,
    round((avg(v) filter (g = 'b') - avg(v) filter (g = 'a')) / sqrt(var_samp(v) filter (g = 'a') / count_if(g = 'a') + var_samp(v) filter (g = 'b') / count_if(g = 'b')), 6) as welch_t,
    round((sum(k) filter (g = 'b') - count_if(g = 'b') * (count_if(g = 'b') + 1) / 2.0)::double, 1) as mann_whitney_u from r""")
def ab_test_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ab_statistics(table(spark, d, "documents"), "doc_kind", "n_chars", "faq", "runbook")


@query("""with v as (select event_type, value, row_number() over (partition by event_type order by value) - 1 i, count(*) over (partition by event_type) n from events where value is not null), p as (select unnest([50.0, 95.0, 99.0]) percentile)
  select distinct event_type, percentile::double as percentile, value from v, p where i = round_even(percentile::double / 100 * (n - 1), 0)""")
def latency_percentile(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.percentile_nearest(table(spark, d, "events"), "event_type", "value", [50, 95, 99])


@query("""with m as (select ts < timestamp '2024-01-15' old, event_type metric, round(avg(value), 6) v from events group by 1, 2), j as (select coalesce(a.metric, b.metric) metric, b.v bv, a.v cv from (select * from m where not old) a full join (select * from m where old) b on a.metric = b.metric)
  select metric, bv as baseline_value, cv as current_value, case when bv is null or cv is null then 'missing_metric' when metric = 'error' and round(bv - cv, 9) > 0 then 'no_drop' when round(bv - cv, 9) > case metric when 'purchase' then 0.02 when 'view' then 0.5 end then 'drop' else 'ok' end as verdict from j""")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy((F.col("ts") < F.lit("2024-01-15").cast("timestamp")).alias("old"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluation.regression_gate(m.where("not old"), m.where("old"), {"purchase": 0.02, "view": 0.5}, ["error"])


@query("""with d as (select strftime(ts, '%Y-%m-%d') as "day", count_if(event_type = 'error')::double / count(*) r from events group by 1) select "day", round(r, 6) as error_rate, case when round(r, 6) <= 0.2 then 'pass' else 'fail' end as status from d""")
def slo_status(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 6).alias("error_rate"))
    return r.withColumn("status", F.when(evaluation.compare_target(F.col("error_rate"), F.lit("<=0.2")), "pass").otherwise("fail"))


_RULES = (("priority == 'p1_critical'", "require_approval"), ("amount > 300000 AND priority != 'p4_low'", "reject"), ("amount >= 100000", "pause_and_notify"), ("not a condition", "reject"))


@query("""with p as (select o_orderkey k, o_totalprice a, case left(o_orderpriority, 1) when '1' then 'p1_critical' when '2' then 'p2_high' when '3' then 'p3_medium' else 'p4_low' end r from orders)
  select k as ticket_id, case when a > 300000 and r <> 'p4_low' then 'reject' when r = 'p1_critical' then 'require_approval' when a >= 100000 then 'pause_and_notify' end as hitl_action,
    ((r = 'p1_critical')::int + (a > 300000 and r <> 'p4_low')::int + (a >= 100000)::int) as hitl_matches from p""")
def hitl_actions(spark: SparkSession, d: str) -> DataFrame:
    t = proxies.tickets(spark, d).select("ticket_id", "priority").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("ticket_id"), F.col("o_totalprice").alias("amount")), "ticket_id")
    return governance.hitl_actions(t, _RULES).select("ticket_id", "hitl_action", "hitl_matches")


@query(_EVENTS + f""", s as (select source_id, fingerprint, min(event_id) d from e where ingest_ts < timestamp '{_CUT}' group by 1, 2), n as (select source_id, fingerprint, event_id from e where ingest_ts >= timestamp '{_CUT}')
  select case when s.d is null then 'execute' when s.d = n.event_id then 'replay' else 'conflict' end as outcome, count(*)::bigint as n_requests from n left join s using (source_id, fingerprint) group by 1""")
def idempotent_replay(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return governance.idempotent_outcome(new, old, ["source_id", "fingerprint"], "event_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n_requests"))


@query("""with r as (select count(*)::bigint total_chunks, count_if(index_release_id = 'idx-2026.06' and embedding is not null)::bigint embedded_chunks, count_if(index_release_id = 'idx-2026.06' and embedding is not null and len(embedding) <> 64)::bigint errors from knowledge_section)
  select *, case when errors > 0 then 'fail' when total_chunks = 0 or embedded_chunks < total_chunks then 'warn' else 'pass' end as quality_gate from r""")
def index_report(spark: SparkSession, d: str) -> DataFrame:
    return indexing.index_report(table(spark, d, "knowledge_section"), "idx-2026.06", 64)


@query("select section_id, (embedding is null or index_release_id <> 'idx-2026.08') as pending from knowledge_section where embedding is null or index_release_id <> 'idx-2026.08'")
def index_pending(spark: SparkSession, d: str) -> DataFrame:
    return indexing.pending(table(spark, d, "knowledge_section"), "idx-2026.08").select("section_id", F.lit(True).alias("pending"))


@query(_LEXICAL + """select q.query_id, count(leg.doc_id)::bigint as n_hits, round(coalesce(least(max(score), 1.0), 0.0), 6)::double as confidence,
  case when count(leg.doc_id) = 0 then 'no_retrieval_results' when round(coalesce(least(max(score), 1.0), 0.0), 6) < 0.6 then 'low_retrieval_confidence' end as abstain_reason from (select distinct query_id from q) q left join leg using (query_id) group by 1""")
def answer_gate(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "rag_golden").select(F.col("case_id").alias("query_id"))
    return indexing.answer_gate(_lexical(spark, d), queries, "query_id", "score")


@query("""select 'repeated_case_id' as rule, case_id as detail from rag_golden group by case_id having count(*) > 1
  union all select 'missing_category', c from (select unnest(['happy','boundary','adversarial','multi_hop','unseen']) c) where c not in (select category from rag_golden)
  union all select 'answerable_without_source', case_id from rag_golden where not should_abstain and trim(coalesce(source_doc, '')) = ''""")
def eval_set_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.eval_set_errors(table(spark, d, "rag_golden"), ["happy", "boundary", "adversarial", "multi_hop", "unseen"])


@query("""with m as (select ts < timestamp '2024-01-15' old, event_type metric, round(avg(value), 6) v from events group by 1, 2)
  select coalesce(a.metric, b.metric) as metric, a.v as current_value, b.v as baseline_value, abs(a.v - b.v) > 1.0 as drifted from (select * from m where not old) a full join (select * from m where old) b on a.metric = b.metric""")
def metric_drift(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy((F.col("ts") < F.lit("2024-01-15").cast("timestamp")).alias("old"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return quality.drift(m.where("not old"), m.where("old"), 1.0)


# --- versioned tables and streams ---------------------------------------------------------------------------------------------------------


@query("select 0 as version, 'overwrite' as operation, count(*)::bigint as n_rows from tickets union all select 1, 'deduplicate', count(distinct ticket_id) from tickets")
def time_travel_counts(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    t = VersionedTable(spark, f"{stage_root(spark)}/lake-{uuid.uuid4().hex[:8]}/tickets")
    rows = table(spark, d, "tickets").select("ticket_id", "status", "ingest_ts")
    t.overwrite(rows)
    t.overwrite(upserts.latest_by(rows, ["ticket_id"], ["ingest_ts", "status"], ["status", "ingest_ts"]), "deduplicate")
    return t.snapshots().select("version", "operation", "n_rows")


@query("select count(*)::bigint as n_rows, 1 as n_snapshots from evidence_anchor")
def table_health(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    t = VersionedTable(spark, f"{stage_root(spark)}/lake-{uuid.uuid4().hex[:8]}/anchors")
    t.overwrite(table(spark, d, "evidence_anchor"))
    return t.health().select("n_rows", "n_snapshots")


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*)::bigint as n from events group by 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_once(jobs.daily_counts(jobs.stream_table(spark, d, "events"), "ts", "event_type"), "daily", "complete")


@query("select count(*)::bigint as n_rows, count(distinct (user_id, event_type))::bigint as n_keys from (select distinct user_id, event_type from events)")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = jobs.stream_table(spark, d, "events").select("user_id", "event_type", "ts")
    out = jobs.run_once(jobs.deduplicated(s, ["user_id", "event_type"], "ts"), "dedup", "append")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id", "event_type").alias("n_keys"))
