"""Core operators on small cases worked out by hand."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from talus.functions import text as X
from talus.operators import chunking, evaluation, governance, quality, retrieval, upserts
from talus.plans import kpi
from talus.sources.lakehouse import VersionedTable, read_jsonl


def test_append_if_absent_replay_inserts_nothing(spark):
    state = spark.createDataFrame([("s", "a")], "src string, fp string")
    batch = spark.createDataFrame([("s", "a", 1), ("s", "b", 3), ("s", "b", 2)], "src string, fp string, n int")
    new = upserts.append_if_absent(state, batch, ["src", "fp"], ["n"])
    assert [tuple(r) for r in new.collect()] == [("s", "b", 2)]
    assert upserts.append_if_absent(state.union(new.select("src", "fp")), batch, ["src", "fp"], ["n"]).count() == 0


def test_keep_latest_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 2)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in upserts.keep_latest(df, ["k"], [F.col("v").desc()]).collect()) == [("", 1), ("", 2), ("a", 2)]


def test_partial_upsert(spark):
    state = spark.createDataFrame([(1, "open", "p1"), (2, "open", None)], "id int, status string, prio string")
    batch = spark.createDataFrame([(1, "closed", "p9", 1), (1, None, "p8", 2), (3, "new", "p3", 1)], "id int, status string, prio string, n int")
    got = {r.id: (r.status, r.prio) for r in upserts.partial_upsert(state, batch, "id", ["status"], "n").collect()}
    assert got == {1: ("closed", "p1"), 2: ("open", None), 3: ("new", "p3")}
    assert upserts.partial_upsert(state, batch.limit(0), "id", ["status"], "n").count() == 2


def test_incremental_decision(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, f string")
    old = spark.createDataFrame([("a", "1"), ("b", "9")], "k string, f string")
    assert {r.k: r.decision for r in upserts.incremental_decision(cur, old, "k", "f").collect()} == {"a": "skip", "b": "reparse", "c": "insert"}


def test_denials_in_order():
    ok = dict(actor_role="admin", metrics=["ticket_count"], date_from="2026-01-01", date_to="2026-01-31")
    code = lambda **k: (d := kpi.validate(kpi.Request(**(ok | k)))) and d.code
    assert code() is None
    assert code(date_to="2026-02-01") is None  # 31 days apart, 32 calendar days
    assert code(date_to="2026-02-02") == "WINDOW_TOO_LARGE"
    assert code(actor_role="guest", metrics=["nope"]) == "ROLE_DENIED"
    assert code(metrics=["first_resolution_rate"]) == "EXPERIMENTAL_METRIC_NOT_ACKNOWLEDGED"
    assert code(actor_role="support_ops") == "ORG_SCOPE_REQUIRED"
    assert code(limit=501) == "SCHEMA_VALIDATION_FAILED"
    assert code(date_from="x") == "SCHEMA_VALIDATION_FAILED"


def test_error_arrays_and_lattice(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "bad"), (3, "", "ok")], "id int, a string, s string")
    e = quality.errors({"blank": quality.blank("a"), "domain": quality.one_of("s", ["ok"])})
    assert {r.id: r.e for r in df.select("id", e.alias("e")).collect()} == {1: [], 2: ["blank", "domain"], 3: ["blank"]}
    assert spark.range(1).select(quality.worst([F.lit("warn"), F.lit("quarantine"), F.lit("accept")])).first()[0] == "quarantine"


def test_boundary_chunks_creep():
    spans = chunking.boundary_spans("Alpha.beta. " + "x" * 900)
    assert spans[:11] == [(i, 11, "boundary_split") for i in range(11)]  # the same boundary, again and again
    assert spans[11:] == [(12, 524, "boundary_split"), (460, 912, "boundary_split")]
    assert chunking.boundary_spans("  short ") == [(2, 7, "whole_section")]
    assert chunking.boundary_spans("y" * 900, "table") == [(0, 900, "whole_table")]
    assert chunking.boundary_spans("") == []


def test_sliding_windows(spark):
    df = spark.createDataFrame([(1, "z" * 500), (2, ""), (3, None)], "id int, t string")
    got = chunking.sliding_window_chunks(df, "id", "t").collect()
    assert sorted((r.id, r.span_start, len(r.chunk_text)) for r in got) == [(1, 0, 500), (1, 448, 52)]


def test_transcript(spark):
    lines = [("d", 1, '{"start_ts": 1.5, "end": 2, "speaker": "A", "text": "hi"}'), ("d", 2, "plain line"), ("d", 3, "  "), ("d", 4, '{"broken')]
    got = chunking.transcript_sections(spark.createDataFrame(lines, "doc string, n int, line string"), "doc", "line", "n").orderBy("section_index").collect()
    assert [(r.section_index, r.speaker, r.start_ts, r.end_ts, r.content) for r in got] == [(0, "A", 1.5, 2.0, "hi"), (1, None, None, None, "plain line"), (2, None, None, None, '{"broken')]


def test_markdown_heading_is_carried(spark):
    md = "# One\n\ntext\n\n| a |\n\n## Two\n\nmore"
    got = chunking.markdown_blocks(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t").orderBy("block_index").collect()
    assert [(r.block_type, r.heading) for r in got] == [("heading", "One"), ("text", "One"), ("table", "One"), ("heading", "Two"), ("text", "Two")]


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c).first()[0]
    assert one(X.tokens("t"), "Ab_1 中文字") == ["ab_1", "中", "文", "字", "中文", "文字"]
    assert one(X.lexical_terms("t"), "boot ERR-12 AB-1234") == ["AB-1234", "ERR-12", "boot"]
    assert one(X.html_text("t"), "<p>a &amp; b</p><script>x</script>") == "a & b\n\nx"
    assert one(X.canonical_json_sha256("t"), '{"b":1,"a":"é"}') == one(X.canonical_json_sha256("t"), '{"a": "\\u00e9", "b": 1}')
    assert one(X.canonical_json_sha256("t"), "{") is None
    assert one(X.stable_id("p", [F.lit(None), "t"]), "x").startswith("p-")
    v = one(X.hash_embedding("t", 20), "ünï")
    assert len(v) == 20 and math.isclose(sum(x * x for x in v), 1, rel_tol=1e-9)
    assert [X.light_stem(w) for w in ("running", "hoped", "ponies", "caress", "sky")] == ["run", "hope", "poni", "caress", "sky"]


def test_rrf(spark):
    leg = lambda rows: spark.createDataFrame([("q", i, s, r) for i, s, r in rows], "q string, item string, score double, rank int")
    got = retrieval.reciprocal_rank_fusion([("vec", leg([("a", 0.9, 1), ("b", 0.8, 2)])), ("fts", leg([("a", 0.4, 1), ("c", 0.3, 2)]))], "q", "item").orderBy(F.desc("rrf_score")).collect()
    assert [r.item for r in got][0] == "a" and len(got) == 3 and math.isclose(got[0].rrf_score, 2 / 61, abs_tol=1e-8)


def test_pruning_skips_and_goes_on(spark):
    hits = [("q", "a", 1, "x" * 400), ("q", "b", 2, "x" * 4000), ("q", "c", 3, "x" * 40), ("q", "d", 6, "x")]
    got = retrieval.prune_contexts(spark.createDataFrame(hits, "q string, item string, rank int, t string"), "q", "item", "t", "rank", token_budget=150).collect()
    assert [(r.item, r.used_tokens) for r in got] == [("a", 100), ("c", 110)]


def test_statistics(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(1, 20))) for _ in range(200)]
    r = evaluation.ab_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v", "a", "b").first()
    a, b = [v for g, v in rows if g == "a"], [v for g, v in rows if g == "b"]
    u = sum((y > x) + 0.5 * (y == x) for x in a for y in b)
    assert (r.n_a, r.n_b) == (len(a), len(b)) and math.isclose(r.mann_whitney_u, u)
    assert evaluation.ab_decision(r.n_a, r.n_b, r.mean_a, r.mean_b, r.welch_t, r.mann_whitney_u)["recommendation"] in ("need_more_data", "ship_B", "keep_A")
    p = evaluation.percentile_nearest(spark.createDataFrame([("x", float(v)) for v in range(10)] + [("x", None)], "g string, v double"), "g", "v", [50, 95])
    assert {q.percentile: q.value for q in p.collect()} == {50.0: 4.0, 95.0: 9.0}


def test_calibration(spark):
    pairs = [("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 2.5), ("d", 0.5, 0.5)]
    r = evaluation.judge_calibration(spark.createDataFrame(pairs, "i string, h double, j double"), "h", "j", "i", 2).first()
    assert r.sample_count == 4 and r.mae == 0.125 and r.top_k_overlap == 1.0 and r.trust_level == "high"


def test_regression_and_slo(spark):
    f = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    got = evaluation.regression_gate(f([("a", 0.7), ("b", 0.5), ("c", 0.9)]), f([("a", 0.71), ("b", 0.6), ("c", 0.95), ("d", 1.0)]), {"a": 0.02, "b": 0.05}, ["c"])
    assert {r.metric: r.verdict for r in got.collect()} == {"a": "ok", "b": "drop", "c": "no_drop", "d": "missing_metric"}
    df = spark.createDataFrame([(1.0, "<=1"), (1.0, "<1"), (1.0, ">=1"), (1.0, ">1"), (1.0, "=1"), (1.0, "2")], "v double, t string")
    assert [r[0] for r in df.select(evaluation.compare_target(F.col("v"), F.col("t"))).collect()] == [True, False, True, False, True, False]


def test_hitl(spark):
    df = spark.createDataFrame([(1, 50.0, "admin"), (2, None, "user"), (3, 500.0, "user")], "id int, amount double, role string")
    rules = [("amount > 100 AND role == 'user'", "reject"), ("amount >= 50", "pause_and_notify"), ("gone < 1", "require_approval"), ("nonsense", "reject")]
    got = {r.id: (r.hitl_action, r.hitl_matches) for r in governance.hitl_actions(df, rules).collect()}
    assert got == {1: ("require_approval", 2), 2: ("require_approval", 1), 3: ("reject", 3)}


def test_idempotency(spark):
    req = spark.createDataFrame([("t", "k1", "d1"), ("t", "k2", "d2"), ("t", "k3", "d3")], "tool string, k string, d string")
    seen = spark.createDataFrame([("t", "k1", "d1"), ("t", "k2", "other")], "tool string, k string, d string")
    assert {r.k: r.outcome for r in governance.idempotent_outcome(req, seen, ["tool", "k"], "d").collect()} == {"k1": "replay", "k2": "conflict", "k3": "execute"}


def test_backfill(spark):
    days = spark.createDataFrame([(dt.datetime(2026, 1, d),) for d in (1, 2, 5)], "ts timestamp")
    assert sorted(r.day.day for r in governance.backfill_gaps(days, "ts").collect()) == [3, 4]
    assert governance.backfill_gaps(days.limit(0), "ts").count() == 0


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.overwrite(spark.range(3).toDF("a")) == 0
    assert t.overwrite(spark.range(5).toDF("a")) == 1
    assert t.overwrite(spark.range(0).toDF("a")) is None
    assert t.read().count() == 5 and t.read(0).count() == 3
    assert t.add_column("b") == 2 and t.read().columns == ["a", "b"]
    with pytest.raises(ValueError):
        t.read(9)
    h = t.health().first()
    assert h.n_rows == 5 and h.n_snapshots == 3 and h.min_bytes > 0


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    good, bad = read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int")
    assert sorted(r.a for r in good.collect()) == [1, 3] and bad.count() == 1


def test_eval_scores(spark):
    samples = spark.createDataFrame(
        [("c1", "happy", "restart the node", ["restart"], ["src-1"], ["magic"], False), ("c2", "adversarial", "x", [], [], None, True), ("c3", "happy", "y", None, ["s"], None, False), ("c4", "adversarial", "x", [], [], None, True), ("c5", "happy", "a b", [], ["q"], ["Magic"], False)],
        "case_id string, category string, expected_answer string, expected_keywords array<string>, expected_ids array<string>, forbidden_phrases array<string>, should_abstain boolean",
    )
    at = dt.datetime(2026, 1, 1)
    preds = spark.createDataFrame(
        [("c1", "t1", "Restart the node", None, at, [("e", "k", None)], [("k",), ("z",), ("m",)]), ("c4", "t4", "Here it is", None, at, None, None), ("c5", "t5", "a b magic", None, at, [], [])],
        "case_id string, trace_id string, answer string, abstain_reason string, created_at timestamp, citations array<struct<evidence_id:string,chunk_id:string,doc_id:string>>, retrieved_contexts array<struct<chunk_id:string>>",
    )
    ctx = spark.createDataFrame([("k", "src-1-part", "please restart the node now"), ("m", "other", "nothing")], "chunk_id string, evidence_id string, content string")
    scores = evaluation.eval_scores(samples, preds, ctx)
    got = {r.case_id: r for r in scores.collect()}
    assert got["c1"].faithfulness == 1.0 and got["c1"].answer_correctness == 1.0 and got["c1"].context_precision == 0.5 and got["c1"].context_recall == 1.0
    assert got["c1"].failure_reasons == ["context_precision_below_threshold:0.500<0.550"] and not got["c1"].passed
    assert got["c2"].passed and got["c2"].faithfulness == 0.5 and not got["c3"].passed
    assert got["c4"].failure_reasons == ["safety_or_compliance_failed", "expected_abstain"] and not got["c5"].safety_pass and got["c5"].context_precision == 0.0
    cats = {r.category: r.cases for r in evaluation.category_breakdown(scores, ["happy", "boundary"]).collect()}
    assert cats == {"happy": 3, "boundary": 0}
    m = evaluation.metric_means(scores).first()
    assert (m.pass_rate, m.adversarial_pass_rate, m.safety_pass_rate) == (0.2, 0.5, 0.6)


def test_cover_density():
    assert retrieval.cover_density([[0], [1]]) == pytest.approx(0.1) and retrieval.cover_density([[0], [3]]) == pytest.approx(0.1 / 3)
    assert retrieval.cover_density([[0, 10], [1, 12]]) == pytest.approx(0.1 + 0.1 / 9 + 0.1 / 2) and retrieval.cover_density([[1], []]) == 0.0


def test_ranges_and_filters(spark):
    df = spark.createDataFrame([("a", float(i % 50)) for i in range(500)] + [("b", 1.0)], "g string, v double")
    got = {(r.g, r.percentile): r.value for r in evaluation.percentile_nearest(df, "g", "v", [0, 50, 100]).collect()}
    assert got == {("a", 0.0): 0.0, ("a", 50.0): 25.0, ("a", 100.0): 49.0, ("b", 0.0): 1.0, ("b", 50.0): 1.0, ("b", 100.0): 1.0}
    s = spark.createDataFrame([("s1", "d1", None), ("s2", "d2", "r2"), ("s3", "gone", "r2")], "section_id string, doc_id string, release string")
    docs = spark.createDataFrame([("d1", "r1", "edge"), ("d2", "r9", "studio")], "doc_id string, release string, line string")
    ids = lambda **f: {r.section_id for r in retrieval.searchable_sections(s, docs, f).collect()}
    assert ids() == {"s1", "s2"} and ids(release="r1") == {"s1"} and ids(release=["r1", "r2"], line="any") == {"s1", "s2"} and ids(line="studio", release="r9") == set()


def test_loads_and_policies(spark):
    df = spark.createDataFrame([(1, "low", "x"), (2, None, "y"), (3, "odd", None)], "n int, level string, who string")
    assert upserts.load(df, "incremental_cursor", "n", cursor="1").count() == 2 and upserts.load(df, "backfill", "n", start="1", end="3").count() == 2 and upserts.load(df, "replay", "n").count() == 3
    with pytest.raises(ValueError):
        upserts.load(df, "other", "n")
    rules = spark.createDataFrame([("low", "hash"), ("high", "drop")], "level string, rule string")
    got = {r.n: r.who for r in governance.apply_policy(df, "level", rules, {"who": "rule"}, "high").collect()}
    assert got[1] and len(got[1]) == 16 and got[2] is None and got[3] is None


def test_vector_blocks_against_brute_force(spark):
    rows = [(i, None if i == 7 else [0.0] * 3 if i == 8 else [1.0, 2.0] if i == 9 else [float(i % 5), float(i % 3), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    got = {(r.q, r.i, r["rank"]) for r in retrieval.vector_top_k(df.where("i % 2 = 0").withColumnRenamed("i", "q"), df, "q", "i", "v", 4, 7, 11).collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 6)
    use = {i: v for i, v in rows if i not in (7, 8, 9)}
    want = {(q, i, n + 1) for q in use if q % 2 == 0 for n, (_, i) in enumerate(sorted((-cos(use[q], v), i) for i, v in use.items() if i != q)[:4])}
    assert got == want
