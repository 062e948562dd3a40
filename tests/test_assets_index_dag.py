import pytest
from pyspark.sql import functions as F

from talus.operators import indexing, quality
from talus.plans.dag import Graph, fallback
from talus.sources import assets


def test_assembly(spark):
    a = spark.createDataFrame([("s1", "s3://b/x.txt", "T", None, None), ("s2", None, "Gone", None, None), ("s3", "file:///d/y.html?v=1", None, "bad", "z.srt")], "source_id string, raw_object_path string, title string, source_fingerprint string, ocr string")
    f = spark.createDataFrame([("x.txt", bytearray(b"hello")), ("y.html", bytearray(b"<p>a</p>")), ("x.ocr.txt", bytearray(b"  ")), ("z.srt", bytearray(b"side"))], "name string, content binary").withColumn("sha256", F.sha2("content", 256))
    got = {r.source_id: r for r in assets.assemble(a, f, [("ocr", ".ocr.txt")]).collect()}
    assert got["s1"].text == "hello" and got["s1"].sidecar is None and got["s1"].fingerprint_ok and not got["s1"].synthetic
    assert got["s2"].synthetic and "Gone" in got["s2"].text and got["s2"].doc_id.startswith("doc-")
    assert not got["s3"].fingerprint_ok and got["s3"].sidecar == "side"


def test_routing(spark):
    df = spark.createDataFrame([("pdf",), ("HTML",), ("odd",), (None,)], "asset_type string")
    assert [r.parser_backend for r in assets.route(df).collect()] == ["pdf_baseline", "html", "plain", "plain"]
    assert {r.parser_backend for r in assets.route(df, requested="markdown").collect()} == {"markdown"}
    assert assets.capability_matrix(spark).count() == len(assets.CAPABILITIES)
    pages = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", ""), ("b", None), ("c", "x"), ("c", " ")], "doc string, text string")
    assert {r.doc: r.pdf_type for r in assets.pdf_types(pages, "doc", "text").collect()} == {"a": "text_based", "b": "scanned", "c": "hybrid"}
    html = spark.createDataFrame([("html", "<b>x</b>"), ("plain", "<b>x</b>")], "parser_backend string, text string")
    assert [r.text for r in assets.parse_text(html).collect()] == ["x", "<b>x</b>"]
    t = assets.synthetic_tickets(spark, 50).collect()
    assert len(t) == 50 and t[0].ticket_id == "TKT-20260101-000000" and {r.status for r in t} <= {"open", "in_progress", "pending", "resolved", "closed"}


def test_index(spark):
    df = spark.createDataFrame([("a", "text", None, None, True), ("b", "t", [1.0, 0.0], "r1", True), ("c", "t", None, None, False), ("d", "t", [1.0, 0.0], None, True)], "section_id string, content string, embedding array<float>, index_release_id string, allowed_for_indexing boolean")
    assert {r.section_id for r in indexing.pending(df, "r2").collect()} == {"a", "b", "c"}
    built = indexing.build_index(df, "r2", 2)
    got = {r.section_id: r.index_release_id for r in built.collect()}
    assert got == {"a": "r2", "b": "r2", "c": None, "d": None}
    r = indexing.index_report(built, "r2", 2).first()
    assert (r.total_chunks, r.embedded_chunks, r.errors, r.quality_gate) == (4, 2, 0, "warn")
    assert indexing.index_report(built, "r2", 3).first().quality_gate == "fail" and indexing.cell_count(120) == 10 and indexing.cell_count(0) == 1
    assert df.where(indexing.metadata_filter({"section_id": ["a", "b"], "content": "any", "index_release_id": "r1"})).count() == 1


def test_answers(spark):
    hits = spark.createDataFrame([("q", 2, "b", 0.5, "B"), ("q", 1, "a", 0.9, "A" * 800), ("w", 1, "c", 0.1, "C")], "q string, rank int, item string, score double, t string")
    ctx = {r.q: r.context for r in indexing.context_blocks(hits, "q", "rank", "item", "t").collect()}
    assert ctx["q"].startswith("[1] a\nA") and ctx["q"].endswith("[2] b\nB")
    asked = spark.createDataFrame([("q",), ("w",), ("none",)], "q string")
    assert {r.q: r.abstain_reason for r in indexing.answer_gate(hits, asked, "q", "score").collect()} == {"q": None, "w": "low_retrieval_confidence", "none": "no_retrieval_results"}
    df = spark.createDataFrame([("see [来源2] and [source 9] [来源2]", 3), ("none", 2), ("none", 0)], "a string, n int")
    assert [r[0] for r in df.select(indexing.cited_markers(F.col("a"), F.col("n"))).collect()] == [[2], [1, 2], []]


def test_quality_rules(spark):
    m = spark.createDataFrame([("text", "pdf", "cdc", None, [("a",), ("a",)]), ("audio", "pdf", "incremental_cursor", "", [("a",)]), ("odd", "x", "odd", None, [])], "modality string, source_type string, load_mode string, cursor_field string, assets array<struct<source_id:string>>")
    got = [r[0] for r in m.select(quality.manifest_errors(m, {"text": ["pdf"], "audio": ["wav"]}, ["cdc", "incremental_cursor"])).collect()]
    assert got == [["repeated_source_id"], ["source_type_not_for_modality", "cursor_missing"], ["unknown_modality", "unknown_load_mode"]]
    one = spark.range(1)
    assert one.select(quality.run_status(F.lit(0), F.lit(1), F.lit(0), F.lit(2))).first()[0] == "partial"
    s = spark.createDataFrame([("c1", "happy", False, "d"), ("c1", "happy", False, "")], "case_id string, category string, should_abstain boolean, source_doc string")
    assert {(r.rule, r.detail) for r in quality.eval_set_errors(s, ["happy", "boundary"]).collect()} == {("repeated_case_id", "c1"), ("missing_category", "boundary"), ("answerable_without_source", "c1")}
    assert ("empty_set", "") in {(r.rule, r.detail) for r in quality.eval_set_errors(s.limit(0), []).collect()}


def test_graph_and_fallback():
    g = Graph()
    g.node("b", ["a"], lambda a: a + 1)
    g.node("c", ["b"], lambda b: b * 2)
    g.check("b", "positive", lambda b: b > 0)
    g.check("c", "any", lambda c: True)
    assert g.run({"a": 1}) == ({"a": 1, "b": 2, "c": 4}, [("b", "positive", "passed"), ("c", "any", "passed")])
    assert g.run({"a": -5})[1] == [("b", "positive", "failed"), ("c", "any", "skipped")]
    with pytest.raises(ValueError):
        g.node("b", [], lambda: 1)
    assert fallback([("x", lambda: 1 / 0), ("y", lambda: 7)])[0] == 7
    with pytest.raises(ZeroDivisionError):
        fallback([("x", lambda: 1 / 0)])
