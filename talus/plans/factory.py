"""The knowledge tables as a dataflow: nodes on plans.dag.Graph with their checks, and the run's evidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import chunking, indexing, quality, upserts
from talus.plans.dag import Graph
from talus.session import stage_table

INPUTS = ("raw_doc_asset", "tickets", "parsed_section", "evidence_anchor")


def manifests(assets: DataFrame) -> DataFrame:
    return assets.where("manifest_id is not null").groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n_assets"), F.max("ingest_ts").alias("newest"))


def sections_of(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """The last version of every section whose source is a known asset."""
    s = upserts.latest_by(sections, ["section_id"], ["ingest_ts"], ["doc_id", "source_id", "section_path", "section_type", "content", "parser_capability", "parse_strategy_version", "data_release_id"])
    return s.join(assets.select("source_id").distinct(), "source_id", "left_semi")


def gate_inputs(chunks: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with the columns the gate reads, and one anchor per chunk."""
    about = sections.select("section_id", "source_id", "parse_strategy_version", "data_release_id", F.lit("boundary-v1").alias("chunk_strategy_version"))
    c = chunks.join(about, "section_id").withColumn("anchor_count", F.lit(1))
    anchors = chunking.evidence_anchors(c.withColumns({"asset_type": F.lit("text"), "page_no": F.lit(None).cast("int")}))
    return c, anchors


def factory(release: str = "idx-run") -> Graph:
    """Ingestion, parsing, chunking, gate and index as nodes. Tables that later nodes read again are staged, so each is computed once."""
    g = Graph()
    rows = lambda df: not df.isEmpty()
    unique = lambda df, key: df.count() == df.select(key).distinct().count()
    g.node("seed_manifests", ["raw_doc_asset"], manifests)
    g.node("raw_doc_assets", ["raw_doc_asset", "seed_manifests"], lambda a, _: upserts.latest_by(a, ["source_id"], ["ingest_ts"], ["asset_type", "manifest_id", "license_tag"]))
    g.node("raw_ticket_events", ["tickets", "seed_manifests"], lambda t, _: upserts.latest_by(t, ["ticket_id"], ["ingest_ts", "status"], ["status", "priority", "created_at"]))
    g.node("parsed_sections", ["parsed_section", "raw_doc_assets"], lambda s, a: stage_table(sections_of(s, a), "factory-sections"))
    g.node("document_chunks", ["parsed_sections"], lambda s: stage_table(chunking.chunk_sections(s, "boundary-v1"), "factory-chunks"))
    g.node("chunk_checks", ["document_chunks", "parsed_sections"], lambda c, s: stage_table(quality.chunk_checks(gate_inputs(c, s)[0], gate_inputs(c, s)[1], s), "factory-checks"))
    g.node("quality_gate", ["document_chunks", "parsed_sections"], lambda c, s: quality.chunk_quality_gate(gate_inputs(c, s)[0], gate_inputs(c, s)[1], s))
    g.node("index", ["document_chunks", "chunk_checks"], lambda c, k: indexing.build_index(c.join(k.select("chunk_id", "allowed_for_indexing"), "chunk_id").withColumns({"embedding": F.lit(None).cast("array<float>"), "index_release_id": F.lit(None).cast("string")}), release))
    g.node("index_report", ["index"], lambda i: indexing.index_report(i, release, 64))
    g.check("seed_manifests", "not_empty", rows)
    g.check("raw_doc_assets", "not_empty", rows)
    g.check("raw_doc_assets", "unique", lambda df: unique(df, "source_id"))
    g.check("raw_ticket_events", "unique", lambda df: unique(df, "ticket_id"))
    g.check("parsed_sections", "not_empty", rows)
    g.check("document_chunks", "unique", lambda df: unique(df, "chunk_id"))
    g.check("chunk_checks", "anchored", lambda df: df.where("unanchored").isEmpty())
    g.check("index_report", "dimensions", lambda df: df.first().errors == 0)
    return g


def run_evidence(spark: SparkSession, inputs: Mapping[str, DataFrame], run_id: str = "run") -> tuple[dict, DataFrame]:
    """Results by node, and one row (run_id, node, check_name, status, downstream) per check; downstream is stop after a failure, else go_on."""
    done, report = factory().run(inputs)
    lines = [(run_id, node, label, status, "go_on" if status == "passed" else "stop") for node, label, status in report]
    return done, spark.createDataFrame(lines, "run_id string, node string, check_name string, status string, downstream string")
