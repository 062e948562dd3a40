"""Assembling source documents from asset rows, files and sidecars; parser routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.text import html_text, stable_id

# What the parser backends can keep, and which one each kind of asset goes to.
CAPABILITIES = {"markdown": (False, True, False), "plain": (False, False, False), "html": (False, False, False), "transcript": (False, False, False), "ocr_sidecar": (True, False, True), "pdf_baseline": (True, False, False)}
ROUTES = {"pdf": "pdf_baseline", "image": "ocr_sidecar", "audio": "transcript", "video": "transcript", "html": "html", "webpage": "html", "markdown": "markdown"}


def capability_matrix(spark: SparkSession) -> DataFrame:
    """(parser_backend, preserves_page, preserves_table, supports_ocr_fallback)."""
    return spark.createDataFrame([(k, *v) for k, v in CAPABILITIES.items()], "parser_backend string, preserves_page boolean, preserves_table boolean, supports_ocr_fallback boolean")


def base_name(c: str):  # noqa: ANN201
    """The last part of a local path, file: or object-store address."""
    return F.element_at(F.split(F.regexp_replace(c, r"[?#].*$", ""), "/"), -1)


def assemble(assets: DataFrame, files: DataFrame, sidecars: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """assets(source_id, raw_object_path, title, source_fingerprint) with the content of files(name, content, sha256): doc_id, text, fingerprint, synthetic, fingerprint_ok, sidecar.

    An asset without a file gets a synthetic text from its title. sidecars: (column with a declared name, suffix of a file beside it) in order of priority; a blank sidecar counts as absent.
    """
    f = files.select(F.col("name").alias("_name"), F.decode("content", "UTF-8").alias("_text"), F.col("sha256").alias("_sha"))
    d = assets.withColumn("_name", base_name("raw_object_path")).join(f, "_name", "left")
    synthetic = F.col("_text").isNull()
    text = F.coalesce("_text", F.concat_ws(" ", F.lit("Source"), "source_id", F.coalesce("title", F.lit(""))))
    d = d.withColumns({"text": text, "synthetic": synthetic, "fingerprint": F.coalesce("_sha", F.sha2(text, 256))})
    d = d.withColumn("fingerprint_ok", F.col("source_fingerprint").isNull() | F.col("synthetic") | (F.col("source_fingerprint") == F.col("fingerprint")))
    found = []
    for i, (column, suffix) in enumerate(sidecars):
        side = f.select(F.col("_name").alias(f"_n{i}"), F.nullif(F.trim("_text"), F.lit("")).alias(f"_s{i}"))
        declared = base_name(column) if column in assets.columns else F.lit(None).cast("string")
        beside = F.concat(F.regexp_replace("_name", r"\.[^.]*$", ""), F.lit(suffix))
        d = d.join(side, F.coalesce(declared, beside) == F.col(f"_n{i}"), "left")
        found.append(F.col(f"_s{i}"))
    d = d.withColumn("sidecar", F.coalesce(*found) if found else F.lit(None).cast("string"))
    return d.withColumn("doc_id", stable_id("doc", ["source_id", "fingerprint"])).select(*assets.columns, "doc_id", "text", "fingerprint", "synthetic", "fingerprint_ok", "sidecar")


def route(assets: DataFrame, asset_type: str = "asset_type", requested: str | None = None, routes: Mapping[str, str] = ROUTES) -> DataFrame:
    """With parser_backend: the requested one if it is known, else the asset type's, else plain."""
    by_type = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in routes.items() for x in (F.lit(k), F.lit(v))]), F.lower(asset_type)), F.lit("plain"))
    return assets.withColumn("parser_backend", F.lit(requested) if requested in CAPABILITIES else by_type)


def parse_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Markup removed where the backend is html; other texts stay."""
    return docs.withColumn(text, F.when(F.col("parser_backend") == "html", html_text(F.col(text))).otherwise(F.col(text)))


def pdf_types(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text_share, pdf_type): text_based above 0.8 of the pages with text, scanned below 0.2, else hybrid."""
    share = F.avg(F.when(F.trim(F.coalesce(text, F.lit(""))) != "", 1.0).otherwise(0.0))
    p = pages.groupBy(doc).agg(F.round(share, 6).alias("text_share"))
    return p.withColumn("pdf_type", F.when(F.col("text_share") > 0.8, "text_based").when(F.col("text_share") < 0.2, "scanned").otherwise("hybrid"))


def synthetic_tickets(spark: SparkSession, n: int, seed: int = 42, start: str = "2026-01-01") -> DataFrame:
    """n made-up tickets: weighted choices from seeded random columns, the same for the same seed and partitioning."""

    def pick(options: Sequence[tuple[str, float]], salt: int):  # noqa: ANN202
        total, low, out = sum(w for _, w in options), 0.0, None
        x = F.rand(seed + salt) * total
        for name, w in options:
            low += w
            out = F.when(x < low, name) if out is None else out.when(x < low, name)
        return out.otherwise(options[-1][0])

    t = spark.range(n).select(F.col("id").alias("seq"), pick([("open", 3), ("in_progress", 2), ("pending", 1), ("resolved", 3), ("closed", 1)], 1).alias("status"), pick([("p1_critical", 1), ("p2_high", 2), ("p3_medium", 4), ("p4_low", 3)], 2).alias("priority"), pick([("enterprise", 1), ("professional", 2), ("standard", 4), ("free", 3)], 3).alias("sla_tier"))
    at = F.lit(start).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("seq").cast("int") * 7)
    return t.withColumn("created_at", at).withColumn("ticket_id", F.concat(F.lit("TKT-"), F.date_format("created_at", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("seq").cast("string"), 6, "0")))
