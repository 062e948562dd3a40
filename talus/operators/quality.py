"""Data quality as columns: error arrays, gates, and reports that take one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of suspected personal data.
PII_A = r"(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})|(\b\d{3}[-.]?\d{2}[-.]?\d{4}\b)"
PII_B = (r"\b1[3-9]\d{9}\b", r"\b\d{17}[\dXx]\b", r"\b\d{12,19}\b")
SEVERITY = ("accept", "warn", "quarantine", "reject")


def errors(rules: Mapping[str, Column]) -> Column:
    """The names of the rules a row breaks; a rule whose condition is null is not broken."""
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))


def schema_rules(schema: Mapping) -> dict[str, Column]:
    """A JSON Schema of flat records as rules ``field:keyword``: required, enum, pattern, minLength, maxLength, minimum, maximum, minItems and maxItems.

    Required fields come first, then the properties in their order. A null breaks ``required`` only. Unknown keywords raise, so that no rule is silently left out.
    """
    size = {
        "minLength": lambda c, x: F.char_length(c) < x, "maxLength": lambda c, x: F.char_length(c) > x, "minimum": lambda c, x: c < x, "maximum": lambda c, x: c > x,
        "minItems": lambda c, x: F.size(c) < x, "maxItems": lambda c, x: F.size(c) > x, "pattern": lambda c, x: ~c.rlike(x), "enum": lambda c, x: ~c.isin(*x),
    }
    rules = {f"{f}:required": F.col(f).isNull() for f in schema.get("required", ())}
    for f, keywords in schema.get("properties", {}).items():
        for k, x in keywords.items():
            if k not in size and k not in ("type", "description", "title"):
                raise ValueError(f"unknown keyword {k} of {f}")
            if k in size:
                rules[f"{f}:{k}"] = F.col(f).isNotNull() & size[k](F.col(f), x)
    return rules


def registry_errors(mart: DataFrame, metric: str, metrics: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """(rule, detail): metrics of a registry that the mart lacks, metrics of the mart that the registry lacks, dimensions that are no column of it."""
    spark = mart.sparkSession
    named = spark.createDataFrame([(m,) for m in metrics], f"{metric} string")
    there = mart.select(metric).dropna().distinct()
    gone = named.join(there, metric, "left_anti").select(F.lit("metric_not_in_mart").alias("rule"), F.col(metric).alias("detail"))
    extra = there.join(named, metric, "left_anti").select(F.lit("metric_not_registered").alias("rule"), F.col(metric).alias("detail"))
    dims = spark.createDataFrame([("dimension_not_in_view", x) for x in dimensions if x not in mart.columns], "rule string, detail string")
    return gone.unionByName(extra).unionByName(dims)


def one_of(c: str, allowed: Sequence[str]) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin(*allowed)


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def worst(levels: Sequence[Column]) -> Column:
    """The worst of several judgments accept < warn < quarantine < reject."""
    rank = [reduce(lambda w, s: w.when(lv == s, SEVERITY.index(s)), SEVERITY[1:], F.when(F.lit(False), 0)).otherwise(0) for lv in levels]
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), (F.greatest(*rank) if len(rank) > 1 else rank[0]) + 1)


def null_rates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n_rows, n_blank) per column, nulls and blanks counted in one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(blank(c)).alias(c) for c in columns])
    return one.unpivot(["n_rows"], list(columns), "field", "n_blank").select("field", "n_rows", "n_blank")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def duplicate_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def pii_suspected(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(PII_A), F.lit(False))


def pii_numbers(c: str) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.col(c).rlike(p) for p in PII_B]), F.lit(False))


SYNTHETIC = "source_path_missing_synthetic_fallback"
# Reason codes that block a chunk of a media file.
MEDIA_BLOCKED = ("audio_transcript_sidecar_missing", "image_ocr_text_empty", "video_no_transcript_or_keyframe_ocr", "media_binary_text_fallback_blocked")


def chunk_checks(chunks: DataFrame, anchors: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per chunk with the findings of the gate: chunk_id, empty, unanchored, orphan, incomplete, pii_suspected, reason_codes, allowed_for_indexing, status.

    chunks hold one row per chunk_id, with reason_codes as an array (null counts as none). Anchors and sections may repeat; only their keys are joined.
    """
    anchored = anchors.select("chunk_id").dropna().distinct().withColumn("_anchored", F.lit(True))
    known = sections.select("section_id").dropna().distinct().withColumn("_known", F.lit(True))
    codes = F.coalesce("reason_codes", F.array().cast("array<string>"))
    j = chunks.join(anchored, "chunk_id", "left").join(known, "section_id", "left").withColumns({
        "empty": blank("content"), "unanchored": F.col("_anchored").isNull(), "orphan": F.col("_known").isNull(), "pii_suspected": pii_suspected("content"),
        "incomplete": blank("chunk_id") | blank("doc_id") | blank("source_id") | blank("section_id") | blank("chunk_strategy_version") | blank("parse_strategy_version") | blank("data_release_id"),
        "synthetic": F.array_contains(codes, SYNTHETIC), "blocked": F.arrays_overlap(codes, F.array(*[F.lit(c) for c in MEDIA_BLOCKED])), "fallback": F.array_contains(codes, "fallback_parser_used"),
    })
    allowed = (F.coalesce("anchor_count", F.lit(0)) > 0) & ~F.col("empty") & ~F.col("synthetic") & ~F.col("blocked") & ~F.col("pii_suspected")
    all_codes = F.array_sort(F.array_distinct(F.when(F.col("pii_suspected"), F.array_append(codes, "pii_suspected")).otherwise(codes)))
    status = F.when(~allowed & ~F.col("synthetic"), "fail").when(F.size(all_codes) > 0, "warn").otherwise("pass")
    return j.select("chunk_id", "empty", "unanchored", "orphan", "incomplete", "pii_suspected", "synthetic", "blocked", "fallback", all_codes.alias("reason_codes"), allowed.alias("allowed_for_indexing"), status.alias("status"))


def chunk_quality_gate(chunks: DataFrame, anchors: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: counts, shares, errors, warnings and the status of a set of chunks (one row per chunk_id), their anchors and sections."""
    c = chunk_checks(chunks, anchors, sections)
    n = lambda name: F.count_if(name).alias(f"{name}_chunks")
    facts = c.agg(F.count(F.lit(1)).alias("n_chunks"), *[n(x) for x in ("empty", "unanchored", "orphan", "incomplete", "pii_suspected", "synthetic", "blocked", "fallback")], F.count_if("allowed_for_indexing").alias("allowed_chunks"))
    known = chunks.select("chunk_id").dropna().distinct().withColumn("_there", F.lit(True))
    facts2 = anchors.join(known, "chunk_id", "left").agg(
        F.count(F.lit(1)).alias("n_anchors"), F.count_if(F.col("_there").isNull()).alias("orphan_anchors"), F.count_if((F.col("asset_type") == "pdf") & F.col("page_no").isNull()).alias("pdf_without_page")
    )
    g = facts.crossJoin(facts2)  # one row each
    share = lambda k: F.round(F.coalesce((F.col("n_chunks") - F.col(k)) / F.nullif(F.col("n_chunks"), F.lit(0)), F.lit(0.0)), 4)
    broken = {"no_chunks": F.col("n_chunks") == 0, "empty_chunks": F.col("empty_chunks") > 0, "missing_evidence_anchor": F.col("unanchored_chunks") > 0, "orphan_chunks": F.col("orphan_chunks") > 0, "orphan_anchors": F.col("orphan_anchors") > 0, "pdf_missing_page_no": F.col("pdf_without_page") > 0, "media_extraction_incomplete": F.col("blocked_chunks") > 0}
    doubtful = {"metadata_incomplete": F.col("incomplete_chunks") > 0, "fallback_parser_used": F.col("fallback_chunks") > 0, SYNTHETIC: F.col("synthetic_chunks") > 0, "pii_suspected": F.col("pii_suspected_chunks") > 0}
    g = g.withColumns({"metadata_completeness": share("incomplete_chunks"), "anchor_coverage": share("unanchored_chunks"), "errors": errors(broken), "warnings": errors(doubtful)})
    return g.withColumn("status", F.when(F.size("errors") > 0, "fail").when(F.size("warnings") > 0, "warn").otherwise("pass"))


def quality_report(gate: DataFrame) -> DataFrame:
    """Completeness, noise, evidence and coherence of a chunk gate's one row, and block, warn or pass."""
    n = F.greatest(F.col("n_chunks"), F.lit(1)).cast("double")
    share = lambda c: F.round(F.greatest(F.lit(0.0), F.lit(1.0) - c / n), 6)
    decision = F.when(F.col("status") == "fail", "block").when(F.col("status") == "warn", "warn").otherwise("pass")
    return gate.select(
        share(F.col("incomplete_chunks")).alias("completeness"), share(F.col("empty_chunks") + F.col("fallback_chunks")).alias("noise"), share(F.col("unanchored_chunks")).alias("evidence"),
        F.when(F.col("status") != "fail", 1.0).otherwise(0.0).alias("coherence"), decision.alias("decision"),
    )


def drift(current: DataFrame, baseline: DataFrame, threshold: float) -> DataFrame:
    """(metric, current_value, baseline_value, drifted): whether the two differ by more than the threshold; null where one is missing."""
    j = current.select("metric", F.col("value").alias("current_value")).join(baseline.select("metric", F.col("value").alias("baseline_value")), "metric", "full_outer")
    return j.withColumn("drifted", F.abs(F.col("current_value") - F.col("baseline_value")) > threshold)


def run_status(errors: Column, warnings: Column, quarantined: Column, invalid: Column) -> Column:
    return F.when(errors > 0, "failed").when(quarantined + invalid > 0, "partial").when(warnings > 0, "warning").otherwise("success")


def eval_set_errors(samples: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(rule, detail): an empty set, repeated case ids, categories without cases, answerable cases without a source."""
    spark = samples.sparkSession
    empty = samples.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty_set").alias("rule"), F.lit("").alias("detail"))
    repeated = duplicates(samples, ["case_id"]).select(F.lit("repeated_case_id").alias("rule"), F.col("case_id").alias("detail"))
    gone = spark.createDataFrame([(c,) for c in categories], "category string").join(samples.select("category").distinct(), "category", "left_anti").select(F.lit("missing_category").alias("rule"), F.col("category").alias("detail"))
    unsourced = samples.where(~F.col("should_abstain") & blank("source_doc")).select(F.lit("answerable_without_source").alias("rule"), F.col("case_id").alias("detail"))
    return empty.unionByName(repeated).unionByName(gone).unionByName(unsourced)


def manifest_errors(manifests: DataFrame, compatible: Mapping[str, Sequence[str]], load_modes: Sequence[str]) -> Column:
    """Rules of a manifest row (modality, source_type, load_mode, cursor_field, assets): known modality for the source type, known load mode, a cursor where one is needed, no repeated source ids."""
    kinds = F.create_map(*[x for k, v in compatible.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    ids = F.transform("assets", lambda a: a["source_id"])
    return errors({
        "unknown_modality": F.try_element_at(kinds, F.col("modality")).isNull(), "source_type_not_for_modality": ~F.array_contains(F.try_element_at(kinds, F.col("modality")), F.col("source_type")),
        "unknown_load_mode": ~F.col("load_mode").isin(*load_modes), "cursor_missing": (F.col("load_mode") == "incremental_cursor") & blank("cursor_field"), "repeated_source_id": F.size(ids) != F.size(F.array_distinct(ids)),
    })
