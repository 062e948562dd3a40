"""Sections, chunks and evidence anchors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.text import stable_id
from talus.session import ship_package

HARD_TYPES = ("table", "code", "image", "transcript")
# Where a chunk may end, as patterns (sentence ends and blank lines; list items).
BOUNDARY = re.compile(r"(?<=[。！？.!?])\s+|\n{2,}")
LIST_START = re.compile(r"\n[-*]\s+|\n\d+\.\s+")
_INK = re.compile(r"\S(?:.*\S)?", re.S)


def windows(text: str, size: int = 512, overlap: int = 64) -> Column:
    """Starts of overlapping windows: 0, size - overlap, ... while below the text's length."""
    n = F.char_length(text)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def sliding_window_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_index, span_start, chunk_text, chunk_id); the last window may lie wholly inside the one before. Window texts are stripped of blanks; null and empty texts have none."""
    d = docs.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.char_length("_text") > 0)
    w = d.select(id_col, "_text", F.posexplode(windows("_text", size, overlap)).alias("chunk_index", "span_start"))
    piece = F.trim(F.substr("_text", F.col("span_start") + 1, F.lit(size)))
    return w.select(id_col, "chunk_index", "span_start", piece.alias("chunk_text")).withColumn("chunk_id", stable_id("chunk", [id_col, "span_start", "chunk_text"]))


def boundary_spans(text: str, section_type: str | None = None, size: int = 512, overlap: int = 64) -> list[tuple[int, int, str]]:
    """(start, end, reason) of chunks that end at the last boundary within reach, without blanks around them.

    After a cut the next window starts ``overlap`` before it, or one character on if that would be no progress; where no later boundary is in
    reach, the same boundary is cut again and the windows creep.
    """
    ink = _INK.search(text)
    if ink is None:
        return []
    first, last = ink.span()
    if last - first <= size or section_type in HARD_TYPES:
        return [(first, last, f"whole_{section_type or 'section'}")]
    stops = np.unique([*(m.end() for m in BOUNDARY.finditer(text, first, last)), *(m.start() + 1 for m in LIST_START.finditer(text, first, last)), last])
    # the cut of the window that starts at each offset, for all offsets at once
    starts = np.arange(first, last)
    best = stops[np.maximum(np.searchsorted(stops, starts + size, side="right") - 1, 0)]
    cut = np.where((best > starts) & (best <= starts + size), best, np.minimum(starts + size, last))
    out, at = [], first
    while at < last:
        end = int(cut[at - first])
        if piece := _INK.search(text, at, end):
            out.append((*piece.span(), "boundary_split"))
        at = last if end == last else max(end - overlap, at + 1)
    return out


def boundary_chunks(sections: DataFrame, id_col: str, text_col: str, type_col: str | None = None, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_index, span_start, span_end, reason, chunk_text). Each chunk's start depends on the cut before it, so texts are handled one by one in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, e, why, t[s:e]) for i, t, kind in zip(b.id, b.text, b.kind, strict=True) if isinstance(t, str) for k, (s, e, why) in enumerate(boundary_spans(t, kind, size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "span_start", "span_end", "reason", "chunk_text"])

    ship_package(sections.sparkSession)
    kind = F.col(type_col).cast("string") if type_col else F.lit(None).cast("string")
    cols = sections.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), kind.alias("kind"))
    t = sections.schema[id_col].dataType.simpleString()
    return cols.mapInPandas(run, f"id {t}, chunk_index int, span_start long, span_end long, reason string, chunk_text string").withColumnRenamed("id", id_col)


def chunk_sections(sections: DataFrame, strategy: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """One row per chunk of every section: chunk_id, section_id, section_chunk_index, span_start, span_end, reason, content, context_prefix, reason_codes.

    sections(section_id, doc_id, section_path, section_type, content, parser_capability). Ids follow from section, index and strategy, so a rerun gives equal ones.
    reason_codes are the parser's warnings, and fallback_parser_used where it fell back. A section without text has no chunk.
    """
    cap = F.col("parser_capability")
    codes = F.concat(F.coalesce(cap["warnings"], F.array().cast("array<string>")), F.when(F.coalesce(cap["fallback_used"], F.lit(False)), F.array(F.lit("fallback_parser_used"))).otherwise(F.array().cast("array<string>")))
    about = sections.select("section_id", "doc_id", "section_path", F.array_sort(F.array_distinct(codes)).alias("reason_codes"))
    pieces = boundary_chunks(sections, "section_id", "content", "section_type", size, overlap).withColumnsRenamed({"chunk_index": "section_chunk_index", "chunk_text": "content"})
    chunk_id = stable_id("chunk", ["section_id", "section_chunk_index", F.lit(strategy)])
    prefix = F.substring(F.concat_ws(" | ", "doc_id", F.nullif("section_path", F.lit(""))), 1, 240)
    return pieces.join(about, "section_id").withColumns({"chunk_id": chunk_id, "context_prefix": prefix})


def paragraph_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_index, section_path, section_type, content): paragraphs by blank lines; the first line names the section."""
    paras = F.split(F.regexp_replace(text_col, "\r\n", "\n"), r"\n\s*\n+")
    p = docs.select(id_col, F.posexplode(paras).alias("section_index", "_raw")).withColumn("content", F.trim(F.regexp_replace("_raw", r"^\s+|\s+$", "")))
    first = F.substring(F.substring_index("content", "\n", 1), 1, 80)
    listy = F.col("content").rlike(r"^(?:[-*]|\d+\.)\s")
    kind = F.when(listy, "list").when((F.char_length("content") <= 80) & ~F.contains("content", F.lit("\n")) & ~F.col("content").rlike(r"[.!?。！？]$"), "title").otherwise("text")
    return p.where("content <> ''").select(id_col, "section_index", first.alias("section_path"), kind.alias("section_type"), "content")


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block_index, block_type, heading, content): blocks by blank lines, each under the last heading before it."""
    b = docs.select(id_col, F.posexplode(F.split(text_col, r"\n\s*\n+")).alias("block_index", "_raw")).withColumn("content", F.trim("_raw")).where("content <> ''")
    is_head, is_table = F.col("content").startswith("#"), F.col("content").startswith("|")
    title = F.when(is_head, F.regexp_replace("content", r"^#+\s*", ""))
    order = Window.partitionBy(id_col).orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    return b.select(id_col, "block_index", F.when(is_head, "heading").when(is_table, "table").otherwise("text").alias("block_type"), F.last(title, ignorenulls=True).over(order).alias("heading"), "content")


def code_symbols(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, symbol, span_start, span_end): a symbol reaches to the next one, the last to the end of the text."""
    ship_package(docs.sparkSession)
    pattern = re.compile(r"^(def|class|function|export function|const)\s+([A-Za-z_][A-Za-z0-9_]*)", re.M)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b.id, b.text, strict=True):
                found = list(pattern.finditer(t)) if isinstance(t, str) else []
                ends = [m.start() for m in found[1:]] + [len(t or "")]
                rows += [(i, m[2], m.start(), e) for m, e in zip(found, ends, strict=True)] if found else []
            yield pd.DataFrame(rows, columns=["id", "symbol", "span_start", "span_end"])

    t = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInPandas(run, f"id {t}, symbol string, span_start long, span_end long").withColumnRenamed("id", id_col)


def transcript_sections(lines: DataFrame, doc_col: str, line_col: str, order_col: str) -> DataFrame:
    """Timed sections from sidecar lines, JSON or plain: (doc, section_index, speaker, start_ts, end_ts, content); blank lines are skipped, unknown JSON fields ignored."""
    field = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(line_col, f"$.{n}"), F.lit("")) for n in names])
    parsed = F.try_parse_json(line_col).isNotNull() & F.col(line_col).startswith("{")
    text = F.when(parsed, field("text", "content")).otherwise(F.col(line_col))
    time = lambda *names: F.when(parsed, field(*names)).try_cast("double")
    t = lines.where(F.trim(line_col) != "").select(doc_col, order_col, F.when(parsed, field("speaker")).alias("speaker"), time("start_ts", "start").alias("start_ts"), time("end_ts", "end").alias("end_ts"), F.coalesce(text, F.col(line_col)).alias("content"))
    index = F.row_number().over(Window.partitionBy(doc_col).orderBy(order_col)) - 1
    return t.withColumn("section_index", index).select(doc_col, "section_index", "speaker", "start_ts", "end_ts", "content")


def evidence_anchors(chunks: DataFrame) -> DataFrame:
    """One anchor per chunk: its kind by what is known about the place (page, time, section), and a stable id."""
    kind = F.when(F.col("asset_type").isin("audio", "video"), "timestamp").when(F.col("page_no").isNotNull(), "page").when(F.coalesce(F.col("section_path"), F.lit("")) != "", "section").otherwise("fallback")
    return chunks.select("chunk_id", "section_id", "doc_id", "asset_type", kind.alias("anchor_type"), "page_no", F.coalesce("span_start", F.lit(0)).cast("long").alias("span_start"), stable_id("anchor", ["chunk_id", "section_id", "page_no", "span_start"], 16).alias("anchor_id"))
