"""Building and checking the section index, and reading it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import hash_embedding


def pending(sections: DataFrame, release: str) -> DataFrame:
    """Sections to embed: without an embedding, or of another release. A null release with an embedding is not selected (three-valued logic)."""
    return sections.where(F.col("embedding").isNull() | (F.col("index_release_id") != release))


def build_index(sections: DataFrame, release: str, dim: int = 64, text: str = "content", allowed: str | None = "allowed_for_indexing") -> DataFrame:
    """The sections with pending ones embedded under the release; where ``allowed`` is given, only sections it allows are embedded."""
    todo = F.coalesce(F.col("embedding").isNull() | (F.col("index_release_id") != release), F.col("embedding").isNull())
    if allowed:
        todo = todo & F.coalesce(F.col(allowed), F.lit(False))
    new = hash_embedding(text, dim).cast("array<float>")
    return sections.withColumns({"embedding": F.when(todo, new).otherwise(F.col("embedding")), "index_release_id": F.when(todo, release).otherwise(F.col("index_release_id"))})


def index_report(sections: DataFrame, release: str, dim: int) -> DataFrame:
    """One row: sections, embedded ones of the release, wrong dimensions and the gate (fail on wrong dimensions, warn if none or some are missing)."""
    mine = F.coalesce(F.col("index_release_id") == release, F.lit(False)) & F.col("embedding").isNotNull()
    r = sections.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if(mine).alias("embedded_chunks"), F.count_if(mine & (F.size("embedding") != dim)).alias("errors"))
    return r.withColumn("quality_gate", F.when(F.col("errors") > 0, "fail").when((F.col("total_chunks") == 0) | (F.col("embedded_chunks") < F.col("total_chunks")), "warn").otherwise("pass"))


def usable_vector(c: str, dim: int) -> Column:
    """Of the length, without nulls, finite, not all zero."""
    v = F.col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def cell_count(n: int) -> int:
    """Cells of an inverted-file index over n vectors."""
    return max(1, math.isqrt(n))


def metadata_filter(filters: Mapping[str, str | Sequence[str] | None]) -> Column:
    """Conjunction of equalities; None and "any" are no condition, a sequence means one of."""
    out = F.lit(True)
    for c, v in filters.items():
        if v is not None and v != "any":
            out = out & (F.col(c) == v if isinstance(v, str) else F.col(c).isin(*v))
    return out


def context_blocks(hits: DataFrame, query: str, rank: str, item: str, text: str, most: int = 700) -> DataFrame:
    """(query, context): numbered blocks in rank order."""
    b = F.struct(F.col(rank).alias("r"), F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.col(item).cast("string"), F.lit("\n"), F.substring(text, 1, most)).alias("t"))
    return hits.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(b)), lambda x: x["t"]), "\n\n").alias("context"))


def answer_gate(hits: DataFrame, queries: DataFrame, query: str, score: str, least: float = 0.6) -> DataFrame:
    """(query, n_hits, confidence, abstain_reason): no hits, or a best score below the limit, abstains. Scores above 1 count as 1."""
    best = hits.groupBy(query).agg(F.count(F.lit(1)).alias("n_hits"), F.max(score).alias("best"))
    g = queries.select(query).distinct().join(best, query, "left").withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "confidence": F.round(F.coalesce(F.least(F.col("best"), F.lit(1.0)), F.lit(0.0)), 6)})
    reason = F.when(F.col("n_hits") == 0, "no_retrieval_results").when(F.col("confidence") < least, "low_retrieval_confidence")
    return g.select(query, "n_hits", "confidence", reason.alias("abstain_reason"))


def cited_markers(answer: Column, n_hits: Column) -> Column:
    """Positions named by [来源N] or [source N] markers that exist; without any, all positions."""
    marks = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(?:来源|source )(\d{1,4})\]"), F.lit(1)), lambda x: x.cast("int"))
    valid = F.array_sort(F.array_distinct(F.filter(marks, lambda x: (x >= 1) & (x <= n_hits))))
    all_ = F.when(n_hits > 0, F.sequence(F.lit(1), n_hits)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(valid) > 0, valid).otherwise(all_)
