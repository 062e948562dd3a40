"""Retrieval for many queries at once: vector and lexical legs, reciprocal rank fusion, pruning, query plans.

Query sets are broadcast only by Spark's own size estimate; the collection is never collected. Each leg keeps its k best rows per query inside the
window (rank limit pushed below the shuffle), so no leg sorts all pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.text import STOP_WORDS, lexical_terms, light_stem, normal_space, token_estimate, words
from talus.operators.indexing import metadata_filter
from talus.session import ship_package, stage_table

RRF_K = 60
#: Queries of a block and items of a shard of the vector search.
BLOCK_ROWS, SHARD_ROWS = 8192, 16384


def top_k(scored: DataFrame, query: str, score: str, item: str, k: int) -> DataFrame:
    """The k best items per query with their rank; ties by item."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_top_k(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, vector: str, k: int, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, item_id, score, rank) by cosine, exact: every block of queries meets every shard of the items in matrix products, and only its k best leave it.

    Vectors that are null, hold nulls or are all zero have no cosine; only vectors of equal length are compared.
    """

    def side(rows: DataFrame, key: str, n: int) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        full = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), v.alias("v")).where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull()))
        return full.withColumns({"dim": F.size("v"), "part": F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")})

    ship_package(queries.sparkSession)
    n_blocks, n_shards = max(1, -(-queries.count() // block_rows)), max(1, -(-items.count() // shard_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = side(queries, query_id, n_blocks).withColumnRenamed("part", "block").withColumn("shard", every(n_shards))
    it = side(items, item_id, n_shards).withColumnRenamed("part", "shard").withColumn("block", every(n_blocks))

    def unit(v: pd.Series) -> np.ndarray:
        m = np.stack(v.to_list())
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": a.id[:0], "item": b.id[:0], "score": np.zeros(0)})
        b = b.sort_values("id", kind="stable")
        codes, _ = pd.factorize(pd.concat([a.id, b.id], ignore_index=True))
        qs, vs, own, others, out = unit(a.v), unit(b.v), codes[: len(a)], codes[len(a) :], []
        for at in range(0, len(a), 128):
            score = np.round(qs[at : at + 128] @ vs.T, 6)
            order = np.where(np.isnan(score), np.inf, score)  # as Spark sorts them
            order[own[at : at + 128, None] == others] = -np.inf
            top = np.argsort(-order, axis=1, kind="stable")[:, :k]  # ties by item
            r, c = np.nonzero(np.take_along_axis(order, top, 1) > -np.inf)
            c = top[r, c]
            out.append(pd.DataFrame({"query": a.id.to_numpy()[at + r], "item": b.id.to_numpy()[c], "score": score[r, c]}))
        return pd.concat(out)

    schema = f"query {queries.schema[query_id].dataType.simpleString()}, item {items.schema[item_id].dataType.simpleString()}, score double"
    keys = ["dim", "block", "shard"]
    found = q.groupBy(*keys).cogroup(it.groupBy(*keys)).applyInPandas(best, schema)
    return top_k(found.select(F.col("query").alias(query_id), F.col("item").alias(item_id), F.round("score", 6).alias("score")), query_id, "score", item_id, k)


def lexical_top_k(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): documents with all of the query's distinct words, stop words left out, scored by occurrences per thousand words.

    The declared scoring stands in for a full-text engine's cover density, which needs that engine's dictionaries.
    """
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    q = queries.select(query_id, F.array_except(F.array_distinct(words(query_text)), stop).alias("_terms")).where(F.size("_terms") > 0)
    asked = q.select(query_id, F.size("_terms").alias("_n"), F.explode("_terms").alias("term"))
    d = docs.select(doc_id, words(doc_text).alias("_words")).where(F.size("_words") > 0)
    tf = d.select(doc_id, F.size("_words").alias("_len"), F.explode("_words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy(doc_id, "_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    hit = tf.join(asked, "term").groupBy(query_id, doc_id, "_n", "_len").agg(F.count(F.lit(1)).alias("_found"), F.sum("tf").alias("_tf")).where("_found = _n")
    return top_k(hit.select(query_id, doc_id, F.round(F.lit(1000.0) * F.col("_tf") / F.col("_len"), 6).alias("score")), query_id, "score", doc_id, k)


def reciprocal_rank_fusion(legs: list[tuple[str, DataFrame]], query: str, item: str, k: int = RRF_K) -> DataFrame:
    """(query, item, rrf_score, <leg>_score...): a contribution 1 / (k + rank) for every occurrence in a leg."""
    union: DataFrame | None = None
    for name, leg in legs:
        part = leg.select(query, item, F.lit(name).alias("leg"), "score", "rank")
        union = part if union is None else union.unionByName(part)
    best = [F.max(F.when(F.col("leg") == n, F.col("score"))).alias(f"{n}_score") for n, _ in legs]
    return union.groupBy(query, item).agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("rrf_score"), *best)


def searchable_sections(sections: DataFrame, docs: DataFrame, filters: Mapping[str, str | Sequence[str] | None]) -> DataFrame:
    """Sections with the columns of their document (inner join on doc_id), restricted by metadata filters; None and "any" restrict nothing.

    A column that both sides have is the section's, or the document's where the section has none.
    """
    both = [c for c in docs.columns if c in sections.columns and c != "doc_id"]
    d = docs.withColumnsRenamed({c: f"_doc_{c}" for c in both})
    j = sections.join(d, "doc_id")
    return j.withColumns({c: F.coalesce(c, f"_doc_{c}") for c in both}).drop(*[f"_doc_{c}" for c in both]).where(metadata_filter(filters)) if both else j.where(metadata_filter(filters))


def with_anchors(hits: DataFrame, anchors: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The k best (hit, anchor) rows per query: a hit stands once for each of its anchors, and once with its own id as evidence without any; ranks count these rows."""
    a = anchors.select(F.col("chunk_id").alias(item), F.col("anchor_id")).dropna().distinct()
    rows = hits.drop("rank").join(a, item, "left").withColumn("evidence_id", F.coalesce("anchor_id", item)).drop("anchor_id")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), item, "evidence_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid_search(
    queries: DataFrame, sections: DataFrame, docs: DataFrame, anchors: DataFrame, filters: Mapping[str, str | Sequence[str] | None], query_id: str, query_text: str, dim: int = 64, k: int = 10, leg_k: int = 20, min_score: float = 0.0
) -> DataFrame:
    """(query, section_id, evidence_id, vector_score, lexical_score, rrf_score, relevance, rank): the k best sections per query from a vector and a lexical leg.

    queries carry their vector as ``embedding``; sections(section_id, doc_id, content, embedding, ...) one row each; both legs search the sections that pass the
    filters, join the anchors and rank the joined rows. The fused score sums over all rows of a section; ties go to the better vector rank, then the better lexical
    rank, then the id. relevance is ten times the score within 0..1; rows below ``min_score`` of it are left out.
    """
    queries = stage_table(queries.select(query_id, query_text, "embedding"), "queries")
    base = stage_table(searchable_sections(sections, docs, filters).select("section_id", "doc_id", "content", "embedding"), "searchable")
    vector = with_anchors(vector_top_k(queries, base, query_id, "section_id", "embedding", leg_k), anchors, query_id, "section_id", leg_k)
    lexical = with_anchors(lexical_top_k(queries, base, query_id, query_text, "section_id", "content", leg_k), anchors, query_id, "section_id", leg_k)
    rows = vector.withColumn("leg", F.lit("vector")).unionByName(lexical.withColumn("leg", F.lit("lexical")))
    of = lambda f, leg, c: f(F.when(F.col("leg") == leg, F.col(c)))
    fused = rows.groupBy(query_id, "section_id").agg(
        F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 9).alias("rrf_score"), of(F.max, "vector", "score").alias("vector_score"), of(F.max, "lexical", "score").alias("lexical_score"),
        of(F.min, "vector", "rank").alias("_v"), of(F.min, "lexical", "rank").alias("_l"), F.min("evidence_id").alias("evidence_id"),
    )
    order = [F.col("rrf_score").desc(), F.col("_v").asc_nulls_last(), F.col("_l").asc_nulls_last(), F.col("section_id")]
    best = fused.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).where(F.col("rank") <= k)
    relevance = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rrf_score") * 10)), 6)
    return best.withColumn("relevance", relevance).where(F.col("relevance") >= min_score).select(query_id, "section_id", "evidence_id", "vector_score", "lexical_score", "rrf_score", "relevance", "rank")


def cover_density(positions: Sequence[Sequence[int]]) -> float:
    """Sum over the covers, the shortest stretches with all query words, of 0.1 / (1 + other words inside): close words count more. positions: of each query word, ascending."""
    total, ends = 0.0, [0] * len(positions)
    start = min((p[0] for p in positions if p), default=-1)
    if start < 0 or not all(positions):
        return 0.0
    while True:
        # the end of the first cover from start on, then its latest beginning
        firsts = []
        for i, p in enumerate(positions):
            while ends[i] < len(p) and p[ends[i]] < start:
                ends[i] += 1
            if ends[i] == len(p):
                return total
            firsts.append(p[ends[i]])
        last = max(firsts)
        begin = min(max(x for x in p if x <= last) for p in positions)
        total += 0.1 / (1 + (last - begin + 1) - len(positions))
        start = begin + 1


def cover_top_k(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): documents with the stems of all of the query's words (stop words left out), scored by the density of their covers.

    Stems are light_stem's. Only the positions of asked stems leave a document, and a document's positions meet per (query, document).
    """
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    ship_package(queries.sparkSession)
    stem = F.pandas_udf(lambda s: s.map(light_stem), "string")
    q = queries.select(query_id, F.explode(F.array_except(F.array_distinct(words(query_text)), stop)).alias("w")).withColumn("term", stem("w"))
    asked = q.select(query_id, "term").distinct().join(q.groupBy(query_id).agg(F.count_distinct("term").alias("_n")), query_id)
    pos = docs.select(doc_id, F.posexplode(words(doc_text)).alias("_at", "w"))
    # each distinct word is stemmed once
    vocabulary = pos.select("w").distinct().withColumn("term", stem("w")).join(asked.select("term").distinct(), "term", "left_semi")
    lists = pos.join(vocabulary, "w").groupBy(doc_id, "term").agg(F.array_sort(F.collect_list("_at")).alias("at"))
    hit = lists.join(asked, "term").groupBy(query_id, doc_id, "_n").agg(F.collect_list("at").alias("at")).where(F.size("at") == F.col("_n"))
    dense = F.pandas_udf(lambda s: s.map(lambda ps: cover_density([list(p) for p in ps])), "double")
    return top_k(hit.select(query_id, doc_id, F.round(dense("at"), 6).alias("score")), query_id, "score", doc_id, k)


def prune_contexts(hits: DataFrame, query: str, item: str, text: str, rank: str, max_chunks: int = 5, token_budget: int = 2500) -> DataFrame:
    """(query, item, used_tokens) of the contexts kept: a context that would exceed the budget is skipped and later ones are tried; the first is always kept."""
    ctx = F.struct(F.col(rank).alias("rank"), F.col(item).alias("item"), token_estimate(text).alias("tokens"))
    few = hits.where(F.col(rank) <= max_chunks).groupBy(query).agg(F.array_sort(F.collect_list(ctx)).alias("c"))  # at most max_chunks per query
    kind = hits.schema[item].dataType.simpleString()
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<item:{kind},used_tokens:int>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = (F.size(s["kept"]) == 0) | (s["used"] + x["tokens"] <= token_budget)
        used = s["used"] + x["tokens"]
        grown = F.concat(s["kept"], F.array(F.struct(x["item"].alias("item"), used.alias("used_tokens"))))
        return F.struct(F.when(fits, used).otherwise(s["used"]).alias("used"), F.when(fits, grown).otherwise(s["kept"]).alias("kept"))

    kept = few.select(query, F.explode(F.aggregate("c", start, step)["kept"]).alias("k"))
    return kept.select(query, F.col("k.item").alias(item), F.col("k.used_tokens").alias("used_tokens"))


def query_plans(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, semantic_query, lexical_terms, mode, use_hyde): rewriting keeps identifiers, procedural questions are widened, the route follows from terms and length."""
    q = queries.select(query_id, normal_space(text).alias("_q")).withColumn("_terms", lexical_terms("_q"))
    n_words = F.size(F.filter(F.split("_q", " "), lambda w: w != ""))
    kept = F.when(F.size("_terms") > 0, F.concat_ws(" ", "_q", F.array_join("_terms", " "))).otherwise(F.col("_q"))
    how = F.contains(F.lower("_q"), F.lit("how do i")) | F.contains("_q", F.lit("如何"))
    semantic = F.when(how, F.concat(kept, F.lit(" troubleshooting steps recovery procedure"))).otherwise(kept)
    mode = F.when(F.size("_terms") > 0, "hybrid_lexical_guard").when(n_words <= 3, "hybrid_short_query").otherwise("hybrid_default")
    return q.select(query_id, semantic.alias("semantic_query"), F.array_join("_terms", " ").alias("lexical_terms"), mode.alias("mode"), ((F.size("_terms") == 0) & (n_words <= 3)).alias("use_hyde"))
