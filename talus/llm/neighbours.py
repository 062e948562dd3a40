"""Most similar vectors for every vector: vantage-point trees per shard, triangle-inequality pruning relaxed by a factor.

Vectors are scaled to unit length, so the Euclidean distance d and the cosine c go together: d^2 = 2 - 2c.

1. A top vantage-point tree, fitted on a bounded sample, splits all rows into leaves of about equal size; a leaf is a shard, a crowded leaf several
   (parts by a hash of the id). Each shard is one row with its packed matrix and a vantage-point tree of its own.
2. Every shard answers its own queries first. That gives each query a k-th best distance tau, near its final one, as the leaf holds its surroundings.
3. A query then goes only to the leaves that the triangle inequality leaves over: those that no node of the top tree separates from it by
   |d(q, vantage) - mu| > tau / factor. Queries travel in packed blocks, each to a shard at most once; shards with many queries are copied over a few tasks.
4. Inside a shard the same rule prunes the shard's tree; leaves are compared by matrix products. The partial answers of a block meet again and are merged.

Factor 1 is the exact search; the larger the factor, the more is skipped. Unless a factor is given, it is fitted to the wanted recall: for SAMPLE_QUERIES
queries the true neighbours are found by a full scan, and for each of them the largest factor that would still reach it is known from the
margins on its way; the factor is the quantile of these that keeps the wanted share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.session import ship_package, stage_table

#: Rows of a shard at most (about), of a leaf of its tree, and of a block of queries.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 65_536, 512, 8192
#: Rows that the top tree is fitted on, and queries that the factor is fitted on.
SAMPLE_ROWS, SAMPLE_QUERIES = 65_536, 256
#: The recall that the factor is fitted to; the distance that rounding may hide.
RECALL, ROUNDING = 0.93, 1e-4
#: Queries that one task compares with its shard, about.
TASK_QUERIES = 131_072


def usable(vector: str, dim: int) -> F.Column:
    """Of the expected length, without nulls, finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def build_tree(m: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row order, vantage vectors and nodes (vantage, mu, inside child, outside child, from, to); a leaf has vantage -1."""
    order, nodes, vantage = np.arange(len(m)), [], []
    todo = [(0, len(m), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        rows = order[lo:hi]
        if hi - lo <= leaf_rows:
            nodes.append([-1, 0.0, -1, -1, lo, hi])
            continue
        v = m[rows[rng.integers(len(rows))]]
        d = np.sqrt(np.maximum(0, 2 - 2 * (m[rows] @ v)))
        half = (hi - lo) // 2
        by = np.argpartition(d, half)
        order[lo:hi] = rows[by]
        nodes.append([len(vantage), float(d[by[half]]), -1, -1, lo, hi])
        vantage.append(v)
        todo += [(lo + half, hi, me, 1), (lo, lo + half, me, 0)]
    return order, np.array(vantage, np.float32).reshape(-1, m.shape[1]), np.array(nodes, np.float64)


def reach(kth: np.ndarray, factor: float) -> np.ndarray:
    """How far from a query a separating sphere may lie to be crossed."""
    return np.sqrt(np.maximum(0, 2 - 2 * kth)) / factor + ROUNDING


def leaf_numbers(m: np.ndarray, vantage: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The leaf (numbered in node order) that each row falls into."""
    number = np.cumsum(nodes[:, 0] < 0) - 1
    out, todo = np.zeros(len(m), np.int64), [(0, np.arange(len(m)))]
    while todo:
        node, rows = todo.pop()
        if nodes[node, 0] < 0:
            out[rows] = number[node]
        elif len(rows):
            near = np.sqrt(np.maximum(0, 2 - 2 * (m[rows] @ vantage[int(nodes[node, 0])]))) < nodes[node, 1]
            todo += [(int(nodes[node, 2]), rows[near]), (int(nodes[node, 3]), rows[~near])]
    return out


def margins(m: np.ndarray, vantage: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row and leaf (numbered in node order) the widest margin by which a node separates them; 0 for the row's own leaf."""
    number = np.cumsum(nodes[:, 0] < 0) - 1
    out, todo = np.zeros((len(m), int(number[-1]) + 1), np.float32), [(0, np.zeros(len(m), np.float32))]
    while todo:
        node, so_far = todo.pop()
        if nodes[node, 0] < 0:
            out[:, number[node]] = so_far
            continue
        d = np.sqrt(np.maximum(0, 2 - 2 * (m @ vantage[int(nodes[node, 0])])))
        gap, near = np.abs(d - nodes[node, 1]).astype(np.float32), d < nodes[node, 1]
        todo += [(int(nodes[node, 2]), np.where(near, so_far, np.maximum(so_far, gap))), (int(nodes[node, 3]), np.where(near, np.maximum(so_far, gap), so_far))]
    return out


def units(vectors: list) -> np.ndarray:
    m = np.stack(vectors).astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def unpacked(ids: object, mat: bytes, vantage: bytes, nodes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, matrix, vantage vectors and nodes of a shard's row."""
    ids = np.asarray(ids, object)
    m = np.frombuffer(mat, np.float32).reshape(len(ids), -1)
    return ids, m, np.frombuffer(vantage, np.float32).reshape(-1, m.shape[1]), np.frombuffer(nodes, np.float64).reshape(-1, 6)


class Best:
    """The k best cosines of each query so far; ``kth`` may be known beforehand."""

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None) -> None:
        self.cos = np.full((n, k), -2.0, np.float32)
        self.ids = np.full((n, k), None, object)
        self.floor = np.full(n, -2.0, np.float32) if kth is None else kth
        self.kth = self.floor.copy()

    def offer(self, q: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> None:
        rows = np.flatnonzero((cos > self.kth[q, None]).any(1))
        if not len(rows):
            return
        k, q, c = self.cos.shape[1], q[rows], cos[rows]
        both = np.concatenate([self.cos[q], c], axis=1)
        top = np.argpartition(-both, k - 1, axis=1)[:, :k]
        self.cos[q] = np.take_along_axis(both, top, 1)
        old = np.take_along_axis(self.ids[q], np.minimum(top, k - 1), 1)
        at = np.maximum(top - k, 0)
        self.ids[q] = np.where(top < k, old, ids[at] if ids.ndim == 1 else np.take_along_axis(ids[rows], at, 1))
        self.kth[q] = np.maximum(self.cos[q].min(1), self.floor[q])


def search_tree(queries: np.ndarray, own: np.ndarray | None, best: Best, m: np.ndarray, ids: np.ndarray, vantage: np.ndarray, nodes: np.ndarray, factor: float) -> int:
    """Offer the shard's rows to all queries; own: the queries' rows in this shard, where it is their own. Returns the number of comparisons."""
    compared = 0
    everyone = np.arange(len(queries))
    todo: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, everyone, None)]
    while todo:
        node, q, margin = todo.pop()
        if margin is not None:
            q = q[margin <= reach(best.kth[q], factor)]
        if not len(q):
            continue
        v, mu, inside, outside, lo, hi = nodes[node]
        lo, hi = int(lo), int(hi)
        if v < 0:
            cos = queries[q] @ m[lo:hi].T
            compared += cos.size
            if own is not None:
                mine = own[q]
                here = np.flatnonzero((mine >= lo) & (mine < hi))
                cos[here, mine[here] - lo] = -2
            best.offer(q, cos, ids[lo:hi])
            continue
        d = np.sqrt(np.maximum(0, 2 - 2 * (queries[q] @ vantage[int(v)])))
        near, gap = d < mu, np.abs(d - mu)
        a, b = q[near], q[~near]
        todo += [(int(inside), b, gap[~near]), (int(outside), a, gap[near]), (int(outside), b, None), (int(inside), a, None)]
    return compared


def fitted_factor(shards: DataFrame, asked: np.ndarray, asked_ids: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int, recall: float) -> float:
    """The largest factor that would still reach the wanted share of the asked queries' true neighbours, 1 at least.

    A neighbour beyond a node's margin g is reached if g <= tau / factor. The true tau is taken, which is smaller than any the search has on its way.
    """
    shared = shards.sparkSession.sparkContext.broadcast((asked, asked_ids, margins(asked, *top)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, q_ids, above = shared.value
        for b in batches:
            out = []
            for leaf, row in zip(b["leaf"], zip(b["ids"], b["mat"], b["vantage"], b["nodes"], strict=True), strict=True):
                ids, m, vantage, nodes = unpacked(*row)
                cos = q @ m.T
                cos[q_ids[:, None] == ids[None, :]] = -2
                n = min(k, len(ids))
                best = np.argpartition(-cos, n - 1, axis=1)[:, :n]
                inside, starts = margins(q, vantage, nodes), nodes[nodes[:, 0] < 0, 4]
                order = np.argsort(starts)
                at = order[np.searchsorted(starts[order], best, side="right") - 1]
                margin = np.maximum(np.take_along_axis(inside, at, 1), above[:, [leaf]])
                out.append(pd.DataFrame({"q": np.repeat(np.arange(len(q)), n), "cos": np.take_along_axis(cos, best, 1).ravel(), "margin": margin.ravel()}))
            if out:
                yield pd.concat(out).astype({"q": np.int32, "cos": float, "margin": float})

    found = shards.select("leaf", "ids", "mat", "vantage", "nodes").mapInPandas(run, "q int, cos double, margin double").where("cos > -1.5")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cos").desc(), "margin"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).toPandas()  # at most SAMPLE_QUERIES * k rows
    if not len(true):
        return 1.0
    tau = np.sqrt(np.maximum(0, 2 - 2 * true.groupby("q")["cos"].transform("min")))
    most = np.sort(np.where(true.margin <= ROUNDING, np.inf, tau / np.maximum(true.margin - ROUNDING, 1e-9)))[::-1]
    return float(np.clip(most[min(len(most) - 1, math.ceil(recall * len(most)) - 1)], 1, 100))


def nearest(
    vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64, factor: float | None = None, version_col: str | None = None, recall: float = RECALL, shard_rows: int | None = None
) -> DataFrame:
    """(id, neighbour_id, cosine, rank): for every usable vector the k most similar others, rank 1 the most similar (ties: the smaller id).

    factor: 1 is exact, None fits it to ``recall``. Vectors that are null, of another length, all zero, or hold null, NaN or infinity are not usable and appear on
    neither side. A vector delivered again counts once, as its last version. With k usable vectors or fewer, all others are given. Where ties go beyond rank k, any
    of them fill it. Extra columns are ignored; an empty table gives an empty result.
    """
    if factor is not None and factor < 1:
        raise ValueError("factor must be 1 or more")
    spark = vectors.sparkSession
    ship_package(spark)
    version = F.col(version_col).cast("timestamp") if version_col else F.lit(None).cast("timestamp")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col, dim)).select(F.col(id_col).cast("string").alias("id"), version.alias("ver"), F.col(vector_col).cast("array<float>").alias("vec"))
    rows = stage_table(rows.groupBy("id").agg(F.max_by("vec", F.struct("ver", "vec")).alias("vec")), "vectors")
    n = rows.count()
    wanted = shard_rows or min(SHARD_ROWS, max(4096, n // 8))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    m = units(sample.vec.to_list()) if n else np.zeros((0, dim), np.float32)
    n_leaves = 1 << max(0, math.ceil(math.log2(max(1, n) / wanted)))
    _, *top = build_tree(m, max(8, -(-len(m) // n_leaves)), np.random.default_rng(5))
    shared_top = spark.sparkContext.broadcast(top)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=leaf_numbers(units(b.vec.to_list()), *shared_top.value).astype(np.int32) if len(b) else np.zeros(0, np.int32))

    placed = stage_table(rows.mapInPandas(place, "id string, vec array<float>, leaf int"), "placed")
    sizes = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most SAMPLE_ROWS / 8 leaves
    first, parts, total = {}, {}, 0
    for leaf in sorted(sizes):
        first[leaf], parts[leaf] = total, max(1, round(sizes[leaf] / wanted))
        total += parts[leaf]
    look = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("leaf")] if of else F.lit(0)
    numbered = placed.withColumn("shard", (look(first) + F.pmod(F.xxhash64("id"), look(parts))).cast("int"))

    def shard(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = units(part.vec.to_list())
        order, vantage, nodes = build_tree(m, LEAF_ROWS, np.random.default_rng(int(key[0])))
        return pd.DataFrame({"shard": [key[0]], "leaf": [part.leaf.iloc[0]], "ids": [part.id.to_numpy()[order]], "mat": [m[order].tobytes()], "vantage": [vantage.tobytes()], "nodes": [nodes.tobytes()]})

    shards = stage_table(numbered.groupBy("shard").applyInPandas(shard, "shard int, leaf int, ids array<string>, mat binary, vantage binary, nodes binary"), "shards")
    if factor is None:
        factor = fitted_factor(shards, m[:SAMPLE_QUERIES], sample.id.to_numpy(object)[:SAMPLE_QUERIES], (top[0], top[1]), k, recall) if n else 1.0

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, leaf, *row in zip(b["shard"], b["leaf"], b["ids"], b["mat"], b["vantage"], b["nodes"], strict=True):
                ids, m, *tree = unpacked(*row)
                for lo in range(0, len(ids), BLOCK_ROWS):
                    q = m[lo : lo + BLOCK_ROWS]
                    best = Best(len(q), k)
                    search_tree(q, lo + np.arange(len(q)), best, m, ids, *tree, factor)
                    yield pd.DataFrame({"shard": [number], "leaf": [leaf], "block": [lo // BLOCK_ROWS], "ids": [ids[lo : lo + BLOCK_ROWS]], "mat": [q.tobytes()], "cos": [best.cos.tobytes()], "near": [best.ids.ravel()]})

    blocks = stage_table(shards.mapInPandas(own, "shard int, leaf int, block int, ids array<string>, mat binary, cos binary, near array<string>"), "blocks")
    salts = max(1, math.ceil(n / TASK_QUERIES), math.ceil(16 / max(1, total)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["target", "salt", "shard", "block", "rows", "mat", "kth"]
        for b in batches:
            for number, leaf, block, mat, cos in zip(b["shard"], b["leaf"], b["block"], b["mat"], b["cos"], strict=True):
                m, kth = np.frombuffer(mat, np.float32).reshape(-1, dim), np.frombuffer(cos, np.float32).reshape(-1, k).min(1)
                goes: dict[int, list[np.ndarray]] = {}
                for lo in range(0, len(m), 1024):
                    go = margins(m[lo : lo + 1024], *shared_top.value) <= reach(kth[lo : lo + 1024], factor)[:, None]
                    for to in np.flatnonzero(go.any(0)):
                        goes.setdefault(int(to), []).append(lo + np.flatnonzero(go[:, to]))
                for to in goes.keys() & parts.keys():
                    at = np.concatenate(goes[to])
                    for target in range(first[to], first[to] + parts[to]):
                        # the other parts of a crowded leaf cannot better a query that has k copies of itself
                        some = at[kth[at] < 1 - 2e-7] if to == leaf else at
                        if target != number and len(some):
                            yield pd.DataFrame([(target, (number + block) % salts, number, block, some.astype(np.int32).tobytes(), m[some].tobytes(), kth[some].tobytes())], columns=names)

    asks = blocks.select("shard", "leaf", "block", "mat", "cos").mapInPandas(ask, "target int, salt int, shard int, block int, rows binary, mat binary, kth binary")
    copies = shards.select(F.col("shard").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "ids", "mat", "vantage", "nodes")
    meet = copies.unionByName(asks, allowMissingColumns=True).repartition(max(1, min(8192, 2 * total * salts)), "target", "salt").sortWithinPartitions("target", "salt", F.col("shard").asc_nulls_first(), "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = None
        for b in batches:
            for ids, mat, vantage, nodes, number, block, at, kth in zip(b["ids"], b["mat"], b["vantage"], b["nodes"], b["shard"], b["block"], b["rows"], b["kth"], strict=True):
                if ids is not None:
                    here = unpacked(ids, mat, vantage, nodes)
                    continue
                q = np.frombuffer(mat, np.float32).reshape(-1, dim)
                best = Best(len(q), k, np.frombuffer(kth, np.float32))
                search_tree(q, None, best, here[1], here[0], here[2], here[3], factor)
                r, c = np.nonzero(best.cos > best.floor[:, None])
                if len(r):
                    yield pd.DataFrame({"shard": [int(number)], "block": [int(block)], "rows": [np.frombuffer(at, np.int32)[r].tobytes()], "cos": [best.cos[r, c].tobytes()], "near": [best.ids[r, c]]})

    found = meet.mapInPandas(search, "shard int, block int, rows binary, cos binary, near array<string>")
    answers = blocks.select("shard", "block", "ids", "cos", "near").unionByName(found, allowMissingColumns=True).repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("rows").asc_nulls_first())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, ids = None, None

        def result() -> pd.DataFrame:
            out = pd.DataFrame({"id": np.repeat(ids, k), "neighbour_id": best.ids.ravel(), "cosine": best.cos.ravel().astype(float)})
            out = out[out.cosine >= -1.5].sort_values(["id", "cosine", "neighbour_id"], ascending=[True, False, True])
            out["rank"] = out.groupby("id").cumcount() + 1
            return out

        for b in batches:
            for own_ids, at, cos, near in zip(b["ids"], b["rows"], b["cos"], b["near"], strict=True):
                near, cos = np.asarray(near, object), np.frombuffer(cos, np.float32)
                if own_ids is not None:
                    if best is not None:
                        yield result()
                    ids = np.asarray(own_ids, object)
                    best = Best(len(ids), k)
                    best.cos, best.ids = cos.reshape(-1, k).copy(), near.reshape(-1, k)
                    best.kth = best.cos.min(1)
                    continue
                at = np.frombuffer(at, np.int32)
                place = np.arange(len(at)) - np.searchsorted(at, at)  # at is sorted, at most k entries each
                wide, who = np.unique(at, return_inverse=True)
                c, i = np.full((len(wide), k), -2.0, np.float32), np.full((len(wide), k), None, object)
                c[who, place], i[who, place] = cos, near
                best.offer(wide, c, i)
        if best is not None:
            yield result()

    return answers.mapInPandas(merge, "id string, neighbour_id string, cosine double, rank int")
