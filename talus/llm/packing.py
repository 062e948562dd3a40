"""Filling fixed-capacity containers: exact best-fit decreasing over all items, without a sequential pass over them.

Best fit decides by sizes alone, and sizes are whole numbers up to the capacity C. So the driver packs the histogram of the sizes (at most
C + 1 rows however many items there are): a segment tree over the remaining capacities gives, in logarithmic time, the tightest one that some
open bin has, and bins of equal remaining capacity are handled as one run. The result is a bounded list of rules "ranks i.. of size s go to
bins b.., k in each"; the items look up their rank's rule in parallel. The packing is the one that item-by-item best-fit decreasing gives.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.session import ship_package, stage_table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public tokenizer's way of taking text apart before merging (a fixed value of that tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a size class that are ranked in one task, about.
CLASS_ROWS = 1 << 18
#: Tokens by which the end of a window may change the number of tokens before it.
EDGE = 16


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity: how many open bins have each, and the least capacity >= s that some bin has."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def first(self, s: int) -> int:
        """-1 if no open bin has s or more left."""
        i = s + self.size
        if self.count[i]:
            return s
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def pack_sizes(sizes: Sequence[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing of (size, number of items): rules (size, first rank, first bin, items per bin) and the number of bins.

    Items of size 0 go to the fullest bin.
    """
    tree, runs = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    rules: list[tuple[int, int, int, int]] = []
    bins = 0

    def put(left: int, first: int, n: int) -> None:
        if n:
            runs[left].append((first, n))
            tree.add(left, n)

    for s, n in sorted(sizes, reverse=True):
        rank, todo = 0, n
        while todo:
            left = tree.first(s)
            if left < 0:
                each = capacity // s if s else todo
                first, there = bins, -(-todo // each)
                bins, left = bins + there, capacity
            else:
                first, there = runs[left].pop()
                tree.add(left, -there)
                each = left // s if s else todo
            full = min(there, todo // each)
            if full:
                rules.append((s, rank, first, each))
                rank, todo = rank + full * each, todo - full * each
                put(left - each * s, first, full)
            used = full
            if todo and used < there:
                rules.append((s, rank, first + used, todo))
                put(left - todo * s, first + used, 1)
                rank, todo, used = rank + todo, 0, used + 1
            put(left, first + used, there - used)
    return rules, bins


@functools.lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_long(text: str, tokens: Sequence[int], seen: int, capacity: int, enc) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """(start, end, tokens) of pieces that each have at most ``capacity`` tokens when encoded by themselves and join to the text. ``tokens`` are those of text[:seen]."""
    out, start = [], 0
    while True:
        # few tokens end the text only if they reach its end; a window's end may itself split a few tokens
        while len(tokens) <= capacity + EDGE and seen < len(text):
            seen = min(len(text), start + 2 * (seen - start))
            tokens = enc.encode_ordinary(text[start:seen])
        if len(tokens) <= capacity:
            return [*out, (start, len(text), len(tokens))]
        take = capacity
        while True:
            piece = enc.decode_bytes(tokens[:take]).decode("utf-8", "ignore")
            end = start + max(1, len(piece))
            own = enc.encode_ordinary(text[start:end])
            if len(own) <= capacity or end == start + 1:
                break
            take -= max(1, len(own) - capacity)
        out.append((start, end, len(own)))
        start = end
        # windows of the text, so that a text of any length is encoded a bounded number of times
        seen = min(len(text), start + 16 * capacity)
        tokens = enc.encode_ordinary(text[start:seen])


def token_items(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece_no, n_pieces, char_start, char_end, n_tokens): a text of more than ``capacity`` tokens in pieces, any other whole. Null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            rows = []
            for key, t in zip(b.id, b.text, strict=True):
                t = t if isinstance(t, str) else ""
                seen = min(len(t), 40 * capacity)
                n = enc.encode_ordinary(t[:seen])
                if len(n) <= capacity and seen == len(t):
                    rows.append((key, 0, 1, 0, len(t), len(n)))
                else:
                    ps = cut_long(t, n, seen, capacity, enc)
                    rows += [(key, k, len(ps), s, e, c) for k, (s, e, c) in enumerate(ps)]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "char_start", "char_end", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInPandas(run, f"id {kind}, piece_no int, n_pieces int, char_start long, char_end long, n_tokens int")


def pack(items: DataFrame, size_col: str, capacity: int, order: Sequence[str]) -> DataFrame:
    """items with a container_id (0, 1, ...): no container holds more than ``capacity``. Sizes must lie in 0..capacity (an error is raised otherwise).

    ``order`` names columns that tell items apart; ties in it only decide which of two equal items goes where. A null size counts as 0. An empty table stays empty.
    """
    size = F.coalesce(F.col(size_col), F.lit(0))
    checked = F.when((size >= 0) & (size <= capacity), size.cast("int")).otherwise(F.raise_error(F.concat(F.lit("size out of range: "), size.cast("string"))).cast("int"))
    it = items.withColumn("_size", checked)
    sizes = {r["_size"]: r.n for r in it.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    shards = np.ones(capacity + 1, np.int64)
    for s, n_s in sizes.items():
        shards[s] = -(-n_s // CLASS_ROWS)
    spread = items.sparkSession.createDataFrame(pd.DataFrame({"_size": np.arange(capacity + 1, dtype=np.int32), "_n": shards}))
    it = it.join(F.broadcast(spread), "_size").withColumn("_shard", F.pmod(F.xxhash64(*order), F.col("_n")).cast("int")).drop("_n")
    first = np.cumsum(shards) - shards
    n = np.zeros(int(shards.sum()), np.int64)
    for r in it.groupBy("_size", "_shard").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity + 1 + items / CLASS_ROWS rows
        n[first[r["_size"]] + r["_shard"]] = r.n
    before = np.cumsum(n) - n
    before -= np.repeat(before[first], shards)
    rules, _ = pack_sizes(list(sizes.items()), capacity)
    rule = np.array(sorted(rules), np.int64).reshape(-1, 4)
    shared = items.sparkSession.sparkContext.broadcast((before, first, rule))
    ranked = it.withColumn("_rank", F.row_number().over(Window.partitionBy("_size", "_shard").orderBy(*order)))

    @F.pandas_udf("long")
    def container(s: pd.Series, shard: pd.Series, rank: pd.Series) -> pd.Series:
        before, first, rule = shared.value
        s = s.to_numpy(np.int64)
        r = before[first[s] + shard.to_numpy()] + rank.to_numpy() - 1
        key = rule[:, 0] * (1 << 44) + rule[:, 1]
        i = np.searchsorted(key, s * (1 << 44) + r, side="right") - 1
        return pd.Series(rule[i, 2] + (r - rule[i, 1]) // rule[i, 3])

    return ranked.withColumn("container_id", container("_size", "_shard", "_rank")).drop("_size", "_shard", "_rank")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """All texts in containers of ``capacity`` tokens: (id, piece_no, n_pieces, char_start, char_end, n_tokens, container_id).

    Only a text of more than ``capacity`` tokens is cut. Repeated rows are packed each for itself; null and empty texts take no space.
    """
    ship_package(docs.sparkSession)
    items = stage_table(token_items(docs, id_col, text_col, capacity, tokenizer), "token-items")
    return pack(items, "n_tokens", capacity, ["id", "piece_no"]).withColumnRenamed("id", id_col)
