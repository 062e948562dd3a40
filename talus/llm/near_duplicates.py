"""Near-duplicate records: generalised pigeonhole search over min-hash bits, verified on the texts.

1. Every text becomes the set of its runs of ``k`` consecutive words. Texts with equal word sequences are one class from here on.
2. The set's sketch is the bits of its min-hash values. The bits of one value agree or differ together, so these correlated bits stay in one
   group; a partition is the bits of three or of four values (WIDTHS), and a separate bit of each of BITS values makes up the record's code.
3. Generalised pigeonhole: a similar pair must agree in one of the probed partitions. The partitions' thresholds are unequal: -1 (not probed)
   or 0 (probed for equality). Dynamic programming picks those that together reach the wanted recall at the least number of index rows and
   estimated candidate pairs; the estimates come from a histogram, of fixed size, of all records' keys. A small table is searched by
   few narrow partitions, a large one by more of the wide ones, whose candidates grow more slowly.
4. Probe: records that agree in a probed partition meet; their codes must lie within a Hamming radius (checked inside the join, so few pairs leave it).
5. Verify: the exact similarity of the two texts decides.

A pair exactly at the threshold is missed with a probability of at most MISS plus that of the radius (3.4 standard deviations, 0.0004); it falls
steeply above the threshold. Nothing below the threshold is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.words import blocks, mix, shingles, word_hashes
from talus.session import ship_package, stage_table

#: Min-hash values in each partition, and bits of a record's code.
WIDTHS, BITS = [3] * 26 + [4] * 24, 128
#: Probability that a pair at the threshold agrees in no probed partition.
MISS = 0.002
#: Buckets of each partition's key histogram; all histograms together are len(WIDTHS) * 4 * BUCKETS bytes.
BUCKETS = 8192
#: What an index row costs, in candidate pairs; steps of recall that the dynamic programming tells apart.
ROW_COST, STEPS = 1.0, 400
_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 2**63, sum(WIDTHS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**64 - 1, sum(WIDTHS), dtype=np.uint64)
SKETCH = "fp long, fp2 long, n_words int, keys array<int>, s0 long, s1 long"


def radius(threshold: float) -> int:
    """Hamming radius of the codes: 3.4 standard deviations above the mean distance at the threshold."""
    p = (1 - threshold) / 2
    return int(BITS * p + 3.4 * (BITS * p * (1 - p)) ** 0.5)


def allocate(costs: np.ndarray, threshold: float, miss: float = MISS) -> list[int]:
    """The partitions with threshold 0; all others have -1. costs: index rows and candidate pairs of each partition.

    gain_i = -log P(a pair at the similarity threshold differs in partition i); least[j] is the least cost of a choice whose gains add up to j steps or more.
    """
    need = -np.log(miss)
    steps = [int(-np.log1p(-(threshold**w)) / need * STEPS) for w in WIDTHS]
    if sum(steps) < STEPS:
        raise ValueError(f"these partitions cannot find pairs of similarity {threshold} with a miss rate of {miss}")
    least = np.full(STEPS + 1, np.inf)
    least[0] = 0
    took = np.zeros((len(WIDTHS), STEPS + 1), bool)
    for i, (g, c) in enumerate(zip(steps, costs, strict=True)):
        before = least[np.maximum(np.arange(STEPS + 1) - g, 0)] + c
        took[i] = before < least
        least = np.minimum(least, before)
    chosen, j = [], STEPS
    for i in range(len(WIDTHS) - 1, -1, -1):
        if took[i, j]:
            chosen.append(i)
            j = max(j - steps[i], 0)
    return chosen[::-1]


def sketch(texts: list[str | None], k: int) -> pd.DataFrame:
    """The columns of SKETCH. A text of fewer than k words has no set: its keys are empty."""
    out = []
    for _, enc in blocks(texts):
        n = len(enc)
        h, doc = word_hashes(enc)
        counts = np.bincount(doc, minlength=n)
        fps = []
        for salt in (np.uint64(0x632BE59BD9B4E019), np.uint64(0x8CB92BA72F3D8DD7)):
            first = np.cumsum(counts) - counts
            place = (np.arange(len(h)) - np.repeat(first, counts)).astype(np.uint64)
            fp = np.zeros(n, np.uint64)
            if len(h):
                fp[counts > 0] = np.add.reduceat(mix(h ^ mix(place * salt + salt)), first[counts > 0])
            fps.append(mix(fp + counts.astype(np.uint64) * salt).view(np.int64))
        s, sdoc = shingles(h, doc, k)
        have, starts = np.unique(sdoc, return_index=True)
        low = np.empty((len(_A), len(have)), np.uint64)
        if len(have):
            for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
                low[i] = np.minimum.reduceat((s ^ b) * a, starts)
        keys = np.zeros((len(WIDTHS), len(have)), np.uint64)
        at = 0
        for i, w in enumerate(WIDTHS):
            for j in range(at, at + w):
                keys[i] = keys[i] * np.uint64(0x9E3779B97F4A7C15) + low[j]
            at += w
        keys = (mix(keys) >> np.uint64(32)).astype(np.uint32).view(np.int32).T
        bits = (low[:BITS] >> np.uint64(17)) & np.uint64(1)
        weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))[:, None]
        words = [(bits[i : i + 64] * weights).sum(0, dtype=np.uint64).view(np.int64) for i in (0, 64)]
        rows: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        ss = np.zeros((2, n), np.int64)
        for i, d in enumerate(have):
            rows[d] = keys[i]
        ss[:, have] = words
        out.append(pd.DataFrame({"fp": fps[0], "fp2": fps[1], "n_words": counts.astype(np.int32), "keys": rows, "s0": ss[0], "s1": ss[1]}))
    return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in SKETCH.split(", ")})


def candidate_pairs(sketched: DataFrame) -> tuple[int, np.ndarray]:
    """Records with keys, and for each partition the estimated number of pairs with equal keys.

    The sum of n * n over the buckets counts equal pairs plus those that share a bucket by chance, which are taken off.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(WIDTHS), BUCKETS), np.int64)
        for b in batches:
            if len(b):
                keys = np.stack(b["keys"].to_list()).view(np.uint32) % np.uint32(BUCKETS)
                for i in range(len(WIDTHS)):
                    total[i] += np.bincount(keys[:, i], minlength=BUCKETS)
        yield pd.DataFrame({"part": range(len(WIDTHS)), "n": [x.tobytes() for x in total]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [part.part.iloc[0]], "n": [sum(np.frombuffer(x, np.int64) for x in part.n).tobytes()]})

    rows = sketched.select("keys").mapInPandas(count, "part int, n binary").groupBy("part").applyInPandas(add, "part int, n binary").collect()
    table = np.zeros((len(WIDTHS), BUCKETS))
    for r in rows:
        table[r.part] = np.frombuffer(r.n, np.int64)
    n = table[0].sum()
    return int(n), np.maximum(0, (table**2).sum(1) - n - n * (n - 1) / BUCKETS) / 2


def sketches(docs: DataFrame, id_col: str, text_col: str, version_col: str | None, k: int) -> DataFrame:
    """One sketch per row with an id."""
    version = F.col(version_col).cast("timestamp") if version_col else F.lit(None).cast("timestamp")
    cols = [F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), version.alias("v")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["id", "v"]].reset_index(drop=True), sketch(b.text.to_list(), k).reset_index(drop=True)], axis=1)

    return docs.select(*cols).where(F.col("id").isNotNull()).mapInPandas(run, f"id string, v timestamp, {SKETCH}")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version_col: str | None = None, k: int = 5, threshold: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(id, class_id, n_words) with the exact-copy class of every record of at least min_words words and
    links(class_a, class_b, similarity), class_a < class_b, between classes of similarity ``threshold`` or more. A class is named by its smallest id.

    Null and empty texts have no words; a record of fewer than k words is in no link, one of fewer than min_words in no class. Records delivered again count once,
    as their last version (ties: the larger fingerprint). Extra columns are ignored. Empty tables give empty results.
    """
    ship_package(docs.sparkSession)
    s = stage_table(sketches(docs, id_col, text_col, version_col, k), "sketches")
    last = s.groupBy("id").agg(F.max_by(F.struct("fp", "fp2", "n_words"), F.struct("v", "fp", "fp2")).alias("s")).select("id", "s.*").where(F.col("n_words") >= min_words)
    members = last.join(last.groupBy("fp", "fp2").agg(F.min("id").alias("class_id")), ["fp", "fp2"])
    named = stage_table(members, "members")
    keyed = s.where((F.size("keys") > 0) & (F.col("n_words") >= min_words))
    n, candidates = candidate_pairs(keyed)
    probed = allocate(ROW_COST * n + candidates, threshold)
    reps = keyed.groupBy("fp", "fp2").agg(F.first("keys").alias("keys"), F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    reps = reps.join(named.select("fp", "fp2").distinct(), ["fp", "fp2"], "left_semi")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                c = b.iloc[lo : lo + 2000]
                keys = np.stack(c["keys"].to_list())[:, probed].view(np.uint32).astype(np.int64) + (np.array(probed, np.int64) << 32)
                each = lambda x: np.repeat(x.to_numpy(), len(probed))
                yield pd.DataFrame({"key": keys.ravel(), "fp": each(c.fp), "s0": each(c.s0), "s1": each(c.s1)})

    index = reps.select("keys", "fp", "s0", "s1").mapInPandas(spread, "key long, fp long, s0 long, s1 long")
    a, b = index.alias("a"), index.alias("b")
    close = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) <= radius(threshold)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & close)
    pairs = stage_table(met.select(F.col("a.fp").alias("fa"), F.col("b.fp").alias("fb")).distinct(), "candidates")
    wanted = pairs.select(F.explode(F.array("fa", "fb")).alias("fp")).distinct()
    used = named.join(wanted, "fp", "left_semi").where(F.col("id") == F.col("class_id")).select("id", "fp", "fp2")
    # the last version's text: a text with another fingerprint is of an older version
    cols = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = cols.join(used, "id").groupBy("id", "fp").agg(F.collect_set("text").alias("texts"), F.first("fp2").alias("fp2"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in batches:
            text = []
            for fp, fp2, ts in zip(c.fp, c.fp2, c.texts, strict=True):
                ts = list(ts)
                if len(ts) > 1:
                    s = sketch(ts, k)
                    ts = [t for t, x, y in zip(ts, s.fp, s.fp2, strict=True) if (x, y) == (fp, fp2)]
                text.append(ts[0])
            yield pd.DataFrame({"fp": c.fp, "class_id": c.id, "text": text})

    texts = texts.mapInPandas(pick, "fp long, class_id string, text string")
    left = texts.select(F.col("fp").alias("fa"), F.col("class_id").alias("ca"), F.col("text").alias("ta"))
    right = texts.select(F.col("fp").alias("fb"), F.col("class_id").alias("cb"), F.col("text").alias("tb"))
    both = pairs.join(left, "fa").join(right, "fb").select("ca", "ta", "cb", "tb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in batches:
            sim = np.zeros(len(c))
            for lo in range(0, len(c), 500):
                p = c.iloc[lo : lo + 500]
                sim[lo : lo + 500] = similarity(p.ta.to_list(), p.tb.to_list(), k)
            x, y = np.minimum(c.ca.to_numpy(object), c.cb.to_numpy(object)), np.maximum(c.ca.to_numpy(object), c.cb.to_numpy(object))
            yield pd.DataFrame({"class_a": x, "class_b": y, "similarity": sim})[sim >= threshold - 1e-12]

    links = both.mapInPandas(verify, "class_a string, class_b string, similarity double")
    return named.select("id", "class_id", "n_words"), links


def similarity(a: list[str], b: list[str], k: int) -> np.ndarray:
    """Jaccard similarity of the sets of k-word runs, pair by pair."""
    out = np.zeros(len(a))
    texts = [t for p in zip(a, b, strict=True) for t in p]
    sizes, common = np.zeros(len(a)), np.zeros(len(a))
    s_all, d_all = [], []
    for first, enc in blocks(texts):
        s, d = shingles(*word_hashes(enc), k)
        s_all.append(s)
        d_all.append(d + first)
    if s_all:
        s, d = np.concatenate(s_all), np.concatenate(d_all)
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        s, d = s[fresh], d[fresh] // 2
        sizes = np.bincount(d, minlength=len(a))
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        twice = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
        common = np.bincount(d[1:][twice], minlength=len(a))
    union = sizes - common
    np.divide(common, union, out=out, where=union > 0)
    return out


def similar_pairs(docs: DataFrame, id_col: str, text_col: str, version_col: str | None = None, k: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """(id_a, id_b), smaller first: all similar pairs of records, copies of a class expanded. Quadratic in the size of a group by its nature; similar_groups is not."""
    members, links = similar_classes(docs, id_col, text_col, version_col, k, threshold, max(min_words, k))
    m = members.select("id", "class_id")
    x, y = m.select(F.col("id").alias("x"), F.col("class_id").alias("class_a")), m.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
    across = links.select("class_a", "class_b").join(x, "class_a").join(y, "class_b").select("x", "y")
    within = x.join(y, (F.col("class_a") == F.col("class_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_groups(docs: DataFrame, id_col: str, text_col: str, version_col: str | None = None, k: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """One row (id, class_id, n_links, group_id) per record: its class of exact copies, the number of other classes linked to that class, and
    its group, the smallest class id reachable over links. Records of fewer than min_words words are left out."""
    members, links = similar_classes(docs, id_col, text_col, version_col, k, threshold, min_words)
    links = stage_table(links, "links")
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    comp = components(links.select("class_a", "class_b"))
    m = members.select("id", "class_id").join(ends, "class_id", "left").join(comp, F.col("class_id") == F.col("node"), "left").drop("node")
    return m.select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "class_id").alias("group_id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component. Alternating large and small stars; every round ends in a stage table."""
    a, b = edges.columns
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()  # every node to a smaller one
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = stage_table(small, "stars")
        roots = new.select("v").distinct().join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = new.groupBy("u").count().where("count > 1")
        if roots.isEmpty() and several.isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = new
