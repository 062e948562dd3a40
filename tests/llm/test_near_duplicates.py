import datetime as dt
import itertools
import re

import numpy as np
import pytest

from talus.llm import near_duplicates as N
from talus.llm.words import shingles, word_hashes

SCHEMA = "chunk_id string, content string, ingest_ts timestamp, id string, fp string, keys string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, v, "clash", "clash", None) for i, t, v in rows], SCHEMA)


def brute(rows, k, threshold, least):
    sets = {}
    for i, t in rows.items():
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= max(least, k):
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def pairs(spark, rows, k=3, threshold=0.6, least=30):
    return {tuple(r) for r in N.similar_pairs(frame(spark, rows), "chunk_id", "content", "ingest_ts", k, threshold, least).collect()}


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.6), (5, 0.8)])
def test_pairs_against_brute_force(spark, texts, k, threshold):
    rows = [(f"c{i:03}", t, None) for i, t in enumerate(texts)] + [(f"d{i}", texts[0].upper(), None) for i in range(3)]
    assert pairs(spark, rows, k, threshold) == brute({i: t for i, t, _ in rows}, k, threshold, 30)


def test_groups_are_components(spark, texts):
    rows = [(f"c{i:03}", t, None) for i, t in enumerate(texts)] + [("z", texts[5], None)]
    got = {r.id: r for r in N.similar_groups(frame(spark, rows), "chunk_id", "content", "ingest_ts", 3, 0.6, 30).collect()}
    want = brute({i: t for i, t, _ in rows}, 3, 0.6, 30)
    root = {i: i for i in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in got}
    assert got["z"].class_id == got["c005"].class_id == min(i for i, t, _ in rows if t == texts[5])


def test_last_version_counts(spark, texts):
    new, old = dt.datetime(2026, 2, 1), dt.datetime(2026, 1, 1)
    rows = [("a", texts[0], old), ("a", texts[1], new), ("b", texts[0], old), ("c", texts[1], old), ("c", texts[1], new)]
    assert pairs(spark, rows) == {("a", "c")}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [("a", None, None), ("b", "", None), ("c", "!!!", None), (None, long, None), ("d", long, None), ("e", long + " end", None), ("f", "one two", None)]
    assert pairs(spark, rows) == {("d", "e")}
    assert pairs(spark, []) == set()
    assert N.similar_groups(frame(spark, []), "chunk_id", "content", "ingest_ts").count() == 0


def test_allocation_is_cheapest():
    rng = np.random.default_rng(0)
    costs = rng.integers(1, 9, len(N.WIDTHS)).astype(float)
    got = N.allocate(costs, 0.8)
    gain = {w: -np.log1p(-(0.8**w)) for w in (3, 4)}
    assert sum(gain[N.WIDTHS[i]] for i in got) >= -np.log(N.MISS)
    best = np.inf
    for a in range(27):  # the cheapest a of width 3 and b of width 4
        for b in range(25):
            if a * gain[3] + b * gain[4] >= -np.log(N.MISS) * 1.02:
                best = min(best, np.sort(costs[:26])[:a].sum() + np.sort(costs[26:])[:b].sum())
    assert costs[got].sum() <= best
    narrow, wide = np.full(26, 1.0), np.full(24, 1.0)
    assert sum(i >= 26 for i in N.allocate(np.r_[narrow, wide], 0.6)) < 4  # small table: narrow partitions
    assert min(N.allocate(np.r_[narrow * 100, wide], 0.8)) >= 26  # narrow ones have many candidates
    with pytest.raises(ValueError):
        N.allocate(np.ones(50), 0.3)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = {r.node: r.root for r in N.components(edges).collect()}
    assert len(got) == 23 and set(got.values()) == {"n00", "x"}


def test_words_and_shingles():
    enc = [t.lower().encode() for t in ["A-b C2", "", "ü x", "a b c2"]]
    h, doc = word_hashes(enc)
    assert list(doc) == [0, 0, 0, 2, 3, 3, 3] and list(h[:3]) == list(h[4:])
    s, d = shingles(h, doc, 3)
    assert list(d) == [0, 3] and s[0] == s[1]
