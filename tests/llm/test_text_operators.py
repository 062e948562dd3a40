"""Splitting, packing, leakage, reading level and their edges."""

import datetime as dt
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talus.llm import leakage, packing, reading_level, splitting

# --- splitting


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n。é́", max_size=600))
def test_pieces_cover_the_text(text):
    ps = splitting.pieces(text, 60, 10)
    assert ps[0][0] == 0 and ps[-1][1] == len(text) and all(0 <= e - s <= 60 for s, e, _ in ps)
    assert all(b[0] == a[1] - 10 for a, b in zip(ps, ps[1:]))


def test_cut_at_the_topic_change():
    one, two = "The red engine pulls carriages. The engine burns coal. Carriages follow the engine. ", "Bakers knead dough early. Dough rises before bakers sleep. Ovens bake dough. "
    ps = splitting.pieces(one * 2 + two * 2, 260, 20)
    assert ps[0][1] == len(one * 2)


def test_split_table(spark):
    schema = "chunk_id string, content string, span_start bigint, heading_path array<string>, ingest_ts timestamp, piece string, id string"
    long = "# Intro\n" + "word " * 400 + "\n\n## Part\n" + "more. " * 300
    rows = [("a", long, 100, ["H"], dt.datetime(2026, 1, 2)), ("a", "short now", 0, ["H"], dt.datetime(2026, 1, 1)), ("b", "x" * 1201, None, None, None), ("c", "é" * 1200, 0, [], None), ("d", None, 0, None, None), ("e", "", 0, None, None), (None, long, 0, None, None), ("f", "中" * 5000, 7, [None, "x"], None)]
    got = splitting.split_oversized(spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {"a", "b", "f"} and all(len(r.piece) <= 1200 for r in got)
    a = [r for r in got if r.chunk_id == "a"]
    text = a[0].piece + "".join(r.piece[120:] for r in a[1:])
    assert text == long and all(long[r.span_start - 100 : r.span_end - 100] == r.piece for r in a)
    assert a[0].heading_path == ["H", "Intro"] and a[-1].heading_path == ["H", "Intro", "Part"]
    assert all(r.span_start is None for r in got if r.chunk_id == "b")
    assert splitting.split_oversized(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(spark.createDataFrame([], schema), limit=200, overlap=100)


# --- packing


def brute_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, left in enumerate(bins) if left >= s]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    return sorted(capacity - left for left in bins)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=80), st.just(30))
def test_rules_are_best_fit_decreasing(sizes, capacity):
    n = [(s, sizes.count(s)) for s in set(sizes)]
    rules, bins = packing.pack_sizes(n, capacity)
    filled = [0] * bins
    left = dict(n)
    for i, (s, first, at, each) in enumerate(sorted(rules)):
        following = [r[1] for r in rules if r[0] == s and r[1] > first]
        for k in range((min(following) if following else left[s]) - first):
            filled[at + k // each] += s
    assert sorted(filled) == brute_best_fit(sizes, capacity) and all(f <= capacity for f in filled)


def test_pack_table(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([7, 7, 7, 12, 29, 3, 0, None])) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "id int, size int"), "size", 40, ["id"]).collect()
    filled = {}
    for r in got:
        filled[r.container_id] = filled.get(r.container_id, 0) + (r.size or 0)
    assert len(got) == 900 and sorted(filled.values()) == brute_best_fit([s or 0 for _, s in rows], 40)
    assert packing.pack(spark.createDataFrame([], "id int, size int"), "size", 40, ["id"]).count() == 0
    with pytest.raises(Exception, match="size out of range"):
        packing.pack(spark.createDataFrame([(1, 41)], "id int, size int"), "size", 40, ["id"]).collect()


def test_pack_documents_round_trip(spark):
    rng = random.Random(6)
    texts = [None, "", "short", "short", "日本語テキスト" * 900, " ".join(str(rng.random()) for _ in range(700)), "é" * 3000, "a" * 20_000, "x  \n" * 2000]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, id string")
    got = packing.pack_documents(df, capacity=128).collect()
    enc = packing.encoder(packing.TOKENIZER)
    filled = {}
    for i, t in enumerate(texts):
        ps = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece_no)
        cut = [(t or "")[r.char_start : r.char_end] for r in ps]
        assert "".join(cut) == (t or "") and [len(enc.encode_ordinary(c)) for c in cut] == [r.n_tokens for r in ps]
        assert len(ps) == 1 or len(enc.encode_ordinary(t)) > 128
        for r in ps:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
    assert max(filled.values()) <= 128 and sorted(filled) == list(range(len(filled)))


def test_text_behind_a_window_of_few_tokens_is_counted(spark):
    texts = [("-" * 100 + "\n") * 3000, "-" * 300_000, ("-" * 100 + "\n") * 60 + "many short words " * 3000, "word " * 900 + "-" * 30_000 + " tail" * 500, "-" * 6000]
    got = packing.token_items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 128).collect()
    enc = packing.encoder(packing.TOKENIZER)
    for i, t in enumerate(texts):
        cut = [(t[r.char_start : r.char_end], r.n_tokens) for r in sorted((r for r in got if r.id == i), key=lambda r: r.piece_no)]
        assert "".join(c for c, _ in cut) == t and all(len(enc.encode_ordinary(c)) == n <= 128 for c, n in cut)
        assert (len(cut) == 1) == (len(enc.encode_ordinary(t)) <= 128)


# --- leakage


def test_leaks_against_brute_force(spark, texts):
    rng = random.Random(8)
    tests = [(f"t{i}", " ".join(texts[i].split()[:20]), texts[i + 20] if i % 2 else None) for i in range(12)] + [("short", "one two three", ""), ("t0", None, texts[50])]
    docs = [(i, t) for i, t in enumerate(texts)] + [(200 + i, "Intro! " + " ".join(texts[i].split()[5 : 5 + 9 + i % 6]).upper() + " " + rng.choice(texts)[:50]) for i in range(12)] + [(300, None), (301, ""), (302, " ".join(texts[3].split()) * 40), (1, texts[1])]
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    runs = {}
    for c, *ts in tests:
        for t in ts:
            w = words(t)
            for k in range(len(w) - 11):
                runs.setdefault(tuple(w[k : k + 12]), set()).add(c)
    want = {(i, c) for i, t in docs for w in [words(t)] for k in range(len(w) - 11) for c in runs.get(tuple(w[k : k + 12]), ())}
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, case_id string")
    q = spark.createDataFrame([(*t, "clash") for t in tests], "case_id string, query string, expected_answer string, doc_id string")
    got = leakage.leaked_passages(d, q, "case_id", ["query", "expected_answer"]).collect()
    assert {(r.doc_id, r.case_id) for r in got} == want and len(got) == len(want) and all(r.longest_run >= 12 for r in got)
    assert leakage.leaked_passages(d.limit(0), q, "case_id", ["query"]).count() == 0
    assert leakage.leaked_passages(d, q.limit(0), "case_id", ["query"]).count() == 0


def test_proximity_finds_reordered_passages(spark, texts):
    rng = random.Random(1)
    passage = texts[0].split()[:24]
    shuffled = passage[:]
    rng.shuffle(shuffled)
    docs = [(1, " ".join(texts[9].split()[:20] + shuffled + texts[8].split())), (2, texts[7]), (3, (" filler" * 30 + " ").join(passage)), (4, None)]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, case_id string")
    q = spark.createDataFrame([("t", " ".join(passage)), ("few", "one two"), ("none", None)], "case_id string, query string")
    got = {(r.doc_id, r.case_id): r.terms_found for r in leakage.near_passages(d, q, "case_id", ["query"]).collect()}
    assert got == {(1, "t"): 10}
    assert leakage.near_passages(d, q.limit(0), "case_id", ["query"]).count() == 0


# --- reading level


def test_short_items_are_asked_for_by_all_their_words(spark):
    d = spark.createDataFrame([(1, "first reseat the blue valve then wait"), (2, "a valve that is blue and reseat it much much much later")], "doc_id long, text string")
    q = spark.createDataFrame([("c", "reseat blue valve", None), (None, "x", "y")], "case_id string, query string, expected_answer string")
    got = [(r.doc_id, r.case_id, r.terms_found, r.terms_asked) for r in leakage.near_passages(d, q, "case_id", ["query", "expected_answer"]).collect()]
    assert got == [(1, "c", 3, 3)]


def test_levels_agree_with_held_out_ratings(spark):
    at = "/root/testdata/sf0.1"
    if not os.path.isdir(at):
        pytest.skip("no test tables here")
    docs, ratings = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/reading_rating.parquet").where("grade is not null")
    levels = reading_level.reading_levels(docs, ratings.where("doc_id % 2 = 0")).select("doc_id", "grade_score").join(ratings.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.avg("grade").alias("g")), "doc_id").toPandas()
    assert len(levels) > 100 and np.corrcoef(levels.grade_score, levels.g)[0, 1] >= 0.9


def test_levels_follow_difficulty(spark):
    rng = random.Random(2)
    easy, hard = "cat dog sun run big red sit hat bed top".split(), "jurisdiction harmonisation interoperability provisioning remediation traceability contractual heterogeneous accountability evidentiary".split()
    rows = []
    for i in range(400):
        level = i % 5
        sents = [" ".join(["the", *(rng.choice(hard if rng.random() < level / 4 else easy) for _ in range(4 + 3 * level))]) + ". " for _ in range(8)]
        rows.append((i, "".join(sents)))
    df = spark.createDataFrame([(*r, "clash") for r in rows] + [(900, None, ""), (901, "", ""), (902, "12345 !!", ""), (903, "的设备需要重新检查。" * 20, ""), (904, rows[0][1], ""), (904, rows[0][1], "")], "doc_id long, text string, grade string")
    rated = spark.createDataFrame([(i, "r", i % 5 + 1) for i in range(0, 400, 4)] + [(1, "r", None)], "doc_id long, rater string, grade int")
    got = {r.doc_id: r for r in reading_level.reading_levels(df, rated).collect()}
    held = [(i % 5 + 1, got[i].grade_score) for i in range(400) if i % 4]
    assert np.corrcoef(*zip(*held))[0, 1] > 0.9
    assert got[900].level == got[901].level == got[902].level == 0 and got[903].language == "zh" and 1 <= got[903].grade <= 5
    assert reading_level.reading_levels(df, rated).where(F.col("doc_id") == 904).count() == 2
    assert reading_level.reading_levels(df.limit(0), None).count() == 0
    assert reading_level.reading_levels(df.where("doc_id = 900"), rated.limit(0)).first().grade == 3


def test_monotone_regression():
    x, y = reading_level.monotone(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert list(y) == [1, 2.5, 4] and list(x) == [1, 2.5, 4]
