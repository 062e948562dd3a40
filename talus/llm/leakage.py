"""Evaluation texts leaking into training text: a distributed positional inverted index and phrase search from the rarest terms.

The index is document-partitioned: each row holds the postings of one block of documents (sorted terms, where each term's list starts, the
lists' positions), so it is built in one pass without a shuffle and searched in one pass without a join. A search

1. adds up how often each test term occurs in the whole index (only the terms and list starts are read for that);
2. picks in every window of ``n`` test words the rarest term: the anchors;
3. in each block shifts the anchors' posting lists by the anchors' offsets and intersects them with the lists of the terms beside, which
   leaves the alignments of test text and document that share a run of words: exact phrase matches.

Reworded or reordered leaks are found by proximity: documents in which most of a passage's rarest terms stand within a short distance.

The test side is taken in blocks of bounded size; each block is one broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from talus.llm.words import blocks, word_hashes
from talus.session import ship_package, stage_table

#: Words of test text in one broadcast (about 30 bytes each).
TEST_WORDS = 1_000_000
INDEX = "doc_ids array<{id}>, doc_ends binary, terms binary, starts binary, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all words of all texts. Rows without id are no documents; null texts have no words; extra columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b.id.to_numpy()
            rows = []
            for first, enc in blocks(b.text.to_list()):
                h, doc = word_hashes(enc)
                order = np.argsort(h, kind="stable")
                sorted_ = h[order]
                starts = np.flatnonzero(np.diff(sorted_, prepend=~sorted_[:1])) if len(h) else np.zeros(0, np.int64)
                ends = np.cumsum(np.bincount(doc, minlength=len(enc)))
                rows.append((ids[first : first + len(enc)], ends.astype(np.uint32).tobytes(), sorted_[starts].tobytes(), starts.astype(np.uint32).tobytes(), order.astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_ids", "doc_ends", "terms", "starts", "positions"])

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return stage_table(cols.mapInPandas(run, INDEX.format(id=docs.schema[id_col].dataType.simpleString())), "positional-index")


class TestSet:
    """Words of the passages of one block of test rows, end to end; passage[i] is the passage of word i, case[p] the case of passage p."""

    def __init__(self, rows: Sequence[Row]) -> None:
        texts = [t for r in rows for t in r[1:]]
        self.case = [r[0] for r in rows for _ in r[1:]]
        h, p = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, enc in blocks(texts):
            a, b = word_hashes(enc)
            h.append(a)
            p.append(b + first)
        self.words, self.passage = np.concatenate(h), np.concatenate(p)
        self.terms = np.unique(self.words)
        self.ids = np.searchsorted(self.terms, self.words)

    def anchors(self, n: int, counts: np.ndarray) -> np.ndarray:
        """Places of the rarest word of each n-word window inside one passage (ties: the first)."""
        m = len(self.words) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        inside = np.flatnonzero(self.passage[:m] == self.passage[n - 1 :])
        best, place = np.full(len(inside), np.inf), np.zeros(len(inside), np.int64)
        for i in range(n):
            c = counts[self.ids[inside + i]]
            place, best = np.where(c < best, inside + i, place), np.minimum(c, best)
        return np.unique(place[best > 0])


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences of the given sorted terms in the whole index."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for t, s, size in zip(b.terms, b.starts, b["size"], strict=True):
                t, s = np.frombuffer(t, np.uint64), np.frombuffer(s, np.uint32).astype(np.int64)
                n = np.diff(s, append=size // 4)
                at = np.searchsorted(shared.value, t)
                hit = np.flatnonzero(shared.value[np.minimum(at, len(shared.value) - 1)] == t)
                total[at[hit]] += n[hit]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        size = F.octet_length("positions").alias("size")
        for r in index.select("terms", "starts", size).mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[r.term] = r.n
    return out


def _search_block(test: TestSet, anchors: np.ndarray, n: int, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, passage, longest common run) of all alignments in one block that share n words or more."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(anchors):
        return none, none, none
    # the block's words as ids of test terms, -1 for other words
    at = np.searchsorted(test.terms, terms)
    known = test.terms[np.minimum(at, len(test.terms) - 1)] == terms
    sizes = np.diff(starts, append=len(positions))
    word = np.empty(len(positions), np.int64)
    word[positions] = np.repeat(np.where(known, at, -1), sizes)
    slot = np.searchsorted(terms, test.words[anchors])
    have = terms[np.minimum(slot, len(terms) - 1)] == test.words[anchors]
    a, slot = anchors[have], slot[have]
    count = sizes[slot]
    anchor = np.repeat(a, count)
    pos = positions[np.repeat(starts[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())].astype(np.int64)
    last_w, last_t = len(word) - 1, len(test.ids) - 1

    def same(k: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the words k places on agree; document ends are dealt with by the caller."""
        x, y = p + k, q + k
        ok = (x >= 0) & (x <= last_w) & (y >= 0) & (y <= last_t)
        x, y = np.clip(x, 0, last_w), np.clip(y, 0, last_t)
        return ok & (word[x] == test.ids[y]) & (test.passage[y] == test.passage[q])

    near = same(1, pos, anchor) | same(-1, pos, anchor)
    pos, anchor = pos[near], anchor[near]
    doc = np.searchsorted(doc_ends, pos, side="right")
    right, left = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for run, step, stop in ((right, 1, doc_ends[doc] - 1 - pos), (left, -1, pos - np.where(doc > 0, doc_ends[doc - 1], 0))):
        live, k = np.arange(len(pos)), 0
        while len(live):
            k += 1
            live = live[(stop[live] >= k) & same(step * k, pos[live], anchor[live])]
            run[live] = k
    total = left + right + 1
    hit = total >= n
    return doc[hit], test.passage[anchor[hit]], total[hit]


def _near_block(term: np.ndarray, passage: np.ndarray, bit: np.ndarray, span: np.ndarray, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, passage, most of the passage's wanted terms within its span) in one block; term holds the hashes of wanted terms, bit their places in the passage's set."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(term):
        return none, none, none
    slot = np.searchsorted(terms, term)
    have = terms[np.minimum(slot, len(terms) - 1)] == term
    slot, passage, bit = slot[have], passage[have], bit[have]
    count = np.diff(starts, append=len(positions))[slot]
    pos = positions[np.repeat(starts[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())].astype(np.int64)
    who, bits = np.repeat(passage, count), np.repeat(np.int64(1) << bit, count)
    order = np.lexsort((pos, who))
    pos, who, bits = pos[order], who[order], bits[order]
    doc = np.searchsorted(doc_ends, pos, side="right")
    seen, live, back = bits.copy(), np.arange(len(pos)), 0
    while len(live):  # gather the terms that end a window, one place further back each time
        back += 1
        live = live[live >= back]
        at = live - back
        live = live[(who[at] == who[live]) & (doc[at] == doc[live]) & (pos[live] - pos[at] < span[who[live]])]
        seen[live] |= bits[live - back]
    found = np.array([int(x).bit_count() for x in seen], np.int64) if len(seen) else none
    best = np.lexsort((-found, who, doc))
    first = best[np.flatnonzero((np.diff(doc[best], prepend=-1) != 0) | (np.diff(who[best], prepend=-1) != 0))] if len(best) else best
    return doc[first], who[first], found[first]


def near_passages(docs: DataFrame, tests: DataFrame, case_col: str, text_cols: Sequence[str], id_col: str = "doc_id", text_col: str = "text", terms: int = 10, share: float = 0.8, stretch: float = 1.5) -> DataFrame:
    """(id, case_id, terms_found, terms_asked): documents in which at least ``share`` of a test text's ``terms`` rarest distinct words stand within ``stretch`` times the text's length.

    A text of fewer distinct words is asked for by all of them. Of several texts of a case the one found best counts. Otherwise as leaked_passages.
    """
    ship_package(docs.sparkSession)
    index = build_index(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def search(rows: list[Row]) -> DataFrame:
        test = TestSet(rows)
        counts = term_counts(index, test.terms)
        asked: list[tuple[int, int, int]] = []
        span, wanted = np.zeros(len(test.case), np.int64), np.zeros(len(test.case), np.int64)
        ends = np.searchsorted(test.passage, np.arange(len(test.case) + 1))
        for p, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            ids = np.unique(test.ids[lo:hi])
            rare = ids[np.argsort(counts[ids], kind="stable")[:terms]]
            asked += [(int(test.terms[i]), p, b) for b, i in enumerate(rare)]
            span[p], wanted[p] = max(1, int((hi - lo) * stretch)), len(rare)
        term, passage, bit = (np.array(x, t) for x, t in zip(zip(*asked, strict=True) if asked else ([], [], []), (np.uint64, np.int64, np.int64), strict=True))
        shared = docs.sparkSession.sparkContext.broadcast((term, passage, bit, span, wanted, test.case))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            term, passage, bit, span, wanted, case = shared.value
            for b in batches:
                out = []
                for ids, e, t, s, p in zip(b.doc_ids, b.doc_ends, b.terms, b.starts, b.positions, strict=True):
                    arrays = (np.frombuffer(t, np.uint64), np.frombuffer(s, np.uint32).astype(np.int64), np.frombuffer(p, np.uint32), np.frombuffer(e, np.uint32).astype(np.int64))
                    doc, who, found = _near_block(term, passage, bit, span, *arrays)
                    out += [(ids[d], case[w], f, wanted[w]) for d, w, f in zip(doc, who, found, strict=True) if f >= share * wanted[w]]
                yield pd.DataFrame(out, columns=["id", "case_id", "terms_found", "terms_asked"])

        return index.mapInPandas(run, f"id {kind}, case_id string, terms_found long, terms_asked long")

    found = reduce(DataFrame.unionByName, [search(rows) for rows in test_blocks(tests, case_col, text_cols)])
    best = F.max_by(F.struct("terms_found", "terms_asked"), F.struct(F.col("terms_found") / F.col("terms_asked"), "terms_asked")).alias("b")
    return found.groupBy("id", "case_id").agg(best).select(F.col("id").alias(id_col), "case_id", "b.*")


def test_blocks(tests: DataFrame, case_col: str, text_cols: Sequence[str]) -> Iterator[list[Row]]:
    """The distinct test rows (case, texts...) in blocks of about TEST_WORDS words; at least one block, which may be empty."""
    held, words = [], 0
    cases = tests.where(F.col(case_col).isNotNull()).select(F.col(case_col).cast("string"), *[F.col(c).cast("string") for c in text_cols]).distinct()
    for r in cases.toLocalIterator():
        held.append(r)
        words += sum(len(t) // 4 for t in r[1:] if t)
        if words >= TEST_WORDS:
            yield held
            held, words = [], 0
    yield held


def leaked_passages(docs: DataFrame, tests: DataFrame, case_col: str, text_cols: Sequence[str], id_col: str = "doc_id", text_col: str = "text", n: int = 12) -> DataFrame:
    """(id, case_id, longest_run): documents that share at least n consecutive words with one text of a case, once each.

    A test text of fewer than n words cannot leak. Null texts have no words; cases without id are left out; a case given more than once has
    all its texts. Empty tables give an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    index = build_index(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def search(rows: list[Row]) -> DataFrame:
        test = TestSet(rows)
        anchors = test.anchors(n, term_counts(index, test.terms).astype(float))
        shared = spark.sparkContext.broadcast((test, anchors))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            test, anchors = shared.value
            for b in batches:
                out = []
                for ids, e, t, s, p in zip(b.doc_ids, b.doc_ends, b.terms, b.starts, b.positions, strict=True):
                    arrays = (np.frombuffer(t, np.uint64), np.frombuffer(s, np.uint32).astype(np.int64), np.frombuffer(p, np.uint32), np.frombuffer(e, np.uint32).astype(np.int64))
                    doc, passage, run_ = _search_block(test, anchors, n, *arrays)
                    out += [(ids[d], test.case[q], r) for d, q, r in zip(doc, passage, run_, strict=True)]
                yield pd.DataFrame(out, columns=["id", "case_id", "longest_run"])

        return index.mapInPandas(run, f"id {kind}, case_id string, longest_run long")

    found = reduce(DataFrame.unionByName, [search(rows) for rows in test_blocks(tests, case_col, text_cols)])
    return found.groupBy("id", "case_id").agg(F.max("longest_run").alias("longest_run")).withColumnRenamed("id", id_col)
