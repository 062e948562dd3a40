"""Splitting oversized items at natural boundaries by lexical cohesion.

A text is taken apart into sentences and paragraphs. At every gap between two of them the words of the blocks before and after are compared;
where the similarity falls into a valley, the topic changes. Each piece ends at the deepest valley in the second half of its size window,
else at the last white space there, else (no white space at all) at the size limit. The next piece starts ``overlap`` characters earlier.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.session import ship_package

_GAP = re.compile(r"\n\s*\n\s*|(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])|\n")
_WORD = re.compile(r"\w+")
_HEADING = re.compile(r"^(#{1,6})\s+(\S.*?)\s*#*$", re.M)
#: Sentences in a block, and sentences whose similarities are computed at once.
BLOCK, STRIDE = 3, 1024


def gaps(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the sentences (offsets where a cut leaves the white space before it), and whether a paragraph ends there."""
    ends, para, last = [], [], 0
    for m in _GAP.finditer(text):
        if last < m.end() < len(text) and text[last : m.end()].strip():
            last = m.end()
            ends.append(last)
            para.append(m[0].count("\n") > 1)
    return np.array(ends, np.int64), np.array(para, bool)


def valley_depths(text: str, ends: np.ndarray) -> np.ndarray:
    """At each gap how far the similarity of the blocks beside it lies below the peaks to its left and right; 0 where it is no valley."""
    n = len(ends)
    if not n:
        return np.zeros(0)
    bounds = np.concatenate([[0], ends, [len(text)]])
    sim = np.empty(n)
    for lo in range(0, n, STRIDE):
        hi = min(n, lo + STRIDE)
        first, last = max(0, lo + 1 - BLOCK), min(n + 1, hi + BLOCK)
        number: dict[str, int] = {}
        words = [[number.setdefault(w, len(number)) for w in _WORD.findall(text[bounds[i] : bounds[i + 1]].lower()) if len(w) > 3 or not w.isascii()] for i in range(first, last)]
        bags = np.zeros((last - first + 1, max(1, len(number))), np.float32)
        for i, at in enumerate(words):
            bags[i + 1] = np.bincount(at, minlength=bags.shape[1]) if at else 0
        total = np.cumsum(bags, axis=0)
        g = np.arange(lo, hi) + 1 - first
        left = total[g] - total[np.maximum(g - BLOCK, 0)]
        right = total[np.minimum(g + BLOCK, last - first)] - total[g]
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        sim[lo:hi] = np.divide((left * right).sum(1), norm, out=np.zeros(hi - lo, np.float32), where=norm > 0)
    peak_left, peak_right = sim.copy(), sim.copy()
    for i in range(1, n):
        if sim[i - 1] >= sim[i]:
            peak_left[i] = peak_left[i - 1] if i > 1 and sim[i - 1] <= peak_left[i - 1] else sim[i - 1]
        if sim[n - i] >= sim[n - i - 1]:
            peak_right[n - i - 1] = max(peak_right[n - i], sim[n - i])
    return (peak_left - sim) + (peak_right - sim)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of each piece. Together they cover the text; neighbours share exactly ``overlap`` characters.

    kind: paragraph, sentence, space, hard or end. A hard cut does not separate a character from its combining marks where it can be avoided.
    """
    if len(text) <= limit:
        return [(0, len(text), "end")]
    ends, para = gaps(text)
    depth = valley_depths(text, ends)
    out, start = [], 0
    while len(text) - start > limit:
        lo, hi = start + max(overlap + 1, limit // 2), start + limit
        i, j = np.searchsorted(ends, lo), np.searchsorted(ends, hi, side="right")
        if j > i:
            best = i + max(range(j - i), key=lambda k: (depth[i + k], para[i + k], k))
            cut, kind = int(ends[best]), "paragraph" if para[best] else "sentence"
        else:
            cut, kind = hi, "hard"
            for k in range(hi, lo, -1):
                if text[k - 1].isspace():
                    cut, kind = k, "space"
                    break
            else:
                while cut > max(lo, hi - 8) and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f" or text[cut - 1] == "\u200d"):
                    cut -= 1
        out.append((start, cut, kind))
        start = cut - overlap
    out.append((start, len(text), "end"))
    return out


def split_oversized(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "content", limit: int = 1200, overlap: int = 120, span_col: str = "span_start", heading_col: str = "heading_path", version_col: str | None = "ingest_ts") -> DataFrame:
    """The pieces of every text longer than ``limit`` code points: (id, piece_no, n_pieces, span_start, span_end, heading_path, cut, piece).

    ``limit`` must be more than twice ``overlap``. span_start is the text's own span_start plus the piece's offset (null stays null). heading_path is the text's, continued
    by the Markdown headings inside the text that are open where the piece starts. Records delivered again count once, as their last version
    (ties: the larger text). Null and empty texts, and rows without id, have no pieces; extra columns are ignored.
    """
    ship_package(rows.sparkSession)
    if limit <= 2 * overlap or overlap < 0:
        raise ValueError("limit must be more than twice overlap")
    text = F.col(text_col).cast("string")
    long = F.when(F.char_length(text) > limit, text)
    version = F.col(version_col).cast("timestamp") if version_col else F.lit(None).cast("timestamp")
    body = F.struct(long.alias("text"), F.col(span_col).cast("long").alias("span"), F.col(heading_col).cast("array<string>").alias("heading"))
    last = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), version.alias("v"), body.alias("b"))
    last = last.groupBy("id").agg(F.max_by("b", F.struct("v", F.col("b.text"))).alias("b")).select("id", "b.*").where(F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, t, span, heading in zip(b.id, b.text, b.span, b.heading, strict=True):
                path = None if heading is None else [None if h is None else str(h) for h in heading]
                inside = [(m.start(), len(m[1]), m[2]) for m in _HEADING.finditer(t)]
                ps, open_, passed = pieces(t, limit, overlap), [], 0
                for k, (s, e, kind) in enumerate(ps):
                    while passed < len(inside) and inside[passed][0] <= s:  # pieces and headings both go forward
                        _, level, name = inside[passed]
                        open_ = [x for x in open_ if x[0] < level] + [(level, name)]
                        passed += 1
                    here = path if not open_ else [*(path or []), *(n for _, n in open_)]
                    base = None if pd.isna(span) else int(span)
                    rows.append((key, k, len(ps), None if base is None else base + s, None if base is None else base + e, here, kind, t[s:e]))
            out = pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "span_start", "span_end", "heading_path", "cut", "piece"])
            yield out.astype({"span_start": "Int64", "span_end": "Int64"})

    schema = "id string, piece_no int, n_pieces int, span_start long, span_end long, heading_path array<string>, cut string, piece string"
    return last.mapInPandas(run, schema).withColumnRenamed("id", id_col)
