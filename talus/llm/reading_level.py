"""Reading level of each document: a Rasch-style latent model linking document levels and word difficulties.

Whether a word occurs in a document depends on the document's level theta and the word's intercept and slope (its difficulty):
P(word | level) is proportional to exp(c + a * theta), over the words of the document's language. Levels and words are estimated in turns:

* documents: given the words, a document's posterior mean level on a grid; it needs only the sum of its words' slopes;
* words: given the levels in BINS bins, each word's counts per bin are a small regression of their own.

One turn is one pass over the documents, which keep only the numbers of their words, and one aggregation of word counts per bin; the turns end when the
words' slopes hold still. Words are hashed into SLOTS numbers per language, so what is broadcast is bounded whatever the vocabulary; two words of one number
are taken for one, which concerns few of the words that occur often enough to count. The start is the usual surface measure (longer words,
longer sentences); it also fixes which end is hard. Each language's levels are scaled to mean 0 and deviation 1. A bounded sample of human
ratings turns levels into grades by monotone regression.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.words import LETTERS, blocks, mix, word_hashes
from talus.session import ship_package, stage_table

SLOTS, BINS, TURNS = 1 << 20, 24, 8
#: The turns end when the slopes change by less than this, as a share of their size (root mean squares, words weighted by occurrences).
STILL = 0.1
#: Occurrences a word needs, the weight of the words against the prior, and the prior's weight on slopes.
LEAST, TEMPER, RIDGE = 5, 0.3, 2.0
#: Rated documents used at most (a hash sample beyond).
MAX_RATED = 20_000
GRID = np.linspace(-3.5, 3.5, 141)
EDGES = np.linspace(-2.5, 2.5, BINS - 1)
CENTRES = np.concatenate([[-2.6], (EDGES[1:] + EDGES[:-1]) / 2, [2.6]])
# Frequent words that tell languages apart.
STOPWORDS = {
    "en": "the and of to is that in for with are was this be not you it on by or from",
    "de": "der die und das ist nicht ein eine den von zu mit auf für bei sie des dem wird nach",
    "es": "el la los las de que y en un una por con para se del no es al su como",
    "fr": "le les des et est dans que une pour qui sur pas au avec du ce sont par plus vous",
}
LANGUAGES = [*STOPWORDS, "zh", "und"]
_CJK = re.compile(r"([぀-ヿ㐀-鿿가-힯])")
_PUNCTUATION = {c: " " for c in [*range(0xA0, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x2190, 0x2C00), *range(0x3000, 0x3040), *range(0xFE30, 0xFE50), *range(0xFF00, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41)]}
_STOPS = {k: np.unique(word_hashes([unicodedata.normalize("NFC", v).encode()], LETTERS)[0]) for k, v in STOPWORDS.items()}
_CJK_LEAD = np.zeros(256, bool)
_CJK_LEAD[0xE3:0xEE] = True


def plain(text: str | None) -> str:
    """Latin text as it is; punctuation of other scripts as blanks, and each CJK character a word."""
    if not isinstance(text, str):
        return ""
    if text.isascii():
        return text
    return _CJK.sub(r" \1 ", unicodedata.normalize("NFC", text)).translate(_PUNCTUATION)


def measure(texts: list[str | None]) -> pd.DataFrame:
    """Per text: language, slots of its words (each once), number of words, mean word length, log of the mean sentence length."""
    out = []
    for _, enc in blocks([plain(t) for t in texts]):
        n = len(enc)
        h, doc = word_hashes(enc, LETTERS)
        words = np.bincount(doc, minlength=n)
        hits = np.stack([np.bincount(doc[np.isin(h, s)], minlength=n) for s in _STOPS.values()])
        share = np.array([_CJK_LEAD[np.frombuffer(e, np.uint8)].sum() for e in enc]) / np.maximum(words, 1)
        language = np.where(share > 0.5, len(STOPWORDS), np.where(hits.max(0) * 20 >= words, hits.argmax(0), len(STOPWORDS) + 1))
        letters = np.array([LETTERS[np.frombuffer(e, np.uint8)].sum() for e in enc])
        ends = np.array([sum(e.count(c) for c in (b". ", b".\n", b"!", b"?", "。".encode())) + e.endswith(b".") for e in enc])
        slot = (mix(h) % np.uint64(SLOTS)).astype(np.int64) + language[doc] * SLOTS
        both = np.unique(doc * (len(LANGUAGES) * SLOTS) + slot)
        counts = np.bincount(both // (len(LANGUAGES) * SLOTS), minlength=n)
        slots = np.split((both % (len(LANGUAGES) * SLOTS)).astype(np.int32), np.cumsum(counts)[:-1])
        out.append(pd.DataFrame({"language": language.astype(np.int32), "slots": slots, "n_words": words, "word_length": letters / np.maximum(words, 1), "sentence_length": np.log1p(words / np.maximum(ends, 1))}))
    return pd.concat(out, ignore_index=True)


class Words:
    """Sorted slots with intercepts and slopes, and per language log Z(theta) on the grid."""

    def __init__(self, slots: np.ndarray, c: np.ndarray, a: np.ndarray) -> None:
        order = np.argsort(slots)
        self.slots, self.c, self.a = slots[order].astype(np.int32), c[order].astype(np.float32), a[order].astype(np.float32)
        self.log_z = np.zeros((len(LANGUAGES), len(GRID)))
        for k in range(len(LANGUAGES)):
            lo, hi = np.searchsorted(self.slots, [k * SLOTS, (k + 1) * SLOTS])
            parts = [np.logaddexp.reduce(self.c[i : min(i + 20_000, hi), None] + self.a[i : min(i + 20_000, hi), None] * GRID, axis=0) for i in range(lo, hi, 20_000)]
            if parts:
                self.log_z[k] = np.logaddexp.reduce(np.stack(parts), axis=0)

    def change(self, before: Words) -> float:
        """Root mean square change of the slopes against their size, words weighted by how often they occur."""
        _, i, j = np.intersect1d(self.slots, before.slots, assume_unique=True, return_indices=True)
        if not len(i):
            return 0.0
        w, a, b = np.exp(self.c[i].astype(float)), self.a[i].astype(float), before.a[j].astype(float)
        return float(np.sqrt((w * (a - b) ** 2).sum() / max((w * a**2).sum(), 1e-12)))

    def levels(self, slots: list[np.ndarray], language: np.ndarray) -> np.ndarray:
        """Posterior mean levels; 0, the prior's, without known words."""
        n = len(slots)
        size = np.array([len(s) for s in slots])
        flat = np.concatenate([np.asarray(s, np.int32) for s in slots]) if n else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(n), size)
        at = np.minimum(np.searchsorted(self.slots, flat), max(0, len(self.slots) - 1))
        known = self.slots[at] == flat if len(self.slots) else np.zeros(len(flat), bool)
        total = np.bincount(doc[known], self.a[at[known]], n) if known.any() else np.zeros(n)
        count = np.bincount(doc[known], minlength=n)
        out = np.zeros(n)
        for lo in range(0, n, 4096):
            s = slice(lo, lo + 4096)
            p = TEMPER * (total[s, None] * GRID - count[s, None] * self.log_z[language[s]]) - GRID**2 / 2
            p = np.exp(p - p.max(1, keepdims=True))
            out[s] = (p @ GRID) / p.sum(1)
        return out


def fit_words(counts: np.ndarray, totals: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poisson regressions counts[w, bin] ~ totals[w, bin] * exp(c + a * centres[w, bin]), with a normal prior on the slopes; Newton steps for all words at once."""
    c, a = np.log((counts.sum(1) + 0.5) / np.maximum(totals.sum(1), 1)), np.zeros(len(counts))
    for _ in range(15):
        mu = np.exp(np.clip(c[:, None] + a[:, None] * centres, -40, 40)) * totals
        g0, g1 = (counts - mu).sum(1), ((counts - mu) * centres).sum(1) - RIDGE * a
        h0, h1, h2 = mu.sum(1) + 1e-6, (mu * centres).sum(1), (mu * centres**2).sum(1) + RIDGE
        det = h0 * h2 - h1**2
        c += np.clip((h2 * g0 - h1 * g1) / det, -1, 1)
        a += np.clip((h0 * g1 - h1 * g0) / det, -1, 1)
    return c, a


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of the best non-decreasing function, to be joined by straight lines."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order], y[order], strict=True):
        pools.append([yi, 1.0, xi])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            y2, n2, x2 = pools.pop()
            y1, n1, x1 = pools[-1]
            pools[-1] = [(y1 * n1 + y2 * n2) / (n1 + n2), n1 + n2, (x1 * n1 + x2 * n2) / (n1 + n2)]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


COUNTS = "slot int, bin int, n double"
_TOTAL, _MOMENT = -1000, -2000


def _pass(docs: DataFrame, words: Words | None, scale: dict[int, tuple[float, float, float, float]]) -> DataFrame:
    """(slot, bin, n): words per level bin; slots _TOTAL - language the sums over words, slots _MOMENT - language with bins 0..2 the number, sum and squares of the levels."""
    shared = docs.sparkSession.sparkContext.broadcast((words, scale))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, scale = shared.value
        for b in batches:
            b = b[b.n_words > 0]
            if not len(b):
                continue
            language, slots = b.language.to_numpy(), b.slots.to_list()
            level = start_levels(b, scale) if words is None else words.levels(slots, language)
            bins = np.digitize(level, EDGES)
            size = np.array([len(s) for s in slots])
            key, n = np.unique(np.concatenate(slots).astype(np.int64) * BINS + np.repeat(bins, size), return_counts=True)
            frames = [pd.DataFrame({"slot": key // BINS, "bin": key % BINS, "n": n})]
            for k in np.unique(language):
                mine = language == k
                frames.append(pd.DataFrame({"slot": _TOTAL - k, "bin": np.arange(BINS), "n": np.bincount(bins[mine], size[mine], BINS)}))
                frames.append(pd.DataFrame({"slot": _MOMENT - k, "bin": np.arange(3), "n": [mine.sum(), level[mine].sum(), (level[mine] ** 2).sum()]}))
            yield pd.concat(frames).astype({"slot": np.int32, "bin": np.int32, "n": float})

    return docs.mapInPandas(run, COUNTS).groupBy("slot", "bin").agg(F.sum("n").alias("n"))


def start_levels(b: pd.DataFrame, scale: dict[int, tuple[float, float, float, float]]) -> np.ndarray:
    m = np.array([scale.get(k, (0, 1, 0, 1)) for k in b.language]).reshape(-1, 4)
    z = (b.word_length - m[:, 0]) / m[:, 1] + (b.sentence_length - m[:, 2]) / m[:, 3]
    return np.clip(z.to_numpy(float) / 1.8, -3, 3)


def _word_turn(counts: DataFrame) -> Words:
    special = counts.where("slot < 0").collect()  # at most languages * (BINS + 3) rows
    totals, moments = np.zeros((len(LANGUAGES), BINS)), np.zeros((len(LANGUAGES), 3))
    for r in special:
        if r.slot <= _MOMENT:
            moments[_MOMENT - r.slot, r.bin] = r.n
        else:
            totals[_TOTAL - r.slot, r.bin] = r.n
    n = np.maximum(moments[:, 0], 1)
    mean = moments[:, 1] / n
    spread = np.sqrt(np.maximum(moments[:, 2] / n - mean**2, 1e-4))
    centres = (CENTRES[None, :] - mean[:, None]) / spread[:, None]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        slots, row = np.unique(part["slot"].to_numpy(), return_inverse=True)
        table = np.zeros((len(slots), BINS))
        table[row, part["bin"].to_numpy()] = part["n"].to_numpy()
        keep = table.sum(1) >= LEAST
        slots, table = slots[keep], table[keep]
        c, a = np.zeros(len(slots)), np.zeros(len(slots))
        for lo in range(0, len(slots), 8192):
            s = slice(lo, lo + 8192)
            k = slots[s] // SLOTS
            c[s], a[s] = fit_words(table[s], totals[k], centres[k])
        return pd.DataFrame({"slot": slots, "c": c, "a": a})

    rows = counts.where("slot >= 0").groupBy(F.pmod("slot", F.lit(64)).alias("part")).applyInPandas(lambda key, p: fit(p), "slot int, c double, a double").toPandas()
    return Words(rows["slot"].to_numpy(), rows["c"].to_numpy(), rows["a"].to_numpy())


def reading_levels(docs: DataFrame, ratings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", turns: int = TURNS, max_rated: int = MAX_RATED) -> DataFrame:
    """(id, language, n_words, level, grade_score, grade) of every row: level is the latent difficulty, grade_score the expected rating, grade its nearest whole number from 1 to 5.

    ratings(id, grade): human ratings, null grades ignored, averaged per document; at most max_rated documents are used, a sample by hash. Without any, grade_score is
    3 + level within 1..5. A null or empty text, or one without words, has level 0. Repeated rows keep their rows; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["id"]].reset_index(drop=True), measure(b.text.to_list())], axis=1) if len(b) else b.assign(language=0, slots=None, n_words=0, word_length=0.0, sentence_length=0.0).drop(columns="text")

    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    d = stage_table(cols.mapInPandas(run, f"id {kind}, language int, slots array<int>, n_words long, word_length double, sentence_length double"), "document-words")
    stats = d.where("n_words > 0").groupBy("language").agg(*[F.coalesce(f(c), F.lit(0.0)) for c in ("word_length", "sentence_length") for f in (F.avg, F.stddev_pop)]).collect()
    scale = {r[0]: (r[1], max(r[2], 1e-6), r[3], max(r[4], 1e-6)) for r in stats}
    words: Words | None = None
    for _ in range(turns):
        before, words = words, _word_turn(stage_table(_pass(d, words, scale), "word-counts"))
        if before is not None and words.change(before) < STILL:
            break
    shared = d.sparkSession.sparkContext.broadcast(words)

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "language": [LANGUAGES[k] for k in b.language], "n_words": b.n_words, "level": np.where(b.n_words > 0, shared.value.levels(b.slots.to_list(), b.language.to_numpy()), 0.0) if len(b) else []})

    levels = stage_table(d.select("id", "language", "slots", "n_words").mapInPandas(level, f"id {kind}, language string, n_words long, level double"), "levels")
    score = F.lit(3.0) + F.col("level")
    if ratings is not None:
        mean = ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg("grade").alias("g"))
        mean = mean.orderBy(F.xxhash64("id"), "id").limit(max_rated)
        rated = levels.select("id", "level").join(mean, "id").groupBy("id").agg(F.avg("level").alias("level"), F.first("g").alias("g")).toPandas()  # at most max_rated rows
        if len(rated):
            x, y = monotone(rated.level.to_numpy(), rated.g.to_numpy(float))

            @F.pandas_udf("double")
            def graded(v: pd.Series) -> pd.Series:
                return pd.Series(np.interp(v.to_numpy(), x, y))

            score = graded("level")
    out = levels.withColumn("grade_score", F.least(F.lit(5.0), F.greatest(F.lit(1.0), score)))
    return out.withColumn("grade", F.round("grade_score").cast("int")).withColumnRenamed("id", id_col)
