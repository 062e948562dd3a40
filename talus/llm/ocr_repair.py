"""Noise in text from scanned pages: page furniture, words broken at line ends, misread characters.

1. A section is a scan if its flag says it may be and its lines break inside sentences (hard-wrapped text) or its path speaks of scanned pages;
   tables, logs, lists and contents pages with the flag are none.
2. Furniture: page numbers, the section's own title as a running header, and phrases that stand alone as lines in several places, most of them at the
   edge of a page. Misread copies of such a phrase meet it over equal parts (within one or two edits at least one of its two or three parts is whole).
3. Words hyphenated at a line end are joined over blank lines and furniture; the hyphen stays if the lexicon has the word only with it.
4. Misread words: the lexicon is the word frequencies of all sections that are no scans. A symmetric-delete index (all words and queries
   with up to two letters deleted meet on equal remainders) yields candidates for words the lexicon lacks; a weighted edit distance, in which pairs of
   characters that look alike cost little, and the frequency of the two neighbouring word pairs pick the repair.

The index is a join of two tables of distinct words, so neither the lexicon nor the misread words need fit anywhere.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.session import ship_package, stage_table

#: Occurrences in clean sections that make a word known; places in which a line that stands alone is furniture, and the share of them at the edge of a page.
KNOWN, REPEATED, EDGE_SHARE = 2, 3, 0.5
#: Characters of a line that may be furniture; share of a scan's text that may stand in lines which are longer.
LINE_CHARS, LONG_SHARE = 120, 0.15
COST, DELETES = 0.3, 2
#: Share of all words that makes a word frequent: at most 1 / FREQUENT_SHARE words are. Buckets of the word pair counts, and slices in which they are added up.
FREQUENT_SHARE, PAIR_BUCKETS, PAIR_SLICES = 2e-6, 1 << 20, 64
# Characters and groups that are mistaken for one another, as (read, meant).
CONFUSIONS = [
    ("0", "o"), ("o", "0"), ("1", "l"), ("l", "1"), ("1", "i"), ("l", "i"), ("i", "l"), ("|", "l"), ("!", "i"), ("5", "s"), ("s", "5"), ("$", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("q", "g"), ("+", "t"), ("7", "t"),
    ("c", "e"), ("e", "c"), ("o", "c"), ("h", "b"), ("b", "h"), ("f", "t"), ("t", "f"), ("u", "v"), ("v", "u"), ("a", "o"), ("2", "z"), ("z", "2"), ("4", "a"), ("3", "e"), ("@", "a"), ("(", "c"), ("n", "h"), ("u", "n"), ("n", "u"),
    ("rn", "m"), ("m", "rn"), ("nn", "m"), ("in", "m"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("ri", "n"), ("n", "ri"), ("tl", "d"), ("ol", "d"), ("lc", "k"), ("fi", "h"), ("j", "i"), ("ij", "y"), ("lo", "b"),
    ("h", "n"), ("l", "t"), ("t", "l"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("m", "nn"), ("w", "vv"), ("y", "v"), ("v", "y"), ("k", "lc"), ("9", "b"), ("9", "l"), ("r", "n"), ("im", "nn"), ("h", "li"), ("t", "li"),
]
_PAIRS: dict[tuple[str, str], float] = {p: COST for p in CONFUSIONS}
_STRIP = ".,;:()\"'!?[]{}<>“”‘’«»"
_CODE = re.compile(r"[/\\_@=#~]|\w\.\w|^[A-Z]{2,}-[A-Z0-9-]+$|^[\d.,:;%+-]+$|^v?\d+(?:[.,:]\d+)*$|https?:")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LIST = re.compile(r"^\s*(?:[-*•‣]\s|\d{1,3}[.)]\s|\|)")
_LOG = re.compile(r"^\s*\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
_SCANNED = re.compile(r"\bscan(?:s|ned)?\b", re.I)
#: Hyphens at a line end: hyphen-minus, hyphen, soft hyphen, not sign.
_HYPHEN = "[-\u2010\u2011\u00ad\u00ac]"
_END = re.compile(r"[.!?:;|。！？]['\")\]]*\s*$")
_ROMAN = r"(?:[ivxlcdm]{1,9}|[IVXLCDM]{1,9})"
_NUMBER = re.compile(rf"^[\s\f]*(?:[-–—\[(|]\s*)?(?:(?:p|pg|page|seite|página|pág|s)\.?\s*)?(?:\d{{1,4}}|{_ROMAN})(?:\s*(?:of|/|von|de)\s*\d{{1,4}})?\s*(?:[-–—\])|])?\s*$", re.I)
_BESIDE = re.compile(rf"^(?:\d{{1,4}}|{_ROMAN})\s{{2,}}|\s{{2,}}(?:\d{{1,4}}|{_ROMAN})$")
_SKELETON = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h")]
_CLASSES = str.maketrans("015$89+6icq|!", "ols" + "sbgtblegl" + "l")


def lines_of(content: str) -> list[str]:
    return content.split("\n")


def is_scan(content: str, section_path: str | None = None, width: int = LINE_CHARS, share: float = 0.03) -> bool:
    """Whether lines of at most ``width`` characters break inside sentences in a share of the places where one text line follows another.

    Only LONG_SHARE of the text may stand in longer lines. Log and table lines break nowhere. Narrow lines also make a scan where the section's path speaks of
    scanned pages: short lists may have no line that breaks.
    """
    lines = lines_of(content)
    if sum(len(x) for x in lines if len(x) > width) > LONG_SHARE * len(content):
        return False
    if section_path and _SCANNED.search(section_path):
        return bool(content.strip())
    broken = follow = 0
    for a, b in zip(lines, lines[1:], strict=False):
        if a.strip() and b.strip():
            follow += 1
            broken += not _END.search(a) and not _LIST.match(b) and not _LOG.match(b) and "|" not in a and bool(re.search(r"[^\W\d_]", a))
    return broken > 0 and broken >= share * follow


@lru_cache(maxsize=200_000)
def skeleton(text: str) -> str:
    """Lower case with look-alike characters folded and digit runs as #: equal for most misreadings of one phrase."""
    s = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    s = re.sub(r"(?<![^\W\d_])\d+(?:\.\d+)*(?![^\W\d_])", "#", s)
    for a, b in _SKELETON:
        s = s.replace(a, b)
    return re.sub(r"\s+", " ", s.translate(_CLASSES)).strip()


def core(line: str) -> str:
    """The line without form feed and without a page number that stands apart at one end."""
    s = line.replace("\f", "").strip()
    return _BESIDE.sub("", s, count=1).strip()


def text_width(lines: list[str]) -> int:
    return max((len(x.rstrip()) for x in lines), default=0)


def stands_alone(lines: list[str], i: int, width: int, strict: bool = False) -> bool:
    """Line i ends no sentence, and the first words of the next lines would have fitted into it: it is no wrapped text."""
    line = lines[i].replace("\f", "").rstrip()
    if not line.strip() or _END.search(line) and not re.fullmatch(r"\s*Rev\..*", line) or _LIST.match(line) or re.search(_HYPHEN + "$", line):
        return False
    following = [w for x in lines[i + 1 : i + 7] if not _NUMBER.match(x) and (w := x.replace("\f", "").split())]
    # the next line may be furniture itself, so the two after it count as well
    return all(len(line) + 1 + len(w[0]) <= width for w in following[: 3 if strict else 1])


def _near(a: str, b: str, most: int) -> bool:
    """Edit distance of at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def titles_of(section_path: str | None) -> list[str]:
    """Skeletons of the headers the section's path may give: its parts, and "head /" for the words before the colon of its first part."""
    parts = [p.strip() for p in re.split(r"\s+>\s+", section_path or "") if p.strip()]
    out = [skeleton(p) for p in parts]
    if parts and ":" in parts[0]:
        out.append(skeleton(parts[0].partition(":")[0]) + " /")
    return [t for t in out if len(t) > 3]


def slashed(phrase: str) -> str:
    """Of a header "chapter / topic" the part up to the slash, else nothing."""
    return phrase[: phrase.find("/") + 1] if phrase.count(" / ") == 1 and len(phrase.split()) <= 6 else ""


def furniture(lines: list[str], section_path: str | None, known: frozenset[int] = frozenset()) -> list[bool]:
    """Which lines are page furniture; ``known`` are the lines with a phrase of the collection."""
    titles, width = titles_of(section_path), text_width(lines)
    out = []
    for i, line in enumerate(lines):
        if not line.strip() or i in known or _NUMBER.match(line):
            out.append(bool(line.strip()))
            continue
        s = skeleton(core(line)) if titles and len(line) <= LINE_CHARS else ""
        short = slashed(s)
        is_title = bool(s) and (s in titles or bool(short) and short in titles)
        if not is_title and len(s) > 3 and (_BESIDE.search(line.replace("\f", "").strip()) or stands_alone(lines, i, width)):
            is_title = any(_near(short or s, t, _edits(s)) for t in titles)
        out.append(is_title)
    return out


def _edits(phrase: str) -> int:
    """Edits within which two phrases are taken for one."""
    return 1 if len(phrase) < 12 else 2


def phrase_lines(content: str) -> list[tuple[int, str, bool, bool, bool]]:
    """(line, phrase, apart, alone, edge) of the lines that may be furniture: whether the line stands apart from the text, whether it is so clearly alone that it
    speaks for the phrase, and whether it stands at the edge of a page (the section's end, a form feed, a page number beside it or in it)."""
    lines = lines_of(content)
    width, out = text_width(lines), []
    text = [i for i, x in enumerate(lines) if x.strip()]
    for k, i in enumerate(text):
        line = lines[i]
        if len(line) > LINE_CHARS or _NUMBER.match(line) or len(s := skeleton(core(line))) < 4:
            continue
        numbered, capital = bool(_BESIDE.search(line.replace("\f", "").strip())), core(line)[:1].isupper()
        apart = numbered or stands_alone(lines, i, width)
        if not apart and not capital:
            continue
        beside = [lines[text[j]] for j in (k - 1, k + 1) if 0 <= j < len(text)]
        edge = numbered or k in (0, len(text) - 1) or "\f" in line or any("\f" in x or _NUMBER.match(x) for x in beside)
        alone = capital and stands_alone(lines, i, width, True)
        out.append((i, s, apart, alone, edge))
        if short := slashed(s):
            out.append((i, short, False, alone, edge))
    return out


def _parts(phrase: str, most: int) -> list[tuple[int, str]]:
    """The phrase in most + 1 parts of about equal length, as (start, part)."""
    cuts = [len(phrase) * i // (most + 1) for i in range(most + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _probes(phrase: str, most: int) -> set[str]:
    """Keys that every phrase within ``most`` edits has one of among its own: its length, edits, part number and a part, shifted by what edits may shift."""
    out = set()
    for n in range(max(1, len(phrase) - most), len(phrase) + most + 1):
        cuts = [n * i // (most + 1) for i in range(most + 2)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out |= {f"{n}|{most}|{i}|{phrase[x : x + b - a]}" for x in range(max(0, a - most), min(len(phrase) - (b - a), a + most) + 1)}
    return out


@lru_cache(maxsize=500_000)
def weighted_distance(read: str, meant: str) -> float:
    """Edit distance in which a confusion costs COST and a lost or gained accent as much; other edits cost 1."""
    n, m = len(read), len(meant)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = 99.0
            if i:
                best = d[i - 1][j] + 1
            if j:
                best = min(best, d[i][j - 1] + 1)
            if i and j:
                a, b = read[i - 1], meant[j - 1]
                same = 0.0 if a == b else COST if unicodedata.normalize("NFD", a)[0] == unicodedata.normalize("NFD", b)[0] else 1.0
                best = min(best, d[i - 1][j - 1] + same)
                for p in (1, 2):
                    for q in (1, 2):
                        if p <= i and q <= j and (c := _PAIRS.get((read[i - p : i], meant[j - q : j]))) is not None:
                            best = min(best, d[i - p][j - q] + c)
            d[i][j] = best
    return d[n][m]


def deletes(word: str, most: int = DELETES) -> set[str]:
    out = {word}
    ring = {word}
    for _ in range(most if len(word) > 4 else 1 if len(word) > 2 else 0):
        ring = {w[:i] + w[i + 1 :] for w in ring for i in range(len(w))}
        out |= ring
    return out


def token_core(token: str) -> tuple[int, str]:
    """Offset and text of the token without punctuation around it."""
    a = len(token) - len(token.lstrip(_STRIP))
    return a, token[a:].rstrip(_STRIP)


def text_tokens(lines: list[str], dropped: list[bool]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Words of the text lines as (line, offset, word), and the (line, next line) pairs over which a word goes on.

    A word that goes on stands once, at its first line, with the hyphen and a newline between its parts.
    """
    words: list[tuple[int, int, str]] = []
    breaks: list[tuple[int, int]] = []
    text = [i for i, x in enumerate(lines) if x.strip() and not dropped[i]]
    carried: tuple[int, int, str] | None = None
    for k, i in enumerate(text):
        found = [(m.start(), m[0]) for m in re.finditer(r"[^\s\f]+", lines[i])]
        for t, (at, token) in enumerate(found):
            if carried and t == 0:
                j, a, first = carried
                cut, word = token_core(token)
                words.append((j, a, f"{first}\n{token[: cut + len(word)]}"))
                carried = None
                continue
            if t == len(found) - 1 and k + 1 < len(text) and re.search(rf"[^\W\d_]{_HYPHEN}$", token) and re.match(r"\s*\f?\s*[^\W_]", lines[text[k + 1]]):
                part = token.lstrip(_STRIP)
                carried = (i, at + len(token) - len(part), part[:-1] + "-")
                breaks.append((i, text[k + 1]))
                continue
            a, word = token_core(token)
            if word:
                words.append((i, at + a, word))
    return words, breaks


def whole(word: str) -> str:
    """A word over two lines without the break."""
    return word.replace("-\n", "")


def checkable(word: str) -> bool:
    w = whole(word)
    return len(w) > 1 and bool(re.search(r"[^\W\d_]", w)) and not _CODE.search(w) and not re.fullmatch(r"\d+[A-Za-z]{0,2}", w)


def scans_of(sections: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Scans, one row (section_id, section_path, content) each, and the word counts (word, n) of all other sections."""
    cols = sections.select(F.col("section_id").cast("string").alias("section_id"), F.col("section_path").cast("string").alias("section_path"), F.col("content").cast("string").alias("content"), F.col("ingest_ts").cast("timestamp").alias("v"), F.coalesce(F.col(flag), F.lit(False)).alias("flag"))
    cols = cols.where(F.col("content").isNotNull())

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[np.array([bool(f) and is_scan(c, p) for f, c, p in zip(b.flag, b.content, b.section_path, strict=True)], bool)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter[str] = Counter()
            for f, c, p in zip(b.flag, b.content, b.section_path, strict=True):
                if not (f and is_scan(c, p)):
                    n.update(_WORD.findall(c.lower()))
            yield pd.DataFrame(list(n.items()), columns=["word", "n"])

    scans = cols.where("flag and section_id is not null").mapInPandas(pick, cols.schema)
    last = scans.groupBy("section_id").agg(F.max_by(F.struct("section_path", "content"), F.struct("v", "content")).alias("s")).select("section_id", "s.*")
    counts = cols.select("content", "flag", "section_path").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stage_table(last, "scans"), stage_table(counts.where(F.col("n") >= KNOWN), "lexicon")


def mark_furniture(scans: DataFrame) -> DataFrame:
    """The scans with ``known``: the numbers of the lines that hold a furniture phrase of the collection, exactly or misread.

    A phrase is furniture if it stands clearly alone in REPEATED places or more, in one scan or in many, and a share of EDGE_SHARE of them is at the edge of a page:
    nothing in it depends on the number of scans. All steps are joins over lines and phrases, so neither need fit anywhere.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, *x) for key, c in zip(b.section_id, b.content, strict=True) for x in phrase_lines(c)]
            yield pd.DataFrame(rows, columns=["section_id", "line_no", "phrase", "apart", "alone", "edge"])

    def keyed(probes: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if probes:
                    pairs = [(p, k) for p in b.phrase for k in _probes(p, _edits(p))]
                else:
                    pairs = [(p, f"{len(p)}|{most}|{i}|{part}") for p in b.phrase for most in (1, 2) for i, (_, part) in enumerate(_parts(p, most))]
                yield pd.DataFrame(pairs, columns=["phrase", "key"])

        return run

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[_near(x, y, _edits(x)) for x, y in zip(b.phrase, b.other, strict=True)], ["phrase"]]

    lines = stage_table(scans.select("section_id", "content").mapInPandas(run, "section_id string, line_no int, phrase string, apart boolean, alone boolean, edge boolean"), "phrase-lines")
    counted = lines.where("alone").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("edges"))
    phrases = stage_table(counted.where((F.col("n") >= REPEATED) & (F.col("edges") >= EDGE_SHARE * F.col("n"))).select("phrase"), "phrases")
    others = lines.where("apart").select("phrase").distinct().join(phrases, "phrase", "left_anti").mapInPandas(keyed(True), "phrase string, key string")
    index = phrases.mapInPandas(keyed(False), "phrase string, key string").withColumnRenamed("phrase", "other")
    misread = others.join(index, "key").select("phrase", "other").distinct().mapInPandas(check, "phrase string").distinct()
    hits = lines.join(phrases, "phrase", "left_semi").select("section_id", "line_no").unionByName(lines.where("apart").join(misread, "phrase", "left_semi").select("section_id", "line_no"))
    known = hits.groupBy("section_id").agg(F.collect_set("line_no").alias("known"))
    return stage_table(scans.join(known, "section_id", "left"), "marked-scans")


def frequent_words(lexicon: DataFrame) -> frozenset[str]:
    """Words of at least FREQUENT_SHARE of all counted words: at most 1 / FREQUENT_SHARE words, whatever the lexicon's size."""
    n = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return frozenset(r.word for r in lexicon.where(F.col("n") >= max(KNOWN, FREQUENT_SHARE * n)).select("word").collect())


def _pair(a: str, b: str) -> int:
    return zlib.crc32(f"{a} {b}".encode("utf-8", "replace")) % PAIR_BUCKETS


def line_set(known: object) -> frozenset[int]:
    return frozenset() if known is None else frozenset(int(i) for i in known)


def findings(scans: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """All that one pass over the marked scans can tell: page furniture, broken words (with the line they go on in), words that are not frequent (with
    their neighbours), and each partition's counts of hashed word pairs, in slices."""
    shared = scans.sparkSession.sparkContext.broadcast(frequent)

    def known(w: str) -> bool:
        return w in shared.value or ("-" in w and all(p in shared.value for p in w.split("-")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(PAIR_BUCKETS, np.int32)
        columns = ["kind", "section_id", "line_no", "next_line", "at", "word", "low", "hyphened", "before", "after", "slice", "counts"]
        for b in batches:
            rows: list[tuple] = []
            for key, path, c, marks in zip(b.section_id, b.section_path, b.content, b.known, strict=True):
                lines = lines_of(c)
                f = furniture(lines, path, line_set(marks))
                words, breaks = text_tokens(lines, f)
                onto = dict(breaks)
                rows += [("furniture", key, i, *[None] * 9) for i, x in enumerate(f) if x]
                lows = [whole(w).lower() for _, _, w in words]
                for k, (i, at, w) in enumerate(words):
                    broken = "\n" in w
                    low, hyphened = lows[k], w.replace("\n", "").lower()
                    if broken:
                        rows.append(("break", key, i, onto.get(i), at, w, low, hyphened, None, None, None, None))
                    if not known(low) and not (broken and known(hyphened)) and checkable(w):
                        rows.append(("word", key, i, onto.get(i) if broken else None, at, w, low, hyphened, lows[k - 1] if k else None, lows[k + 1] if k + 1 < len(lows) else None, None, None))
                if lows:
                    np.add.at(pairs, [_pair(x, y) for x, y in zip(lows, lows[1:], strict=False)], 1)
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in ("line_no", "next_line", "at", "slice")})
        tail = [("pairs", *[None] * 9, k, x.tobytes()) for k, x in enumerate(np.split(pairs, PAIR_SLICES)) if x.any()]
        yield pd.DataFrame(tail, columns=columns).astype({c: "Int32" for c in ("line_no", "next_line", "at", "slice")})

    schema = "kind string, section_id string, line_no int, next_line int, at int, word string, low string, hyphened string, before string, after string, slice int, counts binary"
    return stage_table(scans.mapInPandas(run, schema), "findings")


def pair_counts(found: DataFrame) -> np.ndarray:
    """Counts of hashed word pairs in all scans: a table of fixed size."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in part.counts)
        return pd.DataFrame({"slice": [part["slice"].iloc[0]], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    out = np.zeros((PAIR_SLICES, PAIR_BUCKETS // PAIR_SLICES), np.int32)
    for r in found.where("kind = 'pairs'").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def corrections(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(section_id, line_no, next_line, word, at, repaired) for the misread ones among the findings' words."""
    words = found.where("kind = 'word'").select("section_id", "line_no", "next_line", "at", "word", "low", "hyphened", "before", "after")
    distinct = words.select("low", "hyphened").distinct()
    # a word with the line's hyphen is known with or without it, and a compound by its parts
    plain = lexicon.select(F.col("word").alias("low"))
    asked = distinct.join(plain, "low", "left_anti").join(lexicon.select(F.col("word").alias("hyphened")), "hyphened", "left_anti").select("low").distinct()
    piece = asked.where(F.col("low").contains("-")).select("low", F.explode(F.split("low", "-")).alias("p")).distinct()
    bad = piece.join(lexicon.select(F.col("word").alias("p")), "p", "left_anti").select("low").distinct()
    asked = stage_table(asked.where(~F.col("low").contains("-")).unionByName(bad).where(F.length("low").between(2, 40)), "unknown")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(w, n, d) for w, n in zip(b.word, b.n, strict=True) for d in deletes(w)]
            yield pd.DataFrame(pairs, columns=["word", "n", "rest"])

    index = lexicon.where(F.length("word").between(2, 40)).mapInPandas(spread, "word string, n long, rest string")
    query = asked.select(F.col("low").alias("word"), F.lit(0).cast("long").alias("n")).mapInPandas(spread, "word string, n long, rest string").select(F.col("word").alias("low"), "rest")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cost = [weighted_distance(r, w) for r, w in zip(b.low, b.word, strict=True)]
            out = pd.DataFrame({"low": b.low, "word": b.word, "n": b.n, "cost": cost})
            yield out[out.cost <= out.low.str.len().map(lambda k: 0.35 if k < 4 else 0.65 if k < 6 else 0.95)]

    pairs = query.join(index, "rest").select("low", "word", "n").distinct().mapInPandas(score, "low string, word string, n long, cost double")
    repairs = pairs.groupBy("low").agg(F.collect_list(F.struct("word", "n", "cost")).alias("candidates"))
    shared = found.sparkSession.sparkContext.broadcast(pair_counts(found))

    @F.pandas_udf("string")
    def choose(low: pd.Series, before: pd.Series, after: pd.Series, candidates: pd.Series) -> pd.Series:
        count = lambda a, b: np.log1p(shared.value[_pair(a, b)]) if a and b else 0.0
        weight = lambda c, a, b: 8 * c["cost"] - count(a, c["word"]) - count(c["word"], b) - 0.2 * np.log(c["n"])
        return pd.Series([min(cs, key=lambda c: (weight(c, a, b), c["word"]))["word"] if len(cs) > 1 else cs[0]["word"] for a, b, cs in zip(before, after, candidates, strict=True)], dtype=object)

    return words.join(repairs, "low").select("section_id", "line_no", "next_line", "at", "word", choose("low", "before", "after", "candidates").alias("repaired"))


def analyse(sections: DataFrame, flag: str = "parser_capability.supports_ocr_fallback") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Marked scans, findings, corrections and lexicon of a table of sections."""
    ship_package(sections.sparkSession)
    scans, lexicon = scans_of(sections, flag)
    scans = mark_furniture(scans)
    found = findings(scans, frequent_words(lexicon))
    return scans, found, corrections(found, lexicon), lexicon


def found_noise(sections: DataFrame, flag: str = "parser_capability.supports_ocr_fallback") -> DataFrame:
    """(section_id, line_no, noise_kind): page_furniture, broken_word and misread lines of all scans, one row per line and kind."""
    _, found, fixes, _ = analyse(sections, flag)
    kind = F.when(F.col("kind") == "furniture", "page_furniture").otherwise("broken_word")
    plain = found.where("kind in ('furniture', 'break')").select("section_id", F.col("line_no").cast("long").alias("line_no"), kind.alias("noise_kind"))

    def where(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [wrong_lines(i, None if pd.isna(n) else n, w, r) for i, n, w, r in zip(b.line_no, b.next_line, b.word, b.repaired, strict=True)]
            yield pd.DataFrame([(key, i) for key, ls in zip(b.section_id, at, strict=True) for i in ls], columns=["section_id", "line_no"])

    misread = fixes.mapInPandas(where, "section_id string, line_no long").distinct().withColumn("noise_kind", F.lit("misread"))
    return plain.unionByName(misread)


def wrong_lines(line: int, following: float | None, word: str, repaired: str) -> list[int]:
    """Of a word over two lines, the lines on which its wrong characters stand."""
    if "\n" not in word:
        return [line]
    first, second = word.split("-\n")[0].lower(), word.split("-\n")[1].lower()
    rep = repaired.replace("-", "")
    best = min(range(len(rep) + 1), key=lambda k: (weighted_distance(first, rep[:k]) + weighted_distance(second, rep[k:]), abs(k - len(first))))
    out = [line] if weighted_distance(first, rep[:best]) > 0 else []
    return out + ([int(following)] if following is not None and weighted_distance(second, rep[best:]) > 0 else [])


def cased(read: str, repaired: str) -> str:
    """The repaired word in the case of the word that was read."""
    letters = [c for c in read if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return repaired.upper()
    return repaired[:1].upper() + repaired[1:] if read[:1].isupper() else repaired


def repair_text(content: str, section_path: str | None, known: frozenset[int], fixes: dict[tuple[int, int], str], joined: dict[str, str]) -> str:
    """Continuous paragraphs, a blank line between them; list items keep their lines.

    known: lines with a furniture phrase; fixes: repaired words by (line, offset); joined: for words over two lines, in lower case without break, the spelling to use.
    """
    lines = lines_of(content)
    drop = furniture(lines, section_path, known)
    words, breaks = text_tokens(lines, drop)
    by_line: dict[int, list[tuple[int, str]]] = {}
    for i, at, w in words:
        by_line.setdefault(i, []).append((at, w))
    onto = dict(breaks)
    skip = {j: next((w for _, w in reversed(by_line.get(i, [])) if "\n" in w), "") for i, j in breaks}
    out: list[str] = []
    paragraphs: list[list[str]] = []
    gap_from_furniture = blank = in_list = False
    last_text = ""
    width = text_width([x for x, d in zip(lines, drop, strict=True) if not d])
    for i, line in enumerate(lines):
        if drop[i]:
            gap_from_furniture = True
            continue
        if not line.strip():
            blank = True
            continue
        s = line.replace("\f", "")
        if blank and out and (not gap_from_furniture or (_END.search(last_text) and (_LIST.match(s) and not in_list or not _LIST.match(s) and len(last_text.rstrip()) + 1 + len(s.split()[0]) <= width))):
            paragraphs.append(out)
            out = []
        shift = line.index("\f") if "\f" in line else None
        pieces, at = [], 0
        if i in skip:
            tail = skip[i].split("\n")[1]
            k = s.find(tail)
            at = k + len(tail) if k >= 0 else 0
        for a, w in by_line.get(i, []):
            b = a - 1 if shift is not None and a > shift else a
            if b < at:
                continue
            if "\n" in w:
                first, second = w.split("-\n")
                new = fixes.get((i, a)) or joined.get(whole(w).lower()) or f"{first}{second}".lower()
                pieces += [s[at:b], cased(first, new)]
                rest = lines[onto[i]].replace("\f", "")
                k = rest.find(second)
                end = rest[k + len(second) :].split(None, 1)
                pieces.append("" if not rest[k + len(second) :] or rest[k + len(second)].isspace() else end[0] if end else "")
                at = len(s)
                break
            new = fixes.get((i, a))
            if new:
                pieces += [s[at:b], cased(w, new)]
                at = b + len(w)
        text = "".join([*pieces, s[at:]]) if at < len(s) or pieces else s[at:]
        if i in skip:
            text = re.sub(r"^[^\s]*", "", text, count=1) if text and not text[0].isspace() else text
        text = text.strip()
        in_list = bool(_LIST.match(s)) or (in_list and bool(out))
        if _LIST.match(s) and out:
            out.append("\n")
        if text:
            out.append(text)
        last_text, gap_from_furniture, blank = s, False, False
    if out:
        paragraphs.append(out)
    return "\n\n".join(re.sub(r" ?\n ?", "\n", " ".join(p)).strip() for p in paragraphs if p)


def repaired_sections(sections: DataFrame, flag: str = "parser_capability.supports_ocr_fallback") -> DataFrame:
    """(section_id, clean_content) of every scan. Null contents and sections that are no scans have no row; a section delivered again counts once, as its last version."""
    scans, found, fixes, lexicon = analyse(sections, flag)
    halves_ = found.where("kind = 'break'").select("section_id", "low", "hyphened")
    known = lexicon.select(F.col("word").alias("low"), F.lit(True).alias("plain"))
    kept = halves_.join(known, "low", "left").where("plain is null").join(lexicon.select(F.col("word").alias("hyphened")), "hyphened", "left_semi")
    spelled = kept.groupBy("section_id").agg(F.map_from_entries(F.collect_set(F.struct("low", "hyphened"))).alias("joined"))
    fixed = fixes.groupBy("section_id").agg(F.collect_list(F.struct("line_no", "at", "repaired")).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            clean = [
                repair_text(c, path, line_set(marks), {} if f is None else {(x["line_no"], x["at"]): x["repaired"] for x in f}, dict(j or {}))
                for path, c, marks, f, j in zip(b.section_path, b.content, b.known, b.fixes, b.joined, strict=True)
            ]
            yield pd.DataFrame({"section_id": b.section_id, "clean_content": clean})

    return scans.join(fixed, "section_id", "left").join(spelled, "section_id", "left").mapInPandas(run, "section_id string, clean_content string")
