"""Text, identifier and vector functions; native columns wherever the result can be expressed, Arrow UDFs otherwise."""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of error codes and identifiers, terms of firmware questions, English stop words.
ERROR_CODE = r"\b[A-Z]{2,}-[A-Z0-9-]+\b"
IDENTIFIER = r"\b[A-Z]+-\d{3,}(?:-[A-Z0-9]+)?\b"
FIRMWARE_TERMS = ("firmware", "upgrade", "rollback", "recovery", "boot")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "which", "will", "with")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_id(prefix: str, parts: Sequence[str | Column], length: int = 24) -> Column:
    """prefix-<first hex digits of the sha256 of the parts joined by |>; a null part reads None."""
    text = F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, length))


def normal_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def lexical_terms(c: str | Column) -> Column:
    """Error codes, identifiers and firmware terms of a query, sorted and distinct."""
    t = _col(c)
    firm = F.array_compact(F.array(*[F.when(F.contains(F.lower(t), F.lit(w)), w) for w in FIRMWARE_TERMS]))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(ERROR_CODE), F.lit(0)), F.regexp_extract_all(t, F.lit(IDENTIFIER), F.lit(0)), firm)))


def tokens(c: str | Column) -> Column:
    """Latin words, CJK characters and CJK bigrams."""
    low = F.lower(_col(c))
    cjk = F.regexp_extract_all(low, F.lit(r"[一-鿿]"), F.lit(0))
    n = F.greatest(F.size(cjk) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(cjk, F.lit(1), n), F.slice(cjk, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), cjk, pairs)


def iso_time(c: str | Column) -> Column:
    """ISO 8601 text as a timestamp: Z and offsets are kept, text without zone means UTC (the session's zone), anything else is null."""
    t = F.trim(_col(c))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), t.try_cast("timestamp"))


def day_window(day: str | Column) -> tuple[Column, Column]:
    """First and last microsecond of a day."""
    first = F.date_trunc("day", _col(day).cast("timestamp"))
    return first, first + F.expr("interval 1 day") - F.expr("interval 1 microsecond")


def all_terms_in(query: str, *columns: str) -> Column:
    """Whether every word of the query stands somewhere in the columns' joined text, whatever the case; an empty query holds everywhere."""
    text = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(True)
    for w in query.lower().split():
        out = out & F.contains(text, F.lit(w))
    return out


def words(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def token_estimate(c: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(_col(c)) / 4)).cast("int")


def keyword_coverage(text: str | Column, keywords: str | Column) -> Column:
    """Share of the keywords that the text contains, whatever the case; 1 without keywords."""
    low, kw = F.lower(F.coalesce(_col(text), F.lit(""))), _col(keywords)
    hits = F.size(F.filter(kw, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.coalesce(F.size(kw), F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.round(hits / F.size(kw), 6))


def heading_path(c: str | Column) -> Column:
    return F.filter(F.split(_col(c), r"\s*/\s*| > "), lambda x: x != "")


def context_prefix(title: str, path: str, most: int = 240) -> Column:
    return F.substring(F.concat_ws(" | ", F.nullif(F.col(title), F.lit("")), F.nullif(F.col(path), F.lit(""))), 1, most)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once: inside higher-order functions an expression would be evaluated again for every element."""
    return F.transform(F.array(value), use)[0]


def hash_embedding(c: str | Column, dim: int) -> Column:
    """Deterministic unit vector: blocks of sha256(text, zero byte, block number), eight big-endian 32-bit numbers each, mapped to -1..1."""
    number = lambda h, i: F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(2147483647.5) - F.lit(1.0)
    block = lambda b: F.sha2(F.concat(F.encode(_col(c), "utf-8"), F.unhex(F.lit("00")), F.encode(b.cast("string"), "utf-8")), 256)
    eight = F.sequence(F.lit(0), F.lit(7))
    numbers = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 8) - 1)), lambda b: let(block(b), lambda h: F.transform(eight, lambda i: number(h, i)))))
    return unit(F.slice(numbers, 1, dim))


def unit(v: Column) -> Column:
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return let(v, lambda a: let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    a, b = _col(a), _col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/A-Za-z][^>]*>", re.S)


def html_to_text(page: str | None, joint: str = "\n\n", least: int = 1) -> str | None:
    """What stands between the tags and comments, character references resolved, blanks around each part removed, the parts joined.

    Scripts and styles are parts like others. A page that leaves fewer than ``least`` characters stays as it is.
    """
    if page is None:
        return None
    text = joint.join(t for piece in _MARKUP.split(page) if (t := html.unescape(piece).strip()))
    return text if len(text) >= least else page


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(html_to_text)


@F.pandas_udf(T.StringType())
def canonical_json_sha256(s: pd.Series) -> pd.Series:
    """sha256 of the JSON text with sorted keys and ASCII escapes; null for text that is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True).encode()).hexdigest()
        except ValueError:
            return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def uuid5_url(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))


_VOWEL = frozenset("aeiou")


def _measure(stem: str) -> int:
    """Vowel-consonant changes of the stem."""
    kinds = []
    for i, c in enumerate(stem):
        vowel = c in _VOWEL or (c == "y" and i > 0 and kinds[-1] == "c")
        kinds.append("v" if vowel else "c")
    runs = "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)
    return runs.count("vc")


def light_stem(w: str) -> str:
    """Plural, -ed and -ing endings removed where a stem with a vowel is left; -y becomes -i. A lighter rule than the full Porter algorithm."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    for end in ("ed", "ing"):
        stem = w[: -len(end)]
        if w.endswith(end) and len(stem) > 2 and any(c in _VOWEL or c == "y" for c in stem):
            w = stem
            if w[-2:] in ("at", "bl", "iz"):
                w += "e"
            elif w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and len(w) > 2 and w[-1] not in "wxy" and w[-3] not in _VOWEL and w[-2] in _VOWEL and w[-1] not in _VOWEL:
                w += "e"
            break
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and any(c in _VOWEL for c in w[:-1]) else w
