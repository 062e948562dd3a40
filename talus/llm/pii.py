"""Personal information in free text: found, typed and replaced by format-preserving pseudonyms.

E-mail addresses, phone numbers, identity numbers and street addresses are found by their formats. Names need the collection: one pass counts
how many texts have each word and collects what stands where names stand (after "signed", "reported by" and the like). Words in that place
with many different words after them are given names. Words of many texts are no surnames unless a good share of their occurrences stands beside
given names or after initials, which a second pass counts. The last pass finds given name or initial with surname.

Every item is replaced by ``[TYPE value]``. The value of a phone or identity number is the number itself, permuted within its format by a
keyed Feistel network: separators, length and letter places stay, check digits and letters that were right are right again, a date of birth inside a
number becomes another date, and equal numbers get equal pseudonyms in all texts, however they are spaced. E-mails, names and addresses get a keyed tag of their normalised form, equal for equal values.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.session import ship_package, stage_table

ROUNDS = 10
#: A word of at least this share of the texts, and at least so many, is frequent. So at most (words per text) / share words are.
ORDINARY_SHARE, ORDINARY_TEXTS = 0.0005, 5
#: A frequent word is ordinary unless this share of its occurrences stands where names stand.
NAME_SHARE = 0.3
#: A frequent word is no given name if less than this share of its occurrences stands at cues.
GIVEN_SHARE = 0.1
#: A given name has at least so many different followers that may be surnames, and they are this share of its different followers.
GIVEN_FOLLOWERS, GIVEN_RATIO = 3, 0.4
#: Given names taken from the collection at most; beyond it an error is raised.
MAX_GIVEN = 200_000

# The check letters of Spanish identity numbers, street words and prefixes, phrases that names follow or precede.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
STREET_WORDS = "street lane road rise close row drive yard avenue way court place square hill terrace crescent boulevard gardens grove parade walk mews quay wharf st rd ave ln dr blvd"
STREET_ENDINGS = "gate straße strasse gasse weg allee ring platz ufer damm steig"
STREET_STARTS = "Am An Im Zum Zur"
NAME_CUES = r"signed|signed by|reported by|holder is|belongs to|spoke with|talked to|contact|regards|back to|behalf of|name is|attn|dear|met with"
SURE_CUES = r"signed|signed by|reported by|holder is|belongs to|spoke with|talked to|name is|met with"
TITLES = r"mr|mrs|ms|miss|dr|prof|herr|frau|sir|madam"

_LOCAL = r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*"
EMAIL = re.compile(_LOCAL + r"(?:@|\s*[(\[{]\s*at\s*[)\]}]\s*)(?:[\w-]+(?:\.|\s*[(\[{]\s*dot\s*[)\]}]\s*))+[A-Za-z]{2,}(?![\w@])", re.I)
SPELLED_EMAIL = re.compile(_LOCAL + r"\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+(?![\w@])", re.I)
NATIONAL_ID = re.compile(
    r"(?<![\w.+/-])(?<!\d )(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]\d{8}|\d{6}-\d{4}|\d{2} \d{3} \d{3} \d{3})(?![\w-])(?! \d)(?!\.\d)"
)
_EXT = r"(?:\s?(?:ext\.?|x)\s?\d{1,5})?"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?:(?:\+|00)\d{{1,3}}[ ./-]?(?:\(\d{{1,4}}\)[ ./-]?)?\d{{2,11}}(?:[ ./-]\d{{2,9}}){{0,4}}{_EXT}|\(\d{{2,5}}\)[ ]?\d{{3,5}}[ .-]\d{{3,5}}(?:[ .-]\d{{2,4}})?{_EXT}|\d{{3}}([.-])\d{{3}}\1\d{{4}}{_EXT}|0\d{{1,4}}[ /-]\d{{3,8}}(?:[ -]\d{{2,5}}){{0,2}}{_EXT})(?![\w@])(?!-\d)(?!\.\d)",
    re.I,
)
_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_NUM = r"\d{1,4} ?[A-Za-z]?(?![\w])"
_TYPED = rf"(?:{_CAP}[ ]){{0,3}}(?:(?i:{'|'.join(STREET_WORDS.split())})\b\.?|[A-ZÀ-ÖØ-Þ][^\W\d_]*(?i:{'|'.join(STREET_ENDINGS.split())})\b)"
_STREET = rf"(?:{_NUM}[ ](?=[A-ZÀ-ÖØ-Þ]){_TYPED}|(?:{_TYPED}|(?:{'|'.join(STREET_STARTS.split())})[ ](?:(?:der|dem)[ ])?{_CAP})[ ]{_NUM})"
_TOWN = rf"(?:\d{{4,6}}[ ])?(?:(?:Port|Bad|Saint|St\.?|New|Old|North|South|East|West|PORT|BAD|NEW)[ ])?{_CAP}"
_FLOOR = r"(?:(?i:floor|flat|apt\.?|suite|unit)[ ]\w{1,4}(?:,[ ]?|\n))?"
ADDRESS = re.compile(rf"(?<![\w-])(?:{_STREET}(?:,[ ]?|\n){_FLOOR}{_TOWN}(?:[ ]\d{{4,6}}\b)?|\d{{4,6}}[ ]{_CAP}(?:,[ ]?|\n){_STREET})")
_LETTERS = r"[^\W\d_]"
_PART = rf"{_LETTERS}{{2,}}(?:['’-]{_LETTERS}{{2,}})*"
_HEAD, _TAIL = r"(?<![\w@.+/'’-])", r"(?![\w@+/'’-]|\.\w)"
_GIVEN = re.compile(rf"{_HEAD}({_PART})(?:[ ]{_LETTERS}\.)?[ ]({_PART}){_TAIL}")
_SURNAME_FIRST = re.compile(rf"{_HEAD}({_PART}),[ ]({_PART}){_TAIL}")
_INITIAL = re.compile(rf"{_HEAD}({_LETTERS})\.(?:[ ]{_LETTERS}\.)?[ ]({_PART}){_TAIL}")
_CUE = re.compile(rf"(?i:\b(?:{NAME_CUES}):?,?|\b(?:{TITLES})\.?)[ ]+(?=(?:(?i:{TITLES})\.?[ ])?({_PART})(?:[ ]{_LETTERS}\.)?([ ]|,[ ])({_PART}){_TAIL})")
_CUED_PLACE = re.compile(rf"(?i:\b(?:{NAME_CUES}):?,?|\b(?:{TITLES})\.?)[ ]+$")
_LAST_OF_CUES = frozenset(c.split()[-1] for c in NAME_CUES.split("|") + TITLES.split("|"))
_SURE = re.compile(rf"(?:{SURE_CUES})\b", re.I)
_TITLE = re.compile(TITLES, re.I)
_TITLED = re.compile(r"\b(?i:mrs?|ms|dr|prof|herr|frau)\.?[ ]+$")
WORD = re.compile(rf"{_PART}")


@dataclass(frozen=True)
class Names:
    """What the collection tells: given names, and ordinary words."""

    given: frozenset[str] = frozenset()
    ordinary: frozenset[str] = frozenset()


@dataclass
class Item:
    kind: str
    start: int
    end: int
    text: str = field(default="")


def name_evidence(text: str, cues: list[re.Match] | None = None) -> list[tuple[str, str]]:
    """(given, follower) pairs, lower-cased, at places where names stand and in e-mail addresses (there both ways round). cues: the text's cues, if known."""
    out = []
    for m in _CUE.finditer(text) if cues is None else cues:
        a, sep, b = m[1].lower(), m[2], m[3].lower()
        out.append((b, a) if "," in sep else (a, b))
    if "@" in text:
        for m in EMAIL.finditer(text):
            parts = [p for p in re.findall(rf"{_LETTERS}{{3,}}", re.split(r"[@+(\[{\s]", m[0])[0].lower())][:2]
            out += [tuple(parts), tuple(parts[::-1])] if len(parts) == 2 else []
    return [p for p in out if not _TITLE.fullmatch(p[0])]


def sure_places(text: str, cues: list[re.Match]) -> list[str]:
    """The capitalised words, lower-cased, of pairs after phrases that only a name follows ("reported by"; not "regards", which a team may follow)."""
    return [w.lower() for m in cues if _SURE.match(text, m.start()) and {_case(m[1]), _case(m[3])} <= {"title", "upper"} for w in (m[1], m[3])]


def _case(w: str) -> str:
    return "upper" if w.isupper() else "lower" if w.islower() else "title" if w[:1].isupper() else "mixed"


def _surname(w: str, names: Names, sure: bool = False) -> bool:
    """sure: the place alone makes it a surname, however frequent the word is."""
    low = w.lower()
    if low in names.given or (len(w) < 3 and _case(w) not in ("title", "upper")):
        return False
    if sure and _case(w) in ("title", "upper"):
        return True
    return low not in names.ordinary and not any(p in names.ordinary and len(p) > 3 for p in low.split("-")[:1])


def _pairs_at(text: str, given: frozenset[str], cues: bool = False) -> Iterator[tuple[re.Match, int]]:
    """(match, group of the given name) of the name patterns, tried only where a given name, the last word of a cue (if asked for) or a middle initial says that a name may stand there.

    The consumer may send the offset from which to go on; without it the next word is tried.
    """
    words, places, before, end = [], [], "", 0
    for w in WORD.finditer(text):
        a, b = w.span()
        low = w[0].lower()
        words.append((a, b))
        if text[b : b + 1] == " " and (low in given or (cues and before in _LAST_OF_CUES and not text[end:a].strip(" :,.")) or text[b + 2 : b + 4] == ". "):
            places.append((a, b))
        before, end = low, b
    at = 0
    for a, b in places:
        if a >= at and (m := _GIVEN.match(text, a)):
            at = (yield m, 1) or b
    at = 0
    for a, b in words if ", " in text else ():
        if a >= at and text[b : b + 2] == ", " and (m := _SURNAME_FIRST.match(text, a)):
            at = (yield m, 2) or b


def name_places(text: str, given: frozenset[str] = frozenset(), cues: list[re.Match] | None = None) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Spans of the words at cues and titles (those of ``cues``), and of those beside given names or after initials."""
    cued = {s for m in cues or () for s in (m.span(1), m.span(3))}
    beside = {m.span(2) for m in _INITIAL.finditer(text) if m[1].isupper() and _case(m[2]) in ("title", "upper")}
    if given:
        for m, given_at in _pairs_at(text, given):
            x, y = _case(m[given_at]), _case(m[3 - given_at])
            if m[given_at].lower() in given and (x == y or given_at == 2 and y == "upper") and (given_at == 1 or y != "lower"):
                beside.add(m.span(3 - given_at))
    return cued, beside


def find_names(text: str, names: Names) -> Iterator[Item]:
    walk = _pairs_at(text, names.given, True)
    found = next(walk, None)
    while found:
        m, given_at = found
        given, surname = m[given_at], m[3 - given_at]
        known = given.lower() in names.given
        fit = _case(given) == _case(surname) or (given_at == 2 and _case(surname) == "upper")
        head = text[max(0, m.start() - 24) : m.start()]
        cued, titled, initial = bool(_CUED_PLACE.search(head)), bool(_TITLED.search(head)), given_at == 1 and ". " in m[0]
        past = None
        if fit and (known or _case(given) in ("title", "upper")) and _surname(surname, names, titled or (known and (cued or initial))):
            new = (cued or initial) and _case(given) in ("title", "upper") and (titled or given.lower() not in names.ordinary) and not _TITLE.fullmatch(given)
            if (known or new) and (given_at == 1 or _case(surname) != "lower" or cued):
                yield Item("person", m.start(), m.end())
                past = m.end()
        try:
            found = walk.send(past)
        except StopIteration:
            found = None
    for m in _INITIAL.finditer(text):
        cued = bool(_CUED_PLACE.search(text[max(0, m.start() - 24) : m.start()]))
        if _surname(m[2], names, cued and m[1].isupper()) and ((m[1].isupper() and _case(m[2]) in ("title", "upper")) or cued):
            yield Item("person", m.start(), m.end())


def find_items(text: str, names: Names = Names()) -> list[Item]:
    """All items in order, without overlaps: earlier kinds of email, national_id, phone, address, person win."""
    if not text:
        return []
    found: list[Item] = []
    free = bytearray(len(text))
    some_digit = any(c.isdigit() for c in text)
    low = text.lower()
    kinds: list[tuple[str, Iterator]] = []
    if "@" in low or any(f"{a}at{b}" in low.replace(" ", "") for a, b in ("()", "[]", "{}")):
        kinds.append(("email", EMAIL.finditer(text)))
    if " at " in low and " dot " in low:
        kinds.append(("email", SPELLED_EMAIL.finditer(text)))
    if some_digit:
        kinds += [("national_id", NATIONAL_ID.finditer(text)), ("phone", PHONE.finditer(text)), ("address", ADDRESS.finditer(text))]
    for kind, ms in [*kinds, ("person", find_names(text, names))]:
        for m in ms:
            a, b = (m.start, m.end) if isinstance(m, Item) else m.span()
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in text[a:b]) <= 18:
                continue
            if not any(free[a:b]):
                free[a:b] = b"\1" * (b - a)
                found.append(Item(kind, a, b, text[a:b]))
    return sorted(found, key=lambda i: i.start)


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "|".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def feistel(values: Sequence[int], radices: Sequence[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """Keyed permutation of all tuples of that mixed radix; back undoes it. One place alone is shifted by a keyed amount."""
    n = len(values)
    if n < 2:
        shift = _prf(key, tweak, "one") * (-1 if back else 1)
        return [(v + shift) % r for v, r in zip(values, radices, strict=True)]
    h = n // 2

    def pack(vs: Sequence[int], rs: Sequence[int]) -> tuple[int, int]:
        x, size = 0, 1
        for v, r in zip(vs, rs, strict=True):
            x, size = x * r + v, size * r
        return x, size

    def spread(x: int, rs: Sequence[int]) -> list[int]:
        out = []
        for r in reversed(rs):
            x, v = divmod(x, r)
            out.append(v)
        return out[::-1]

    (a, na), (b, nb) = pack(values[:h], radices[:h]), pack(values[h:], radices[h:])
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2:
            b = (b + (-1 if back else 1) * _prf(key, tweak, i, a)) % nb
        else:
            a = (a + (-1 if back else 1) * _prf(key, tweak, i, b)) % na
    return spread(a, radices[:h]) + spread(b, radices[h:])


def _luhn(digits: str) -> str:
    """Check digit that follows the digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _mod_11_10(digits: str) -> str:
    p = 10
    for d in digits:
        p = ((int(d) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


#: Identity numbers with a check: pattern (body, check), and what the check is for the body's digits.
CHECKED = [
    (re.compile(r"(\d{8})-?([A-Z])"), lambda b: CHECK_LETTERS[int(b) % 23]),
    (re.compile(r"([XYZ]-?\d{7})-?([A-Z])"), lambda b: CHECK_LETTERS[int(str("XYZ".index(b[0])) + b[1:]) % 23]),
    (re.compile(r"(\d{6}-\d{3})(\d)"), lambda b: _luhn(b)),
    (re.compile(r"(\d{2} \d{3} \d{3} \d{2})(\d)"), lambda b: _mod_11_10(b)),
]


def _permuted(value: str, key: bytes, back: bool) -> str:
    """ASCII digits and letters permuted within their places; everything else stays. The tweak is the format without separators."""
    place = [i for i, c in enumerate(value) if c.isascii() and c.isalnum()]
    base = [(ord("0"), 10) if value[i].isdigit() else (ord("A"), 26) if value[i].isupper() else (ord("a"), 26) for i in place]
    shape = "".join("9" if value[i].isdigit() else "A" if value[i].isupper() else "a" for i in place)
    out = list(value)
    for i, v, (o, _) in zip(place, feistel([ord(value[i]) - o for i, (o, _) in zip(place, base, strict=True)], [r for _, r in base], key, shape, back), base, strict=True):
        out[i] = chr(v + o)
    return "".join(out)


def _birth_date(value: str) -> date | None:
    """The date of a number of six digits yymmdd, taken in the years 1930 to 2029."""
    y, m, d = int(value[:2]), int(value[2:4]), int(value[4:6])
    try:
        return date(1900 + y if y >= 30 else 2000 + y, m, d)
    except ValueError:
        return None


def _format(value: str) -> tuple[int, bool, int]:
    """What a pseudonym shares with its value beside places: the check that holds (its number, or -1), a date at the head, an international prefix 00."""
    for i, (rx, check) in enumerate(CHECKED):
        if (m := rx.fullmatch(value)) and check(re.sub(r"[^0-9A-Z]", "", m[1])) == m[2]:
            return i, bool(re.fullmatch(r"\d{6}-\d{3}", m[1]) and _birth_date(m[1])), 0
    return -1, False, 2 if re.fullmatch(r"00[1-9](?:\D*\d){7,}", value) else 0


def pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """The value permuted within its format: separators, length and the places of letters stay.

    A check that holds for the value holds for the pseudonym, and a date at the head of a number of the form yymmdd-nnnn stays a date. The first letter X, Y or Z of
    such numbers and the international prefix 00 stay, as they belong to the format. Where a step leaves the format, the next one is taken, so values and pseudonyms are one to one.
    """
    kind = _format(value)
    which, born, lead = kind
    out = value
    while True:
        if which < 0:
            out = out[:lead] + _permuted(out[lead:], key, back)
        else:
            rx, check = CHECKED[which]
            m = rx.fullmatch(out)
            body = m[1]
            if born:
                body = f"{pseudonym_date(_birth_date(body), key, date(1930, 1, 1), 36525, back):%y%m%d}-{_permuted(body[7:], key, back)}"
            else:
                first = 1 if body[0] in "XYZ" else 0
                body = body[:first] + _permuted(body[first:], key, back)
            out = body + out[m.end(1) : m.start(2)] + check(re.sub(r"[^0-9A-Z]", "", body))
        if _format(out) == kind:
            return out


def pseudonym_date(d: date, key: bytes, first: date = date(1900, 1, 1), days: int = 73049, back: bool = False) -> date:
    """A date permuted among the ``days`` days from ``first`` on (by walking the cycle of a permutation of four digits in base 17)."""
    x = (d - first).days
    if not 0 <= x < days or days > 17**4:
        raise ValueError(f"{d} is not in the range")
    while True:
        vs = []
        for _ in range(4):
            x, v = divmod(x, 17)
            vs.append(v)
        for i, v in enumerate(reversed(feistel(vs, [17] * 4, key, "date", back))):
            x = v if not i else x * 17 + v
        if x < days:
            return first + timedelta(days=x)


def tag(value: str, kind: str, key: bytes) -> str:
    """Sixteen hex digits of the normalised value: case, white space and, for names, order and initials' dots do not matter."""
    low = re.sub(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+", "@", value.lower()) if kind == "email" else value.lower()
    low = re.sub(r"\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+", ".", low) if kind == "email" else low
    low = " ".join(sorted(re.findall(r"\w+", low))) if kind == "person" else re.sub(r"[\s,]+", " ", low)
    return f"{_prf(key, kind, low):064x}"[:16]


def redact(text: str, items: Sequence[Item], key: bytes) -> str:
    """The text with every item replaced by its typed placeholder."""
    out, at = [], 0
    for i in items:
        numeric = i.kind in ("phone", "national_id")
        out += [text[at : i.start], f"[{i.kind.upper()} {pseudonym(i.text, key) if numeric else tag(i.text, i.kind, key)}]"]
        at = i.end
    return "".join([*out, text[at:]])


def latest(rows: DataFrame, id_col: str, text_cols: Sequence[str], version_col: str | None) -> DataFrame:
    """(id, texts...) of the last version of each record (ties: the larger texts)."""
    cols = [F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(text_cols)]
    v = F.col(version_col).cast("timestamp") if version_col else F.lit(None).cast("timestamp")
    last = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), v.alias("v"), F.struct(*cols).alias("t"))
    ship_package(rows.sparkSession)
    return stage_table(last.groupBy("id").agg(F.max_by("t", F.struct("v", "t")).alias("t")).select("id", "t.*"), "last-texts")


def learn_names(texts: DataFrame, cols: Sequence[str]) -> Names:
    """Given names and ordinary words of the collection (columns of text, one row per record)."""
    from collections import Counter

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of words (texts, occurrences, occurrences at cues and at sure ones) and, with a follower, of pairs at places of names."""
        for b in batches:
            texts, total, cued, sure, pairs = Counter(), Counter(), Counter(), Counter(), Counter()
            for row in b[list(cols)].itertuples(index=False):
                seen: set[str] = set()
                for t in row:
                    if not isinstance(t, str):
                        continue
                    cues = list(_CUE.finditer(t))
                    pairs.update(name_evidence(t, cues))
                    if "@" in t:
                        seen.update(WORD.findall(t.lower()))
                        t = EMAIL.sub(" . ", t)
                        cues = list(_CUE.finditer(t))
                    words = WORD.findall(t.lower())
                    seen.update(words)
                    total.update(words)
                    cued.update(t[x:y].lower() for x, y in set().union(*name_places(t, cues=cues)))
                    sure.update(sure_places(t, cues))
                texts.update(seen)
            out = [(w, None, n, total[w], cued[w], sure[w]) for w, n in texts.items()] + [(g, f, n, None, None, None) for (g, f), n in pairs.items()]
            yield pd.DataFrame(out, columns=["word", "follower", *counts]).astype({c: "Int64" for c in counts})

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, given = shared.value
        for b in batches:
            placed: Counter[str] = Counter()
            for t in (t for row in b[list(cols)].itertuples(index=False) for t in row if isinstance(t, str)):
                t = EMAIL.sub(" . ", t) if "@" in t else t
                placed.update(w for x, y in name_places(t, given)[1] if (w := t[x:y].lower()) in frequent)
            yield pd.DataFrame(list(placed.items()), columns=["word", "placed"])

    n, counts = texts.count(), ("n", "total", "cued", "sure")
    evidence = texts.mapInPandas(first, "word string, follower string, n long, total long, cued long, sure long").groupBy("word", "follower").agg(*[F.sum(c).alias(c) for c in counts])
    evidence = stage_table(evidence, "name-evidence")
    common = {r.word: r for r in evidence.where(F.col("follower").isNull() & (F.col("n") >= max(ORDINARY_TEXTS, ORDINARY_SHARE * n))).collect()}
    sc = texts.sparkSession.sparkContext
    away = evidence.where(F.col("follower").isNull() & (F.col("n") >= max(ORDINARY_TEXTS, ORDINARY_SHARE * n)) & (F.col("cued") < NAME_SHARE * F.col("total"))).select(F.col("word").alias("follower"), F.lit(0).alias("may"))
    pairs = evidence.where(F.col("follower").isNotNull()).select(F.col("word").alias("given"), "follower").join(away, "follower", "left").withColumn("may", F.coalesce("may", F.lit(1)))
    # in addresses either may be the given name: it is the one that stands beside more others than these do
    degree = pairs.groupBy(F.col("given").alias("follower")).agg(F.count(F.lit(1)).alias("degree"))
    known = pairs.join(degree, "follower", "left").groupBy("given").agg(F.count(F.lit(1)).alias("all"), F.sum("may").alias("followers"), F.avg(F.coalesce("degree", F.lit(0))).alias("theirs"))
    enough = (F.col("followers") >= GIVEN_FOLLOWERS) & (F.col("followers") >= GIVEN_RATIO * F.col("all")) & (F.col("all") > 2 * F.col("theirs"))
    given = {r.given for r in known.where(enough).limit(MAX_GIVEN + 1).collect()}
    if len(given) > MAX_GIVEN:
        raise ValueError(f"more than {MAX_GIVEN} given names")
    given = frozenset(g for g in given if g not in common or common[g].cued >= GIVEN_SHARE * common[g].total)
    shared = sc.broadcast((frozenset(common), given))
    placed = {r.word: r.placed for r in texts.mapInPandas(beside, "word string, placed long").groupBy("word").agg(F.sum("placed").alias("placed")).collect()}
    return Names(given, frozenset(w for w, r in common.items() if max(placed.get(w, 0), r.sure) < max(1, NAME_SHARE * r.total)) - given)


def find_pii(rows: DataFrame, id_col: str, text_cols: Sequence[str], version_col: str | None = None) -> DataFrame:
    """(id, field_name, pii_kind, start_at, end_at, value): one row per item; offsets are code points from 0, end_at excluded.

    Null and empty texts have no items; rows without id are no records; a record delivered again counts once, as its last version. Extra columns are ignored.
    """
    last = latest(rows, id_col, text_cols, version_col)
    cols = [f"t{i}" for i in range(len(text_cols))]
    shared = rows.sparkSession.sparkContext.broadcast(learn_names(last, cols))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                (key, name, i.kind, i.start, i.end, i.text)
                for c, name in zip(cols, text_cols, strict=True)
                for key, t in zip(b.id, b[c], strict=True)
                if isinstance(t, str)
                for i in find_items(t, shared.value)
            ]
            yield pd.DataFrame(out, columns=["id", "field_name", "pii_kind", "start_at", "end_at", "value"])

    return last.mapInPandas(run, "id string, field_name string, pii_kind string, start_at long, end_at long, value string").withColumnRenamed("id", id_col)


def redact_table(rows: DataFrame, id_col: str, text_cols: Sequence[str], key: bytes, version_col: str | None = None) -> DataFrame:
    """(id, texts...) with the items of every text replaced; null texts stay null. One row per record, its last version."""
    last = latest(rows, id_col, text_cols, version_col)
    cols = [f"t{i}" for i in range(len(text_cols))]
    shared = rows.sparkSession.sparkContext.broadcast(learn_names(last, cols))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = {c: pd.Series([redact(t, find_items(t, shared.value), key) if isinstance(t, str) else None for t in b[c]], index=b.index, dtype=object) for c in cols}
            yield pd.DataFrame({"id": b.id, **done})

    out = last.mapInPandas(run, ", ".join(["id string", *(f"{c} string" for c in cols)]))
    return out.select(F.col("id").alias(id_col), *[F.col(c).alias(n) for c, n in zip(cols, text_cols, strict=True)])
