"""Schemas that drift between files: change reports and one consistent table.

Each file's lines are profiled into a schema tree (presence, JSON kind and a value sketch for every field); neighbouring files of a
feed are compared by tree edit distance with the operations keep, retype, add, delete, rename (same parent) and move (other parent); the
renames of all files then compile into one projection per target table.

A field's sketch keeps, of all its whole values and of their shapes, the SKETCH ones with the smallest hashes, with exact counts. Sketches of parts merge to the
sketch of the whole, so a profile does not depend on batches, parts or the order of lines.

Scale: the lines of a file meet in one task, those of a large file in many, and are folded to sketches there, so a file or feed holding a
third of all rows is no hot spot. Files are paired by a window over (feed, file) keys alone. Only field names and pairs of names that may be renames reach the
driver; the number of names is checked against ``max_fields``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.session import ship_package, stage_table

#: Hashes that a field's sketch keeps of its values, and of their shapes.
SKETCH = 64
#: A file of more lines is profiled in so many parts.
LARGE, PARTS = 50_000, 64
#: A rename must cost less than this; deleting and adding costs 1 each, so the cheapest script prefers it below 2.
RENAME_LIMIT = 0.72


def _kind(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def parse_line(payload: object) -> dict | None:
    """The line's JSON object; None for cut-off lines, other JSON values and the non-JSON constants NaN and Infinity."""

    def bad(_: str) -> None:
        raise ValueError

    try:
        o = json.loads(payload, parse_constant=bad) if isinstance(payload, str) else None
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def _walk(o: dict) -> Iterator[tuple[str, object, float]]:
    """(path, value, place among its siblings) of every field at every depth."""
    todo = [("", o)]
    while todo:
        prefix, fields = todo.pop()
        for i, (k, v) in enumerate(fields.items()):
            yield (path := f"{prefix}{k}"), v, i / len(fields)
            if isinstance(v, dict):
                todo.append((f"{path}.", v))


class _Shapes(dict):
    """Translation table: letters to a, digits to 9."""

    def __missing__(self, c: int) -> str | int:
        self[c] = out = "9" if chr(c).isdigit() else "a" if chr(c).isalpha() else c
        return out


_TABLE = _Shapes()
_RUN = re.compile(r"(.)\1+", re.S)


def _shape(text: str) -> str:
    """Letters become a, digits 9, runs are folded: cus_00611 gives a_9."""
    return _RUN.sub(r"\1", text.translate(_TABLE))


class _Sketch:
    """Counts of the SKETCH smallest hashes of a multiset of texts: the same for any order and any division into parts that are merged."""

    def __init__(self, raw: dict[str, int] | None = None) -> None:
        self.n = {int(h): c for h, c in (raw or {}).items()}
        self.limit = max(self.n) if len(self.n) >= SKETCH else 1 << 32

    def add(self, text: str) -> None:
        h = zlib.crc32(text.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF
        if h <= self.limit:
            self.n[h] = self.n.get(h, 0) + 1
            if len(self.n) > 4 * SKETCH:
                self.cut()

    def cut(self) -> None:
        if len(self.n) > SKETCH:
            self.n = {h: self.n[h] for h in sorted(self.n)[:SKETCH]}
        if len(self.n) == SKETCH:
            self.limit = max(self.n)

    def merge(self, o: _Sketch) -> None:
        for h, c in o.n.items():
            self.n[h] = self.n.get(h, 0) + c
        self.cut()

    def both(self, o: _Sketch) -> tuple[dict[int, int], dict[int, int]]:
        """The two sketches where both are complete: up to the smaller of their limits."""
        self.cut()
        o.cut()
        top = min(self.limit, o.limit)
        return tuple({h: c for h, c in x.n.items() if h <= top} for x in (self, o))


class _Profile:
    """Of one field: lines, kinds, summed place among its siblings, sketches of shapes and values, range of numbers, summed length of shapes."""

    def __init__(self, raw: list | None = None) -> None:
        n, kinds, place, shapes, values, number, length = raw or [0, {}, 0.0, {}, {}, None, 0]
        self.n, self.kinds, self.place, self.shapes, self.values, self.number, self.length = n, Counter(kinds), place, _Sketch(shapes), _Sketch(values), number, length

    def add(self, v: object, place: float) -> None:
        self.n += 1
        self.kinds[(kind := _kind(v))] += 1
        self.place += place
        if kind == "string" or kind == "array":
            text = v if kind == "string" else json.dumps(v, ensure_ascii=False)
            shape = _shape(text)
            self.shapes.add(shape)
            self.values.add(text)
            self.length += len(shape)
        elif kind == "number":
            self.number = [min(v, (self.number or [v, v])[0]), max(v, (self.number or [v, v])[1])]
            self.values.add(str(v))

    def merge(self, o: _Profile) -> None:
        self.n += o.n
        self.place += o.place
        self.length += o.length
        self.kinds.update(o.kinds)
        self.shapes.merge(o.shapes)
        self.values.merge(o.values)
        if o.number:
            self.number = [min(o.number[0], (self.number or o.number)[0]), max(o.number[1], (self.number or o.number)[1])]

    def raw(self) -> list:
        self.shapes.cut()
        self.values.cut()
        return [self.n, dict(self.kinds), self.place, self.shapes.n, self.values.n, self.number, self.length]

    def kind(self) -> str | None:
        """The kind of most non-null values; ties by name, None where all values are null."""
        return min(((-n, k) for k, n in self.kinds.items() if k != "null"), default=(0, None))[1]


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        files: dict[tuple, dict[str, _Profile]] = defaultdict(dict)
        first: dict[tuple, pd.Timestamp] = {}
        for feed, name, target, at, payload in zip(b.feed, b.file_name, b.target_table, b.exported_at, b.payload, strict=True):
            key = (feed, name, target)
            if key not in first or not (first[key] <= at):
                first[key] = at
            fields = files[key]
            for path, v, place in _walk(parse_line(payload) or {}):
                if path not in fields:
                    fields[path] = _Profile()
                fields[path].add(v, place)
        rows = [(*k, first[k], json.dumps({p: x.raw() for p, x in f.items()})) for k, f in files.items()]
        yield pd.DataFrame(rows, columns=_COLUMNS)


_COLUMNS = ["feed", "file_name", "target_table", "exported_at", "profile"]


def _merged(parts: list[tuple]) -> tuple:
    """One row of a file from the rows of its parts."""
    if len(parts) == 1:
        return parts[0]
    fields: dict[str, _Profile] = {}
    for *_, p in parts:
        for path, profile in _read_profiles(p).items():
            if path in fields:
                fields[path].merge(profile)
            else:
                fields[path] = profile
    targets, times = [x[2] for x in parts if x[2] is not None], [x[3] for x in parts if not pd.isna(x[3])]
    return (*parts[0][:2], min(targets, default=None), min(times, default=None), json.dumps({p: x.raw() for p, x in fields.items()}))


def _merge_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by feed and file: the parts of each file are folded as they pass."""
    held: list[tuple] = []
    for b in batches:
        out = []
        for row in b[_COLUMNS].itertuples(index=False, name=None):
            if held and held[0][:2] != row[:2]:
                out.append(_merged(held))
                held = []
            held.append(row)
        yield pd.DataFrame(out, columns=_COLUMNS)
    if held:
        yield pd.DataFrame([_merged(held)], columns=_COLUMNS)


def file_schemas(records: DataFrame) -> DataFrame:
    """One row (feed, file_name, target_table, exported_at, profile) per file. Repeated record_ids count once; rows without feed or file name are no file's."""
    cols = records.select("record_id", "feed", "file_name", "target_table", F.col("exported_at").cast("timestamp").alias("exported_at"), "payload").dropna(subset=["feed", "file_name"])
    # the lines of a file go to one task, those of a large file to PARTS tasks; there are at most (lines / LARGE) large files
    large = cols.groupBy("feed", "file_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("feed", "file_name", F.lit(True).alias("large"))
    # a line without record_id repeats another only if its payload does
    same = F.coalesce("record_id", F.concat(F.lit("\0"), F.coalesce("payload", F.lit(""))))
    part = F.when(F.col("large"), F.pmod(F.xxhash64(same), F.lit(PARTS))).otherwise(0).alias("part")
    spread = cols.join(large, ["feed", "file_name"], "left").select(*cols.columns, part, F.xxhash64(same).alias("same")).repartition("feed", "file_name", "part")
    lines = spread.dropDuplicates(["feed", "file_name", "part", "same"]).sortWithinPartitions("feed", "file_name").drop("record_id", "part", "same")
    schema = "feed string, file_name string, target_table string, exported_at timestamp, profile string"
    profiles = lines.mapInPandas(_profiles, schema).repartition("feed", "file_name").sortWithinPartitions("feed", "file_name")
    return profiles.mapInPandas(_merge_sorted, schema)


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if w]


def _edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _name_likeness(a: str, b: str) -> float:
    x, y = _words(a), _words(b)
    if sorted(x) == sorted(y):
        return 1.0
    used: set[int] = set()
    hits = 0.0
    for w in x:
        for j, v in enumerate(y):
            short, long = sorted((w, v), key=len)
            stem = next((k for k, (p, q) in enumerate(zip(short, long)) if p != q), len(short))
            if j not in used and w not in ("at", "is", "id", "no") and (w == v or (stem == len(short) > 2) or stem >= max(4, 0.6 * len(short))):
                used.add(j)
                hits += 1
                break
    tokens = hits / max(1, min(len(x), len(y)))
    p, q = "".join(x), "".join(y)
    letters = 1 - _edit(p, q) / max(len(p), len(q), 1)
    return max(0.9 * tokens, letters if letters >= 0.75 else 0.0)


def _overlap(x: _Sketch, y: _Sketch) -> float:
    """Shared mass of two distributions."""
    a, b = x.both(y)
    na, nb = sum(a.values()), sum(b.values())
    return sum(min(a[k] / na, b[k] / nb) for k in a if k in b) if na and nb else 0.0


def _value_likeness(a: _Profile, b: _Profile) -> tuple[float, float]:
    """Likeness of the values and how much it tells. Two booleans or two unbounded texts look alike whatever they mean."""
    ka, kb = a.kind(), b.kind()
    if ka is None or kb is None:
        return 0.5, 0.0
    if ka != kb:
        return (0.1, 0.7) if {ka, kb} != {"string", "array"} else (_overlap(a.shapes, b.shapes), 0.6)
    if ka == "boolean":
        return 0.6, 0.25
    if ka == "number":
        (la, ha), (lb, hb) = a.number or [0, 0], b.number or [0, 0]
        span = max(ha, hb) - min(la, lb)
        shared = max(0.0, min(ha, hb) - max(la, lb))
        return (shared / span if span else 1.0), 0.45
    if ka == "object":
        return 0.5, 0.2
    same, shapes = _overlap(a.values, b.values), _overlap(a.shapes, b.shapes)
    mine, others = a.shapes.both(b.shapes)
    largest = {h: max(mine.get(h, 0), others.get(h, 0)) for h in mine | others}
    if len(largest) > 6 and sum(largest.values()) < 3 * len(largest):  # running text: shapes hardly repeat, the lengths do
        la, lb = (p.length / max(1, p.kinds["string"] + p.kinds["array"]) for p in (a, b))
        shapes = max(shapes, min(la, lb) / max(la, lb, 1))
    return max(same, 0.9 * shapes), 0.8 if same > 0.3 else 0.6


def rename_cost(old: str, a: _Profile, new: str, b: _Profile, children: tuple[set[str], set[str]], moved: bool) -> float:
    """0 for the same field under a like name, 1 for unrelated ones."""
    name = _name_likeness(old.rpartition(".")[2], new.rpartition(".")[2])
    value, weight = _value_likeness(a, b)
    if children[0] and children[1]:
        value, weight = len(children[0] & children[1]) / len(children[0] | children[1]), 0.8
    place = 1 - min(1.0, 4 * abs(a.place / max(a.n, 1) - b.place / max(b.n, 1)))
    told = 0.5 + weight + 0.25
    return 1 - (0.5 * name + weight * value + 0.25 * place) / told + 0.15 * moved


def _assign(cost: np.ndarray) -> np.ndarray:
    """Hungarian method by shortest augmenting paths: for each row the column of a cheapest assignment; as many columns as rows or more."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, last, far = start, -1, 0.0
        while True:
            step = far + cost[at] - u[at] - v
            better = ~done & (step < dist)
            dist[better], back[better] = step[better], last
            last = int(np.argmin(np.where(done, np.inf, dist)))
            far = dist[last]
            done[last] = True
            if row_of[last] < 0:
                break
            at = row_of[last]
        slack = far - dist[done]
        held = row_of[done]
        u[held[held >= 0]] += slack[held >= 0]
        u[start] += far
        v[done] -= slack
        while last >= 0:
            before = back[last]
            row_of[last] = row_of[before] if before >= 0 else start
            last = before
    out = np.zeros(n, np.int64)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def unmatched(old: dict[str, _Profile], new: dict[str, _Profile]) -> tuple[list[str], list[str], list[str]]:
    """(kept under another kind, only old, only new) among the children of kept fields. A field under an equal path is the same field."""

    def children(fields: dict[str, _Profile]) -> dict[str, set[str]]:
        out = defaultdict(set)
        for p in fields:
            out[p.rpartition(".")[0]].add(p)
        return out

    mine, others = children(old), children(new)
    retyped, gone, come, todo = [], [], [], [""]
    while todo:
        parent = todo.pop()
        a, b = mine[parent], others[parent]
        for p in sorted(a & b):
            ka, kb = old[p].kind(), new[p].kind()
            if ka and kb and ka != kb:
                retyped.append(p)
            else:
                todo.append(p)
        gone += sorted(a - b)
        come += sorted(b - a)
    return retyped, gone, come


def edit_script(old: dict[str, _Profile], new: dict[str, _Profile], together: frozenset[tuple[str, str]] = frozenset()) -> list[tuple[str, str, str]]:
    """Cheapest script from one schema tree to the other: (change_kind, field_path, new_path), fields below a changed field left out.

    Equal paths are kept at no cost, as the problem defines a field by its path. All other nodes, of all levels at once, take part in one cheapest assignment: a rename
    (same parent) or move (another parent, which costs more) at rename_cost, a deletion or an addition at 1 each. Names that occur together in some file
    (pairs of ``together``, smaller first) hold different information, so no rename joins them.
    """
    retyped, gone, come = unmatched(old, new)
    leaves = lambda fields, p: {x[len(p) + 1 :] for x in fields if x.startswith(p + ".")}
    script = [("retyped", p, "") for p in retyped]
    if gone and come:
        below_old, below_new = {p: leaves(old, p) for p in gone}, {p: leaves(new, p) for p in come}

        def pay(o: str, n: str) -> float:
            return 9.0 if (min(o, n), max(o, n)) in together else rename_cost(o, old[o], n, new[n], (below_old[o], below_new[n]), o.rpartition(".")[0] != n.rpartition(".")[0])

        paid = np.array([[pay(o, n) for n in come] for o in gone])
        # a pair saves one deletion and one addition; the other columns stand for deletions
        cost = np.concatenate([paid / RENAME_LIMIT - 1, np.ones((len(gone), len(gone)))], axis=1)
        for i, j in enumerate(_assign(cost)):
            if j < len(come) and paid[i, j] < RENAME_LIMIT:
                script.append(("renamed", gone[i], come[j]))
        done_old, done_new = {x[1] for x in script}, {x[2] for x in script}
        gone, come = [o for o in gone if o not in done_old], [n for n in come if n not in done_new]
    return script + [("removed", p, "") for p in gone] + [("added", p, "") for p in come]


def _read_profiles(text: str) -> dict[str, _Profile]:
    return {p: _Profile(r) for p, r in json.loads(text).items()}


def _neighbours(schemas: DataFrame) -> DataFrame:
    """Each file with the profile of the file before it in its feed."""
    order = Window.partitionBy("feed").orderBy("exported_at", "file_name")
    pairs = schemas.select("feed", "file_name", "exported_at").withColumn("previous", F.lag("file_name").over(order)).drop("exported_at").where(F.col("previous").isNotNull())
    after = schemas.select("feed", "file_name", "target_table", "profile")
    before = schemas.select("feed", F.col("file_name").alias("previous"), F.col("profile").alias("before"))
    return pairs.join(after, ["feed", "file_name"]).join(before, ["feed", "previous"]).drop("previous")


def names_together(schemas: DataFrame, neighbours: DataFrame, max_fields: int = 5000) -> dict[str | None, frozenset[tuple[str, str]]]:
    """Of each target table, those pairs of field names (smaller first) that might be a rename between two files, but some file has both of.

    Asked are only pairs of a name that one file lost with a name that the same file gained; they are looked up in the distinct sets of names. The number of field names is checked.
    """
    sets = stage_table(schemas.select("target_table", F.array_sort(F.map_keys(F.from_json("profile", "map<string,string>"))).alias("names")).distinct(), "name-sets")
    if (n := sets.select("target_table", F.explode("names").alias("path")).distinct().limit(max_fields + 1).count()) > max_fields:
        raise ValueError(f"more than {max_fields} field names, {n} seen")

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for target, before, after in zip(b.target_table, b.before, b.profile, strict=True):
                _, gone, come = unmatched(_read_profiles(before), _read_profiles(after))
                out |= {(target, min(o, n), max(o, n)) for o in gone for n in come}
            yield pd.DataFrame(sorted(out, key=str), columns=["target_table", "a", "b"])

    asked = neighbours.select("target_table", "before", "profile").mapInPandas(possible, "target_table string, a string, b string").distinct()
    has = sets.select("target_table", "names", F.explode("names").alias("a"))
    met = asked.join(has, asked.target_table.eqNullSafe(has.target_table) & (asked.a == has.a)).where(F.array_contains("names", F.col("b")))
    out: dict[str | None, set[tuple[str, str]]] = defaultdict(set)
    for r in met.select(asked.target_table, asked.a, "b").distinct().collect():
        out[r.target_table].add((r.a, r.b))
    return {k: frozenset(v) for k, v in out.items()}


def _changes(schemas: DataFrame, max_fields: int = 5000) -> DataFrame:
    neighbours = _neighbours(schemas)
    together = schemas.sparkSession.sparkContext.broadcast(names_together(schemas, neighbours, max_fields))

    def diffs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for feed, name, target, before, after in zip(b.feed, b.file_name, b.target_table, b.before, b.profile, strict=True):
                rows += [(feed, name, target, *c) for c in edit_script(_read_profiles(before), _read_profiles(after), together.value.get(target, frozenset()))]
            yield pd.DataFrame(rows, columns=["feed", "file_name", "target_table", "change_kind", "field_path", "new_path"])

    return neighbours.mapInPandas(diffs, "feed string, file_name string, target_table string, change_kind string, field_path string, new_path string")


def schema_changes(records: DataFrame) -> DataFrame:
    """(feed, file_name, change_kind, field_path, new_path): each file against the one before it in its feed by exported_at, then name.

    records: record_id, feed, file_name, target_table, exported_at, payload; further columns are ignored. A file whose lines are all invalid
    has no fields, so the next change report removes and adds all of them. An empty table gives no rows.
    """
    ship_package(records.sparkSession)
    return _changes(stage_table(file_schemas(records), "file-schemas")).drop("target_table")


def consistent_table(records: DataFrame, target: str, max_fields: int = 5000) -> DataFrame:
    """All valid lines of one target table under one set of columns, plus _record_id, _feed, _file_name, _exported_at, _line_no.

    The renames found between files join field names into classes; a class is named after the member found in most files (ties by name), and
    two names that occur together in a file are never joined. A line's column is the first non-null of its class's fields, in that order. Columns
    are text; objects and arrays keep their JSON. Fields that are objects in most files are spread into their leaves. ``.`` becomes ``__`` in column names. The number
    of field names is checked: more than max_fields raises. Repeated record_ids give one row, the last ingested.
    """
    ship_package(records.sparkSession)
    rows = records.where(F.col("target_table") == target)
    schemas = stage_table(file_schemas(rows), "file-schemas")
    field = F.explode(F.map_entries(F.from_json("profile", "map<string,string>"))).alias("f")
    raw = F.from_json(F.col("f.value"), "array<string>")
    seen = schemas.select("feed", "file_name", field).select("feed", "file_name", F.col("f.key").alias("path"), F.coalesce(F.from_json(raw[1], "map<string,bigint>")["object"], F.lit(0)).alias("objects"), raw[0].cast("long").alias("n"))
    counted = seen.groupBy("path").agg(F.count(F.lit(1)).alias("files"), F.sum("objects").alias("objects"), F.sum("n").alias("n")).limit(max_fields + 1).collect()
    if len(counted) > max_fields:
        raise ValueError(f"more than {max_fields} field names in the files of {target}")
    files = {r.path: r.files for r in counted}
    objects = {r.path for r in counted if 2 * r.objects > r.n}
    # pairs of at most max_fields names
    renames = _changes(schemas, max_fields).where("change_kind = 'renamed'").groupBy("field_path", "new_path").count().collect()
    pairs = seen.select("feed", "file_name", "path").join(records.sparkSession.createDataFrame([(r.field_path, r.new_path) for r in renames] or [("", "")], "path string, other string"), "path")
    both = pairs.join(seen.select("feed", "file_name", F.col("path").alias("other")), ["feed", "file_name", "other"], "left_semi").select("path", "other").distinct().collect()
    clash = {(r.path, r.other) for r in both}
    root: dict[str, str] = {}

    def find(p: str) -> str:
        while root.get(p, p) != p:
            p = root[p]
        return p

    members: dict[str, set[str]] = {p: {p} for p in files}
    for r in sorted(renames, key=lambda r: (-r["count"], r.field_path, r.new_path)):
        a, b = find(r.field_path), find(r.new_path)
        if a != b and not any((x, y) in clash or (y, x) in clash for x in members[a] for y in members[b]):
            root[b] = a
            members[a] |= members.pop(b)
    cols: dict[str, Column] = {}
    for group in members.values():
        ranked = sorted(group, key=lambda p: (-files[p], p))
        if ranked[0] in objects:
            continue
        parents = {p.rpartition(".")[0] for p in ranked}
        if any(p and p not in objects for p in parents) and not any(p in objects or not p for p in parents):
            continue  # below a field that is mostly no object: its JSON is kept whole
        paths = ["$" + "".join(f"['{k}']" for k in p.split(".")) for p in ranked]
        cols[ranked[0].replace(".", "__")] = F.coalesce(*[F.get_json_object("payload", p) for p in paths])
    an_object = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    order = Window.partitionBy("record_id").orderBy(F.col("ingest_ts").desc(), F.col("line_no").desc(), F.col("payload"))
    last = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").where(an_object)
    keep = ("record_id", "feed", "file_name", "exported_at", "line_no")
    return last.select(*[F.col(c).alias(f"_{c}") for c in keep], *[c.alias(n) for n, c in sorted(cols.items())])
