import datetime as dt
import itertools
import json

from talus.operators.schema_drift import _assign, _Profile, _walk, consistent_table, edit_script, parse_line, schema_changes

SCHEMA = "record_id string, feed string, target_table string, file_name string, exported_at timestamp, line_no int, payload string, ingest_ts timestamp, profile string"


def tree(*lines):
    fields = {}
    for o in lines:
        for path, v, place in _walk(o):
            fields.setdefault(path, _Profile()).add(v, place)
    return {p: _Profile(x.raw()) for p, x in fields.items()}


def test_script_kinds():
    a = tree(*[{"id": f"x{i}", "customer_id": f"cus_{i:05}", "n": i, "old": [1], "box": {"w": 1, "h": 2}} for i in range(8)])
    b = tree(*[{"id": f"x{i}", "cust_id": f"cus_{i + 3:05}", "n": str(i), "box": {"w": 1, "h": 2}, "extra": {"os": "a", "build": 1}} for i in range(8)])
    assert set(edit_script(a, b)) == {("renamed", "customer_id", "cust_id"), ("retyped", "n", ""), ("removed", "old", ""), ("added", "extra", "")}


def test_object_rename_and_move():
    a = tree(*[{"requester": {"org_id": f"org_{i:04}"}, "cap": {"page": True, "table": False}} for i in range(6)])
    b = tree(*[{"requester": {"x": 1}, "org_id": f"org_{i + 2:04}", "capability": {"page": True, "table": False}} for i in range(6)])
    got = set(edit_script(a, b))
    assert ("renamed", "requester.org_id", "org_id") in got and ("renamed", "cap", "capability") in got and ("added", "requester.x", "") in got


def test_names_seen_together_are_no_rename():
    a, b = tree({"created_at": "2026-01-01T00:00:00Z"}), tree({"updated_at": "2026-01-02T00:00:00Z"})
    assert set(edit_script(a, b, frozenset({("created_at", "updated_at")}))) == {("removed", "created_at", ""), ("added", "updated_at", "")}


def test_all_null_field_is_not_retyped():
    assert edit_script(tree({"a": None}), tree({"a": 1})) == []


def test_assignment_is_cheapest():
    cost = [[4, 1, 3], [2, 0, 5], [3, 2, 2]]
    best = min(sum(cost[i][p[i]] for i in range(3)) for p in itertools.permutations(range(3)))
    assert sum(cost[i][j] for i, j in enumerate(_assign(cost))) == best


def test_lines():
    assert parse_line('{"a": 1') is None and parse_line("[1]") is None and parse_line('{"a": NaN}') is None and parse_line(None) is None and parse_line('{"a": null}') == {"a": None}


def test_sketches_do_not_depend_on_parts():
    texts = [f"value {i % 300} " + "x" * (i % 7) for i in range(5000)]
    whole, parts = _Profile(), [_Profile() for _ in range(7)]
    for i, t in enumerate(texts):
        whole.add(t, 0.0)
        parts[i * 13 % 7].add(t, 0.0)
    merged = _Profile()
    for p in parts:
        merged.merge(_Profile(json.loads(json.dumps(p.raw()))))
    assert json.dumps(merged.raw(), sort_keys=True) == json.dumps(whole.raw(), sort_keys=True)


def test_deep_fields_and_long_values_count():
    deep = lambda leaf: {"a": json.loads('{"b":' * 80 + json.dumps(leaf) + "}" * 80)}
    assert {c[0] for c in edit_script(tree(deep({"x": 1})), tree(deep({"y": "z"})))} == {"removed", "added"}
    same, other = "l" * 500 + "-1", "l" * 500 + "-2"
    assert _Profile(tree({"v": same})["v"].raw()).values.n != _Profile(tree({"v": other})["v"].raw()).values.n


def rows(files, feed="f", target="t"):
    out = []
    for day, (name, lines) in enumerate(files, 1):
        at = dt.datetime(2026, 1, day)
        out += [(f"{name}-{i}", feed, target, name, at, i, x if isinstance(x, str) else json.dumps(x), at, "clash") for i, x in enumerate(lines)]
    return out


def test_files_of_a_feed(spark):
    one = [{"k": f"cus_{i}", "v": i, "s": {"a": True}} for i in range(5)]
    two = [{"v": i, "customer": f"cus_{i}", "s": {"a": True, "b": 1}} for i in range(5)] + ['{"cut": "of']
    three = [{"v": str(i), "customer": f"cus_{i}", "s": {"a": True, "b": 1}} for i in range(5)]
    df = spark.createDataFrame(rows([("1", one), ("2", two), ("3", three)])[::-1], SCHEMA)
    got = {(r.file_name, r.change_kind, r.field_path, r.new_path) for r in schema_changes(df.union(df)).collect()}
    assert got == {("2", "renamed", "k", "customer"), ("2", "added", "s.b", ""), ("3", "retyped", "v", "")}
    t = consistent_table(df.union(df), "t")
    assert t.count() == 15 and "s__a" in t.columns and not {"k", "customer"} <= set(t.columns)
    named = "customer" if "customer" in t.columns else "k"
    assert {r[named] for r in t.collect()} == {f"cus_{i}" for i in range(5)}


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert schema_changes(empty).count() == 0
    assert consistent_table(empty, "t").count() == 0
    nulls = spark.createDataFrame([tuple([None] * 9), ("r", "f", "t", "n", None, None, None, None, None), ("q", "f", "t", "m", None, 1, '{"a": "' + "x" * 100_000 + '"}', None, None)], SCHEMA)
    assert schema_changes(nulls).count() == 1
    assert consistent_table(nulls, "t").count() == 1
