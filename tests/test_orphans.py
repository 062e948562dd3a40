import datetime as dt

import pytest

from talus.operators.orphans import Rule, find_orphans, orphan_report

T0, T1 = dt.datetime(2026, 1, 5), dt.datetime(2026, 3, 5)
REFS = "rid string, created_at timestamp, a string, b string, k0 string, orphan_kind string"


def run(spark, refs, target, rule, dead=None):
    r = spark.createDataFrame([(*x, "clash", "clash") for x in refs], REFS)
    t = spark.createDataFrame(target, "x string, y string, created_at timestamp")
    d = None if dead is None else spark.createDataFrame(dead, "table_name string, record_key string, restored_at timestamp")
    return {(x.record_id, x.ref_key, x.orphan_kind) for x in find_orphans(r, "rid", "created_at", "src", rule, t, d).collect()}


def test_single_column(spark):
    one = Rule("a", ("a",), "t", ("x",))
    refs = [("r1", T0, " K1 ", None), ("r1", T1, "k1", None), ("r2", T0, "k2", None), ("r3", T0, None, None), ("r4", T0, "  ", None), ("r5", T0, "gone", None), ("r6", T0, "back", None), ("r7", None, "k2", None), ("r8", T0, "none", None)]
    target = [("k1", "", T0), ("K1", "", T1), ("k2", "", T1), ("back", "", T0), (None, "", T0)]
    dead = [("t", "GONE", None), ("t", "k1", T1), ("other", "none", None), ("t", "back", T1)]
    assert run(spark, refs, target, one, dead) == {("r2", "k2", "late"), ("r5", "gone", "deleted"), ("r8", "none", "missing")}


def test_deleted_wins_over_row_there(spark):
    assert run(spark, [("r", T0, "k", None)], [("k", "", T0)], Rule("a", ("a",), "t", ("x",)), [("t", "k", None)]) == {("r", "k", "deleted")}


@pytest.mark.parametrize(
    ("match", "want"),
    [("simple", {("r2", "p|z", "missing")}), ("partial", {("r2", "p|z", "missing"), ("r4", "|w", "missing")}), ("full", {("r2", "p|z", "missing"), ("r3", "p|", "malformed"), ("r4", "|w", "malformed")})],
)
def test_null_masks(spark, match, want):
    refs = [("r1", T0, "p", "q"), ("r2", T0, "p", "z"), ("r3", T0, "p", None), ("r4", T0, None, "w"), ("r5", T0, None, None)]
    assert run(spark, refs, [("p", "q", T0), ("p", "r", T0)], Rule("ab", ("a", "b"), "t", ("x", "y"), match)) == want


def test_empty_tables(spark):
    one = Rule("a", ("a",), "t", ("x",))
    assert run(spark, [], [("k", "", T0)], one, []) == set()
    assert run(spark, [("r", T0, "k", None)], [], one, []) == {("r", "k", "missing")}


def test_report_counts_by_month(spark):
    r = spark.createDataFrame([("r1", T0, "a", "", "k0", ""), ("r2", T0, "b", "", "", ""), ("r3", T1, "c", "", "", "")], REFS)
    t = spark.createDataFrame([], "x string, created_at timestamp")
    got = {(x.month, x.n_orphans) for x in orphan_report(find_orphans(r, "rid", "created_at", "src", Rule("a", ("a",), "t", ("x",)), t)).collect()}
    assert got == {("2026-01", 2), ("2026-03", 1)}


def test_bad_rule():
    with pytest.raises(ValueError):
        Rule("a", ("a",), "t", ("x", "y"))
