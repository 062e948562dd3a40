import datetime as dt
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.llm import neighbours, ocr_repair, pii

NAMES = pii.Names(frozenset({"emil", "hanna", "noor"}), frozenset("hello the from regards compare warehouse signed with".split()))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to (jo.Doe+x@mail.example.org) or <a-b@c.test>, not user@cluster or @edge.", [("email", "jo.Doe+x@mail.example.org"), ("email", "a-b@c.test")]),
        ("cc priya89 (at) brellin.example and jo at mail dot orvane dot test.", [("email", "priya89 (at) brellin.example"), ("email", "jo at mail dot orvane dot test")]),
        ("Call +44 20 7946 0730, (555) 011-1606 or 020 7946 0846; +1 (555) 016 8029 ext. 12.", [("phone", "+44 20 7946 0730"), ("phone", "(555) 011-1606"), ("phone", "020 7946 0846"), ("phone", "+1 (555) 016 8029 ext. 12")]),
        ("555.015.9214, 030/23125-402 and 0049 (0)30 23125543", [("phone", "555.015.9214"), ("phone", "030/23125-402"), ("phone", "0049 (0)30 23125543")]),
        ("QX461245D, QX 21 54 10 D, 956-57-5950, 88357492X, L51250781, 918697-1849, 99 056 567 579", [("national_id", x) for x in ("QX461245D", "QX 21 54 10 D", "956-57-5950", "88357492X", "L51250781", "918697-1849", "99 056 567 579")]),
        ("Trace 88213-4471, serial 5550-1199-AX, order 4711-0815-22, 555.01 ms, build 2026.04.17-1133, peer 10.20.30.41, invoice 912-4418, QX-9", []),
        ("to 125 Mill Rise, Silverfen 06206. Am Speicher 72, 06818 Port Elsin", [("address", "125 Mill Rise, Silverfen 06206"), ("address", "Am Speicher 72, 06818 Port Elsin")]),
        ("139 Mill Rise\n08910 Pellgrove; 28B Saltgate, Floor 4, Wendelau; Room Saltgate; Hall 7, Rack 12", [("address", "139 Mill Rise\n08910 Pellgrove"), ("address", "28B Saltgate, Floor 4, Wendelau")]),
        ("Signed: Emil Vanthor. Regards, HANNA LINKOWIC. noor borwenin from the warehouse", [("person", "Emil Vanthor"), ("person", "HANNA LINKOWIC"), ("person", "noor borwenin")]),
        ("Reported by Harbelano, Noor Compare. Ms K. Nurbelin. Hello, Emil Bordis-Vane", [("person", "Harbelano, Noor"), ("person", "K. Nurbelin"), ("person", "Emil Bordis-Vane")]),
        ("Regards, Edge Operations Desk", []),
        ("", []),
    ],
)
def test_items(text, want):
    names = pii.Names(NAMES.given, NAMES.ordinary | {"edge", "operations"})
    got = pii.find_items(text, names)
    assert [(i.kind, i.text) for i in got] == want and all(text[i.start : i.end] == i.text for i in got)


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"[0-9A-Za-z][0-9A-Za-z .\-]{0,14}", fullmatch=True))
def test_pseudonyms_keep_the_format_and_can_be_undone(value):
    p = pii.pseudonym(value, b"k")
    shape = lambda s: [("9" if c.isdigit() else "A" if c.isupper() else "a") if c.isalnum() else c for c in s]
    assert shape(p) == shape(value) and pii.pseudonym(p, b"k", back=True) == value and pii.pseudonym(value, b"k") == p


def test_pseudonyms_are_permutations():
    assert len({pii.pseudonym(f"{i:03}", b"k") for i in range(1000)}) == 1000
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(500)]
    out = [pii.pseudonym_date(d, b"k") for d in days]
    assert len(set(out)) == 500 and [pii.pseudonym_date(d, b"k", back=True) for d in out] == days
    number = pii.pseudonym("12345678Z", b"k")
    assert pii.CHECK_LETTERS[int(number[:8]) % 23] == number[8]
    assert pii.tag("Emil B. Vane", "person", b"k") == pii.tag("VANE, emil b", "person", b"k")


def test_pii_table(spark):
    schema = "ticket_id string, subject string, description string, ingest_ts timestamp, t0 string, value string"
    people = [f"Signed: {g} {s}. Call +44 20 7946 0{i}30." for i, (g, s) in enumerate([("Emil", "Vanthor"), ("Emil", "Brisnak"), ("Emil", "Kolwen")], 1)]
    rows = [(f"T{i}", None if i else "", p, dt.datetime(2026, 1, 1)) for i, p in enumerate(people)] + [("T9", "for emil vanthor", "x" * 200_000 + " a@b.example", None), ("T1", "old", "old b@c.example", dt.datetime(2025, 1, 1)), (None, "a@b.example", None, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    got = {(r.ticket_id, r.field_name, r.pii_kind, r.start_at) for r in pii.find_pii(df, "ticket_id", ["subject", "description"], "ingest_ts").collect()}
    assert ("T9", "subject", "person", 4) in got and ("T9", "description", "email", 200_001) in got and ("T0", "description", "phone", 27) in got and not any(k == "email" and t == "T1" for t, _, k, _ in got)
    red = {r.ticket_id: r for r in pii.redact_table(df, "ticket_id", ["subject", "description"], b"k", "ingest_ts").collect()}
    assert red["T1"].subject is None and red["T0"].subject == "" and "[PHONE +" in red["T0"].description and "Vanthor" not in red["T0"].description
    assert red["T0"].description.split("[PERSON ")[1][:8] == red["T9"].subject.split("[PERSON ")[1][:8]
    assert pii.find_pii(df.limit(0), "ticket_id", ["subject"], "ingest_ts").count() == 0


def test_checked_numbers_stay_checked():
    for number in ("12345678Z", "X1234567L", "850709-9805", "86 095 742 719"):
        p = pii.pseudonym(number, b"k")
        assert p != number and pii.pseudonym(p, b"k", back=True) == number
        assert any((m := rx.fullmatch(p)) and check("".join(c for c in m[1] if c.isalnum())) == m[2] for rx, check in pii.CHECKED)
    assert pii._birth_date(pii.pseudonym("850709-9805", b"k"))
    assert pii.pseudonym("+49 170 1234567", b"k").replace(" ", "")[1:] == pii.pseudonym("0049 (170) 123-4567", b"k").translate({ord(c): None for c in " ()-"})[2:]


def test_names_found_do_not_fade_when_tickets_repeat(spark):
    at = "/root/testdata/sf0.01/tickets.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    one = spark.read.parquet(at).select("ticket_id", "subject", "description", "ingest_ts")
    four = one.selectExpr("explode(sequence(1, 4)) as copy", "*").selectExpr("concat(ticket_id, '-', copy) as ticket_id", "subject", "description", "ingest_ts")
    persons = [pii.find_pii(df, "ticket_id", ["subject", "description"], "ingest_ts").where("pii_kind = 'person'").count() for df in (one, four)]
    assert persons[1] >= 0.97 * 4 * persons[0] > 0


def test_recurring_and_short_names(spark):
    people = ["Emil Vanthor"] * 40 + ["Emil Brisnak", "Emil Kolwen", "Hanna Li", "Hanna Wexford", "Hanna Dorvane", "Noor Ng"]
    rows = [(f"T{i:02}", f"Signed: {p}. The gateway is slow again.") for i, p in enumerate(people)] + [(f"S{i}", "Regards, Edge Operations Desk. The edge operations manual is old.") for i in range(20)]
    rows += [(f"V{i}", "we saw that emil vanthor waits") for i in range(5)] + [("D1", "Ask Dr Ulla Gateway about it"), ("D2", "for Hanna Li")]
    found = pii.find_pii(spark.createDataFrame(rows, "ticket_id string, description string"), "ticket_id", ["description"]).collect()
    got = {(r.ticket_id, r.value) for r in found if r.pii_kind == "person"}
    assert got == {*((f"T{i:02}", p) for i, p in enumerate(people)), *((f"V{i}", "emil vanthor") for i in range(5)), ("D1", "Ulla Gateway"), ("D2", "Hanna Li")}


SECTION = "section_id string, section_path string, content string, ingest_ts timestamp, flag boolean, low string"
CLEAN = "Please restart the modern controller before the weekly window because the profile was slow. The planner exported many records and the archive volume still keeps every entry. "


def scan(body, width=44):
    out, line = [], ""
    for w in body.split():
        if len(line) + len(w) + 1 > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def test_scan_repair(spark):
    body = scan(CLEAN * 2)
    noisy = "\n".join(["FIELD GUIDE 3.2", *body[:3], "- 12 -", "\x0cFIELD GUIDE 3.2", *body[3:]]).replace("controller before", "contro11er before", 1).replace("archive", "archlve", 1)
    lines = noisy.split("\n")
    k = next(i for i, x in enumerate(lines) if " planner" in x or x.startswith("planner"))
    at = lines[k].index("planner")
    before, after = lines[k][:at] + "plan-", "ner" + lines[k][at + 7 :]
    lines[k : k + 1] = [before, after]
    rows = [("s1", "Guide: a b", "\n".join(lines), None, True), ("c1", "x", CLEAN * 3, None, True), ("c2", "x", CLEAN * 3, None, False), ("n", None, None, None, True), ("e", "x", "", None, True), ("t", "x", "| a | b |\n| c | d |", None, True), (None, "x", "\n".join(lines), None, True)]
    rows += [(f"o{i}", "Guide: a b", "\n".join(["FIELD GUIDE 3.2", *body]), None, True) for i in range(3)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SECTION)
    got = {(r.section_id, r.line_no, r.noise_kind) for r in ocr_repair.found_noise(df, "flag").collect()}
    mine = {(n, kind) for s, n, kind in got if s == "s1"}
    wrong = [i for i, x in enumerate(lines) if "contro11er" in x or "archlve" in x]
    assert mine == {*((i, "page_furniture") for i, x in enumerate(lines) if "FIELD GUIDE" in x or x == "- 12 -"), (k, "broken_word"), *((i, "misread") for i in wrong)}
    clean = {r.section_id: r.clean_content for r in ocr_repair.repaired_sections(df, "flag").collect()}
    assert set(clean) == {"s1", "o0", "o1", "o2"} and clean["s1"] == " ".join((CLEAN * 2).split())
    assert ocr_repair.found_noise(df.limit(0), "flag").count() == 0 and ocr_repair.repaired_sections(df.limit(0), "flag").count() == 0


def test_furniture_does_not_depend_on_the_number_of_scans(spark):
    """A header on a few scans, exactly or misread, is found whatever else lies in the table; one long line makes no scan of other sections."""
    body = scan(CLEAN * 6)
    page = lambda header: "\n".join([header, *body[:4], "- 7 -", "", header, *body[4:]])
    long = page("Kestrel operator notes") + "\n" + "x" * 125
    mine = [(f"m{i}", None, page("Kestrel operator notes")) for i in range(3)] + [("wrong", None, page("Kestrel operat0r note5")), ("long", None, long)]
    for others in (5, 400):
        rows = mine + [(f"o{i}", None, page(f"Chapter {chr(97 + i % 26) * 9}{chr(97 + i // 26) * 9}")) for i in range(others)]
        df = spark.createDataFrame([(*r, None, True, None) for r in rows], SECTION)
        got = {}
        for r in ocr_repair.found_noise(df, "flag").where("noise_kind = 'page_furniture'").collect():
            got.setdefault(r.section_id, set()).add(r.line_no)
        assert all(got[k] == {0, 5, 7} for k in ("m0", "m1", "m2", "wrong", "long"))


def test_part_keys_meet_within_the_edits():
    for a, b, most in (("field guide manual", "f1eld guide manua", 2), ("operator notes", "xoperator note", 2), ("short one", "shart one", 1), ("same", "same", 1)):
        keys = {f"{len(b)}|{most}|{i}|{part}" for i, (_, part) in enumerate(ocr_repair._parts(b, most))}
        assert keys & ocr_repair._probes(a, most)


def test_context_chooses_among_all_candidates(spark):
    pairs = np.zeros(ocr_repair.PAIR_BUCKETS, np.int32)
    pairs[ocr_repair._pair("big", "xuuuvx")] = 50
    rows = [("word", "s", 0, None, 4, "xuuuux", "xuuuux", "xuuuux", "big", None, None, None)]
    rows += [("pairs", *[None] * 9, k, bytearray(x.tobytes())) for k, x in enumerate(np.split(pairs, ocr_repair.PAIR_SLICES)) if x.any()]
    found = spark.createDataFrame(rows, "kind string, section_id string, line_no int, next_line int, at int, word string, low string, hyphened string, before string, after string, slice int, counts binary")
    lexicon = spark.createDataFrame([("xvuuux", 100), ("xuvuux", 100), ("xuuvux", 100), ("xnuuux", 100), ("xuuuvx", 50)], "word string, n long")
    assert [r.repaired for r in ocr_repair.corrections(found, lexicon).collect()] == ["xuuuvx"]


def test_weighted_distance():
    assert ocr_repair.weighted_distance("rnodern", "modern") == pytest.approx(0.3)
    assert ocr_repair.weighted_distance("cat", "car") == 1 and ocr_repair.weighted_distance("same", "same") == 0
    assert ocr_repair.wrong_lines(3, 4, "coii-\nnector", "connector") == [3]
    assert ocr_repair.wrong_lines(3, 5, "con-\nnec+or", "connector") == [5]


def test_neighbours_exact_and_relaxed(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    x[350:] = x[:350] + 0.01 * rng.normal(size=(350, 16))
    rows = [(f"v{i:03}", [float(a) for a in v], None, "c") for i, v in enumerate(x)]
    bad = [("n1", None), ("n2", [0.0] * 16), ("n3", [float("nan")] + [1.0] * 15), ("n4", [1.0] * 15), ("n5", [1.0] * 15 + [None]), ("n6", [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    rows += [(i, v, None, "c") for i, v in bad] + [("v000", [1.0] * 16, dt.datetime(2020, 1, 1), "c"), ("v000", [float(a) for a in x[0]], dt.datetime(2026, 1, 1), "c")]
    df = spark.createDataFrame(rows, "section_id string, vec array<float>, at timestamp, id string")
    u = x.astype("f4").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    want = {f"v{i:03}": {f"v{j:03}" for j in np.argsort(-g[i])[:5]} for i in range(700)}
    for factor, least in ((1.0, 1.0), (None, 0.9)):
        got = {}
        for r in neighbours.nearest(df, "section_id", "vec", 5, 16, factor, "at", shard_rows=200).collect():
            got.setdefault(r.id, set()).add(r.neighbour_id)
        assert set(got) == set(want) and np.mean([len(got[i] & want[i]) / 5 for i in want]) >= least
    assert neighbours.nearest(df.limit(0), "section_id", "vec", 5, 16).count() == 0
    few = neighbours.nearest(df.where("section_id in ('v001', 'v002', 'n2')"), "section_id", "vec", 5, 16).collect()
    assert {(r.id, r.neighbour_id, r.rank) for r in few} == {("v001", "v002", 1), ("v002", "v001", 1)}
    with pytest.raises(ValueError):
        neighbours.nearest(df, "section_id", "vec", factor=0.5)


def test_neighbours_of_vectors_that_repeat(spark):
    """A third of all rows is one vector: its leaf is cut into parts, and every row still has its k neighbours."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).astype("f4")
    x[:300] = x[0]
    df = spark.createDataFrame([(f"v{i:03}", [float(a) for a in v]) for i, v in enumerate(x)], "i string, v array<float>")
    u = neighbours.units(list(x)).astype(float)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    for factor, least in ((1.0, 1.0), (None, 0.9)):
        got = neighbours.nearest(df, "i", "v", 3, 8, factor, shard_rows=60).toPandas()
        assert len(got) == 2700 and not got.duplicated(["id", "neighbour_id"]).any() and set(got["rank"]) == {1, 2, 3}
        third = got[got["rank"] == 3].set_index("id")["cosine"]
        assert np.mean([third[f"v{i:03}"] >= np.sort(g[i])[-3] - 1e-5 for i in range(900)]) >= least


def test_neighbours_default_recall_on_the_test_vectors(spark):
    at = "/root/testdata/sf0.01/knowledge_section.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(at)
    got = neighbours.nearest(rows, "section_id", "embedding", version_col="created_at").toPandas().groupby("id")["neighbour_id"].agg(set)
    last = rows.where(neighbours.usable("embedding", 64)).toPandas().sort_values("created_at").drop_duplicates("section_id", keep="last")
    m, ids = neighbours.units(last.embedding.to_list()), last.section_id.to_numpy()
    g = m @ m.T
    np.fill_diagonal(g, -2)
    assert np.mean([len(got[i] & set(ids[np.argsort(-g[k])[:5]])) / 5 for k, i in enumerate(ids)]) >= 0.9


def test_ties_take_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in ("b", "a", "c")]
    got = neighbours.nearest(spark.createDataFrame(rows, "i string, v array<float>"), "i", "v", 2, 2).where("id = 'c'").orderBy("rank").collect()
    assert [r.neighbour_id for r in got] == ["a", "b"]


def test_scan_decision():
    assert ocr_repair.is_scan("This line breaks\nin the middle of it.") and not ocr_repair.is_scan("One.\nTwo.\nThree.")
    assert not ocr_repair.is_scan("2026-08-19T17:44 INFO took=1\n2026-08-19T17:45 WARN took=2") and ocr_repair.is_scan("1. One.\n2. Two.", "Guide > Scanned pages")
    assert not ocr_repair.is_scan("| a |\n| b |") and not ocr_repair.is_scan("x" * 300 + "\ny") and not ocr_repair.is_scan("")
