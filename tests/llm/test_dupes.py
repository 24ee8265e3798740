from collections import defaultdict

import pytest

from sparkloom.llm import dupes

SCHEMA = "Id long, Title string, Body string, id2 long, h1 string, copies int"
FIELDS = {"Title": "text", "Body": "text"}

BASE = ("How to use c++ 5.12?", "<p>Some &amp; text</p><ul><li>a: 1</li><li>b: 2</li></ul>")
EQUAL = [
    ("HOW  to use C++ 5.12", "<p>some text</p>\n<ul><li>a 1</li><li>b 2</li></ul>"),
    BASE[::-1],
    ("How to use c++ 5.12?", "<p>Some text</p><ul><li>b: 2</li><li>a: 1</li></ul>"),
    ("[How to use c++ 5.12]\t", "<P>SOME &amp; TEXT</P><UL><LI>A: 1</LI><LI>B: 2</LI></UL>"),
]
OTHER = [
    ("How to use c 5.12?", BASE[1]),
    ("How to use c++ 512?", BASE[1]),
    ("How to use c++ 5.12?", "<p>Some text</p><ul><li>a: 1</li><li>b: 2</li><li>b: 2</li></ul>"),
    ("How to use c++ 5.12?", "<p>Some text</p><ul><li>a: 2</li><li>b: 1</li></ul>"),
    ("How to use c++ 5.12? Some", "<p>text</p><ul><li>a: 1</li><li>b: 2</li></ul>"),
    ("", ""),
]


def make(spark, rows):
    return spark.createDataFrame([(i, t, b, 1, "clash", 2) for i, t, b in rows], SCHEMA)


@pytest.mark.parametrize("row", EQUAL)
def test_equal(row):
    assert dupes.fingerprint(row, ["text", "text"]) == dupes.fingerprint(BASE, ["text", "text"])
    assert dupes.same_fields(row, BASE, ["text", "text"])


@pytest.mark.parametrize("row", OTHER)
def test_other(row):
    assert dupes.fingerprint(row, ["text", "text"]) != dupes.fingerprint(BASE, ["text", "text"])
    assert not dupes.same_fields(row, BASE, ["text", "text"])


def test_accents_and_kinds():
    assert dupes.bare("café") == dupes.canonical("café")[0]
    assert dupes.fingerprint(["a", "b"], ["x", "y"]) != dupes.fingerprint(["b", "a"], ["x", "y"])


def test_found_and_collapsed(spark):
    rows = [(10, *BASE), (10, *BASE), (3, *EQUAL[0]), (7, *EQUAL[1]), (20, *OTHER[0]), (21, None, "x"), (22, None, "x"), (None, *BASE), (30, "", ""), (31, " ", "..."), (40, "z" * 200_000, "y"), (41, "Y", "z" * 200_000)]
    df = make(spark, rows)
    assert {tuple(r) for r in dupes.hidden_duplicates(df, "Id", FIELDS).collect()} == {(10, 3), (7, 3), (31, 30), (41, 40)}
    assert {tuple(r) for r in dupes.collapse_duplicates(df, "Id", FIELDS).collect()} == {(3, 3), (20, 1), (30, 2), (40, 2)}


def test_hot_group(spark):
    rows = [(i, f"Title{'!' * (i % 5)}", "BODY" if i % 2 else "body") for i in range(1, 400)] + [(i, f"t{i}", "b") for i in range(400, 500)]
    got = {tuple(r) for r in dupes.hidden_duplicates(make(spark, rows), "Id", FIELDS).collect()}
    assert got == {(i, 1) for i in range(2, 400)}
    df = make(spark, rows)
    members = dupes.duplicate_groups(df, "Id", FIELDS)
    salted = dupes.verify_groups(dupes.member_texts(df, members, "Id", FIELDS), members, ["text", "text"], per_salt=7)
    assert {(r.id, r.rep) for r in salted.filter("same").collect()} == got


def test_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/questions.parquet")
    groups = defaultdict(set)
    for r in df.dropna(subset=["Title", "Body"]).collect():
        key = frozenset((t, frozenset(items.items())) for t, items in map(dupes.canonical, (r.Title, r.Body)))
        groups[key].add(r.Id)
    want = {(i, min(g)) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in dupes.hidden_duplicates(df, "Id", FIELDS).collect()} == want


def test_an_id_with_two_texts_keeps_its_link(spark):
    """The text an id is grouped by is the one it is compared by, whichever of its two texts that is."""
    texts = [("aa", "b"), ("zz", "y")]
    for other in texts:
        rows = [(1, *texts[0]), (1, *texts[1]), (2, *other)]
        got = {tuple(r) for r in dupes.hidden_duplicates(make(spark, rows), "Id", FIELDS).collect()}
        kept = min(texts, key=lambda t: dupes.fingerprint(t, ["text", "text"]))
        assert got == ({(2, 1)} if other == kept else set())


def test_collisions_neither_make_nor_lose_links(spark, monkeypatch):
    monkeypatch.setattr(dupes, "fingerprint", lambda values, kinds: (1, 2))
    rows = [(i, "abc"[i % 3] + "!" * (i % 2), "x") for i in range(1, 13)] + [(20, "alone", "x")]
    got = {tuple(r) for r in dupes.hidden_duplicates(make(spark, rows), "Id", FIELDS).collect()}
    assert got == {(i, (i - 1) % 3 + 1) for i in range(4, 13)}


def test_empty(spark):
    df = make(spark, [])
    assert dupes.hidden_duplicates(df, "Id", FIELDS).count() == 0
    assert dupes.collapse_duplicates(df, "Id", FIELDS).count() == 0
