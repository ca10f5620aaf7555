import duckdb
import pytest

from quarry.llm.lookalike import LOOK_ALIKES, canonical_sql, look_alikes, lookalike_classes, lookalike_pairs, several_forms, single_forms, with_canonical

DOCS = "doc_id long, text string, canonical string"
CONNECTION = duckdb.connect()
SQL = canonical_sql("t")


def form(text):
    return CONNECTION.execute(f"SELECT {SQL} FROM (SELECT ?::VARCHAR AS t)", [text]).fetchone()[0]


ALIKE = [
    ("turbinе", "turbine"), ("ﬁlter", "filter"), ("a​b⁠", "ab"), ("é", "é"), ("Ｃｏｍ（１）", "Com(1)"), ("𝗐𝖺𝗌", "was"), ("a\r\nb", "a\nb"), ("a b　c d", "a b c d"), ("ⅾo ⅱ", "do ii"),
    ("non‑break", "non-break"), ("ё", "ë"), ("Kelbring", "Kelbring"), ("ό", "ó"), ("οne", "one"), ("e​́", "é"), ("ｶﾞ", "ガ"), ("so­ft", "soft"), ("Μissing Ѕtring", "Missing String"), ("exp օrt", "exp ort"), ("﻿x", "x"),
]
DIFFERENT = [("5²1", "521"), ("A", "a"), ("é", "e"), ("👩🏽‍💻", "👩🏽💻"), ("x–y", "x-y"), ("a b", "ab"), ("a\nb", "a b"), ("a\n\nb", "a\nb"), ("①", "1"), ("½", "1⁄2"), ("‘a’", "'a'"), ("…", "..."), ("ſ", "s"), ("0", "O"), ("1", "l"), ("ж", "x"), ("№", "No.")]


@pytest.mark.parametrize("a, b", ALIKE)
def test_looks_the_same(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_looks_different(a, b):
    assert form(a) != form(b)


def test_one_form():
    assert form(None) is None and form("") == "" and form("plain 'text'") == "plain 'text'"
    for a, b in ALIKE:
        assert form(form(a)) == form(a)
    source, target = single_forms()
    assert len(source) == len(target) == len(set(source)) and all(form(t) == t for t in set(target) if t not in "\r")
    assert several_forms()["ﬁ"] == "fi"


def test_pairs(spark):
    rows = [(1, "one turbine", "clash"), (2, "οne turbine", None), (3, "one turbine", None), (4, "One turbine", None), (5, None, None), (6, "", None), (7, " \n", None), (8, "  ", None), (9, "​", None), (10, "x" * 80_000 + "ﬁ", None), (11, "x" * 80_000 + "fi", None), (12, "one  turbine", None), (2, "οne turbine", None), (None, "one turbine", None)]
    frame = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in lookalike_pairs(frame).collect()} == {(1, 2), (2, 3), (10, 11)}
    assert with_canonical(frame).count() == len(rows)
    assert lookalike_pairs(frame.limit(0)).count() == 0


def test_a_large_group_of_copies_makes_no_pairs(spark):
    frame = spark.range(20_000).selectExpr("id as doc_id", "if(id = 7, 'сopy', 'copy') as text", "'' as canonical")
    pairs = lookalike_pairs(frame)
    assert pairs.count() == 19_999
    assert lookalike_pairs(frame.filter("doc_id <> 7")).count() == 0


def test_the_public_table(spark):
    table = dict(look_alikes(spark))
    # All of the small table follow from the rule, and more do; letters that their readers tell apart stay apart.
    assert all(table[c] == to for c, to in LOOK_ALIKES.items()) and len(table) > 150
    assert {c: table.get(c) for c in "ɑναսհᎪꓮ"} == dict(zip("ɑναսհᎪꓮ", "avauhAA"))
    assert not {"ı", "σ", "ß", "ж", "0", "é", "l", "ո"} & set(table) and table["ο"] == "o"
    sql = canonical_sql("t", look_alikes(spark))
    one = lambda t: CONNECTION.execute(f"SELECT {sql} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0]
    assert one("ԝaνe սp") == "wave up"
    assert all(one(a) == one(b) for a, b in ALIKE) and all(one(a) != one(b) for a, b in DIFFERENT)


def test_classes(spark):
    rows = [(5, "one turbine", "clash"), (2, "οne turbine", None), (3, "one turbine", None), (4, "One turbine", None), (7, "οne turbine", None), (5, "one turbine", None), (9, None, None), (None, "оne turbine", None)]
    frame = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in lookalike_classes(frame).collect()) == [(2, 2, 2), (3, 2, 3), (5, 2, 3), (7, 2, 2)]
    assert lookalike_classes(frame.limit(0)).count() == 0
