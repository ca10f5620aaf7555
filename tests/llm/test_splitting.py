from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from quarry.llm.splitting import Limits, is_oversized, line_count, once, split_chunks, split_oversized, split_text

SCHEMA = "chunk_id long, start_line int, end_line int, text string, piece string"


def line_total(text):
    return 0 if not text else text.count("\n") + (not text.endswith("\n"))


def rebuilt(pieces):
    out, last = [], 0
    for first, end, text, repeated in pieces:
        if repeated:
            lines = text.split("\n")
            lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
            assert 0 < last - first + 1 <= 5
            text = "".join(lines[last - first + 1 :])
        out.append(text)
        last = end
    return "".join(out)


TEXTS = st.lists(st.sampled_from(["", "def f():", "    return 1", "}", "# Head", "word other " * 20, "é" * 400, "x" * 900, "a. b! " * 120, "\r", "ab\rcd", "   "]), max_size=90).flatmap(lambda x: st.sampled_from(["\n", "\r\n"]).map(lambda e: e.join(x)))


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(5, 30), st.sampled_from([50, 700, 3000]))
def test_pieces_fit_and_make_up_the_text(text, lines, size):
    limits = Limits(max_bytes=size, max_lines=lines)
    pieces = split_text(text, limits)
    assert all(len(t.encode()) <= size and line_total(t) <= lines for _, _, t, _ in pieces)
    assert rebuilt(pieces) == text
    if len(text.encode()) > size or line_total(text) > lines:
        assert len(pieces) > 1


def test_cut_at_the_change_of_subject():
    garden = [f"the garden has green plants and water number {i}" for i in range(8)]
    engine = [f"the engine burns fuel under pressure with a piston {i}" for i in range(8)]
    text = "\n".join([*garden[:4], "", *garden[4:], "", *engine[:4], "", *engine[4:]])
    pieces = split_text(text, Limits(max_lines=16))
    assert pieces[0][1] == 10 and "engine" not in pieces[0][2] and pieces[1][0] == 11


def test_overlap_only_without_a_pause():
    text = "\n".join(f"    step {i}" for i in range(70))
    pieces = split_text(text)
    assert [(a, b, o) for a, b, _, o in pieces] == [(1, 30, False), (26, 55, True), (51, 70, True)]
    parts = split_text("One sentence here. " * 400)
    assert len(parts) > 1 and all(p[2].endswith(". ") for p in parts) and all(p[:2] == (1, 1) and not p[3] for p in parts)


def test_table(spark):
    rows = [
        (1, 11, 40, "a\n" * 30, "clash"), (2, 11, 41, "a\n" * 31, "clash"), (3, None, None, "x" * 3001, None), (4, 0, 0, "é" * 1501, None), (5, 1, 1, None, None), (6, 1, 1, "", None),
        (2, 11, 41, "a\n" * 31, "clash"), (None, 1, 1, "b\n" * 40, None), (7, 1, 2, "\n" * 31, None), (8, 1, 2, "a\r\n" * 30 + "b\r", None), (9, 5, 5, "lone\rcr" * 40, None), (10, 3, 9, "line\n" * 4000, None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    pieces = split_oversized(frame).collect()
    assert {r["chunk_id"] for r in split_chunks(split_oversized(frame)).collect()} == {2, 3, 4, 7, 8, 10, None}
    assert [(r["start_line"], r["end_line"]) for r in pieces if r["chunk_id"] == 1] == [(11, 40)]
    assert all(r["start_line"] is None for r in pieces if r["chunk_id"] in (3, 4))
    assert all(r["start_line"] == r["first_line"] + 2 for r in pieces if r["chunk_id"] == 10)
    assert not [r for r in pieces if r["chunk_id"] in (5, 6)]
    counted = frame.select("text", line_count(F.col("text")).alias("n"), is_oversized(F.col("text")).alias("big")).collect()
    for r in counted:
        if r["text"] is not None:
            assert r["n"] == line_total(r["text"]) and r["big"] == (len(r["text"].encode()) > 3000 or r["n"] > 30)
    assert split_oversized(frame.limit(0)).count() == 0


def test_a_pause_among_few_long_lines():
    # Three lines fill a window: the paragraph's end after the second is early, but the only pause there is.
    long = "word " * 180 + "end.\n"
    text = long + long + "\n" + long + long + long
    pieces = split_text(text)
    assert pieces[0][:2] == (1, 2) or pieces[0][:2] == (1, 3)
    assert not pieces[1][3] and all(len(p.encode()) <= 3000 for _, _, p, _ in pieces)


def test_one_row_an_id(spark):
    rows = [(1, 1, "a\nb"), (1, 1, "a\nb"), (2, 1, "c"), (3, None, None)]
    frame = spark.createDataFrame(rows, "chunk_id long, start_line int, text string")
    assert sorted(r["chunk_id"] for r in once(frame).collect()) == [1, 2, 3]
    assert once(frame.limit(0)).count() == 0
