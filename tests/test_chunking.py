from hypothesis import given, settings, strategies as st

from quarry.operators.chunking import ChunkLimits, batched_lengths, chunk_text, chunk_texts, plan_batches

RECIPE = """Onion soup
  Slice six onions.
  Let them brown slowly.

    Stir every minute.

Rye bread
  Knead for a while.
  Rest over night.
  Bake until dark.
"""


def spans(text, **limits):
    """Line ranges with limits that do not matter unless given."""
    own = {"min_lines": 1, "max_lines": 40, "overlap": 0, "max_bytes": 9000, "min_characters": 0} | limits
    return [(a, b) for a, b, _ in chunk_text(text, ChunkLimits(**own))]


def test_a_line_as_shallow_as_the_first_begins_the_next_chunk():
    # The indented paragraph of line 5 belongs to the soup; the bread (line 7) is its sibling.
    assert spans(RECIPE) == [(1, 5), (7, 10)]


def test_a_window_that_ends_early_is_cut_at_its_shallowest_seam():
    # Four lines reach to line 5: no sibling there, but a deeper seam. The rest begins with that line.
    assert spans(RECIPE, max_lines=4) == [(1, 3), (5, 5), (7, 10)]
    # The same window over a text that ends within it is left whole.
    assert spans("Onion soup\n\n    Stir every minute.\n", max_lines=4) == [(1, 3)]


def test_seams_too_near_to_the_start_are_passed_over_unless_they_are_headings():
    errands = "post office\n\nbaker\n\nlibrary\n\ntailor\n"
    assert spans(errands, min_lines=3) == [(1, 3), (5, 7)]
    assert spans("post office\n\n# Baker\n\nlibrary\n", min_lines=4) == [(1, 1), (3, 5)]
    # What follows a heading is not parted from it.
    assert spans("# Errands\n\npost office\n\nbaker\n") == [(1, 3), (5, 5)]


def test_closing_lines_begin_nothing():
    settings_file = "server = [\n  8080,\n\n];\n\nname = demo\n"
    assert spans(settings_file) == [(1, 4), (6, 6)]


def test_without_a_seam_windows_overlap():
    verses = "\n".join(f"verse {i}" for i in range(1, 13))
    assert spans(verses, max_lines=5, overlap=2) == [(1, 5), (4, 8), (7, 11), (10, 12)]
    # An overlap of the whole window would not move on: it moves by a line.
    assert spans("a\nb\nc\n", max_lines=2, overlap=2) == [(1, 2), (2, 3)]


def test_thin_chunks_join_a_neighbour():
    assert spans("ab\n\nabcdefgh\n\nabcdefgh\n", min_characters=5) == [(1, 3), (5, 5)]
    assert spans("abcdefgh\n\nab\n", min_characters=5) == [(1, 3)]
    # Not beyond the byte limit: 12 bytes hold no two of them.
    assert spans("ab\n\nabcdefgh\n\nab\n", min_characters=5, max_bytes=11) == [(1, 1), (3, 3), (5, 5)]


def test_bytes_limit_lines_and_parts_of_a_line():
    assert spans("twelve bytes\ntwelve bytes\ntwelve bytes", max_bytes=30) == [(1, 2), (3, 3)]
    pieces = chunk_text("žluťoučký", ChunkLimits(1, 5, 0, 4, 0))  # two bytes a marked letter
    assert [p for _, _, p in pieces] == ["žlu", "ťou", "čk", "ý"] and {a for a, _, _ in pieces} == {1}
    assert [p for _, _, p in chunk_text("🙂🙂", ChunkLimits(1, 5, 0, 3, 0))] == ["🙂", "🙂"]


def test_blank_texts_and_line_ends():
    assert chunk_text("") == chunk_text(" \n\t\r\n　\n") == []
    assert chunk_text("\n\nlate\r\nlater\r\n\r\n") == [(3, 4, "late\nlater")]
    assert chunk_text("one\rline") == [(1, 1, "one\rline")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["", "  ", "x = 1", "    y = 2", "# H", "}", "word " * 30, "é" * 50]), max_size=60).map("\n".join), st.integers(1, 6), st.integers(6, 12), st.integers(0, 5))
def test_chunks_hold_every_line_that_is_not_blank(text, low, high, overlap):
    chunks = chunk_text(text, ChunkLimits(low, high, overlap, 200, 5))
    covered = {n for a, b, _ in chunks for n in range(a, b + 1)}
    assert {i for i, line in enumerate(text.split("\n"), 1) if line.strip()} <= covered
    assert [a for a, _, _ in chunks] == sorted(a for a, _, _ in chunks)
    assert all(len(t.encode()) <= 201 for _, _, t in chunks)


def test_batches():
    assert plan_batches([5000, 10], 1000) == [[1], [0]]
    assert plan_batches([], 10) == []
    assert plan_batches([3, 3, 3, 3], 6) == [[0, 1], [2, 3]]


def test_tables(spark):
    rows = spark.createDataFrame([(1, "one\n\ntwo\n"), (2, None), (3, ""), (4, "x" * 7000)], "id long, text string")
    found = chunk_texts(rows, "id").collect()
    assert {r["id"] for r in found} == {1, 4} and sum(r["id"] == 4 for r in found) == 3
    lengths = batched_lengths(rows.selectExpr("id", "length(text) as n"), "id", "n", 10)
    assert lengths.count() == 4
    assert chunk_texts(rows.limit(0), "id").count() == 0
