import datetime as dt
import random

from pyspark.sql import functions as F

from quarry.llm.handwritten import FEATURES, file_features, judge, measure, notices

CHUNKS = "chunk_id long, file_id long, kind string, start_line int, text string, path string"
FILES = "file_id long, path string, recorded_at timestamp, text string"
NAMES = "garden kettle tunnel engine window signal harbour ticket planet copper".split()


def hand(rng):
    out = []
    for _ in range(rng.randint(3, 9)):
        a, b, c, d = rng.sample(NAMES, 4)
        out += [f"def {a}_{b}({c}, {d}):", f"    # the {d} may be missing", f"    if not {d}:", f"        raise ValueError('{a} without {d}')", f"    {b} = load_{c}({d}, {c})", f"    return {b}.{a}", ""]
    return "\n".join(out)


def made(rng):
    a = rng.choice(NAMES)
    return "\n".join(f"def get_{a}_{i}(self):\n    return self.slots[{i}]" for i in range(rng.randint(15, 40)))


def minified(rng):
    return "".join(f"function {rng.choice('abcdefg')}({rng.choice('xyz')},n){{return n[{rng.randint(1, 99)}]||{rng.choice('xyz')}(n)}}var q={rng.choice('abc')}.b;" for _ in range(30))


def data(rng):
    return "TABLE = [\n" + "\n".join("    " + ", ".join(f"0x{rng.randint(0, 255):02x}" for _ in range(12)) + "," for _ in range(25)) + "\n]"


def tables(spark, seed=1):
    rng, files, chunks, truth = random.Random(seed), [], [], {}
    notice = ["# Code generated by toolx. DO NOT EDIT.", "// @generated by toolx from a.schema", "# Automatisch erzeugt von toolx - nicht von Hand bearbeiten."]
    for i in range(1, 241):
        kind = ("hand", "hand", "hand", "made", "min", "data", "vendored", "made-bare")[i % 8]
        path, text = f"/p/src/{rng.choice(NAMES)}_{i}.py", hand(rng)
        if kind == "made":
            text = rng.choice(notice) + "\n" + made(rng)
        elif kind == "made-bare":
            text = made(rng)
        elif kind == "min":
            path = f"/p/web/{rng.choice(NAMES)}_{i}" + rng.choice([".min.js", ".js"])
            text = ("/*! toolx 3.1 */" if rng.random() < 0.6 else "") + minified(rng)
        elif kind == "data":
            text = data(rng)
        elif kind == "vendored":
            path = f"/p/{rng.choice(['third_party', 'node_modules'])}/zib/{rng.choice(NAMES)}_{i}.py"
            text = ("# Zib 2.1.0 - https://zib.example - released under the Reed Licence\n" if rng.random() < 0.7 else "") + text
        files.append((i, path, dt.datetime(2026, 1, 2), "clash"))
        for k, part in enumerate([text]):
            chunks.append((i * 10 + k, i, rng.choice(["text", "TEXT", None]), 1 + k * 30, part, "clash"))
        truth[i] = kind != "hand"
    return files, chunks, truth


def test_held_out_kinds(spark):
    files, chunks, truth = tables(spark)
    files += [(500, "/p/docs/handbook.md", dt.datetime(2026, 1, 2), None), (501, "/p/src/codegen/emit.py", dt.datetime(2026, 1, 2), None), (1, "/p/third_party/zib/old.py", dt.datetime(2025, 1, 1), None), (502, None, dt.datetime(2026, 1, 1), None), (503, "/p/src/empty.py", dt.datetime(2026, 1, 1), None)]
    chunks += [(9000, 500, "text", 1, "Code generated by hand. DO NOT EDIT.", None), (9001, 501, "text", 1, "# Do not edit the order of this list before asking.\n" + hand(random.Random(9)), None), (9002, 503, "text", 1, None, None), (9003, None, "text", 1, "x", None), (9004, 777, "text", 1, "x = 1", None), chunks[0]]
    found = judge(file_features(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(files, FILES))).collect()
    got = {r["file_id"]: r["not_handwritten"] for r in found}
    assert set(got) == set(truth) | {501} and not got[501]
    wrong = [i for i, t in truth.items() if got[i] != t]
    assert len(wrong) <= 0.02 * len(truth), wrong


def test_without_labels_notices_decide(spark):
    files = spark.createDataFrame([(1, "/a/x.py", dt.datetime(2026, 1, 1), None), (2, "/a/y.py", dt.datetime(2026, 1, 1), None)], FILES)
    chunks = spark.createDataFrame([(1, 1, "text", 1, "# Code generated by t. DO NOT EDIT.\nx = 1", None)], CHUNKS)
    assert [r["not_handwritten"] for r in judge(file_features(chunks, files)).collect()] == [True]
    assert judge(file_features(chunks.limit(0), files)).count() == 0


def test_notices_are_hidden_from_the_measures():
    tool, others, kept = notices(["# Code generated by t. DO NOT EDIT.", "x = 1"])
    assert (tool, others, kept) == (True, False, ["x = 1"])
    assert notices(["/*! lib 1.2 */var a=1"])[1:] == (True, ["var a=1"])
    assert notices(["# Copyright the owners of this repository. Internal use."])[:2] == (False, False)
    assert notices(["# ref 0.576", "// see kettle 2.4.1"])[:2] == (False, False)
    assert notices(["-- zib 2.4.1 | all of it"])[:2] == (False, True)
    assert notices(['print("Code generated by me")'])[:2] == (False, False)
    assert notices(["# Code generated by t. DO NOT EDIT."], 15)[0] is False and notices(["x = 1", "# Code generated by t. DO NOT EDIT."], 13)[0] is True
    assert notices(["// " + "x" * 400 + " @generated by t"])[0] is True
    assert measure([""])[0] == 0
    assert not any("literal" in f for f in FEATURES)


def test_the_forest_alone(spark):
    files, chunks, truth = tables(spark, 4)
    features = file_features(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(files, FILES)).cache()
    rows = judge(features).collect()
    # No file is called made by the forest without reason; most of what has no notice is found, though half the kind has none.
    assert sum(r["by_forest"] and not truth[r["file_id"]] for r in rows) <= 3
    bare = [r for r in rows if truth[r["file_id"]] and not r["by_notice"]]
    assert sum(r["by_forest"] for r in bare) >= 0.85 * len(bare)
    # A forest has not seen the label of what it scores: without its notice a file gets much the same score.
    one = next(r for r in rows if r["by_notice"] and r["score"] > 0.9)
    again = judge(features.withColumn("tool", F.col("tool") & (F.col("file_id") != one["file_id"])).withColumn("others", F.col("others") & (F.col("file_id") != one["file_id"])))
    assert again.filter(F.col("file_id") == one["file_id"]).first()["score"] > 0.5


def test_swapped_line_numbers_hide_no_header(spark):
    notice = "# Code generated by t. DO NOT EDIT.\n"
    files = spark.createDataFrame([(i, f"/a/x{i}.py", dt.datetime(2026, 1, 1), None) for i in range(1, 5)], FILES)
    rows = [(1, 1, "text", 23, 1, notice + "x = 1"), (2, 2, "text", 30, 40, notice + "x = 1"), (3, 3, "text", None, 24, notice + "x = 1"), (4, 4, "text", 23, None, notice + "x = 1")]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_id long, kind string, start_line int, end_line int, text string")
    got = {r["file_id"]: (r["tool"], r["n_lines"]) for r in file_features(chunks, files).collect()}
    assert got == {1: (True, 1), 2: (False, 2), 3: (True, 1), 4: (False, 2)}


def test_an_oversized_body_counts(spark):
    files, chunks, truth = tables(spark)
    rng = random.Random(3)
    for i in range(600, 604):
        files.append((i, f"/p/src/kettle_{i}.js", dt.datetime(2026, 1, 2), None))
        chunks += [(i * 100, i, "text", 1, hand(rng), None), (i * 100 + 1, i, "text", 31, "".join(minified(rng) for _ in range(6)), None)]
    found = judge(file_features(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(files, FILES))).collect()
    got = {r["file_id"]: r["not_handwritten"] for r in found}
    assert all(got[i] for i in range(600, 604))
