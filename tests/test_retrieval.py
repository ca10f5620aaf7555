import math

import pytest

from pyspark.sql import functions as F

from quarry.functions import encoders, render, segments, text, vectors
from quarry.operators import catalog, retrieval
from quarry.operators.batch_search import batch_topk


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_floor(spark):
    def floor(values, spread):
        ranked = spark.createDataFrame([(1, i, v) for i, v in enumerate(values, 1)], "query_id int, rank int, similarity double")
        return retrieval.relevance_floor(ranked, spark.createDataFrame([(1, spread)], "query_id int, spread double")).first()["floor"]

    assert floor([0.723, 0.723, 0.694, 0.69, 0.689], 0.026) == 0.723
    assert floor([0.7, 0.69, 0.68, 0.67], 0.026) is None
    assert floor([0.9, 0.5], 0.0) is None
    assert floor([0.9], 0.1) is None
    assert floor([0.9, 0.8, 0.7], 0.1) == 0.8  # the last of equal drops, within rounding
    assert floor([0.5] * 20 + [0.1], 0.1) is None  # beyond the ranks looked at


def test_query_terms(spark):
    assert one(spark, text.keyword_query(F.lit("retry_with_backoff, a HTTP!"))) == '"retry_with_backoff" AND "http"'
    assert one(spark, text.keyword_query(F.lit("a b"))) is None
    assert one(spark, text.query_terms(F.lit("Été été x"))) == ["été"]


def test_fusion_keeps_ids_of_weight_zero(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id int, chunk_id long, rank int")
    rows = retrieval.reciprocal_rank_fusion((a, F.lit(1.0)), (b, F.lit(0.0))).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in rows] == [10, 11, 12] and rows[2]["fused"] == 0
    rows = retrieval.reciprocal_rank_fusion((a, F.lit(1.0)), (b, F.lit(1.0))).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in rows] == [11, 10, 12]


RESULT = "query_id int, fused_rank int, chunk_id long, path string, kind string, page int, start_line int, end_line int, start_ms long, end_ms long"


def test_suppression(spark):
    rows = [
        (1, 1, 1, "a", "text", None, 1, 10, None, None), (1, 2, 2, "a", "text", None, 8, 17, None, None), (1, 3, 3, "a", "text", None, 15, 20, None, None), (1, 4, 4, "b", "pdf", 1, 1, 5, None, None),
        (1, 5, 5, "b", "pdf", 2, 1, 5, None, None), (1, 6, 6, "c", "video", None, None, None, 0, 9000), (1, 7, 7, "c", "audio", None, None, None, 8999, 30000), (1, 8, 8, "c", "audio", None, None, None, 9000, 30000),
        (1, 9, 9, "a", "image", None, None, None, None, None), (2, 1, 1, "a", "text", None, 1, 10, None, None),
    ]
    kept = retrieval.suppress_overlaps(spark.createDataFrame(rows, RESULT), F.lit(10)).collect()
    assert sorted((r["query_id"], r["chunk_id"]) for r in kept) == [(1, 1), (1, 3), (1, 4), (1, 5), (1, 6), (1, 8), (2, 1)]
    assert retrieval.suppress_overlaps(spark.createDataFrame(rows, RESULT), F.lit(2)).filter("query_id = 1").count() == 2
    best = retrieval.best_per_file(spark.createDataFrame(rows, RESULT)).filter("query_id = 1").collect()
    assert sorted(r["chunk_id"] for r in best) == [1, 4, 6]


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(1, "red green green"), (2, "red blue"), (3, ""), (4, None), (5, "Gréen red x")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "green RED"), (2, "x"), (3, None), (4, "nowhere red")], "query_id int, query_text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.keyword_scores(chunks, queries).collect()}
    assert set(got) == {(1, 1), (1, 5)}
    mean = (3 + 2 + 0 + 0 + 3) / 5
    idf = lambda df: max(math.log((5 - df + 0.5) / (df + 0.5)), 0) or 1e-6
    part = lambda i, tf, n: i * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert got[1, 1] == pytest.approx(part(idf(2), 2, 3) + part(idf(3), 1, 3))


def test_batch_search_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    vectors_ = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 5), (903, [1.0] * 5)]
    vectors_.append((950, vectors_[3][1]))  # a copy: the higher id comes first
    rows = spark.createDataFrame(vectors_, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in vectors_[:7]] + [(900, None), (902, [1.0] * 5)], "query_id long, embedding array<float>")
    got = {}
    for r in batch_topk(rows, queries, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    for q, v in vectors_[:7]:
        want = sorted(((round(sum(a * b for a, b in zip(v, w)), 4), i) for i, w in vectors_ if w and len(w) == 8), reverse=True)[:5]
        assert [got[q][k] for k in range(1, 6)] == [i for _, i in want]
    assert set(got[902].values()) == {902, 903} and 900 not in got
    out = queries.selectExpr("query_id", "query_id as chunk_id")
    assert batch_topk(rows, queries, 5, excluded=out).filter("query_id = chunk_id").count() == 0
    assert batch_topk(rows, queries.limit(0), 5).count() == 0


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0))
    assert one(spark, vectors.truncate_and_normalize(a, 2)) == [0.6, 0.8]
    assert one(spark, vectors.normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vectors.dot(a, F.slice(a, 1, 2))) is None
    assert one(spark, vectors.root_mean_square(F.array().cast("array<double>"))) == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [-1.0, 0.0])], "file_id int, embedding array<double>")
    means = {r["file_id"]: r["embedding"] for r in retrieval.mean_direction(rows).collect()}
    assert means[1] == pytest.approx([0.5**0.5] * 2) and means[2] == [0, 0]


def test_moments_and_percentiles(spark):
    scored = spark.createDataFrame([(float(x) / 100,) for x in range(100)], "similarity double")
    m = retrieval.similarity_moments(scored).first()
    assert (m["n"], round(m["mean"], 6)) == (100, 0.495)
    assert {r["fraction"]: r["similarity"] for r in retrieval.percentiles_by_rank(scored).collect()} == {0.5: 0.5, 0.9: 0.9, 0.99: 0.99}
    empty = retrieval.similarity_moments(scored.limit(0)).first()
    assert (empty["n"], empty["mean"], empty["spread"]) == (0, 0.0, 0.0)


def test_bag_of_words_agrees(spark):
    doc = "Der Kessel kocht, der Garten_ruht 12"
    by_column = one(spark, encoders.bag_of_words(F.lit(doc)))
    assert by_column == pytest.approx(encoders.BagOfWords().encode_query(doc))
    rows = encoders.bag_of_words_table(spark.createDataFrame([(1, doc), (2, ""), (3, None)], "doc_id long, text string"), "doc_id").collect()
    assert {r["doc_id"] for r in rows} == {1} and all(by_column[r["bucket"]] == pytest.approx(r["weight"]) for r in rows)


def test_scopes_and_roots(spark):
    paths = spark.createDataFrame([("/work/a",), ("/workshop/b",), ("/work",), ("/x%/y",)], "path string")
    assert {r["path"] for r in paths.filter(catalog.in_scope(F.col("path"), "/work")).collect()} == {"/work/a", "/work"}
    assert paths.filter(catalog.in_scope(F.col("path"), "/")).count() == 4
    roots = spark.createDataFrame([("/p/photos/2024", 1), ("/p/photos", 5), ("/p/photos/", 7), ("/p/photos2", 2), (None, 3)], "path string, indexed_at long")
    assert sorted((r["path"], r["merged"], r["indexed_at"]) for r in catalog.merge_roots(roots).collect()) == [("/p/photos", 1, 7), ("/p/photos2", 0, 2)]


def test_reconcile(spark):
    kind = "path string, size long, modified_nanoseconds long, content_hash string"
    found = spark.createDataFrame([("new", 1, 1, "a"), ("same", 1, 1, "x"), ("touched", 1, 2, "t"), ("changed", 1, 2, "c2"), ("unhashed", 2, 2, None)], kind)
    indexed = spark.createDataFrame([("same", 1, 1, "y"), ("touched", 1, 1, "t"), ("changed", 1, 1, "c1"), ("unhashed", 1, 1, "u"), ("gone", 1, 1, "g")], kind)
    states = catalog.reconcile(found, indexed)
    assert {r["path"]: r["state"] for r in states.collect()} == {"new": "new", "same": "unchanged", "touched": "touched", "changed": "modified", "unhashed": "modified", "gone": "deleted"}
    assert catalog.pending_changes(states).first()["updates_itself"]


def test_spans(spark):
    spans = lambda e: [(s["start_ms"], s["end_ms"]) for s in one(spark, e)]

    def by_loop(duration, window, hop):
        out, start, covered = [], 0, 0
        while start + window <= duration:
            out.append((start, start + window))
            covered, start = start + window, start + hop
        if covered < duration:
            out.append((start, duration))
        return [s for s in out if s[1] - s[0] >= segments.SHORTEST_AUDIO]

    for duration in (0, 500, 1000, 29_999, 30_000, 30_001, 55_000, 55_001, 80_000, 123_456):
        assert spans(segments.audio_windows(F.lit(duration))) == by_loop(duration, 30_000, 25_000), duration
    assert spans(segments.video_segments(F.lit(20_000))) == [(0, 9000), (9000, 18000), (18000, 20000)]
    assert spans(segments.video_segments(F.lit(0))) == []
    assert tuple(one(spark, segments.fit_within(F.lit(4000), F.lit(3000), 768))) == (768, 576)
    assert tuple(one(spark, segments.fit_within(F.lit(10), F.lit(5000), 768))) == (2, 768)
    assert one(spark, segments.to_milliseconds(F.lit(1.2345))) == 1235 and one(spark, segments.to_milliseconds(F.lit(-3.0))) == 0


def test_told_texts(spark):
    assert one(spark, text.time_range(F.lit(8.0), F.lit(17.4))) == "0:08-0:17"
    assert one(spark, text.timestamp(F.lit(3723.0))) == "1:02:03"
    assert [one(spark, text.readable_size(F.lit(n))) for n in (0, 1, 3500, 999_999, 274_999_999)] == ["0 KB", "1 KB", "4 KB", "1000 KB", "274 MB"]
    assert [one(spark, text.readable_age(F.lit(n))) for n in (-5, 59, 60, 7200, 86400 * 3)] == ["just now", "just now", "1 minute ago", "2 hours ago", "3 days ago"]
    assert render.file_uri("/My Docs/é.pdf") == "file:///My%20Docs/%C3%A9.pdf" and render.file_uri("\\\\host\\a b") == "file://host/a%20b"
    lines = one(spark, text.numbered_lines(F.lit(7), F.lit("    a  \r\n\n      b" + "x" * 200)))
    assert [(x["line_number"], x["line"][:4], len(x["line"])) for x in lines] == [(7, "a", 1), (8, "", 0), (9, "  bx", 161)]
    assert one(spark, text.display_path(F.lit("/a/b/c"), "/a/b")) == "c" and one(spark, text.display_path(F.lit("/a/bc"), "/a/b")) == "/a/bc" and one(spark, text.display_path(F.lit("/a"), "/a")) == "."
    kinds = {"a.TS": "text", "b.ogg": "audio", "c.JPG": "image", "d.pdf": "pdf", "e.mkv": "video", "noending": "text", "x/.jpg": "image"}
    assert {p: one(spark, text.kind_of_path(F.lit(p))) for p in kinds} == kinds


def test_hits_by_line_page_and_second(spark):
    from quarry.operators.evaluation import recall_at

    results = spark.createDataFrame(
        [(1, 1, "a", 5, 9, None, None, None), (2, 1, "b", 1, 4, None, None, None), (3, 1, "p", None, None, 2, None, None), (4, 1, "m", None, None, None, 1000, 4000), (5, 1, "z", None, None, None, None, None), (6, 1, "q", 1, 2, None, None, None), (6, 2, "a", 1, 2, None, None, None)],
        "query_id long, place int, path string, start_line int, end_line int, page int, start_ms long, end_ms long",
    )
    labels = spark.createDataFrame(
        [(1, "a", None, 7, None, None), (2, "b", None, 9, None, None), (3, "p", None, None, 2, None), (4, "m", None, None, None, 4.0), (5, "y", ["z"], None, None, None), (6, "a", None, None, None, None), (7, "a", None, None, None, None)],
        "query_id long, expected string, also_correct array<string>, expected_line int, expected_page int, expected_seconds double",
    )
    assert [tuple(r)[:2] for r in recall_at(results, labels).collect()] == [(7, 4)]
    assert [tuple(r)[:2] for r in recall_at(results, labels, 2).collect()] == [(7, 5)]
    assert tuple(recall_at(results, labels.limit(0)).first()) == (0, 0, 0.0)


def test_file_uris(spark):
    from quarry.functions.render import file_uri, file_uris

    paths = ["/a b/c*d~e/ü+%.txt", "//host/share/x y", "C:\\Users\\x", "/", "rel/a", None]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(file_uris(F.col("path"))).collect()
    assert [r[0] for r in rows] == [file_uri(p) for p in paths]


def test_topk_and_moments_against_all_pairs(spark):
    import random
    import statistics

    from quarry.operators.batch_search import spread_of_moments, topk_and_moments

    rng = random.Random(2)
    one_of = lambda: [rng.choice([-1.0, 0.0, 0.5]) for _ in range(4)]  # many equal similarities
    rows = [(i, rng.choice(["text", "pdf", None]), one_of()) for i in range(500)] + [(600, "text", None), (601, "text", [1.0, None, 0.0, 0.0]), (602, None, [1.0]), (603, None, [1.0])]
    queries = [(i, one_of(), "text" if i % 3 == 0 else None) for i in range(20)] + [(30, [2.0], None), (31, None, None), (32, [1.0] * 4, "audio"), (33, [1.0] * 5, None)]
    found = topk_and_moments(spark.createDataFrame(rows, "chunk_id long, kind string, embedding array<float>").repartition(3), spark.createDataFrame(queries, "query_id long, asked array<float>, wanted string"), 7)
    each = found.select("query_id", F.explode(F.arrays_zip("ids", "similarities")).alias("x")).select("query_id", F.col("x.ids").alias("chunk_id"), F.col("x.similarities").alias("similarity"))
    got = {}
    for r in retrieval.top_per_query(each, 7, F.desc("similarity"), F.desc("chunk_id")).collect():
        got.setdefault(r["query_id"], []).append((r["similarity"], r["chunk_id"]))
    spreads = {r["query_id"]: r["spread"] for r in spread_of_moments(found).collect()}
    for q, v, kind in queries:
        pairs = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, k, w in rows if v and w and None not in w and len(w) == len(v) and kind in (None, k)), reverse=True)
        assert sorted(got.get(q, []), reverse=True) == pairs[:7]
        assert spreads.get(q, 0) == pytest.approx(statistics.pstdev([s for s, _ in pairs]) if pairs else 0)
    strange = spark.createDataFrame([(i, None, [float(i), 0.0]) for i in range(9)] + [(9, None, [math.nan, 0.0]), (10, None, [math.inf, 0.0])], "chunk_id long, kind string, embedding array<float>").coalesce(1)
    assert topk_and_moments(strange, spark.createDataFrame([(1, [1.0, 0.0], None)], "query_id long, asked array<float>, wanted string"), 3).first()["ids"] == [9, 10, 8]
