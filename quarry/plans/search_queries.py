"""Queries on retrieval: vectors, keywords, fusion, cutoff, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quarry.functions import encoders, text, vectors
from quarry.operators import catalog, retrieval
from quarry.operators.batch_search import batch_topk, spread_of_moments, topk_and_moments
from quarry.session import shared_folder, table, wide_table

SCOPE = "/home/tel/code"
#: One of a hundred rows is a query.
EACH = 100


def _six(column: str):
    return F.round(column, 6).alias(column)


def query_vector(spark: SparkSession, sf: str):
    """The vector of the first row of ``embeddings``, as a literal: one row is read."""
    row = table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()
    return vectors.literal_vector(row["embedding"])


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.clean_chunks(table(spark, sf, "chunks"))


def _chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """With repeated rows, as what follows counts an id once: so vectors aren't shuffled to find the repeats."""
    return catalog.with_known_kind(wide_table(spark, sf, "chunks", "chunk_id", "file_id", "kind", "embedding")).filter("chunk_id is not null")


def _distinct_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.clean_chunks(table(spark, sf, "chunks").select("chunk_id", "file_id", "kind", "embedding"))


def vector_topk(spark, sf):
    top = retrieval.vector_topk(table(spark, sf, "embeddings"), query_vector(spark, sf), 10, "vec_id")
    return top.select("vec_id", _six("similarity"))


def vector_topk_kind(spark, sf):
    rows = _chunk_vectors(spark, sf).filter("kind = 'pdf'")
    return retrieval.vector_topk(rows, query_vector(spark, sf), 10, repeats=True).select("chunk_id", _six("similarity"))


def vector_topk_scope(spark, sf):
    rows = _chunk_vectors(spark, sf)
    rows = catalog.chunks_with_path(rows, table(spark, sf, "files")).filter(catalog.in_scope(F.col("path"), SCOPE))
    return retrieval.vector_topk(rows, query_vector(spark, sf), 10, repeats=True).select("chunk_id", _six("similarity"))


def _query_set(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").filter(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk_batch(spark, sf):
    found = batch_topk(_chunk_vectors(spark, sf), _query_set(spark, sf), 10)
    return found.select("query_id", "chunk_id", _six("similarity"), "rank")


def _scored(spark, sf) -> DataFrame:
    scored = retrieval.similarities(_chunk_vectors(spark, sf), query_vector(spark, sf))
    return scored.groupBy("chunk_id").agg(F.max("similarity").alias("similarity"))


def background_stats(spark, sf):
    return retrieval.similarity_moments(_scored(spark, sf)).select("n", _six("mean"), _six("spread"))


def standard_score(spark, sf):
    return retrieval.standard_scores(_scored(spark, sf)).select("chunk_id", _six("standard_score"))


def similarity_percentiles(spark, sf):
    return retrieval.percentiles_by_rank(_scored(spark, sf)).select("fraction", _six("similarity"))


def truncate_normalize(spark, sf):
    each = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.truncate_and_normalize(F.col("embedding"), 16)).alias("pos", "value"))
    return each.select("vec_id", "pos", _six("value"))


def mean_direction(spark, sf):
    rows = _distinct_vectors(spark, sf).filter("file_id is not null and embedding is not null")
    means = retrieval.mean_direction(retrieval.of_usual_length(rows))
    return means.select("file_id", F.posexplode("embedding").alias("pos", "value")).select("file_id", "pos", _six("value"))


def similar_to_example(spark, sf):
    """X-6, PR-5, PR-7: the chunks most like every hundredth file as a whole, without the file's own."""
    rows = _chunk_vectors(spark, sf).filter("file_id is not null and embedding is not null")
    own = catalog.clean_chunks(rows.filter(F.col("file_id") % EACH == 0))
    examples = retrieval.mean_direction(retrieval.of_usual_length(own)).withColumnRenamed("file_id", "query_id")
    return batch_topk(rows, examples, 10, excluded=own.select(F.col("file_id").alias("query_id"), "chunk_id")).select("query_id", "chunk_id", _six("similarity"), "rank")


def query_terms(spark, sf):
    each = table(spark, sf, "search_queries").select("query_id", F.posexplode(text.query_terms(F.col("query_text"))).alias("pos", "term"))
    return each.select("query_id", "pos", "term")


def keyword_strings(spark, sf):
    return table(spark, sf, "search_queries").select("query_id", text.keyword_query(F.col("query_text")).alias("keywords"), text.query_prompt(F.col("query_text")).alias("prompt"))


def token_stats(spark, sf):
    tokens = text.words(F.col("text"))
    return wide_table(spark, sf, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.size(tokens).alias("tokens"), F.size(F.array_distinct(tokens)).alias("terms"))


def _keyword_scores(spark, sf) -> DataFrame:
    return retrieval.keyword_scores(wide_table(spark, sf, "chunks", "chunk_id", "text"), table(spark, sf, "search_queries").select("query_id", "query_text"))


def keyword_match_all(spark, sf):
    return _keyword_scores(spark, sf).select("query_id", "chunk_id")


def bm25_topk(spark, sf):
    scored = _keyword_scores(spark, sf).withColumn("score", F.round("score", 9))
    return retrieval.top_per_query(scored, retrieval.CANDIDATES, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", _six("score"), "rank")


def bow_embedding(spark, sf):
    return encoders.bag_of_words_table(table(spark, sf, "documents"), "doc_id").select("doc_id", "bucket", _six("weight"))


def _candidates(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rankings of the given candidates by similarity and by keywords, the queries, and the spread of each one's similarities.

    A query's kind filters the candidates before they are ranked (A1); the spread is that of all of them, not only of
    those ranked first. The engine's sign is taken off keyword scores.
    """
    queries = table(spark, sf, "search_queries").withColumn("keyword_weight", F.coalesce("keyword_weight", F.lit(1.0))).withColumn("wanted", F.lower("kind"))
    once = table(spark, sf, "search_results").groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("similarity"), F.max("keyword_score").alias("keyword_score"))
    sign = once.groupBy("query_id").agg(F.max("keyword_score").alias("most"))
    once = once.join(sign, "query_id").withColumn("keyword_score", F.when(F.col("most") < 0, -F.col("keyword_score")).otherwise(F.col("keyword_score"))).drop("most")
    kinds = _chunks(spark, sf).select("chunk_id", "kind")
    once = once.join(queries.select("query_id", "wanted"), "query_id").join(kinds, "chunk_id", "left").filter("wanted is null or kind = wanted").drop("wanted", "kind")
    spread = once.groupBy("query_id").agg(F.stddev_pop("similarity").alias("spread"))
    by_vector = retrieval.top_per_query(once.filter("similarity is not null"), retrieval.CANDIDATES, F.desc("similarity"), F.desc("chunk_id"))
    by_keyword = retrieval.top_per_query(once.filter("keyword_score is not null"), retrieval.CANDIDATES, F.desc("keyword_score"), F.col("chunk_id"))
    return by_vector, by_keyword.join(queries.select("query_id", "keyword_weight"), "query_id"), queries, spread


def _fused(spark, sf) -> DataFrame:
    by_vector, by_keyword, _, _ = _candidates(spark, sf)
    return retrieval.reciprocal_rank_fusion((by_vector, F.lit(1.0)), (by_keyword, F.col("keyword_weight")))


def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "chunk_id", F.round("fused", 9).alias("fused"), "fused_rank")


def hybrid_candidates(spark, sf):
    by_vector, by_keyword, _, _ = _candidates(spark, sf)
    return by_vector.select("query_id", "chunk_id").unionByName(by_keyword.select("query_id", "chunk_id")).distinct()


def relevance_floor(spark, sf):
    by_vector, _, _, spread = _candidates(spark, sf)
    return retrieval.relevance_floor(by_vector, spread).select("query_id", F.round("floor", 6).alias("floor"))


def _relevant(spark, sf) -> DataFrame:
    """Fused candidates of existing chunks and files past the cutoff."""
    by_vector, by_keyword, queries, spread = _candidates(spark, sf)
    fused = retrieval.reciprocal_rank_fusion((by_vector, F.lit(1.0)), (by_keyword, F.col("keyword_weight")))
    known = fused.join(by_vector.select("query_id", "chunk_id", "similarity"), ["query_id", "chunk_id"], "left").join(by_keyword.select("query_id", "chunk_id", F.lit(True).alias("is_keyword")), ["query_id", "chunk_id"], "left")
    floors = retrieval.relevance_floor(by_vector, spread)
    passed = known.join(floors, "query_id").filter(retrieval.passes_cutoff(F.col("floor"), F.coalesce("similarity", F.lit(-1.0)), F.coalesce("is_keyword", F.lit(False)), F.col("fused_rank")))
    placed = catalog.chunks_with_path(_chunks(spark, sf).drop("text", "embedding"), table(spark, sf, "files"))
    out = passed.join(placed, "chunk_id").join(queries.select("query_id", F.coalesce("result_limit", F.lit(10)).alias("result_limit")), "query_id")
    return out.select("query_id", "fused_rank", "chunk_id", "path", "kind", "page", "start_line", "end_line", "start_ms", "end_ms", "similarity", "result_limit")


def hybrid_end_to_end(spark, sf):
    """EP-1 from the texts of the queries: both retrievers run over all chunks of the wanted kind.

    A query's vector is the row of ``embeddings`` with its number. The spread is that of all chunks in reach, and every
    fused chunk has its similarity, found by vector or by words (PR-3).
    """
    queries = table(spark, sf, "search_queries").select("query_id", "query_text", F.coalesce("keyword_weight", F.lit(1.0)).alias("keyword_weight"), F.lower("kind").alias("wanted"), F.coalesce("result_limit", F.lit(10)).alias("result_limit"))
    asked = queries.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), "query_id")
    shared_folder(spark)
    once = _chunks(spark, sf)
    paths = catalog.chunks_with_path(once.select("chunk_id", "file_id"), table(spark, sf, "files")).select("chunk_id", "path")
    placed = once.select("chunk_id", "kind", "embedding").join(paths, "chunk_id").checkpoint()  # by id; no vector is shuffled twice; read four times
    # All pairs of chunks and queries are compared; of them leave a task the first ones of a query and the moments of all.
    found = topk_and_moments(placed, asked, retrieval.CANDIDATES).checkpoint()
    spread = spread_of_moments(found)
    each = found.select("query_id", F.explode(F.arrays_zip("ids", "similarities")).alias("x")).select("query_id", F.col("x.ids").alias("chunk_id"), F.round("x.similarities", 12).alias("similarity"))
    by_vector = retrieval.top_per_query(each, retrieval.CANDIDATES, F.desc("similarity"), F.desc("chunk_id")).checkpoint()  # two short lists a query, read several times
    wanted = F.col("wanted").isNull() | (F.col("kind") == F.col("wanted"))
    matched = _keyword_scores(spark, sf).withColumn("score", F.round("score", 9)).join(asked.select("query_id", "wanted").distinct(), "query_id").join(placed.select("chunk_id", "kind"), "chunk_id").filter(wanted).select("query_id", "chunk_id", "score").distinct()
    by_keyword = retrieval.top_per_query(matched, retrieval.CANDIDATES, F.desc("score"), F.col("chunk_id")).join(queries.select("query_id", "keyword_weight"), "query_id").checkpoint()
    fused = retrieval.reciprocal_rank_fusion((by_vector, F.lit(1.0)), (by_keyword, F.col("keyword_weight")))
    # What words found gets its similarity here; few vectors are shuffled for that.
    by_words = by_keyword.select("query_id", "chunk_id").join(asked.select("query_id", "asked", "wanted"), "query_id").join(placed.select("chunk_id", "kind", "embedding"), "chunk_id").filter(wanted)
    by_words = by_words.select("query_id", "chunk_id", F.round(vectors.dot(F.col("embedding"), F.col("asked")), 12).alias("similarity"))
    scored = by_vector.select("query_id", "chunk_id", "similarity").unionByName(by_words).groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("similarity"))
    known = fused.join(scored, ["query_id", "chunk_id"]).join(placed.select("chunk_id", "path"), "chunk_id").join(by_keyword.select("query_id", "chunk_id", F.lit(True).alias("is_keyword")), ["query_id", "chunk_id"], "left")
    floors = retrieval.relevance_floor(by_vector, spread)
    passed = known.join(floors, "query_id", "left").filter(retrieval.passes_cutoff(F.col("floor"), F.coalesce("similarity", F.lit(-1.0)), F.coalesce("is_keyword", F.lit(False)), F.col("fused_rank")))
    best = retrieval.best_per_file(passed.join(queries.select("query_id", "result_limit"), "query_id"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("fused_rank"))
    return best.withColumn("place", place).filter("place <= result_limit").select("query_id", "place", "chunk_id", "path", _six("similarity"))


def hybrid_search(spark, sf):
    best = retrieval.best_per_file(_relevant(spark, sf))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("fused_rank"))
    return best.withColumn("place", place).filter("place <= result_limit").select("query_id", "place", "chunk_id", "path", _six("similarity"))


def hybrid_search_all(spark, sf):
    kept = retrieval.suppress_overlaps(_relevant(spark, sf), F.col("result_limit"))
    return kept.select("query_id", "fused_rank", "chunk_id", "path", "kind")


def overlap_suppression(spark, sf):
    """W-5: all candidates of a query in fused order, whatever the cutoff, without those that show a place twice."""
    by_vector, by_keyword, _, _ = _candidates(spark, sf)
    fused = retrieval.reciprocal_rank_fusion((by_vector, F.lit(1.0)), (by_keyword, F.col("keyword_weight")))
    placed = catalog.chunks_with_path(_chunks(spark, sf).drop("text", "embedding"), table(spark, sf, "files"))
    kept = retrieval.suppress_overlaps(fused.join(placed, "chunk_id"), F.lit(100))
    return kept.select("query_id", "fused_rank", "chunk_id")


def best_per_file(spark, sf):
    return retrieval.best_per_file(_relevant(spark, sf)).select("query_id", "path", "chunk_id", "fused_rank")


def files_with_matches(spark, sf):
    """AG-14: the files of the results, by their first one."""
    first = _relevant(spark, sf).groupBy("query_id", "path").agg(F.min("fused_rank").alias("first"))
    return first.select("query_id", "path", F.row_number().over(W.partitionBy("query_id").orderBy("first")).alias("place"))


def _neighbours_by_label(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    queries = rows.filter(F.col("vec_id") % EACH == 0)
    found = batch_topk(rows, queries.select(F.col("vec_id").alias("query_id"), "embedding"), 100, "vec_id", excluded=queries.select(F.col("vec_id").alias("query_id"), "vec_id"))
    labels = rows.select("vec_id", "label")
    return found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected")), "query_id")


def recall_at_1(spark, sf):
    """AG-11, JN-13, PR-16: the share of queries whose first result has their label, by label."""
    hit = (F.col("label") == F.col("expected")).cast("double")
    return _neighbours_by_label(spark, sf).filter("rank = 1").groupBy("expected").agg(F.count("*").alias("queries"), F.round(F.avg(hit), 6).alias("recall"))


def margins(spark, sf):
    """AG-11: how far the best right result is above the best wrong one among the candidates; -1 where one is missing."""
    right, wrong = F.max(F.when(F.col("label") == F.col("expected"), F.col("similarity"))), F.max(F.when(F.col("label") != F.col("expected"), F.col("similarity")))
    each = _neighbours_by_label(spark, sf).groupBy("query_id").agg((F.coalesce(right, F.lit(-1.0)) - F.coalesce(wrong, F.lit(-1.0))).alias("margin"))
    return each.select("query_id", F.round("margin", 6).alias("margin"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_kind, vector_topk_scope, vector_topk_batch, background_stats, standard_score, similarity_percentiles, truncate_normalize, mean_direction,
        similar_to_example, query_terms, keyword_strings, token_stats, keyword_match_all, bm25_topk, bow_embedding, rrf_fusion, hybrid_candidates, relevance_floor,
        hybrid_search, hybrid_search_all, hybrid_end_to_end, overlap_suppression, best_per_file, files_with_matches, recall_at_1, margins,
    )
}

CUR = """cur AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY recorded_at DESC, file_id DESC, modified_nanoseconds DESC, size DESC, content_hash DESC) AS k FROM files WHERE path IS NOT NULL) WHERE k = 1)"""
CH = """ch AS (SELECT * EXCLUDE (k) REPLACE (CASE WHEN lower(kind) IN ('text', 'image', 'pdf', 'audio', 'video') THEN lower(kind) END AS kind) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY recorded_at) AS k FROM chunks WHERE chunk_id IS NOT NULL) WHERE k = 1)"""
_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_SCORED = f"WITH {CH}, {_Q}, scored AS (SELECT chunk_id, list_dot_product(embedding::DOUBLE[], v) AS similarity FROM ch, q WHERE len(embedding) = len(v))"
_WORD = r"[^\p{L}\p{N}_]+"
_FOLD = f"translate(lower(text), '{text.ACCENTED}', '{text.BARE}')"
_TERMS = f"""terms AS (
  SELECT DISTINCT query_id, translate(term, '{text.ACCENTED}', '{text.BARE}') AS term
  FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query_text), '{_WORD}')) AS term FROM search_queries) WHERE length(term) >= 2)"""
_BM25 = f"""WITH {CH}, {_TERMS},
words AS (SELECT chunk_id, list_filter(regexp_split_to_array({_FOLD}, '{_WORD}'), lambda w: w <> '') AS words FROM ch),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(coalesce(len(words), 0)) AS mean_length FROM words),
tf AS (SELECT chunk_id, term, length, count(*)::DOUBLE AS tf FROM (SELECT chunk_id, len(words) AS length, unnest(words) AS term FROM words) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
idf AS (SELECT term, greatest(ln((n - df + 5e-1) / (df + 5e-1)), 0) AS raw FROM (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1), corpus),
scored AS (
  SELECT query_id, chunk_id, sum(CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * length / mean_length))) AS score, count(*) AS matched
  FROM tf JOIN terms USING (term) JOIN idf USING (term), corpus GROUP BY 1, 2),
found AS (SELECT query_id, chunk_id, round(score, 9) AS score FROM scored JOIN (SELECT query_id, count(*) AS wanted FROM terms GROUP BY 1) USING (query_id) WHERE matched = wanted)"""
_CANDIDATES = f"""{CH}, once AS (SELECT query_id, chunk_id, max(similarity) AS similarity, max(keyword_score) AS raw FROM search_results GROUP BY 1, 2),
every AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) < 0 THEN -raw ELSE raw END AS keyword_score FROM once),
signed AS (SELECT e.* FROM every e JOIN search_queries q USING (query_id) WHERE q.kind IS NULL OR EXISTS (SELECT 1 FROM ch WHERE ch.chunk_id = e.chunk_id AND ch.kind = lower(q.kind))),
by_vector AS (SELECT * FROM (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id DESC) AS rank FROM signed WHERE similarity IS NOT NULL) WHERE rank <= 100),
by_keyword AS (SELECT k.*, coalesce(keyword_weight, 1.0) AS weight FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, chunk_id) AS rank FROM signed WHERE keyword_score IS NOT NULL) k JOIN search_queries USING (query_id) WHERE rank <= 100),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, chunk_id) AS fused_rank FROM (
  SELECT query_id, chunk_id, sum(part) AS fused FROM (SELECT query_id, chunk_id, 1 / (60.0::DOUBLE + rank) AS part FROM by_vector UNION ALL SELECT query_id, chunk_id, weight / (60.0::DOUBLE + rank) FROM by_keyword) GROUP BY 1, 2)),
drops AS (SELECT * FROM (SELECT *, similarity - lead(similarity) OVER (PARTITION BY query_id ORDER BY rank) AS d FROM by_vector WHERE rank <= 20) WHERE d IS NOT NULL),
widest AS (SELECT query_id, similarity AS above, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, rank DESC) AS k FROM drops) WHERE k = 1),
floors AS (SELECT s.query_id, CASE WHEN spread > 0 AND d >= 75e-2 * spread THEN above END AS floor FROM (SELECT query_id, stddev_pop(similarity) AS spread FROM signed GROUP BY 1) s LEFT JOIN widest w USING (query_id))"""
_RELEVANT = f"""WITH {CUR}, {_CANDIDATES},
relevant AS (
  SELECT f.query_id, f.fused_rank, f.chunk_id, c.path, ch.kind, ch.page, ch.start_line, ch.end_line, ch.start_ms, ch.end_ms, v.similarity, coalesce(s.result_limit, 10) AS result_limit
  FROM fused f LEFT JOIN by_vector v USING (query_id, chunk_id) LEFT JOIN by_keyword k USING (query_id, chunk_id) JOIN floors USING (query_id)
  JOIN ch ON ch.chunk_id = f.chunk_id JOIN cur c ON c.file_id = ch.file_id JOIN search_queries s ON s.query_id = f.query_id
  WHERE (floor IS NULL OR f.fused_rank = 1 OR coalesce(v.similarity, -1) >= floor OR k.chunk_id IS NOT NULL)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY fused_rank) AS b FROM relevant) WHERE b = 1)"""
# One result after another, in fused order: those kept so far are carried along.
_TOUCH = """y.path = o.path AND CASE WHEN o.kind = 'text' AND y.kind = 'text' THEN coalesce(y.start_line <= o.end_line AND o.start_line <= y.end_line, true)
  WHEN o.kind = 'pdf' AND y.kind = 'pdf' THEN coalesce(y.page, 1) = coalesce(o.page, 1) AND coalesce(y.start_line <= o.end_line AND o.start_line <= y.end_line, true)
  WHEN y.start_ms IS NOT NULL AND o.start_ms IS NOT NULL AND y.end_ms IS NOT NULL AND o.end_ms IS NOT NULL THEN y.start_ms < o.end_ms AND o.start_ms < y.end_ms ELSE true END"""
_ROW = "{'fused_rank': o.fused_rank, 'chunk_id': o.chunk_id, 'path': o.path, 'kind': o.kind, 'page': o.page, 'start_line': o.start_line, 'end_line': o.end_line, 'start_ms': o.start_ms, 'end_ms': o.end_ms}"
_WALK = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS n FROM relevant),
walk AS (
  SELECT o.query_id, n, [{_ROW}] AS kept FROM numbered o WHERE n = 1
  UNION ALL
  SELECT w.query_id, o.n, CASE WHEN len(w.kept) >= o.result_limit OR len(list_filter(w.kept, lambda y: {_TOUCH})) > 0 THEN w.kept ELSE list_append(w.kept, {_ROW}) END
  FROM walk w JOIN numbered o ON o.query_id = w.query_id AND o.n = w.n + 1),
chosen AS (SELECT query_id, unnest(kept) AS r FROM (SELECT query_id, arg_max(kept, n) AS kept FROM walk GROUP BY 1))"""
_BATCH = f"""WITH {CH}, vecs AS (SELECT chunk_id, file_id, embedding::DOUBLE[] AS v FROM ch WHERE len(embedding) = 64)"""
# Of a file's vectors those of the length that most of them have, the longer one of equally frequent ones.
_MEANS = f"""WITH {CH}, lengths AS (SELECT file_id, len(embedding) AS d, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, len(embedding) DESC) AS k FROM ch WHERE file_id IS NOT NULL AND len(embedding) > 0 GROUP BY 1, 2),
usual AS (SELECT ch.file_id, embedding::DOUBLE[] AS v FROM ch JOIN lengths l ON l.file_id = ch.file_id AND l.k = 1 AND l.d = len(embedding)),
sums AS (SELECT file_id, pos, sum(v[pos]) AS s FROM (SELECT *, unnest(range(1, len(v) + 1)) AS pos FROM usual) GROUP BY 1, 2)"""
_LABELS = """WITH near AS (
  SELECT q.vec_id AS query_id, q.label AS expected, e.label, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, e.vec_id DESC) AS rank
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 100)"""

SQL = {
    "vector_topk": f"WITH {_Q} SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v) AS s FROM embeddings, q ORDER BY s DESC, vec_id DESC LIMIT 10)",
    "vector_topk_kind": f"WITH {CH}, {_Q} SELECT chunk_id, round(s, 6) AS similarity FROM (SELECT chunk_id, list_dot_product(embedding::DOUBLE[], v) AS s FROM ch, q WHERE kind = 'pdf' AND len(embedding) = 64 ORDER BY s DESC, chunk_id DESC LIMIT 10)",
    "vector_topk_scope": f"WITH {CUR}, {CH}, {_Q} SELECT chunk_id, round(s, 6) AS similarity FROM (SELECT chunk_id, list_dot_product(embedding::DOUBLE[], v) AS s FROM ch JOIN cur USING (file_id), q WHERE (path = '{SCOPE}' OR starts_with(path, '{SCOPE}/')) AND len(embedding) = 64 ORDER BY s DESC, chunk_id DESC LIMIT 10)",
    "vector_topk_batch": f"""{_BATCH}
SELECT query_id, chunk_id, round(s, 6) AS similarity, rank FROM (
  SELECT vec_id AS query_id, chunk_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, chunk_id DESC) AS rank
  FROM (SELECT vec_id, chunk_id, round(list_dot_product(e.embedding::DOUBLE[], v), 12) AS s FROM vecs, embeddings e WHERE vec_id % 100 = 0)) WHERE rank <= 10""",
    "background_stats": f"{_SCORED} SELECT count(*) AS n, round(avg(similarity), 6) AS mean, round(stddev_pop(similarity), 6) AS spread FROM scored",
    "standard_score": f"{_SCORED} SELECT chunk_id, round((similarity - m) / s, 6) AS standard_score FROM scored, (SELECT avg(similarity) AS m, stddev_pop(similarity) AS s FROM scored)",
    "similarity_percentiles": f"{_SCORED}, ranked AS (SELECT similarity, row_number() OVER (ORDER BY similarity DESC) - 1 AS i, count(*) OVER () AS n FROM scored) SELECT fraction, round(similarity, 6) AS similarity FROM ranked, (SELECT unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS fraction) WHERE i = floor((n - 1) * (1 - fraction) + 1e-9)",
    "truncate_normalize": "SELECT vec_id, pos - 1 AS pos, round(v[pos] / sqrt(list_dot_product(v, v)), 6) AS value FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), (SELECT unnest(generate_series(1, 16)) AS pos)",
    "mean_direction": f"{_MEANS} SELECT file_id, pos - 1 AS pos, round(CASE WHEN sqrt(sum(s * s) OVER (PARTITION BY file_id)) > 0 THEN s / sqrt(sum(s * s) OVER (PARTITION BY file_id)) ELSE s END, 6) AS value FROM sums",
    "similar_to_example": f"""{_MEANS}, means AS (SELECT file_id, list(s ORDER BY pos) AS m FROM sums WHERE file_id % 100 = 0 GROUP BY 1),
vecs AS (SELECT chunk_id, file_id, embedding::DOUBLE[] AS v FROM ch WHERE len(embedding) > 0 AND file_id IS NOT NULL)
SELECT query_id, chunk_id, round(s, 6) AS similarity, rank FROM (
  SELECT query_id, chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id DESC) AS rank
  FROM (SELECT means.file_id AS query_id, chunk_id, round(list_dot_product(m, v) / CASE WHEN list_dot_product(m, m) > 0 THEN sqrt(list_dot_product(m, m)) ELSE 1 END, 12) AS s FROM vecs JOIN means ON vecs.file_id <> means.file_id AND len(m) = len(v))) WHERE rank <= 10""",
    "query_terms": rf"""SELECT query_id, pos - 1 AS pos, terms[pos] AS term FROM (
  SELECT query_id, list_filter(w, lambda x, i: length(x) >= 2 AND list_position(w, x) = i) AS terms FROM (SELECT query_id, regexp_split_to_array(lower(query_text), '{_WORD}') AS w FROM search_queries)), (SELECT unnest(generate_series(1, 100)) AS pos) WHERE pos <= len(terms)""",
    "keyword_strings": rf"""SELECT query_id, CASE WHEN len(terms) > 0 THEN array_to_string(list_transform(terms, lambda x: '"' || x || '"'), ' AND ') END AS keywords, 'task: search result | query: ' || query_text AS prompt FROM (
  SELECT query_id, query_text, list_filter(w, lambda x, i: length(x) >= 2 AND list_position(w, x) = i) AS terms FROM (SELECT query_id, query_text, regexp_split_to_array(lower(query_text), '{_WORD}') AS w FROM search_queries))""",
    "token_stats": f"SELECT doc_id, len(w) AS tokens, len(list_distinct(w)) AS terms FROM (SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '{_WORD}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)",
    "keyword_match_all": f"{_BM25} SELECT query_id, chunk_id FROM found",
    "bm25_topk": f"{_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM found) WHERE rank <= 100",
    "bow_embedding": r"""WITH counts AS (SELECT doc_id, (('0x' || substr(sha256(w), 1, 2))::INT % 64) AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM counts""",
    "rrf_fusion": f"WITH {_CANDIDATES} SELECT query_id, chunk_id, round(fused, 9) AS fused, fused_rank FROM fused",
    "hybrid_candidates": f"WITH {_CANDIDATES} SELECT query_id, chunk_id FROM by_vector UNION SELECT query_id, chunk_id FROM by_keyword",
    "relevance_floor": f"WITH {_CANDIDATES} SELECT query_id, round(floor, 6) AS floor FROM floors",
    "hybrid_search": f"{_RELEVANT} SELECT query_id, place, chunk_id, path, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS place FROM best) WHERE place <= result_limit",
    "hybrid_search_all": f"{_RELEVANT.replace('WITH', 'WITH RECURSIVE', 1)}, {_WALK} SELECT query_id, r.fused_rank, r.chunk_id, r.path, r.kind FROM chosen",
    "overlap_suppression": f"""WITH RECURSIVE {CUR}, {_CANDIDATES}, relevant AS (SELECT f.query_id, f.fused_rank, c.path, ch.*, 100 AS result_limit FROM fused f JOIN ch USING (chunk_id) JOIN cur c USING (file_id)), {_WALK}
SELECT query_id, r.fused_rank, r.chunk_id FROM chosen""",
    "hybrid_end_to_end": f"""{_BM25}, {CUR},
reach AS (SELECT q.query_id, ch.chunk_id, cur.path, round(CASE WHEN len(ch.embedding) = len(e.embedding) THEN list_dot_product(ch.embedding::DOUBLE[], e.embedding::DOUBLE[]) END, 12) AS similarity
  FROM ch JOIN cur USING (file_id) JOIN search_queries q ON q.kind IS NULL OR lower(q.kind) = ch.kind JOIN embeddings e ON e.vec_id = q.query_id),
by_vector AS (SELECT * FROM (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id DESC) AS rank FROM reach WHERE similarity IS NOT NULL) WHERE rank <= 100),
by_keyword AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM found SEMI JOIN reach USING (query_id, chunk_id)) WHERE rank <= 100),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, chunk_id) AS fused_rank FROM (SELECT query_id, chunk_id, sum(part) AS fused FROM (
  SELECT query_id, chunk_id, 1 / (60.0::DOUBLE + rank) AS part FROM by_vector UNION ALL SELECT query_id, chunk_id, coalesce(keyword_weight, 1) / (60.0::DOUBLE + rank) FROM by_keyword JOIN search_queries USING (query_id)) GROUP BY 1, 2)),
drops AS (SELECT * FROM (SELECT *, similarity - lead(similarity) OVER (PARTITION BY query_id ORDER BY rank) AS d FROM by_vector WHERE rank <= 20) WHERE d IS NOT NULL),
widest AS (SELECT query_id, similarity AS above, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, rank DESC) AS k FROM drops) WHERE k = 1),
floors AS (SELECT s.query_id, CASE WHEN spread > 0 AND d >= 75e-2 * spread THEN above END AS floor FROM (SELECT query_id, stddev_pop(similarity) AS spread FROM reach GROUP BY 1) s LEFT JOIN widest USING (query_id)),
passed AS (SELECT query_id, fused_rank, chunk_id, path, similarity FROM fused JOIN reach USING (query_id, chunk_id) JOIN floors USING (query_id) LEFT JOIN (SELECT query_id, chunk_id, 1 AS is_keyword FROM by_keyword) USING (query_id, chunk_id)
  WHERE floor IS NULL OR fused_rank = 1 OR coalesce(similarity, -1) >= floor OR is_keyword = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY fused_rank) AS b FROM passed) WHERE b = 1)
SELECT query_id, place, chunk_id, path, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS place FROM best) JOIN search_queries USING (query_id) WHERE place <= coalesce(result_limit, 10)""",
    "best_per_file": f"{_RELEVANT} SELECT query_id, path, chunk_id, fused_rank FROM best",
    "files_with_matches": f"{_RELEVANT} SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS place FROM best",
    "recall_at_1": f"{_LABELS} SELECT expected, count(*) AS queries, round(avg((label = expected)::INT), 6) AS recall FROM near WHERE rank = 1 GROUP BY 1",
    "margins": f"{_LABELS} SELECT query_id, round(coalesce(max(similarity) FILTER (label = expected), -1) - coalesce(max(similarity) FILTER (label <> expected), -1), 6) AS margin FROM near GROUP BY 1",
}
# A rounded negative zero is a plain one, as in Spark.
for _name, _column in (("standard_score", "standard_score"), ("truncate_normalize", "value"), ("mean_direction", "value"), ("margins", "margin"), ("similarity_percentiles", "similarity"), ("background_stats", "mean")):
    SQL[_name] = f"SELECT * REPLACE ({_column} + 0::DOUBLE AS {_column}) FROM ({SQL[_name]})"
