"""Retrieval: vector top-k, keyword ranking, fusion, cutoff and suppression.

All operators take a batch of queries (a column ``query_id``), so one plan serves one query or many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import segments, text, vectors
from quarry.session import shared_folder

#: Candidates a retriever gives; the constant of reciprocal rank fusion; ranks the cliff is looked for in
#: and the drop it needs, in spreads; BM25's constants and least inverse document frequency.
CANDIDATES, RRF, CLIFF_RANKS, CLIFF_FACTOR = 100, 60.0, 20, 0.75
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def similarities(chunks: DataFrame, query: Column) -> DataFrame:
    """JN-9 for one query: ``similarity`` beside the chunks with a vector of the query's length. No shuffle."""
    return chunks.withColumn("similarity", vectors.dot(query, F.col("embedding"))).filter(F.col("similarity").isNotNull() & ~F.isnan("similarity"))


def vector_topk(chunks: DataFrame, query: Column, k: int = CANDIDATES, key: str = "chunk_id", repeats: bool = False) -> DataFrame:
    """T-1: the k most similar, of equal ones the higher id. The scan keeps k rows a task; texts are not read.

    With ``repeats`` an id may occur several times and counts once; then ids and similarities, no vectors, are shuffled.
    """
    scored = similarities(chunks, query).select(key, "similarity")
    if repeats:
        scored = scored.groupBy(key).agg(F.max("similarity").alias("similarity"))
    return scored.orderBy(F.desc("similarity"), F.desc(key)).limit(k)


def similarity_moments(scored: DataFrame) -> DataFrame:
    """AG-2: one row of count, mean and population deviation (both 0 without rows; the deviation 0 below two)."""
    return scored.agg(F.count("similarity").alias("n"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("similarity"), F.lit(0.0)).alias("spread"))


def standard_scores(scored: DataFrame) -> DataFrame:
    """AG-3: how many spreads above the mean each similarity lies, 0 without spread."""
    moments = similarity_moments(scored)
    z = F.when(F.col("spread") > 0, (F.col("similarity") - F.col("mean")) / F.col("spread")).otherwise(0.0)
    return scored.crossJoin(F.broadcast(moments)).withColumn("standard_score", z).drop("n", "mean", "spread")  # one row


def percentiles_by_rank(scored: DataFrame, fractions: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """AG-10: the value at index trunc((n - 1)(1 - f)) of the descending list, for each fraction.

    Ranks come from counts of equal values and a running sum over the distinct ones in blocks, not from one sort of all
    rows in a task.
    """
    counted = scored.groupBy("similarity").count()
    total = counted.agg(F.sum("count").alias("n"))
    blocks = counted.withColumn("block", F.floor(F.col("similarity") * 1024).cast("long"))
    inside = W.partitionBy("block").orderBy(F.desc("similarity"))
    per_block = blocks.groupBy("block").agg(F.sum("count").alias("rows"))  # at most a few thousand for cosines
    above = per_block.withColumn("above", F.sum("rows").over(W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1))).select("block", F.coalesce("above", F.lit(0)).alias("above"))
    placed = blocks.withColumn("last", F.sum("count").over(inside.rowsBetween(W.unboundedPreceding, 0))).join(above, "block")
    placed = placed.withColumn("last", F.col("last") + F.col("above")).withColumn("first", F.col("last") - F.col("count"))
    wanted = F.explode(F.array(*[F.lit(f) for f in fractions]))
    index = F.floor((F.col("n") - 1) * (F.lit(1.0) - F.col("fraction")) + 1e-9)
    at = total.select("n", wanted.alias("fraction")).withColumn("at", index)
    return placed.join(F.broadcast(at), (F.col("first") <= F.col("at")) & (F.col("at") < F.col("last"))).select("fraction", "similarity")


#: The term of a posting that only says how long a chunk is.
LENGTH = ""


def postings(chunks: DataFrame, key: str = "chunk_id", *carried: str) -> DataFrame:
    """SNK-8: ``term, key, tf, length`` of every word of every text, and for every row, texts or not, one of term ``LENGTH``.

    Words are folded as by the keyword index. ``carried`` columns, which the key decides, go along.
    """
    each = chunks.filter(F.col(key).isNotNull()).select(key, *carried, F.coalesce(text.words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    each = each.select(key, *carried, F.size("words").alias("length"), F.posexplode(F.concat(F.array(F.lit(LENGTH)), "words")).alias("at", "term"))
    return each.groupBy("term", key, "length", *carried).agg(F.countDistinct("at").cast("double").alias("tf"))  # repeated rows of a key have the same places


def query_words(queries: DataFrame) -> DataFrame:
    """``query_id, term``: the distinct words of each query, folded."""
    return queries.select("query_id", F.explode(F.array_distinct(F.transform(text.query_terms(F.col("query_text")), text.folded))).alias("term")).distinct()


def rank_postings(hits: DataFrame, terms: DataFrame, key: str = "chunk_id") -> DataFrame:
    """JN-2, AG-12, AG-13: ``query_id, key, score`` of the keys that hold every word of a query, by BM25.

    ``hits``: postings of at least the words of ``terms`` and of ``LENGTH``; of those come the number of rows and their
    mean length.
    """
    corpus = hits.filter(F.col("term") == LENGTH).agg(F.count("*").cast("double").alias("n_rows"), F.avg("length").alias("mean_length"))
    found = hits.filter(F.col("term") != LENGTH)
    df = found.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    weighted = df.crossJoin(F.broadcast(corpus))  # one row
    raw = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = weighted.select("term", "df", "mean_length", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"))
    # Only keys that hold a query's rarest word are looked at; a word that nothing holds comes first, without a df, and meets nothing.
    asked = terms.join(weighted, "term", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("df", "term", "idf", "mean_length"))).alias("words"))
    rarest = asked.filter(F.col("words")[0]["df"].isNotNull()).select("query_id", F.col("words")[0]["term"].alias("term"), "words")
    each = found.select("term", key).join(rarest, "term").select("query_id", key, F.size("words").alias("wanted"), F.explode("words").alias("word"))
    each = each.select("query_id", key, "wanted", "word.term", "word.idf", "word.mean_length")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = each.join(found, ["term", key]).groupBy("query_id", key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"), F.max("wanted").alias("wanted"))
    return scored.filter("matched = wanted").select("query_id", key, "score")


def keyword_scores(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """:func:`rank_postings` of chunks without stored postings: every text is taken apart once.

    N and the mean length count all rows of ``chunks``, also those without text. Only words of some query and a length a
    row are kept before anything is shuffled. Queries without a word of two characters match nothing. Repeated rows of
    an id are copies of one text and count once.
    """
    terms = query_words(queries)
    shared_folder(chunks.sparkSession)
    words = F.coalesce(text.words(F.col("text")), F.array().cast("array<string>"))
    each = chunks.filter(F.col(key).isNotNull()).select(key, words.alias("words"))
    each = each.select(key, F.size("words").alias("length"), F.posexplode(F.concat(F.array(F.lit(LENGTH)), "words")).alias("at", "term"))
    wanted = terms.select("term").distinct().unionByName(chunks.sparkSession.range(1).select(F.lit(LENGTH).alias("term")))
    kept = each.join(wanted, "term", "left_semi").repartition("term", key).groupBy("term", key, "length").agg(F.countDistinct("at").cast("double").alias("tf"))
    return rank_postings(kept.checkpoint(), terms, key)  # words of queries and lengths, by word and row; read four times


def top_per_query(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with ``rank`` from 1 (W-1); Spark keeps k rows a query before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def reciprocal_rank_fusion(*rankings: tuple[DataFrame, Column]) -> DataFrame:
    """AG-4, JN-11, U-1, T-4: ``query_id, chunk_id, fused, fused_rank`` of rankings with ``query_id, chunk_id, rank``.

    Each ranking comes with the weight of its ranks. A weight of 0 keeps its ids, with a score of 0 (A9).
    """
    parts = [r.select("query_id", "chunk_id", (w / (F.lit(RRF) + F.col("rank"))).alias("part")) for r, w in rankings]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("fused"))
    order = W.partitionBy("query_id").orderBy(F.round("fused", 12).desc(), "chunk_id")
    return fused.withColumn("fused_rank", F.row_number().over(order))


def relevance_floor(ranked: DataFrame, spread: DataFrame) -> DataFrame:
    """W-2, W-3: ``query_id, floor``: the similarity above the widest drop among the first ranks, the last of equal ones.

    Null where there is no drop of ``CLIFF_FACTOR`` spreads, or no spread. ``ranked``: ``query_id, rank, similarity``.
    """
    order = W.partitionBy("query_id").orderBy("rank")
    drops = ranked.filter(F.col("rank") <= CLIFF_RANKS).withColumn("drop", F.col("similarity") - F.lead("similarity").over(order)).filter("drop is not null")
    widest = drops.groupBy("query_id").agg(F.max_by("similarity", F.struct("drop", "rank")).alias("above"), F.max("drop").alias("drop"))
    steep = (F.col("spread") > 0) & (F.col("drop") >= CLIFF_FACTOR * F.col("spread"))
    return spread.join(widest, "query_id", "left").select("query_id", F.when(steep, F.col("above")).alias("floor"))


def passes_cutoff(floor: Column, similarity: Column, is_keyword: Column, fused_rank: Column) -> Column:
    """PR-9, A3-A5: what is not below the floor, matches the keywords, or comes first."""
    return floor.isNull() | (fused_rank == 1) | ~(similarity < floor) | is_keyword


def _touch(a: Column, b: Column) -> Column:
    """JN-10: two results of one file that show the same place: lines, pages or time; other kinds always do (A7)."""
    both = lambda f: a[f].isNotNull() & b[f].isNotNull()
    lines = (a["start_line"] <= b["end_line"]) & (b["start_line"] <= a["end_line"])
    spans = segments.overlaps(a["start_ms"], a["end_ms"], b["start_ms"], b["end_ms"])
    place = (
        F.when((a["kind"] == "text") & (b["kind"] == "text"), F.coalesce(lines, F.lit(True)))
        .when((a["kind"] == "pdf") & (b["kind"] == "pdf"), (F.coalesce(a["page"], F.lit(1)) == F.coalesce(b["page"], F.lit(1))) & F.coalesce(lines, F.lit(True)))
        .when(both("start_ms") & both("end_ms"), spans).otherwise(True)
    )
    return (a["path"] == b["path"]) & place


def suppress_overlaps(results: DataFrame, limit: Column) -> DataFrame:
    """W-5: in fused order, drops each result that overlaps one already kept, up to a limit of kept ones.

    ``results``: ``query_id, fused_rank, chunk_id, path, kind, page, start_line, end_line, start_ms, end_ms``; at most two
    candidate lists a query, so its results fit into one array.
    """
    fields = ["fused_rank", "chunk_id", "path", "kind", "page", "start_line", "end_line", "start_ms", "end_ms"]
    grouped = results.withColumn("limit", limit).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all"), F.max("limit").alias("limit"))
    empty = F.filter(F.col("all"), lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        full = F.size(kept) >= F.col("limit")
        return F.when(full | F.exists(kept, lambda y: _touch(x, y)), kept).otherwise(F.concat(kept, F.array(x)))

    kept = grouped.select("query_id", F.explode(F.aggregate("all", empty, step)).alias("x"))
    return kept.select("query_id", *[F.col(f"x.{f}").alias(f) for f in fields])


def best_per_file(results: DataFrame) -> DataFrame:
    """W-4: of each file the first chunk in fused order."""
    return results.withColumn("k", F.row_number().over(W.partitionBy("query_id", "path").orderBy("fused_rank"))).filter("k = 1").drop("k")


def of_usual_length(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """The rows of each group whose vectors have the length that most of its vectors have, the longer of equally frequent ones."""
    counts = rows.filter(F.size("embedding") > 0).groupBy(key, F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    usual = counts.groupBy(key).agg(F.max_by("d", F.struct("n", "d")).alias("d"))
    return rows.join(usual, (rows[key] == usual[key]) & (F.size(rows["embedding"]) == usual["d"]), "left_semi")


def mean_direction(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """AG-5: ``key, embedding``: the sum of a group's vectors, of length one; a zero sum stays.

    Vectors of a group have one length. Batches are summed in Arrow first, so a batch sends one row a group, not one an
    element.
    """
    kind = rows.schema[key].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_inverse=True)
            vectors_ = batch.column(2)
            sizes, offsets, values = np.diff(vectors_.offsets.to_numpy()), vectors_.offsets.to_numpy(), vectors_.values.to_numpy(zero_copy_only=False)
            firsts = np.full(len(keys), 0)
            firsts[places] = np.arange(len(places))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                matrix = values[offsets[at][:, None] + np.arange(size)].astype(np.float64)
                order = np.argsort(places[at], kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(places[at][order]) > 0])
                added = np.add.reduceat(matrix[order], starts, axis=0)
                own = batch.column(0).take(pa.array(firsts[places[at][order][starts]]))
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(np.arange(len(added) + 1, dtype=np.int32) * int(size)), pa.array(added.ravel()))], ["_key", "sum"])

    each = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col(key).alias("_key"), F.xxhash64(key).alias("_h"), "embedding").mapInArrow(sums, f"_key {kind}, sum array<double>")
    parts = each.select("_key", F.posexplode("sum").alias("at", "value")).groupBy("_key", "at").agg(F.sum("value").alias("value"))
    joined = parts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))  # as many as dimensions
    return joined.select(F.col("_key").alias(key), vectors.normalized(F.transform("v", lambda x: x["value"])).alias("embedding"))
