"""One ranking from several differently scaled scores by a walk over ranks (problem 5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.session import shared_folder

#: The walk's share against uniform restarts. Nearer to 1, leading one score alone outweighs standing well in all.
DAMPING = 0.7
#: Rounds stop when no probability moves by more than this, relative to 1 / n.
TOLERANCE = 1e-9
#: Rounds at most.
ROUNDS = 1000
#: Candidates of a query that one task ranks; larger queries are ranked by all tasks together, with the same result.
MOST_IN_TASK = 500_000
#: Stretches that the ranks of a larger query are cut into.
STRETCHES = 200


def rank_walk(scores: list[np.ndarray], weights: list[float], damping: float = DAMPING) -> np.ndarray:
    """The stationary probability of each item under a walk over the ranks of several scores (larger is better).

    In each round the walk restarts anywhere with probability ``1 - damping``. Else it picks a score by weight and an
    item uniformly, and goes there if the score ranks that item above the present one; so each item ranked higher is as
    likely as any other. An item without a score (NaN) stands below all that have it and is never reached by it; equal
    scores don't reach one another. Only the order of a score counts. Sums over all items ranked lower are differences
    of prefix sums in sorted order, so a round takes linear time.
    """
    n = len(scores[0])
    total = float(sum(weights))
    orders = []
    for values, weight in zip(scores, weights):
        if weight <= 0 or np.isnan(values).all():
            continue
        keyed = np.where(np.isnan(values), -np.inf, values)
        order = np.argsort(-keyed, kind="stable")
        ordered = -keyed[order]
        first = np.searchsorted(ordered, ordered, side="left")  # items strictly above
        past = np.searchsorted(ordered, ordered, side="right")  # items at or above
        missing = np.isnan(values[order])
        orders.append((weight / total, order, first, past, missing))
    if not orders:
        return np.full(n, 1 / n) if n else np.zeros(0)
    share = sum(o[0] for o in orders)
    stays = np.zeros(n)
    for weight, order, first, _, _ in orders:
        stays[order] += weight / share * (1 - first / n)
    now = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        new = now * stays
        for weight, order, _, past, missing in orders:
            sums = np.concatenate([[0.0], np.cumsum(now[order])])
            gain = (sums[-1] - sums[past]) / n
            gain[missing] = 0
            new[order] += weight / share * gain
        new = (1 - damping) / n + damping * new
        moved = np.abs(new - now).max() * n
        now = new
        if moved < TOLERANCE:
            break
    return now


def upward_walk(scores: list[np.ndarray], weights: list[float], damping: float = DAMPING) -> np.ndarray:
    """As :func:`rank_walk`, but every step goes up: to one of the items ranked higher, each as likely, and from the top to a restart.

    This is the plainer walk, kept to compare. An item gets ``1 / (rank - 1)`` of the probability of each one below it,
    so a score's leader gets nearly all of the second's, half of the third's, and so on: leading one score outweighs
    standing well in all (:func:`fuse_scores` therefore uses the other walk).
    """
    n, total = len(scores[0]), 0.0
    orders = []
    for values, weight in zip(scores, weights):
        if weight > 0 and not np.isnan(values).all():
            keyed = np.where(np.isnan(values), -np.inf, values)
            order = np.argsort(-keyed, kind="stable")
            ordered = -keyed[order]
            orders.append((weight, order, np.searchsorted(ordered, ordered, side="left"), np.searchsorted(ordered, ordered, side="right"), np.isinf(ordered)))
            total += weight
    now = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        new = np.zeros(n)
        for weight, order, above, past, missing in orders:
            sent = np.where(above > 0, now[order] / np.maximum(above, 1), 0)
            sums = np.concatenate([[0.0], np.cumsum(sent)])
            gain = sums[-1] - sums[past]
            gain[missing] = 0
            new[order] += weight / total * gain
        new *= damping
        new += (1 - new.sum()) / n
        moved = np.abs(new - now).max() * n
        now = new
        if moved < TOLERANCE:
            break
    return now


def _above(items: DataFrame, score: str, value: Column) -> DataFrame:
    """``query_id, <score>_at, <score>, through``: the sum of ``value`` over the items whose score is that level or better.

    Items of a level are summed before anything is sorted; the levels of a stretch are added up in order, and the sums of
    the stretches before it come from a table of a row a stretch.
    """
    place = f"{score}_at"
    levels = items.filter(F.col(score).isNotNull()).groupBy("query_id", place, score).agg(F.sum(value).alias("own"))
    inside = W.partitionBy("query_id", place).orderBy(F.desc(score))
    sums = levels.groupBy("query_id", place).agg(F.sum("own").alias("own"))
    before = sums.withColumn("before", F.sum("own").over(W.partitionBy("query_id").orderBy(place).rowsBetween(W.unboundedPreceding, -1))).select("query_id", place, F.coalesce("before", F.lit(0)).alias("before"))
    running = levels.withColumn("through", F.sum("own").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return running.join(before, ["query_id", place]).select("query_id", place, score, (F.col("through") + F.col("before")).alias("through"), "own")


def _higher_than(score: str):
    return lambda x: x > F.col(score)


def rank_walk_large(items: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``query_id, chunk_id, similarity, stationarity``: :func:`rank_walk` of large queries, by DataFrame operators.

    ``items``: ``query_id, chunk_id, similarity, keyword, keyword_weight``, one row a candidate, NaN as null.
    """
    shared_folder(items.sparkSession)
    scores = ("similarity", "keyword")
    cuts = F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)])
    facts = items.groupBy("query_id").agg(F.count("*").cast("double").alias("n"), *[F.count(c).alias(f"{c}_n") for c in scores], *[F.percentile_approx(c, cuts, 10_000).alias(f"{c}_cuts") for c in scores])
    now = items.join(facts, "query_id")
    weight = {"similarity": F.when(F.col("similarity_n") > 0, F.lit(1.0)).otherwise(0.0), "keyword": F.when(F.col("keyword_n") > 0, F.col("keyword_weight")).otherwise(0.0)}
    total = weight["similarity"] + weight["keyword"]
    for c in scores:  # higher scores are in lower stretches; equal ones in the same
        now = now.withColumn(f"{c}_at", F.when(F.col(c).isNotNull(), F.size(F.filter(f"{c}_cuts", _higher_than(c))))).withColumn(f"{c}_weight", F.when(total > 0, weight[c] / total).otherwise(0.0))
    now = now.select("query_id", "chunk_id", "n", *scores, *[f"{c}_at" for c in scores], *[f"{c}_weight" for c in scores], (F.lit(1.0) / F.col("n")).alias("p"))
    stay = F.lit(0.0)
    for c in scores:
        counted = _above(now, c, F.lit(1.0)).select("query_id", f"{c}_at", c, (F.col("through") - F.col("own")).alias(f"{c}_above"))
        counts = now.filter(F.col(c).isNotNull()).groupBy("query_id").agg(F.count("*").cast("double").alias(f"{c}_all"))
        now = now.join(counted, ["query_id", f"{c}_at", c], "left").join(counts, "query_id", "left")
        above = F.coalesce(f"{c}_above", f"{c}_all", F.lit(0.0))  # an item without a score has all that have it above it
        stay = stay + F.col(f"{c}_weight") * (1 - above / F.col("n"))
    nowhere = F.col("similarity_weight") + F.col("keyword_weight") == 0  # without any score the walk only restarts
    now = now.withColumn("stay", stay).drop(*[f"{c}_{x}" for c in scores for x in ("above", "all")]).checkpoint()
    for _ in range(rounds):
        new = now
        gain = F.col("p") * F.col("stay")
        for c in scores:
            through = _above(now, c, F.col("p")).select("query_id", f"{c}_at", c, F.col("through").alias(f"{c}_through"))
            new = new.join(through, ["query_id", f"{c}_at", c], "left")
            gain = gain + F.when(F.col(c).isNotNull(), F.col(f"{c}_weight") * (1 - F.col(f"{c}_through")) / F.col("n")).otherwise(0.0)
        moved = F.when(nowhere, F.col("p")).otherwise((1 - damping) / F.col("n") + damping * gain)
        new = new.withColumn("next", moved).drop(*[f"{c}_through" for c in scores]).checkpoint()
        most = new.agg(F.max(F.abs(F.col("next") - F.col("p")) * F.col("n"))).first()[0]
        now = new.withColumn("p", F.col("next")).drop("next")
        if most is None or most < tolerance:
            break
    return now.select("query_id", "chunk_id", "similarity", F.col("p").alias("stationarity"))


def fuse_scores(candidates: DataFrame, queries: DataFrame, damping: float = DAMPING, most_in_task: int = MOST_IN_TASK, tolerance: float = TOLERANCE) -> DataFrame:
    """``query_id, chunk_id, stationarity, position``: all candidates of each query, ranked by :func:`rank_walk`.

    Repeated candidates count once, with the best of their scores. Keyword scores of a query that are all negative carry
    the engine's sign and are turned round. A null ``keyword_weight`` is 1, one below 0 (or NaN) is 0; NaN scores are
    missing. A candidate without any score keeps its place by restarts only. Equal probabilities (to 12 digits) are
    ordered by similarity, then chunk id. Queries without a row in ``queries`` get weight 1; candidates with a null
    query or chunk id are dropped. Queries of more than ``most_in_task`` candidates go through :func:`rank_walk_large`.
    """
    missing = lambda c: F.when(~F.isnan(c), F.col(c))
    once = (
        candidates.filter("query_id is not null and chunk_id is not null")
        .groupBy("query_id", "chunk_id")
        .agg(F.max(missing("similarity")).alias("similarity"), F.max(missing("keyword_score")).alias("high"), F.min(missing("keyword_score")).alias("low"))
    )
    weights = queries.groupBy("query_id").agg(F.max("keyword_weight").alias("keyword_weight"))
    weighted = once.join(weights, "query_id", "left").withColumn("keyword_weight", F.greatest(F.nanvl(F.coalesce("keyword_weight", F.lit(1.0)), F.lit(0.0)), F.lit(0.0)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        similarity = pdf["similarity"].to_numpy(float)
        high, low = pdf["high"].to_numpy(float), pdf["low"].to_numpy(float)
        known = high[~np.isnan(high)]
        keyword = -low if len(known) and (known < 0).all() else high
        found = rank_walk([similarity, keyword], [1.0, float(pdf["keyword_weight"].iloc[0])], damping)
        out = pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "stationarity": found})
        key = np.round(found * len(found), 12)
        order = np.lexsort((pdf["chunk_id"].to_numpy(), -np.where(np.isnan(similarity), -np.inf, similarity), -key))
        out["position"] = 0
        out.iloc[order, 3] = np.arange(1, len(out) + 1)
        return out

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")}
    sizes = once.groupBy("query_id").agg(F.count("*").alias("rows"), F.max("high").alias("most")).filter(F.col("rows") > most_in_task)
    large = [r["query_id"] for r in sizes.select("query_id").collect()]  # fewer than rows / most_in_task
    small = weighted.filter(~F.col("query_id").isin(large)) if large else weighted
    ranked = small.groupBy("query_id").applyInPandas(walk, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, stationarity double, position int")
    if not large:
        return ranked
    signed = F.when(F.col("most") < 0, -F.col("low")).otherwise(F.col("high"))
    items = weighted.filter(F.col("query_id").isin(large)).join(F.broadcast(sizes), "query_id").select("query_id", "chunk_id", "similarity", signed.alias("keyword"), "keyword_weight")
    found = rank_walk_large(items, damping, tolerance)
    count = found.groupBy("query_id").agg(F.count("*").alias("n"))
    key = F.round(F.col("stationarity") * F.col("n"), 12)
    # Positions by stretches of the probability, as for the scores.
    keyed = found.join(count, "query_id").withColumn("key", key)
    cuts = F.percentile_approx("key", F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)]), 10_000)
    placed = keyed.join(keyed.groupBy("query_id").agg(cuts.alias("cuts")), "query_id").withColumn("key_at", F.size(F.filter("cuts", _higher_than("key"))))
    sums = placed.groupBy("query_id", "key_at").agg(F.count("*").alias("own"))
    before = sums.withColumn("before", F.sum("own").over(W.partitionBy("query_id").orderBy("key_at").rowsBetween(W.unboundedPreceding, -1))).select("query_id", "key_at", F.coalesce("before", F.lit(0)).alias("before"))
    inside = W.partitionBy("query_id", "key_at").orderBy(F.desc("key"), F.desc_nulls_last("similarity"), "chunk_id")
    numbered = placed.withColumn("k", F.row_number().over(inside)).join(before, ["query_id", "key_at"])
    return ranked.unionByName(numbered.select("query_id", "chunk_id", "stationarity", (F.col("k") + F.col("before")).cast("int").alias("position")))
