import numpy as np
import pytest

from quarry.llm.fusion import fuse_scores, rank_walk, rank_walk_large, upward_walk

RESULTS, QUERIES = "query_id long, chunk_id long, similarity double, keyword_score double, position string", "query_id long, keyword_weight double"
NAN = float("nan")


def by_matrix(scores, weights, damping):
    n = len(scores[0])
    use = [(np.where(np.isnan(s), -np.inf, s), w) for s, w in zip(scores, weights) if w > 0 and not np.isnan(s).all()]
    total = sum(w for _, w in use)
    walk = np.zeros((n, n))
    for s, w in use:
        for i in range(n):
            above = s > s[i]
            walk[i, above] += w / total / n
            walk[i, i] += w / total * (1 - above.sum() / n)
    whole = damping * walk + (1 - damping) / n
    values, vectors = np.linalg.eig(whole.T)
    v = np.real(vectors[:, np.argmax(np.real(values))])
    return v / v.sum()


@pytest.mark.parametrize("seed", range(6))
def test_prefix_sums_against_the_whole_matrix(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 12, 40).astype(float), rng.integers(0, 5, 40) * 1000.0
    a[rng.random(40) < 0.2], b[rng.random(40) < 0.6] = NAN, NAN
    assert rank_walk([a, b], [1.0, 0.5], 0.7) == pytest.approx(by_matrix([a, b], [1.0, 0.5], 0.7), abs=1e-8)


def test_only_the_order_counts():
    a = np.array([0.9, 0.8, 0.7, 0.6, NAN])
    b = np.array([NAN, 5.0, 1.0, NAN, 1e9])
    first = rank_walk([a, b], [1, 1])
    assert first.argmax() == 1 and first.sum() == pytest.approx(1)
    assert rank_walk([a * 1000 - 7, np.log(b)], [1, 1]) == pytest.approx(first)
    assert rank_walk([a, b], [1, 0]).argmax() == 0
    assert rank_walk([a, np.full(5, NAN)], [1, 1]).argmax() == 0
    assert rank_walk([np.full(3, NAN)], [1]) == pytest.approx([1 / 3] * 3) and len(rank_walk([np.zeros(0)], [1])) == 0


def test_table(spark):
    rows = [
        (1, 1, 0.9, None, "clash"), (1, 2, 0.8, 9.0, None), (1, 3, 0.7, 5.0, None), (1, 4, None, 999.0, None), (1, 2, 0.8, 9.0, None), (1, 5, 0.6, None, None),
        (2, 1, 0.9, None, None), (2, 2, 0.8, -9.0, None), (2, 3, 0.7, -1.0, None), (2, 4, None, -99.0, None),
        (3, 1, 0.5, 1.0, None), (3, 2, 0.9, None, None), (4, 7, None, None, None), (4, 8, NAN, NAN, None), (5, 1, 0.2, 3.0, None), (5, 2, 0.1, 4.0, None), (None, 1, 0.1, 1.0, None), (1, None, 0.99, 1.0, None),
        (6, 1, 0.5, 2.0, None), (6, 2, 0.5, 2.0, None),
    ]
    weights = [(1, None), (2, 1.0), (3, 0.0), (5, -2.0), (5, None), (6, 1.0), (None, 1.0)]
    got = fuse_scores(spark.createDataFrame(rows, RESULTS), spark.createDataFrame(weights, QUERIES)).collect()
    first = {r["query_id"]: r["chunk_id"] for r in got if r["position"] == 1}
    assert first == {1: 2, 2: 2, 3: 2, 4: 7, 5: 1, 6: 1}
    assert sorted(r["position"] for r in got if r["query_id"] == 1) == [1, 2, 3, 4, 5]
    empty = spark.createDataFrame([], RESULTS)
    assert fuse_scores(empty, spark.createDataFrame(weights, QUERIES)).count() == 0


def test_large_queries_walk_alike(spark):
    """Two rounds of the distributed walk against two rounds of the whole matrix."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 40).astype(float), rng.integers(1, 6, 40).astype(float)
    a[rng.random(40) < 0.2], b[rng.random(40) < 0.5] = NAN, NAN
    none = lambda x: None if np.isnan(x) else float(x)
    rows = [(1, i, none(x), none(y), 0.5) for i, (x, y) in enumerate(zip(a, b))] + [(2, 0, None, None, 1.0), (2, 1, None, None, 1.0), (3, 0, 0.5, None, 2.0), (3, 1, 0.7, None, 2.0)]
    items = spark.createDataFrame(rows, "query_id long, chunk_id long, similarity double, keyword double, keyword_weight double")
    got = {(r["query_id"], r["chunk_id"]): r["stationarity"] for r in rank_walk_large(items, 0.7, rounds=2).collect()}
    n, walk = 40, np.zeros((40, 40))
    for s, w in ((a, 1 / 1.5), (b, 0.5 / 1.5)):
        for i in range(n):
            above = (s > s[i]) if not np.isnan(s[i]) else ~np.isnan(s)
            walk[i, above] += w / n
            walk[i, i] += w * (1 - above.sum() / n)
    want = np.full(n, 1 / n)
    for _ in range(2):
        want = 0.3 / n + 0.7 * want @ walk
    assert [got[1, i] for i in range(n)] == pytest.approx(want.tolist())
    assert got[2, 0] == got[2, 1] == 0.5 and got[3, 1] > got[3, 0]


def test_large_queries_get_positions(spark):
    rows = [(1, i, 0.5 + i / 100, float(i % 3) if i % 2 else None, None) for i in range(12)] + [(2, 1, 0.4, None, None)]
    frame = fuse_scores(spark.createDataFrame(rows, RESULTS), spark.createDataFrame([(1, 1.0)], QUERIES), most_in_task=5, tolerance=1e9)
    got = {(r["query_id"], r["position"]): r["chunk_id"] for r in frame.collect()}
    assert sorted(p for q, p in got if q == 1) == list(range(1, 13)) and got[1, 1] == 11 and got[2, 1] == 1


def test_large_queries_converge_to_the_same(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random(60), rng.integers(0, 12, 60).astype(float)
    b[rng.random(60) < 0.4] = NAN
    rows = [(1, i, float(x), None if np.isnan(y) else float(y), 0.8) for i, (x, y) in enumerate(zip(a, b))]
    items = spark.createDataFrame(rows, "query_id long, chunk_id long, similarity double, keyword double, keyword_weight double")
    got = {r["chunk_id"]: r["stationarity"] for r in rank_walk_large(items, 0.05).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(rank_walk([a, b], [1.0, 0.8], 0.05).tolist(), rel=1e-8)


def test_why_the_walk_may_stay():
    n = 40
    up = lambda first: np.array([first, *range(n - 1, 0, -1)], float)
    # Item 0 leads one score and is in the middle of the other; item 1 is second and first.
    a, b = up(n + 1), up(n / 2 + 0.5)
    assert rank_walk([a, b], [1, 1]).argmax() == 1
    # Where item 1 is second in both, the upward walk still prefers the leader of one.
    b[2] = n + 2
    assert rank_walk([a, b], [1, 1]).argmax() == 1 and upward_walk([a, b], [1, 1]).argmax() != 1
    assert upward_walk([a, b], [1, 1]).sum() == pytest.approx(1)
    matrix = np.zeros((4, 4))
    c = np.array([3.0, 2.0, 2.0, 1.0])
    for i in range(4):
        above = c > c[i]
        matrix[i] = above / above.sum() if above.any() else 0.25
    want = np.full(4, 0.25)
    for _ in range(200):
        want = 0.3 / 4 + 0.7 * want @ matrix
    assert upward_walk([c], [1.0]) == pytest.approx(want.tolist())
