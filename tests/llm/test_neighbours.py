import numpy as np

from pyspark.sql import functions as F

from quarry.llm import neighbours as nb

SCHEMA = "chunk_id long, embedding array<float>, vector string"


def clustered(seed=0, rows=3000, dimensions=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((rows, dimensions)) * np.linspace(2, 0.3, dimensions)
    for i in range(0, 300, 3):
        base[i + 1] = base[i] + rng.standard_normal(dimensions) * np.linspace(2, 0.3, dimensions) * 0.15
    return base.astype(np.float32)


def truth(vectors, k):
    unit = nb.unit(vectors)
    similar = unit @ unit.T
    np.fill_diagonal(similar, -2)
    return similar, np.argsort(-similar, axis=1)[:, :k]


def test_recall_and_pairs(spark):
    vectors = clustered()
    similar, top = truth(vectors, 10)
    frame = spark.createDataFrame([(i + 1, v.tolist(), "clash") for i, v in enumerate(vectors)], SCHEMA)
    settings = nb.Settings(probes=6, list_size=300)
    got = {}
    for r in nb.nearest_neighbours(frame, settings=settings).collect():
        got.setdefault(r["id"] - 1, {})[r["neighbour"] - 1] = r["similarity"]
    assert np.mean([len(set(got[i]) & set(top[i])) / 10 for i in range(len(vectors))]) >= 0.9
    assert all(abs(s - similar[i, j]) < 1e-4 for i in range(0, len(vectors), 97) for j, s in got[i].items())
    pairs = {(r[0] - 1, r[1] - 1) for r in nb.similar_pairs(nb.nearest_neighbours(frame, floor=0.9, settings=settings), 0.9).collect()}
    a, b = np.nonzero(np.triu(similar >= 0.9, 1))
    assert pairs == set(zip(a.tolist(), b.tolist())) and len(pairs) >= 90


def test_blocks_of_hot_lists_change_nothing(spark):
    vectors = clustered(1, 900)
    frame = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(vectors)], SCHEMA)
    one = nb.Settings(probes=3, list_size=300)
    cut = nb.Settings(probes=3, list_size=300, member_block=60, query_block=100)
    rows = lambda s: {(r["id"], r["neighbour"]) for r in nb.nearest_neighbours(frame, settings=s, floor=0.3).collect()}
    assert rows(one) == rows(cut)
    assert rows(one) == rows(nb.Settings(probes=3, list_size=300, query_block=50))


def test_fine_lists_find_the_same(spark):
    vectors = clustered(2)
    similar, top = truth(vectors, 10)
    frame = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(vectors)], SCHEMA)
    settings = nb.Settings(probes=12, list_size=30, most_coarse=12, probes_nearest=48)
    index = nb.Index({64: vectors}, {64: len(vectors)}, settings, 12)
    assert len(index.coarse[64]) == 12 and len(index.fine[64]) == 9 and index.lists == 108
    middles = np.array([index.place(n)[1] for n in range(108)])
    part = nb.unit(vectors[:50])
    exact = ((part[:, None, :] - middles[None]) ** 2).sum(2)
    assert (index.nearest(part, 4)[:, 0] == exact.argmin(1)).mean() > 0.95
    pairs = {tuple(r) for r in nb.similar_pairs(nb.nearest_neighbours(frame, floor=0.9, settings=settings), 0.9).collect()}
    a, b = np.nonzero(np.triu(similar >= 0.9, 1))
    assert len(pairs & set(zip(a.tolist(), b.tolist()))) >= 0.99 * len(a) and pairs <= set(zip(a.tolist(), b.tolist()))
    got = {}
    for r in nb.nearest_neighbours(frame, settings=settings).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert np.mean([len(got[i] & set(top[i])) / 10 for i in range(len(vectors))]) >= 0.9


def test_a_vector_of_a_third_of_all_rows(spark):
    vectors = clustered(7, 600)
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)] + [(1000 + i, vectors[5].tolist(), None) for i in range(300)] + [(1000, vectors[5].tolist(), None)] * 90
    frame = spark.createDataFrame(rows, SCHEMA)
    for settings in (nb.Settings(k=5, many_copies=64, list_size=2000), nb.Settings(k=5, many_copies=10**9, list_size=2000)):
        got = {}
        for r in nb.nearest_neighbours(frame, settings=settings, queries=F.col("id") % 2 == 0).collect():
            got.setdefault(r["id"], []).append(r["neighbour"])
        assert set(got) == {r[0] for r in rows if r[0] % 2 == 0}
        assert sorted(got[1000]) == [5, 1001, 1002, 1003, 1004] and sorted(got[1298]) == [5, 1000, 1001, 1002, 1003]
        assert all(len(n) == 5 for n in got.values())


def test_dirty_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], None), (3, [0.0, 0.0], None), (4, None, None), (5, [], None), (6, [1.0, float("nan")], None), (7, [1.0, None], None), (8, [1.0, 0.0, 0.0], None), (9, [2.0, 0.1, 0.0], None), (None, [1.0, 0.0], None), (10, [-1.0, 0.0], None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r["id"], r["neighbour"]) for r in nb.nearest_neighbours(frame).collect()}
    assert got == {(1, 2), (2, 1), (1, 10), (10, 1), (2, 10), (10, 2), (8, 9), (9, 8)}
    assert {tuple(r) for r in nb.similar_pairs(nb.nearest_neighbours(frame, floor=0.9), 0.9).collect()} == {(1, 2), (8, 9)}
    assert nb.nearest_neighbours(frame.limit(0)).count() == 0
    asked = nb.nearest_neighbours(frame, queries=F.col("id") % 2 == 0).collect()
    assert {r["id"] for r in asked} == {2, 8, 10}


def test_bounds_hold():
    rng = np.random.default_rng(3)
    members, queries = nb.unit(rng.standard_normal((800, 64))), nb.unit(rng.standard_normal((200, 64)))
    centroid, turn = nb.unit(rng.standard_normal((1, 64)))[0] * 0.4, nb.rotation(64, 7)
    at, error = nb.Codes(members, centroid, turn).estimate(queries, centroid, turn)
    off = np.abs(at - queries @ members.T)
    assert off.mean() < 0.12 and (off <= 3.5 * error + 0.02).mean() > 0.995
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-4)


def test_repeated_rows_take_one_place():
    vectors = nb.unit(clustered(5, 500))
    similar, top = truth(vectors, 10)
    near = int(top[0][0])
    ids = np.r_[np.arange(500), np.full(300, near), np.zeros(40, np.int64)]
    members = np.r_[vectors, np.repeat(vectors[near][None], 300, 0), np.repeat(vectors[:1], 40, 0)]
    centroid, turn = nb.unit(vectors.mean(0)[None])[0], nb.rotation(64, 7)
    for floor in (-1.0, 0.0):
        found = list(nb.search_list(np.arange(20), vectors[:20], ids, members, centroid, turn, 10, floor, 3.5))
        a, b, s = (np.concatenate([f[i] for f in found]) for i in range(3))
        assert all(set(b[a == q]) == set(top[q]) and len(b[a == q]) == 10 for q in range(20))
    # Other rows of the same id, less similar, take no place either.
    other = np.r_[members, nb.unit(vectors[top[0]] + 0.05)]
    found = list(nb.search_list(np.zeros(1, np.int64), vectors[:1], np.r_[ids, top[0]], other, centroid, turn, 10, -1.0, 3.5))
    assert len(set(found[0][1])) == 10
