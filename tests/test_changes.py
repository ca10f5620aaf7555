import datetime as dt

import pytest

from quarry.operators import changes, intervals
from quarry.session import shared_folder
from quarry.sources.commits import Conflict
from quarry.streaming.ledger import Ledger

T = dt.datetime(2026, 1, 1)


def at(n):
    return T + dt.timedelta(hours=n)


FILES = "file_id long, path string, size long, modified_nanoseconds long, content_hash string, recorded_at timestamp"
RUNS = "scan_id long, started_at timestamp, finished_at timestamp, run_status string, recorded_at timestamp"
SEEN = "scan_id long, path string, size long, modified_nanoseconds long, content_hash string, seen_at timestamp, arrived_at timestamp"


def tables(spark, files, runs, seen):
    return spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(seen, SEEN)


def run(scan, hour, status="succeeded", recorded=None):
    return (scan, at(hour), at(hour + 1), status, at(recorded or hour + 1))


def sighting(scan, path, content, hour, late=0):
    return (scan, path, 1, 0, content, at(hour), at(hour + late))


def due(spark, files, runs, seen):
    return {(r["scan_id"], r["path"]) for r in changes.paths_to_process(*tables(spark, files, runs, seen)).collect()}


def brute(files, runs, seen):
    """One path at a time, one run after another."""
    plain = lambda h: None if h is None or not h.split(":")[-1].strip() else h.split(":")[-1].strip().lower()
    last = {}
    for r in sorted(runs, key=lambda r: r[4]):
        last[r[0]] = r
    order = sorted((r for r in last.values() if r[3] == "succeeded"), key=lambda r: (r[1], r[0]))
    state = {}
    for f in sorted(files, key=lambda f: f[5]):
        if f[1] is not None:
            state[f[1]] = plain(f[4])
    out = set()
    for r in order:
        now = {}
        for s in sorted((s for s in seen if s[0] == r[0] and s[1] is not None), key=lambda s: (s[5], s[6])):
            now[s[1]] = plain(s[4])
        new = {}
        for path, content in now.items():
            known = state.get(path)
            if content is not None and content != known:
                out.add((r[0], path))
            new[path] = known if content is None else content
        state = new
    return out


def test_cases(spark):
    files = [(1, "same", 1, 0, "AA", at(-9)), (2, "old", 1, 0, "x1", at(-9)), (2, "old", 1, 0, "x0", at(-10)), (3, "never", 1, 0, None, at(-9)), (4, "gone", 1, 0, "g", at(-9)), (5, None, 1, 0, "n", at(-9))]
    runs = [run(30, 10), run(10, 0), run(20, 5, "failed"), run(40, 20), run(40, 20, "running", 20), (50, at(30), None, None, at(30))]
    seen = [
        sighting(10, "same", "sha256:aa", 0), sighting(10, "old", "x0", 0), sighting(10, "old", "x1", 1), sighting(10, "never", "v", 0), sighting(10, "never", "v", 0),
        sighting(10, "unread", None, 0), sighting(20, "onlyfailed", "f", 5), sighting(20, "same", "bb", 5), sighting(30, "same", "aa", 10), sighting(30, "onlyfailed", "f", 10),
        sighting(30, "gone", "g", 10, late=200), sighting(30, "old", None, 10), sighting(40, "old", "x1", 20), sighting(40, "never", "v", 20), sighting(50, "new", "n", 30), sighting(99, "norun", "n", 1), sighting(30, None, "n", 10),
    ]
    expected = {(10, "never"), (30, "onlyfailed"), (30, "gone"), (40, "never")}
    assert brute(files, runs, seen) == expected
    assert due(spark, files, runs, seen) == expected
    assert due(spark, [], [], []) == set()
    assert due(spark, files, runs, []) == set()


@pytest.mark.parametrize("seed", range(3))
def test_against_one_run_after_another(spark, seed):
    import random

    rng = random.Random(seed)
    paths = [f"p{i}" for i in range(12)]
    content = lambda: rng.choice([None, "a", "A", "sha1:b", "b", "c", ""])
    files = [(i, p, 1, 0, content(), at(-5 + rng.random())) for i, p in enumerate(paths) if rng.random() < 0.7]
    starts = rng.sample(range(0, 100, 3), 8)
    runs = [run(i, h, rng.choice(["succeeded", "succeeded", "failed"]), h + 1 + k + rng.random()) for i, h in enumerate(starts) for k in range(rng.randint(1, 2))]
    seen = [sighting(i, p, content(), h + rng.random(), rng.random() * 50) for i, h in enumerate(starts) for p in paths for _ in range(rng.randint(0, 2))]
    assert due(spark, files, runs, seen) == brute(files, runs, seen)


def test_intervals_of_a_path_are_disjoint(spark, small):
    from quarry.plans.change_queries import p4_intervals

    rows = p4_intervals(spark, small).collect()
    by_path = {}
    for r in rows:
        by_path.setdefault(r["path"], []).append((r["from_number"], r["to_number"]))
    assert rows and all(a[1] < b[0] for own in by_path.values() for a, b in zip(sorted(own), sorted(own)[1:]))


def test_interval_sets(spark):
    numbers = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    held = lambda df: sorted((r["low"], r["high"]) for r in df.collect())
    own = intervals.to_intervals(numbers(5, 1, 2, 2, 9, None, 3), "n")
    assert held(own) == [(1, 3), (5, 5), (9, 9)]
    assert held(intervals.merge(own.unionByName(intervals.to_intervals(numbers(4, 10), "n")))) == [(1, 5), (9, 10)]
    edge = intervals.STRETCH
    assert held(intervals.to_intervals(numbers(edge - 1, edge), "n")) == [(edge - 1, edge - 1), (edge, edge)]
    assert sorted(r["n"] for r in intervals.subtract(numbers(1, 4, 5, 8, None), "n", own).collect()) == [4, 8]
    assert sorted(r["n"] for r in intervals.keep(numbers(1, 4, 5), "n", own).collect()) == [1, 5]
    assert held(intervals.to_intervals(numbers(), "n")) == []


def test_ledger_survives_failures_and_late_records(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    rows = lambda *n: spark.createDataFrame([(x, f"r{x}") for x in n], "n long, v string")
    assert ledger.version() == 0 and ledger.output() is None
    assert ledger.run(rows(1, 2, 5), "n", lambda d: d) == 1
    real = ledger._commit
    ledger._commit = lambda version: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        ledger.run(rows(1, 2, 3, 5, 6), "n", lambda d: d)
    ledger._commit = real
    assert ledger.version() == 1 and ledger.output().count() == 3
    with pytest.raises(Exception):
        ledger.run(rows(1, 7), "n", lambda d: d.selectExpr("raise_error('bad') as x"))
    assert ledger.run(rows(1, 2, 3, 4, 5, 6), "n", lambda d: d) == 2  # 3, 6 are new, 4 was committed late
    assert ledger.run(rows(1, 2, 3, 4, 5, 6), "n", lambda d: d) == 2
    assert sorted(r["n"] for r in ledger.output().collect()) == [1, 2, 3, 4, 5, 6]
    assert [(r["low"], r["high"]) for r in ledger.processed().collect()] == [(1, 6)]


def test_runs_are_taken_by_the_ledger(spark, tmp_path, monkeypatch):
    files = [(1, "kept", 1, 0, "a", at(-9)), (2, "gone", 1, 0, "g", at(-9))]
    runs = [run(10, 0), run(20, 5), run(30, 10), run(40, 20)]
    seen = [sighting(10, "kept", "a", 0), sighting(10, "gone", "g", 0), sighting(20, "kept", None, 5), sighting(40, "kept", "a", 20), sighting(40, "gone", "h", 20)]  # run 30 saw nothing
    own, folder = tables(spark, files, runs, seen), str(tmp_path / "c")
    commit, taken = Ledger._commit, []

    def failing(ledger, version):
        taken.append(version)
        if len(taken) == 3:
            raise OSError("lost")
        commit(ledger, version)

    monkeypatch.setattr(Ledger, "_commit", failing)
    with pytest.raises(OSError):
        changes.paths_to_process(*own, folder)
    found = changes.paths_to_process(*own, folder)
    assert taken == [1, 2, 3, 3, 4]
    assert sorted(tuple(r) for r in found.collect()) == [(40, "gone"), (40, "kept")]
    ledger = Ledger(spark, f"{folder}/ledger")
    assert [(r["low"], r["high"]) for r in ledger.processed().orderBy("low").collect()] == [(0, 2), (4, 4)]
    window = changes.content_intervals(*own).filter("from_number > 0").select("path", "from_number").collect()
    assert sorted(tuple(r) for r in window) == [("gone", 4), ("kept", 4)]


def test_two_runs_from_one_commit(spark, tmp_path):
    one, two = Ledger(spark, str(tmp_path / "l")), Ledger(spark, str(tmp_path / "l"))
    rows = lambda *n: spark.createDataFrame([(x, f"r{x}") for x in n], "n long, v string")
    one.run(rows(1), "n", lambda d: d)

    def meanwhile(new):
        assert two.run(rows(1, 2), "n", lambda d: d) == 2
        return new

    with pytest.raises(Conflict):
        one.run(rows(1, 2, 3), "n", meanwhile)
    assert one.version() == 2 and sorted(r["n"] for r in one.output().collect()) == [1, 2]
    assert one.run(rows(1, 2, 3), "n", lambda d: d) == 3
    assert sorted(r["n"] for r in two.output().collect()) == [1, 2, 3]
    assert one.clean() > 0 and sorted(r["n"] for r in one.output().collect()) == [1, 2, 3]
    assert one.run(rows(1, 2, 3), "n", lambda d: d) == 3


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        shared_folder(Session)
