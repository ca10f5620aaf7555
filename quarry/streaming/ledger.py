"""Processing each record once, across failures and late commits (problem 4, for any numbered source).

Each run writes its output and the merged intervals of all numbers processed so far into a folder of its own, and counts
from the moment its commit exists; the commit names both, so they come into force together. What a failed run leaves
behind is named by no commit: it is not read, and ``clean`` removes it. Of two runs that start from the same commit
one fails, with nothing of it counted.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import intervals
from quarry.sources.commits import Commits

INTERVALS = "stretch long, low long, high long"


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Commits(spark, self.folder)
        self._next: dict = {}

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        return self.commits.last()

    def _state(self, version: int) -> dict:
        return self.commits.read(version) if version else {"intervals": None, "outputs": []}

    def processed(self, version: int | None = None) -> DataFrame:
        """``stretch, low, high`` of all numbers processed up to the version."""
        run = self._state(self.version() if version is None else version)["intervals"]
        if run is None:
            return self.spark.createDataFrame([], INTERVALS)
        return self.spark.read.schema(INTERVALS).parquet(f"{self.folder}/runs/{run}/intervals")

    def output(self) -> DataFrame | None:
        """The output of all committed versions, None before the first."""
        runs = self._state(self.version())["outputs"]
        return self.spark.read.parquet(*[f"{self.folder}/runs/{r}/output" for r in runs]) if runs else None

    def run(self, source: DataFrame, number: str, process: Callable[[DataFrame], DataFrame]) -> int:
        """Processes the records whose numbers are in the source and not yet processed; gives the committed version.

        The gaps are written first, and exactly the records in them are processed, so a record that arrives meanwhile
        waits for the next run. Records without a number are never processed. A run that finds no gap commits nothing.
        """
        version, run = self.version(), str(uuid4())
        state, own = self._state(version), f"{self.folder}/runs/{run}"
        done = self.processed(version)
        intervals.to_intervals(intervals.subtract(source, number, done), number).write.parquet(f"{own}/gaps")
        gaps = self.spark.read.schema(INTERVALS).parquet(f"{own}/gaps")
        if gaps.isEmpty():
            return version
        process(intervals.keep(source, number, gaps)).write.parquet(f"{own}/output")
        intervals.merge(done.unionByName(gaps)).write.parquet(f"{own}/intervals")
        self._next = {"intervals": run, "outputs": [*state["outputs"], run]}
        self._commit(version + 1)
        return version + 1

    def _commit(self, version: int) -> None:
        self.commits.publish(version, self._next)

    def clean(self) -> int:
        """Removes the folders of runs that no commit needs any more, and gives their number. Not while another run works."""
        state = self._state(self.version())
        needed, runs = {*state["outputs"], state["intervals"]}, self.commits.path("runs")
        stale = [s.getPath() for s in self.commits.fs.listStatus(runs) if s.getPath().getName() not in needed] if self.commits.fs.exists(runs) else []
        for path in stale:
            self.commits.fs.delete(path, True)
        return len(stale)
