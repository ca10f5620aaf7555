"""Which paths each scan run has to process (problem 4).

Successful runs are numbered in order of time, from 1; number 0 is the state the index had before. Each content of a
path is processed once and holds for an interval of numbers: from the run that processed it, as long as successful runs
see the path, and either see the same content or can't read it. A run has to process what no interval covers.

The runs are taken one after another by the ledger: the numbers it has processed are kept as intervals, and each gap is
compared with the state committed by the run before it. ``content_intervals`` gives the same by windows over all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.session import scratch_folder
from quarry.streaming.ledger import Ledger


def plain_hash(column: str) -> Column:
    """A content hash without its algorithm tag, in lower case; null for blank ones."""
    bare = F.lower(F.trim(F.regexp_replace(column, r"^\s*[A-Za-z][A-Za-z0-9_-]*:", "")))
    return F.when(bare != "", bare)


def successful_runs(runs: DataFrame) -> DataFrame:
    """``scan_id, number`` of the runs whose latest row says that they succeeded.

    Of equally late rows a finished one holds. Runs without a start come last, equal starts are ordered by id. One row a
    run: a short table.
    """
    last = runs.filter("scan_id is not null").groupBy("scan_id").agg(F.max_by(F.struct("started_at", "run_status"), F.struct("recorded_at", "finished_at", "run_status")).alias("last"))
    good = last.filter(F.lower(F.trim("last.run_status")) == "succeeded")
    return good.select("scan_id", F.row_number().over(W.orderBy(F.col("last.started_at").asc_nulls_last(), "scan_id")).alias("number"))


def path_states(files: DataFrame, numbered: DataFrame, sightings: DataFrame) -> DataFrame:
    """``path, number, content``: what each numbered run saw of each path, and the index before them as number 0.

    Of the sightings of a path in a run the latest by ``seen_at`` holds (of equal ones the latest arrival, then the
    larger hash), whenever it arrived; of its rows in ``files`` the latest by ``recorded_at``. Null paths are dropped.
    Aggregations come before the shuffles; a path has at most one row a run.
    """
    before = files.filter("path is not null").groupBy("path").agg(F.max_by(F.struct(plain_hash("content_hash").alias("content")), F.struct("recorded_at", "modified_nanoseconds", plain_hash("content_hash"))).alias("last")).select("path", F.lit(0).alias("number"), F.col("last.content").alias("content"))
    seen = sightings.filter("path is not null").join(F.broadcast(numbered) if _is_short(numbered) else numbered, "scan_id")
    seen = seen.groupBy("path", "number").agg(F.max_by(F.struct(plain_hash("content_hash").alias("content")), F.struct("seen_at", "arrived_at", plain_hash("content_hash"))).alias("last")).select("path", "number", F.col("last.content").alias("content"))
    return before.unionByName(seen)


def content_intervals(files: DataFrame, runs: DataFrame, sightings: DataFrame) -> DataFrame:
    """``path, content, from_number, to_number``: disjoint intervals of each path, in which its content was processed."""
    states = path_states(files, successful_runs(runs), sightings)
    by_path = W.partitionBy("path").orderBy("number")
    # A run of consecutive numbers: the path was there all the time.
    stay = states.withColumn("stay", F.col("number") - F.row_number().over(by_path))
    in_stay = W.partitionBy("path", "stay").orderBy("number")
    known = F.last("content", True).over(in_stay.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(F.col("content").isNotNull() & ~known.eqNullSafe(F.col("content")), 1).otherwise(0)
    versions = stay.withColumn("starts", starts).withColumn("version", F.sum("starts").over(in_stay.rowsBetween(W.unboundedPreceding, 0)))
    held = versions.filter("version > 0").groupBy("path", "stay", "version").agg(F.max("content").alias("content"), F.min("number").alias("from_number"), F.max("number").alias("to_number"))
    return held.select("path", "content", "from_number", "to_number")


def _is_short(runs: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of runs is short enough to be sent to all executors: counted, not assumed."""
    return len(runs.limit(most + 1).collect()) <= most


def process_runs(ledger: Ledger, states: DataFrame, last: int) -> None:
    """Takes the numbers up to ``last`` one by one; each commits ``path, number, content, due`` with the merged intervals.

    ``content`` is what was last processed. Numbers the ledger already has are not taken again, so a call after a failure
    goes on where that one stopped. Only the state of the number just before counts: what a run didn't see is gone.
    """
    first, done = 0, ledger.processed().agg(F.max("high")).first()[0]
    if done is not None:
        first = done + 1
    for number in range(first, last + 1):

        def process(new: DataFrame, number: int = number) -> DataFrame:
            output = ledger.output()
            if output is None:
                return new.select("path", "number", "content", F.lit(False).alias("due") if number == 0 else F.col("content").isNotNull().alias("due"))
            known = output.filter(F.col("number") == number - 1).select("path", F.col("content").alias("known"))
            joined = new.join(known, "path", "left")
            due = F.col("content").isNotNull() & ~F.col("content").eqNullSafe(F.col("known"))
            return joined.select("path", "number", F.coalesce("content", "known").alias("content"), due.alias("due"))

        ledger.run(states.filter(F.col("number") <= number), "number", process)


def paths_to_process(files: DataFrame, runs: DataFrame, sightings: DataFrame, folder: str | None = None) -> DataFrame:
    """``scan_id, path``: what no interval covers in a run, that run has to process.

    ``folder`` is where the ledger is kept, a new one in the shared folder if not given. Sightings are reduced to a row a
    path and run once, stored by run, so that a run reads its own rows and the state before it.
    """
    spark = files.sparkSession
    folder = folder or scratch_folder(spark, "changes")
    numbered = successful_runs(runs)
    path_states(files, numbered, sightings).write.mode("overwrite").partitionBy("number").parquet(f"{folder}/states")
    states = spark.read.schema("path string, content string, number int").parquet(f"{folder}/states")
    ledger = Ledger(spark, f"{folder}/ledger")
    process_runs(ledger, states, numbered.agg(F.max("number")).first()[0] or 0)
    output = ledger.output()
    if output is None:
        return numbered.join(states, "number").select("scan_id", "path")
    return output.filter("due").join(numbered, "number").select("scan_id", "path")
