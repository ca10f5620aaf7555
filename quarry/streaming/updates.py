"""ST-4 as a stream: sightings of files arrive, the table of files follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators.changes import plain_hash

SIGHTINGS = "scan_id long, path string, size long, modified_nanoseconds long, content_hash string, seen_at timestamp, arrived_at timestamp"


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the rows written to a folder of Parquet files."""
    return spark.readStream.schema(SIGHTINGS).parquet(folder)


def latest_states(stream: DataFrame) -> DataFrame:
    """``path, content, seen_at`` of the latest sighting of each path so far; state holds one row a path."""
    content = plain_hash("content_hash")
    last = F.max_by(content, F.struct("seen_at", "arrived_at")).alias("content")
    return stream.filter("path is not null").groupBy("path").agg(last, F.max("seen_at").alias("seen_at"))


def sightings_per_day(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Distinct sightings a day of arrival; rows later than ``delay`` are dropped with the state of their day."""
    kept = stream.withWatermark("arrived_at", delay).dropDuplicates(["scan_id", "path", "arrived_at"])
    return kept.groupBy(F.window("arrived_at", "1 day").alias("day")).agg(F.count("*").alias("sightings"))


def run_available(stream: DataFrame, process, checkpoint: str) -> None:
    """Processes what is there in batches, each once (``process(batch, number)`` has to be repeatable), and stops."""
    query = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
