"""SRC-11, SNK-1..SNK-8: an index as immutable versions of its tables, with an identity that must fit.

Tables of files are kept in buckets of a file's id. A version is one commit that names, for each table and bucket, the
folder its rows are in; a write makes new folders only for the buckets it changes, and the rest are named again. So one
changed file costs the rewriting of its buckets, and a new row of roots that of the roots.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import catalog, retrieval
from quarry.sources.commits import Commits

SCHEMAS = {
    "files": "file_id long, path string, size long, modified_nanoseconds long, content_hash string",
    "chunks": "chunk_id long, file_id long, kind string, page int, start_ms long, end_ms long, start_line int, end_line int, text string, embedding array<float>",
    "postings": "term string, chunk_id long, tf double, length int, file_id long",
    "skipped": "file_id long, reason string",
    "roots": "path string, options string, indexed_at long",
}
BY_FILE = ("files", "chunks", "postings", "skipped")
#: Versions of the rules chunks and segments are made by.
CHUNKER, SEGMENTATION, LAYOUT = "2", "1", "2"
#: Buckets of a new index; an index keeps the number it began with.
BUCKETS = 64


class IdentityError(ValueError):
    """The index was made by another encoder or by other rules; it has to be rebuilt."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, encoder: str, dimensions: int, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.identity = {"layout": LAYOUT, "encoder": encoder, "dimensions": dimensions, "chunker": CHUNKER, "segmentation": SEGMENTATION}
        self.commits, self._buckets = Commits(spark, self.folder, "versions"), buckets

    def version(self) -> int:
        return self.commits.last()

    def _state(self) -> dict:
        last = self.version()
        return self.commits.read(last) if last else {"identity": self.identity, "buckets": self._buckets, "tables": {}}

    def check(self) -> None:
        """Fails if the last version has another identity."""
        found = self._state()["identity"]
        if found != self.identity:
            raise IdentityError(f"the index is of {found}, not of {self.identity}")

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        folders = (self._state() if state is None else state)["tables"].get(name, {})
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.folder}/data/{f}" for f in sorted(set(folders.values()))])

    def postings_of(self, terms: list[str]) -> DataFrame:
        """The postings of some words and the lengths of all chunks; rows lie in order of words, so the rest is not read."""
        return self.table("postings").filter(F.col("term").isin([retrieval.LENGTH, *terms]))

    def _bucket(self, state: dict):
        return F.pmod(F.xxhash64(F.col("file_id").cast("long")), F.lit(state["buckets"])).cast("int")

    def _store(self, run: str, name: str, rows: DataFrame, state: dict) -> dict[str, str]:
        columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        if name not in BY_FILE:
            rows.select(*columns).write.parquet(f"{self.folder}/data/{run}/{name}")
            return {"all": f"{run}/{name}"}
        if name == "chunks":
            wrong = F.col("embedding").isNotNull() & (F.size("embedding") != self.identity["dimensions"])
            rows = rows.withColumn("embedding", F.when(wrong, F.raise_error(F.lit(f"a vector without {self.identity['dimensions']} dimensions"))).otherwise(F.col("embedding")))
        order = ["bucket", "term"] if name == "postings" else ["bucket", "kind", "file_id"] if name == "chunks" else ["bucket", "file_id"]
        placed = rows.select(*columns, self._bucket(state).alias("bucket")).repartition("bucket").sortWithinPartitions(*order)
        placed.write.partitionBy("bucket").parquet(f"{self.folder}/data/{run}/{name}")
        listed = self.commits.fs.listStatus(self.commits.path(f"data/{run}/{name}"))
        names = [s.getPath().getName() for s in listed]
        return {n.removeprefix("bucket="): f"{run}/{name}/{n}" for n in names if n.startswith("bucket=")}

    def _publish(self, version: int, state: dict) -> int:
        self.commits.publish(version + 1, {**state, "identity": self.identity})
        return version + 1

    def write(self, **tables: DataFrame) -> int:
        """A new version with whole tables exchanged; those that aren't given stay as they are. Postings follow the chunks."""
        self.check()
        version, state, run = self.version(), self._state(), str(uuid4())
        if "chunks" in tables:
            tables["postings"] = retrieval.postings(tables["chunks"].select("chunk_id", "file_id", "text"), "chunk_id", "file_id")
        changed = {name: self._store(run, name, rows, state) for name, rows in tables.items()}
        return self._publish(version, {**state, "tables": {**state["tables"], **changed}})

    def replace_files(self, files: DataFrame, chunks: DataFrame, skipped: DataFrame, removed: DataFrame, roots: DataFrame | None = None) -> int:
        """SNK-1..SNK-4, SNK-8: the given files with their chunks, words and reasons instead of what was there, and ``removed`` paths gone.

        Only buckets with a file that comes, changes or goes are written. With ``roots`` these are exchanged in the same
        version. Without any change there is no new version.
        """
        self.check()
        version, state, run = self.version(), self._state(), str(uuid4())
        old = self.table("files", state)
        gone = files.select("path").unionByName(removed.select("path")).distinct()
        ids = old.join(gone, "path", "left_semi").select("file_id").unionByName(files.select("file_id")).distinct().checkpoint()
        touched = sorted(r["bucket"] for r in ids.select(self._bucket(state).alias("bucket")).distinct().collect())  # at most as many as there are buckets
        new = {"files": files, "chunks": chunks, "postings": retrieval.postings(chunks.select("chunk_id", "file_id", "text"), "chunk_id", "file_id"), "skipped": skipped}
        tables = dict(state["tables"])
        for name in BY_FILE if touched else ():
            known = tables.get(name, {})
            here = {b: f for b, f in known.items() if int(b) in touched}
            rest = self.table(name, {"tables": {name: here}}).join(ids, "file_id", "left_anti")
            columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
            tables[name] = {b: f for b, f in known.items() if b not in here} | self._store(run, name, rest.select(*columns).unionByName(new[name].select(*columns)), state)
        if roots is not None:
            tables["roots"] = self._store(run, "roots", roots, state)
        return version if not touched and roots is None else self._publish(version, {**state, "tables": tables})

    def forget(self, scope: str) -> int:
        """SNK-5: the number of files removed; roots inside the scope go too."""
        files = self.table("files")
        out = files.filter(catalog.in_scope(F.col("path"), scope)).select("path")
        count = out.count()
        nothing = {name: self.spark.createDataFrame([], SCHEMAS[name]) for name in ("files", "chunks", "skipped")}
        self.replace_files(nothing["files"], nothing["chunks"], nothing["skipped"], out, self.table("roots").filter(~catalog.in_scope(F.col("path"), scope)))
        return count

    def compact(self) -> None:
        """SNK-7: drops the versions before the last, and all data that the last does not name. Not while another run works."""
        last, fs = self.version(), self.commits.fs
        named = {f for folders in self._state()["tables"].values() for f in folders.values()}
        for number in self.commits.numbers():
            if number != last:
                fs.delete(self.commits.path(f"versions/{number}"), False)
        if not fs.exists(self.commits.path("data")):
            return
        for run in fs.listStatus(self.commits.path("data")):
            own = run.getPath().getName()
            if not any(f.startswith(f"{own}/") for f in named):
                fs.delete(run.getPath(), True)
                continue
            for part in fs.listStatus(run.getPath()):
                name = part.getPath().getName()
                for bucket in fs.listStatus(part.getPath()) if name in BY_FILE else ():
                    leaf = bucket.getPath().getName()
                    if leaf.startswith("bucket=") and f"{own}/{name}/{leaf}" not in named:
                        fs.delete(bucket.getPath(), True)

    def rebuild(self) -> None:
        """Starts over: all versions are dropped."""
        for folder in ("versions", "data", "drafts"):
            self.commits.fs.delete(self.commits.path(folder), True)
