"""Numbered commits in a folder: each is one small file that appears whole, and only if nobody else made that number."""

from __future__ import annotations

import json
import os
from uuid import uuid4

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """The number was committed by another run meanwhile; nothing of this run counts."""


class Commits:
    """Commit files hold a JSON object that names what belongs to the commit.

    Data is written to a folder of its own before, so runs never write over each other, and what a failed run leaves
    behind is in no commit.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "commits"):
        self.folder, self.name = folder.rstrip("/"), name
        self._jvm = spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path(self.name)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.name))]
        return sorted(int(n) for n in names if n.isdigit())

    def last(self) -> int:
        """The last committed number, 0 before the first."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.path(f"{self.name}/{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        """Writes a draft and gives it its number by a step that fails if the number is taken: a link, or a rename that replaces nothing."""
        draft, final = self.path(f"drafts/{uuid4()}"), self.path(f"{self.name}/{number}")
        for folder in ("drafts", self.name):
            self.fs.mkdirs(self.path(folder))
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                array = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
                array[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, array)
        except FileExistsError as taken:
            raise Conflict(f"{number} was committed by another run") from taken
        except Exception as error:
            if "AlreadyExists" in str(error):
                raise Conflict(f"{number} was committed by another run") from error
            raise
        finally:
            self.fs.delete(draft, False)
