"""SRC-1, D-1: walking folders with ignore rules, as a Spark data source."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files with ignore rules: those of version control, and this engine's own, which hold for their folder and below.
IGNORE_FILES = (".gitignore", ".quarryignore")
MOST_NANOSECONDS = (1 << 63) - 1


def _pattern(rule: str) -> re.Pattern[str]:
    """A rule as an expression over the path below the rule's folder: ``*`` stays within a name, ``**`` crosses folders."""
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            inside = rule[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return re.compile(out + r"\Z")


class Rules:
    """The ignore rules of one folder."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern[str], bool, bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((_pattern(line.lstrip("/")), keep, folder, anchored))

    def verdict(self, below: str, is_folder: bool) -> bool | None:
        """True to ignore, False to keep, None if no rule says anything; the last rule that matches holds."""
        found = None
        for pattern, keep, folder, anchored in self.rules:
            if (is_folder or not folder) and pattern.match(below if anchored else below.rsplit("/", 1)[-1]):
                found = not keep
        return found


def _rules_of(folder: str) -> Rules | None:
    texts = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as file:
                texts.append(file.read())
        except OSError:
            pass
    return Rules("\n".join(texts)) if texts else None


def _ignored(path: str, is_folder: bool, rules: list[tuple[str, Rules]]) -> bool:
    for folder, own in reversed(rules):  # the nearest folder's rules first
        verdict = own.verdict(path[len(folder) :].lstrip("/"), is_folder)
        if verdict is not None:
            return verdict
    return False


def modified_nanoseconds(stat: os.stat_result) -> int:
    """D-1: 0 before 1970, the largest 64-bit number at most."""
    return min(max(stat.st_mtime_ns, 0), MOST_NANOSECONDS)


def walk(folder: str, rules: list[tuple[str, Rules]] | None = None, deep: bool = True) -> Iterator[tuple[str, os.stat_result]]:
    """Regular files below a folder by path; hidden names and ignored ones are left out, links are not followed."""
    rules = list(rules or [])
    own = _rules_of(folder)
    if own:
        rules.append((folder, own))
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for entry in entries:
        if entry.name.startswith("."):
            continue
        try:
            if entry.is_dir(follow_symlinks=False):
                if deep and not _ignored(entry.path, True, rules):
                    yield from walk(entry.path, rules)
            elif entry.is_file(follow_symlinks=False) and not _ignored(entry.path, False, rules):
                yield entry.path, entry.stat(follow_symlinks=False)
        except OSError:
            continue


class _Folder(InputPartition):
    def __init__(self, folder: str, rules: list[tuple[str, Rules]], deep: bool):
        self.folder, self.rules, self.deep = folder, rules, deep


class _FolderReader(DataSourceReader):
    """One task for the files of the root itself, one for each folder in it."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.root):
            return [_Folder(self.root, [], False)]
        own = _rules_of(self.root)
        rules = [(self.root, own)] if own else []
        parts: list[InputPartition] = [_Folder(self.root, [], False)]
        for entry in sorted(os.scandir(self.root), key=lambda e: e.name):
            if entry.is_dir(follow_symlinks=False) and not entry.name.startswith(".") and not _ignored(entry.path, True, rules):
                parts.append(_Folder(entry.path, rules, True))
        return parts

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if os.path.isfile(partition.folder):
            found: Iterator = iter([(partition.folder, os.stat(partition.folder))])
        else:
            found = walk(partition.folder, partition.rules, partition.deep)
        for path, stat in found:
            yield path, stat.st_size, modified_nanoseconds(stat)


class FolderSource(DataSource):
    """``spark.read.format("folder").load(root)``: ``path, size, modified_nanoseconds`` of the files to be indexed."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, size long, modified_nanoseconds long"

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(os.path.abspath(self.options["path"]))


def discover(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").load(root)
