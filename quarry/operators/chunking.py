"""S-17, W-8: structure-aware chunks of text files, and W-6: batches of similar lengths.

A text is turned into a table of its lines once (prefix sums of bytes and of visible characters, indentation, and the
seams: lines that may begin a unit). Where chunks end is then looked up in these arrays by bisection.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class ChunkLimits:
    """The limits chunks are made for."""

    min_lines: int = 4
    max_lines: int = 30
    overlap: int = 5
    max_bytes: int = 3000
    min_characters: int = 60


#: What counts as white space (Unicode's property of that name).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE_RUNS = re.compile(f"[{WHITE}]+")
#: Lines of these only close what stands above them.
CLOSERS = "})];,"
_HEADING = re.compile("#+ ")


class Span(NamedTuple):
    """Lines ``low`` up to, not including, ``high``; or a part of one long line, with its own text."""

    low: int
    high: int
    part: str | None = None


class LineTable:
    """The lines of a text (a CR belongs to the end only before an LF), by position from 0."""

    def __init__(self, text: str):
        pieces = text.split("\n")
        tail = [pieces.pop()]
        self.lines = [p.removesuffix("\r") for p in pieces] + (tail if tail[0] else [])
        bodies = [x.strip(WHITE) for x in self.lines]
        widths = [len(x) if x.isascii() else len(x.encode("utf-8", "replace")) for x in self.lines]
        #: Bytes of all lines before, each with a line end; visible characters of all lines before.
        self.bytes_before = [0, *accumulate(w + 1 for w in widths)]
        self.visible_before = [0, *accumulate(len(_WHITE_RUNS.sub("", b)) for b in bodies)]
        self.solid = [i for i, b in enumerate(bodies) if b]
        self.depth: dict[int, int] = {}
        self.headings = {i for i in self.solid if _HEADING.match(self.lines[i])}
        #: Solid lines under a blank one that open something: no closers, and no first line of a heading's own text.
        self.seams: list[int] = []
        for above, i in zip([-1, *self.solid], self.solid):
            if above < i - 1 and i and above not in self.headings and bodies[i].strip(CLOSERS):
                self.seams.append(i)
        for i in self.solid:
            front = self.lines[i][: len(self.lines[i]) - len(self.lines[i].lstrip(WHITE))]
            self.depth[i] = len(front.encode("utf-8"))

    def width(self, low: int, high: int) -> int:
        """Bytes of the lines joined by line feeds."""
        return self.bytes_before[high] - self.bytes_before[low] - 1

    def visible(self, span: Span) -> int:
        if span.part is not None:
            return len(_WHITE_RUNS.sub("", span.part))
        return self.visible_before[span.high] - self.visible_before[span.low]

    def next_solid(self, at: int) -> int | None:
        k = bisect_right(self.solid, at - 1)
        return self.solid[k] if k < len(self.solid) else None

    def last_solid(self, before: int) -> int:
        return self.solid[bisect_right(self.solid, before - 1) - 1]


def _window(table: LineTable, low: int, limits: ChunkLimits) -> int:
    """The end of the longest span from ``low`` within both limits; a span holds a line at least."""
    fits = bisect_right(table.bytes_before, table.bytes_before[low] + limits.max_bytes) - 1
    return min(max(fits, low + 1), low + limits.max_lines, len(table.lines))


def _seam(table: LineTable, low: int, end: int, limits: ChunkLimits) -> int | None:
    """The seam to cut at, up to ``end``: the first as shallow as ``low``; in a cut-off window else the shallowest."""
    inside = table.seams[bisect_right(table.seams, low) : bisect_right(table.seams, end)]
    ranked = [(table.depth[i] > table.depth[low], table.depth[i], i) for i in inside if i - low >= limits.min_lines or i in table.headings]
    if not ranked:
        return None
    level = [i for deeper, _, i in ranked if not deeper]
    return level[0] if level else min(ranked)[2] if end < len(table.lines) else None


def _slices(line: str, most: int) -> Iterator[str]:
    """A line in parts of at most ``most`` bytes; a character wider than that stands alone."""
    raw, at = line.encode("utf-8", "replace"), 0
    while at < len(raw):
        part = raw[at : at + most].decode("utf-8", "ignore") or raw[at:].decode("utf-8")[0]
        at += len(part.encode("utf-8"))
        yield part


def _spans(table: LineTable, limits: ChunkLimits) -> Iterator[Span]:
    low = table.next_solid(0)
    while low is not None:
        end = _window(table, low, limits)
        if table.width(low, low + 1) > limits.max_bytes:
            yield from (Span(low, low + 1, part) for part in _slices(table.lines[low], limits.max_bytes))
            low = table.next_solid(low + 1)
            continue
        seam = _seam(table, low, end, limits)
        yield Span(low, table.last_solid(seam or end) + 1)
        if seam is None and end == len(table.lines):
            return
        low = table.next_solid(max(end - limits.overlap, low + 1)) if seam is None else seam


def _gather(spans: Iterator[Span], table: LineTable, limits: ChunkLimits) -> list[Span]:
    """Thin spans (with few visible characters) take in what follows; a thin last one goes to the span before it."""
    out: list[Span] = []

    def merge(first: Span, second: Span) -> Span | None:
        fits = first.part is second.part is None and second.high >= first.high and table.width(first.low, second.high) <= limits.max_bytes
        return Span(first.low, second.high) if fits else None

    thin = lambda s: table.visible(s) < limits.min_characters
    for span in spans:
        both = merge(out[-1], span) if out and thin(out[-1]) else None
        out[-1 if both else len(out) :] = [both or span]
    if len(out) > 1 and thin(out[-1]) and (both := merge(*out[-2:])):
        out[-2:] = [both]
    return out


def chunk_text(text: str, limits: ChunkLimits = ChunkLimits()) -> list[tuple[int, int, str]]:
    """Chunks as (first line, last line, text), lines from 1; none for an empty or blank text."""
    table = LineTable(text or "")
    return [(s.low + 1, s.high, "\n".join(table.lines[s.low : s.high]) if s.part is None else s.part) for s in _gather(_spans(table, limits), table, limits)]


def chunk_texts(rows: DataFrame, key: str, text: str = "text", limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """``key, chunk_no, start_line, end_line, text`` of each row's text; nothing for null and blank texts. No shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    names = ["_key", "chunk_no", "start_line", "end_line", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n, *c) for i, own in enumerate(batch.column(1).to_pylist()) if own for n, c in enumerate(chunk_text(own, limits))]
            keys = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([f[i + 1] for f in found], t) for i, t in enumerate(types)]], names)

    out = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, chunk_no int, start_line int, end_line int, text string")
    return out.withColumnRenamed("_key", key)


def plan_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """W-6: positions in batches of ascending length, so that number times longest stays within the budget; a longer one is alone."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda x: (lengths[x], x)):
        if out and (len(out[-1]) + 1) * lengths[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def batched_lengths(rows: DataFrame, key: str, length: str, budget: int = 2400, block: int = 4096) -> DataFrame:
    """W-6 over a table: ``key, length, batch``; batches are made within blocks of a task's rows, as an encoder would."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                sizes = [x or 0 for x in part.column(1).to_pylist()]
                of = [0] * len(sizes)
                for own in plan_batches(sizes, budget):
                    for i in own:
                        of[i] = number
                    number += 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(of, pa.int64())], ["_key", "length", "batch"])

    out = rows.select(F.col(key).alias("_key"), F.col(length).cast("long")).mapInArrow(run, f"_key {kind}, length long, batch long")
    return out.withColumnRenamed("_key", key)
