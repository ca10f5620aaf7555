"""Cutting oversized texts at natural boundaries by lexical cohesion (problem 1)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Limits:
    """Limits of a piece and of the search for its end. Lines end at LF or CRLF only."""

    max_bytes: int = 3000
    max_lines: int = 30
    min_lines: int = 4
    overlap: int = 5
    #: Lines on each side of a gap whose words are compared.
    block: int = 6


_WORD = re.compile(r"[^\W\d_]{2,}")
_HEADING = re.compile(r"#{1,6} \S")
_CLOSING = re.compile(r"[\s)\]}>;,]+|\s*(?:end|fi|done|esac)\b[\s;]*")
_SENTENCE = re.compile(r"[.!?;。！？](?:\s|(?<=[。！？]))")


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at its very end opens no further line. 0 for an empty text, null for null."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1))


def is_oversized(text: Column, limits: Limits = Limits()) -> Column:
    return (F.octet_length(text) > limits.max_bytes) | (line_count(text) > limits.max_lines)


def _lines(text: str) -> list[str]:
    lines = text.split("\n")
    out = [x + "\n" for x in lines[:-1]]
    return out + [lines[-1]] if lines[-1] else out


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


class _Cohesion:
    """Similarity of the words before and after each gap between lines, as a cosine; kept once computed."""

    def __init__(self, lines: list[str], block: int):
        self.lines, self.block = lines, block
        self.words: dict[int, Counter] = {}
        self.known: dict[int, float] = {}

    def _bag(self, start: int, end: int) -> Counter:
        bag: Counter = Counter()
        for i in range(max(0, start), min(len(self.lines), end)):
            own = self.words.get(i)
            if own is None:
                own = self.words[i] = Counter(w.lower() for w in _WORD.findall(self.lines[i]))
            bag.update(own)
        return bag

    def similarity(self, gap: int) -> float:
        found = self.known.get(gap)
        if found is None:
            a, b = self._bag(gap - self.block, gap), self._bag(gap, gap + self.block)
            norm = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
            found = self.known[gap] = sum(x * b[w] for w, x in a.items() if w in b) / norm**0.5 if norm else 0.0
        return found

    def depth(self, gap: int, low: int, high: int) -> float:
        """How far the similarity rises on both sides of the gap before it falls again."""
        here, total = self.similarity(gap), 0.0
        for step in (-1, 1):
            peak, at = here, gap + step
            while low <= at <= high and self.similarity(at) >= peak:
                peak = self.similarity(at)
                at += step
            total += peak - here
        return total

    def forget(self, before: int) -> None:
        for kept in (self.words, self.known):
            for i in [i for i in kept if i < before]:
                del kept[i]


def _pauses(lines: list[str], start: int, at: int, limits: Limits) -> bool:
    """Whether the text itself pauses before line ``at``: a new paragraph, section or top-level unit begins there."""
    line = lines[at]
    if not line.strip() or _CLOSING.fullmatch(line):
        return False
    if _HEADING.match(line):
        return True
    before = lines[at - 1]
    if _HEADING.match(before):
        return False
    if not before.strip():
        return True
    closed = _CLOSING.fullmatch(before) is not None and _indent(line) <= _indent(before)
    return closed and _indent(line) <= _indent(lines[start])


def _window_end(sizes: list[int], start: int, limits: Limits) -> int:
    end, used = start, 0
    while end < len(sizes) and end - start < limits.max_lines and used + sizes[end] <= limits.max_bytes:
        used += sizes[end]
        end += 1
    return end


def _split_line(line: str, limit: int) -> list[str]:
    """One line over the limit, cut after a sentence, else after a space, else between characters."""
    out, raw = [], line.encode("utf-8")
    while len(raw) > limit:
        head = raw[:limit].decode("utf-8", "ignore")
        cuts = [m.end() for m in _SENTENCE.finditer(head)]
        cut = cuts[-1] if cuts and cuts[-1] * 3 >= len(head) else head.rfind(" ") + 1
        if cut * 3 < len(head):
            cut = len(head)
        out.append(head[:cut])
        raw = raw[len(head[:cut].encode("utf-8")) :]
    return [*out, raw.decode("utf-8")] if raw else out


def split_text(text: str, limits: Limits = Limits()) -> list[tuple[int, int, str, bool]]:
    """Pieces as (first line, last line, text, starts with an overlap), lines from 1.

    A piece ends at the deepest cohesion valley among the natural pauses of its size window (the later of equal ones);
    without one it ends with the window, and up to ``overlap`` of its last lines are repeated in the next piece. A line
    over the byte limit is cut alone and its parts share its number. Apart from repeated lines, the pieces make up the
    text exactly. An empty text gives no piece.
    """
    lines = _lines(text)
    sizes = [len(x.encode("utf-8", "replace")) for x in lines]
    cohesion = _Cohesion(lines, limits.block)
    pieces: list[tuple[int, int, str, bool]] = []
    start, repeated = 0, 0  # so many lines of the piece before come again
    while start < len(lines):
        if sizes[start] > limits.max_bytes:
            pieces += [(start + 1, start + 1, part, False) for part in _split_line(lines[start], limits.max_bytes)]
            start, repeated = start + 1, 0
            continue
        end = _window_end(sizes, start, limits)
        following, again = end, 0
        if end < len(lines) and sizes[end] <= limits.max_bytes:
            # Not inside the repeated lines: each piece must bring new ones.
            least = start + repeated + 1
            pauses = [at for at in range(least, end + 1) if _pauses(lines, start, at, limits)]
            # Early pauses make small pieces: they count where there are no later ones.
            pauses = [at for at in pauses if at >= start + limits.min_lines] or pauses
            if pauses:
                cohesion.forget(start - limits.block)
                low, high = start + 1, min(len(lines) - 1, end)
                end = following = max(pauses, key=lambda at: (cohesion.depth(at, low, high), at))
            else:
                for back in range(limits.overlap, 0, -1):
                    if end - back > start and _window_end(sizes, end - back, limits) > end:
                        following, again = end - back, back
                        break
        pieces.append((start + 1, end, "".join(lines[start:end]), repeated > 0))
        start, repeated = following, again
    return pieces


def split_oversized(chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``chunk_id, piece, n_pieces, start_line, end_line, first_line, last_line, overlaps, text``.

    ``first_line, last_line`` count within the chunk's text from 1; ``start_line, end_line`` are true lines of the file,
    counted from the chunk's ``start_line`` (null where that is unknown or below 1; its ``end_line`` is not trusted). A
    text within the limits stays one piece, without Python. Null and empty texts give no piece; repeated rows give
    repeated pieces. No shuffle. Other columns of the input are ignored.
    """
    own = chunks.select("chunk_id", F.col("start_line").cast("int").alias("start_line"), "text").filter("text <> ''")
    big = is_oversized(F.col("text"), limits)
    columns = ["chunk_id", "piece", "n_pieces", "start_line", "end_line", "first_line", "last_line", "overlaps", "text"]
    base = F.when(F.col("start_line") >= 1, F.col("start_line") - 1)
    lines = line_count(F.col("text")).cast("int")
    whole = own.filter(~big).select(
        "chunk_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), (base + 1).alias("start_line"), (base + lines).alias("end_line"),
        F.lit(1).alias("first_line"), lines.alias("last_line"), F.lit(False).alias("overlaps"), "text",
    )
    kind = own.schema["chunk_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for chunk, start, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pieces = split_text(text, limits)
                at = start - 1 if start is not None and start >= 1 else None
                for k, (first, last, part, overlaps) in enumerate(pieces):
                    rows.append((chunk, k, len(pieces), None if at is None else at + first, None if at is None else at + last, first, last, overlaps, part))
            types = [batch.schema.types[0], *[pa.int32()] * 6, pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], columns)

    schema = f"chunk_id {kind.simpleString()}, piece int, n_pieces int, start_line int, end_line int, first_line int, last_line int, overlaps boolean, text string"
    return whole.select(columns).unionByName(own.filter(big).mapInArrow(cut, schema))


def once(chunks: DataFrame) -> DataFrame:
    """One row for each chunk id; rows without an id all stay. Ids are shuffled, and texts only of ids that occur again."""
    again = chunks.groupBy("chunk_id").count().filter("count > 1").select("chunk_id")
    return chunks.join(again, "chunk_id", "left_anti").unionByName(chunks.join(again, "chunk_id", "left_semi").dropDuplicates(["chunk_id"]))


def split_chunks(pieces: DataFrame) -> DataFrame:
    """The chunks that had to be cut."""
    return pieces.filter(F.col("n_pieces") > 1).select("chunk_id").distinct()
