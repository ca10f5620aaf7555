"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.vectors import let

#: Endings by kind of file; everything else is text.
ENDINGS = {
    "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "jfif"),
    "audio": ("mp3", "wav", "m4a", "flac", "ogg", "opus", "aac", "wma"),
    "video": ("mp4", "mov", "mkv", "webm", "avi", "m4v", "wmv"),
    "pdf": ("pdf",),
}
#: Accented Latin letters and their bare forms, for keyword matching.
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
BARE = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
WORD_BREAK = r"[^\p{L}\p{N}_]+"
SHOWN_CHARACTERS = 160
#: How skip reasons are told, in their order; a missing reason comes first.
SKIP_REASONS = {
    "binary": "skipped: binary",
    "image_too_small": "skipped: images too small to be photos (icons)",
    "image_unreadable": "skipped: unreadable images",
    "pdf_without_text": "skipped: PDFs without text (scans need OCR)",
    "pdf_unreadable": "skipped: unreadable PDFs",
    "recording_unreadable": "skipped: unreadable audio and video",
    "recording_without_content": "skipped: silent audio and video",
}
UNKNOWN_SKIP = "skipped: no reason was recorded"


def file_ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind_of_path(path: Column) -> Column:
    """SRC-2: the kind of file by its ending; ``.ts`` is text. Null for null."""
    ending = file_ending(path)
    kind = F.lit("text")
    for name, endings in ENDINGS.items():
        kind = F.when(ending.isin(*endings), name).otherwise(kind)
    return F.when(path.isNotNull(), kind)


def folded(text: Column) -> Column:
    """S-2: lower case without the accents of Latin letters, as the keyword index compares words."""
    return F.translate(F.lower(text), ACCENTED, BARE)


def words(text: Column) -> Column:
    """All tokens of a text in order, one-character ones included; an empty array for an empty text."""
    return F.filter(F.split(folded(text), WORD_BREAK), lambda w: w != "")


def query_terms(text: Column) -> Column:
    """S-1, PR-15: distinct words of at least two characters, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: F.length(w) >= 2))


def keyword_query(text: Column) -> Column:
    """S-1: the words quoted and joined by AND; null without any."""
    quoted = F.array_join(F.transform(query_terms(text), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " AND ")
    return F.when(quoted != "", quoted)


def file_title(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def document_prompt(title: Column, text: Column) -> Column:
    """S-3."""
    shown = F.when(F.trim(title) == "", "none").otherwise(F.coalesce(title, F.lit("none")))
    return F.format_string("title: %s | text: %s", shown, text)


def query_prompt(text: Column) -> Column:
    return F.format_string("task: search result | query: %s", text)


def display_path(path: Column, folder: str) -> Column:
    """S-5: relative to the folder, ``.`` for the folder itself, absolute elsewhere."""
    prefix = folder if folder.endswith("/") else folder + "/"
    return F.when(path == folder, ".").when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def timestamp(seconds: Column) -> Column:
    """S-7: m:ss, or h:mm:ss from an hour on; halves round up, negative times are 0, null stays null."""
    total = F.floor(F.greatest(seconds, F.lit(0.0)) + 0.5).cast("long")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    told = F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))
    return F.when(seconds.isNotNull(), told)


def time_range(start: Column, end: Column) -> Column:
    return F.concat(timestamp(start), F.lit("-"), timestamp(end))


def readable_size(size: Column) -> Column:
    """S-9: whole KB rounded up, whole MB rounded down, both decimal."""
    small = F.concat(F.ceil(size / 1000).cast("string"), F.lit(" KB"))
    return F.when(size < 1_000_000, small).otherwise(F.concat(F.floor(size / 1_000_000).cast("string"), F.lit(" MB")))


def readable_age(seconds: Column) -> Column:
    """S-9: just now, minutes, hours or days."""

    def plural(count: Column, unit: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f" {unit}"), F.when(count == 1, "").otherwise("s"), F.lit(" ago"))

    s = F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0)))
    return F.when(s < 60, "just now").when(s < 3600, plural(F.floor(s / 60), "minute")).when(s < 86400, plural(F.floor(s / 3600), "hour")).otherwise(plural(F.floor(s / 86400), "day"))


def count_files(count: Column) -> Column:
    return F.concat(count.cast("string"), F.when(count == 1, " file").otherwise(" files"))


def meaningful_characters(text: Column) -> Column:
    """S-11: characters that are no white space (of any script)."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def lines(text: Column) -> Column:
    """Lines ended by LF or CRLF; a line end at the very end opens no further line."""
    ended = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(ended, 1, F.size(ended) - 1)).otherwise(ended)


def is_blank_line(line: Column) -> Column:
    return ~line.rlike(r"\S")


def is_heading(line: Column) -> Column:
    """S-10: number signs at the start, then a space."""
    return line.rlike("^#+ ")


def is_closing_line(line: Column) -> Column:
    """S-10: closing marks only; blank lines too."""
    return line.rlike(r"^[\s})\];,]*$")


def indentation(line: Column) -> Column:
    """S-10: bytes of white space before the text."""
    return F.octet_length(F.regexp_extract(line, r"^(\s*)", 1))


def numbered_lines(start_line: Column, text: Column) -> Column:
    """S-8: ``array<struct<line_number, line>>``: right ends trimmed, shared indent dropped, long lines cut with an ellipsis."""
    trimmed = F.transform(lines(text), lambda x: F.regexp_replace(x, r"\s+$", ""))

    def numbered(rows: Column) -> Column:
        indents = F.transform(F.filter(rows, lambda x: x != ""), lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1)))
        return let(F.coalesce(F.array_min(indents), F.lit(0)), lambda shared: F.transform(rows, lambda x, i: shown(x, i, shared)))

    def shown(x: Column, i: Column, shared: Column) -> Column:
        rest = F.substr(x, shared + 1)
        cut = F.when(F.length(rest) > SHOWN_CHARACTERS, F.concat(F.substring(rest, 1, SHOWN_CHARACTERS), F.lit("…"))).otherwise(rest)
        return F.struct((start_line + i).alias("line_number"), cut.alias("line"))

    return let(trimmed, numbered)


def describe_skip(reason: Column) -> Column:
    """S-16: how a skip reason is told; unknown and missing ones alike."""
    told = F.lit(UNKNOWN_SKIP)
    for key, text in SKIP_REASONS.items():
        told = F.when(reason == key, text).otherwise(told)
    return told


def known_reason(reason: Column) -> Column:
    """CO-1: an unknown reason is no reason."""
    return F.when(reason.isin(*SKIP_REASONS), reason)


def reason_order(reason: Column) -> Column:
    order = F.lit(0)
    for i, key in enumerate(SKIP_REASONS, 1):
        order = F.when(reason == key, i).otherwise(order)
    return order
