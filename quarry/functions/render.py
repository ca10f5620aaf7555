"""SNK-9, S-6, S-14, S-15, R-1: results as text, paths or JSON."""

from __future__ import annotations

import json
import os
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import text

COLUMNS = ("path", "kind", "similarity", "page", "start_line", "end_line", "start_ms", "end_ms", "text")


def file_uri(path: str | None) -> str | None:
    """S-6: percent-encoded but for unreserved characters, slashes and colons; a share keeps its host."""
    if path is None:
        return None
    slashes = path.replace("\\", "/")
    if slashes.startswith("//"):
        return "file://" + quote(slashes[2:], safe="-._~/:")
    return "file:///" + quote(slashes.lstrip("/"), safe="-._~/:")


def file_uris(column: Column) -> Column:
    """S-6 as an expression: the form encoding of the JVM, turned into percent encoding."""
    slashes = F.translate(column, "\\", "/")
    share = slashes.startswith("//")
    coded = F.url_encode(F.when(share, F.substr(slashes, F.lit(3))).otherwise(F.ltrim(slashes, F.lit("/"))))
    for code, shown in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":")):
        coded = F.replace(coded, F.lit(code), F.lit(shown))
    return F.concat(F.when(share, F.lit("file://")).otherwise(F.lit("file:///")), coded)


def content(kind: Column) -> Column:
    """PR-8, CO-2, CO-4: the fields that a kind of result has; PDFs show a page (1 if unknown) and no lines."""
    line = lambda c: F.when(kind == "text", F.col(c))
    spans = kind.isin("audio", "video") & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    return F.struct(
        F.col("path"), kind.alias("kind"), F.round("similarity", 4).alias("similarity"), F.when(kind == "pdf", F.coalesce("page", F.lit(1))).alias("page"),
        line("start_line").alias("start_line"), line("end_line").alias("end_line"),
        F.when(spans, F.col("start_ms") / 1000).alias("start_seconds"), F.when(spans, F.col("end_ms") / 1000).alias("end_seconds"),
        F.when(kind.isin("text", "pdf"), F.col("text")).alias("text"),
    )


def result_json(kind: Column) -> Column:
    """One result as JSON; fields it does not have are left out."""
    return F.to_json(content(kind))


def headline(kind: Column) -> Column:
    """The first line of a result as text: place and similarity with two decimals."""
    similar = F.format_string("%.2f", F.coalesce("similarity", F.lit(0.0)))
    span = text.time_range(F.col("start_ms") / 1000, F.col("end_ms") / 1000)
    return (
        F.when(kind == "text", F.concat_ws("", "path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit("  "), similar))
        .when(kind == "pdf", F.concat_ws("  ", "path", F.concat(F.lit("page "), F.coalesce("page", F.lit(1))), similar))
        .when(kind == "image", F.concat_ws("  ", "path", similar, F.lit("[image]"))).otherwise(F.concat_ws("  ", "path", span, similar, F.concat(F.lit("["), kind, F.lit("]"))))
    )


def paint(code: str, shown: str, colours: bool) -> str:
    return f"\x1b[{code}m{shown}\x1b[0m" if colours else shown


def link(path: str, shown: str, links: bool) -> str:
    return f"\x1b]8;;{file_uri(path)}\x1b\\{shown}\x1b]8;;\x1b\\" if links else shown


def render(results: DataFrame, form: str = "text", folder: str | None = None, colours: bool = False, links: bool = False) -> str:
    """The results of one query (ordered by ``place``) as ``text``, ``paths`` or ``json``. Results are few: a query's limit."""
    folder = folder or os.getcwd()
    rows = results.withColumn("_shown", text.display_path(F.col("path"), folder)).withColumn("_lines", text.numbered_lines(F.coalesce("start_line", F.lit(1)), F.coalesce("text", F.lit("")))).withColumn("_json", result_json(F.col("kind"))).orderBy("place").collect()
    if form == "json":
        return json.dumps([json.loads(r["_json"]) for r in rows], ensure_ascii=False, indent=2)
    if form == "paths":
        return "".join(f"{link(path, shown, links)}\n" for path, shown in dict.fromkeys((r["path"], r["_shown"]) for r in rows))
    out = []
    for r in rows:
        name, score = link(r["path"], paint("35", r["_shown"], colours), links), paint("2", f"{r['similarity'] or 0:.2f}", colours)
        if r["kind"] == "text":
            width = len(str(r["end_line"]))
            body = [paint("32", f"{x['line_number']:>{width}}", colours) + (f": {x['line']}" if x["line"] else ":") for x in r["_lines"]]
            out.append("\n".join([f"{name}:{paint('32', f'{r['start_line']}-{r['end_line']}', colours)}  {score}", *body]))
        elif r["kind"] == "pdf":
            out.append("\n".join([f"{name}  {paint('32', f'page {r['page'] or 1}', colours)}  {score}", *[f"    {x['line']}" if x["line"] else "" for x in r["_lines"]]]))
        elif r["kind"] == "image":
            out.append(f"{name}  {score}  {paint('36', '[image]', colours)}")
        else:
            out.append(f"{name}  {paint('32', _times(r), colours)}  {score}  {paint('36', f'[{r['kind']}]', colours)}")
    return "\n\n".join(out) + "\n" if out else ""


def _times(row) -> str:
    def told(ms: int | None) -> str:
        total = int((ms or 0) / 1000 + 0.5)
        hours, rest = divmod(total, 3600)
        return f"{hours}:{rest // 60:02}:{rest % 60:02}" if hours else f"{rest // 60}:{rest % 60:02}"

    return f"{told(row['start_ms'])}-{told(row['end_ms'])}"
