"""Operators on the tables of an index: files, chunks, skipped files, roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import text

KINDS = ("text", "image", "pdf", "audio", "video")
#: Files that a search may bring up to date by itself.
FEW_FILES = 25


def in_scope(path: Column, scope: str | None) -> Column:
    """PR-1: the path itself or anything below it; a sibling with the same beginning is neither. None is everything."""
    if scope is None:
        return F.lit(True)
    return (path == scope) | path.startswith(scope if scope.endswith("/") else scope + "/")


def current_files(files: DataFrame) -> DataFrame:
    """The latest row of each path; null paths are dropped. Partial aggregation, then one shuffle of a row a path."""
    rest = [c for c in files.columns if c != "path"]
    order = ["recorded_at", *[c for c in ("file_id", "modified_nanoseconds", "size", "content_hash") if c in rest]]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return files.filter("path is not null").groupBy("path").agg(last).select("path", "last.*")


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each chunk id (the earliest where there is ``recorded_at``), kinds as by :func:`with_known_kind`."""
    order = [F.col(c) for c in ("recorded_at",) if c in chunks.columns] or [F.col("chunk_id")]
    first = chunks.filter("chunk_id is not null").withColumn("_k", F.row_number().over(W.partitionBy("chunk_id").orderBy(*order)))
    return with_known_kind(first.filter("_k = 1").drop("_k"))


def with_known_kind(chunks: DataFrame) -> DataFrame:
    """Kinds in lower case, and only known ones (else null)."""
    kind = F.lower("kind")
    return chunks.withColumn("kind", F.when(kind.isin(*KINDS), kind))


def chunks_with_path(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """JN-1: chunks of known files, with the path; the join's strategy is left to the sizes."""
    return chunks.join(current_files(files).select("file_id", "path"), "file_id")


def scope_statistics(chunks: DataFrame, files: DataFrame, scope: str | None = None) -> DataFrame:
    """AG-1: files with chunks, images and recordings among them, and chunks; one row."""
    rows = chunks_with_path(chunks.select("chunk_id", "file_id", "kind"), files).filter(in_scope(F.col("path"), scope))
    return rows.agg(
        F.countDistinct("file_id").alias("files"), F.countDistinct(F.when(F.col("kind") == "image", F.col("file_id"))).alias("images"),
        F.countDistinct(F.when(F.col("kind").isin("audio", "video"), F.col("file_id"))).alias("recordings"), F.count("chunk_id").alias("chunks"),
    )


def skipped_files(files: DataFrame, chunks: DataFrame, skipped: DataFrame, scope: str | None = None) -> DataFrame:
    """JN-3: indexed files without chunks, with the reason if a known one was recorded (of several the first by order)."""
    reasons = skipped.select("file_id", text.known_reason(F.col("reason")).alias("reason")).groupBy("file_id").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), text.reason_order(F.col("reason")))).alias("reason"))
    bare = current_files(files).filter(in_scope(F.col("path"), scope)).join(chunks.select("file_id"), "file_id", "left_anti")
    return bare.join(reasons, "file_id", "left").select("path", "reason")


def skip_reason_groups(skipped: DataFrame, samples: int = 5) -> DataFrame:
    """AG-8, T-7: files by reason in order, an unknown reason first, with their number and some sample paths."""
    ranked = skipped.withColumn("k", F.row_number().over(W.partitionBy("reason").orderBy("path")))
    counts = skipped.groupBy("reason").agg(F.count("*").alias("files"))
    shown = ranked.filter(F.col("k") <= samples).groupBy("reason").agg(F.sort_array(F.collect_list("path")).alias("samples"))
    return counts.join(shown, counts["reason"].eqNullSafe(shown["reason"])).select(counts["reason"], text.describe_skip(counts["reason"]).alias("description"), "files", F.array_join("samples", "\n").alias("samples"))


def reconcile(found: DataFrame, indexed: DataFrame, skipped: DataFrame | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """JN-6, JN-7: ``<keys>, state`` from ``<keys>, size, modified_nanoseconds, content_hash`` of both sides.

    ``new``: not indexed; ``deleted``: not found; ``unchanged``: size and time are the same (PR-10); ``touched``: only
    the time or size differs, the content is the same; ``modified``: the content differs or can't be compared.
    """
    a, b = found.alias("a"), indexed.alias("b")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.modified_nanoseconds").eqNullSafe(F.col("b.modified_nanoseconds"))
    state = (
        F.when(F.col("b.path").isNull(), "new").when(F.col("a.path").isNull(), "deleted").when(same, "unchanged")
        .when(F.col("a.content_hash") == F.col("b.content_hash"), "touched").otherwise("modified")
    )
    equal = F.lit(True)
    for key in keys:
        equal = equal & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    out = a.join(b, equal, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], state.alias("state"))
    return out if skipped is None else out.join(skipped.select("path"), "path", "left_anti")


def pending_changes(states: DataFrame, *by: str) -> DataFrame:
    """AG-7, PR-14: one row of counts (for each value of ``by``), and whether a search may update the index by itself."""
    kind = text.kind_of_path(F.col("path"))
    changed = F.col("state").isin("new", "modified")
    counts = states.groupBy(*by).agg(
        F.count_if(F.col("state") == "new").alias("new_files"), F.count_if(F.col("state") == "modified").alias("modified_files"), F.count_if(F.col("state") == "deleted").alias("deleted_files"),
        F.count_if(F.col("state") == "touched").alias("touched_files"), F.count_if(F.col("state") == "unchanged").alias("unchanged_files"), F.count_if(changed & (kind != "text") & (kind != "pdf")).alias("changed_media"),
    )
    return counts.withColumn("updates_itself", (F.col("changed_media") == 0) & (F.col("new_files") + F.col("modified_files") <= FEW_FILES))


def root_options(options: Column) -> Column:
    """SRC-16: the options of a root from JSON; null for broken JSON or wrong types."""
    schema = "max_text_size long, max_media_size long, include_images boolean, include_audio boolean, include_video boolean"
    parsed = F.from_json(options, schema)
    return F.when(parsed["max_text_size"].isNotNull(), parsed)


def merge_roots(roots: DataFrame) -> DataFrame:
    """JN-8, SNK-6: the roots that no other root contains, each with the number of roots merged into it.

    A trailing slash means nothing; of repeated roots the latest holds. The ancestors of each path are made by an
    expression and met by an equal join, so no pair of roots is compared in vain.
    """
    plain = F.regexp_replace("path", "(?<=.)/+$", "")
    once = roots.filter("path is not null").groupBy(plain.alias("path")).agg(F.max(F.coalesce("indexed_at", F.lit(0))).alias("indexed_at"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, "/").otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    each = once.withColumn("above", F.explode(F.array_distinct(above)))
    tops = each.join(once.select(F.col("path").alias("root")), F.col("above") == F.col("root")).groupBy("path").agg(F.min_by("root", F.length("root")).alias("root"))
    return tops.groupBy("root").agg((F.count("*") - 1).cast("long").alias("merged")).join(once.withColumnRenamed("path", "root"), "root").select(F.col("root").alias("path"), "merged", "indexed_at")


def forget(table: DataFrame, scope: str) -> DataFrame:
    """SNK-5: the rows outside the scope."""
    return table.filter(~in_scope(F.col("path"), scope))


def sizes_verdict(files: DataFrame, max_text: int = 1 << 20, max_media: int = 64 << 20, left_out: tuple[str, ...] = ()) -> DataFrame:
    """SRC-3: ``path, kind, verdict``: ok, too_large or left_out; recordings have no limit, a size at the limit is fine."""
    kind = text.kind_of_path(F.col("path"))
    limit = F.when(kind == "text", max_text).when(kind.isin("image", "pdf"), max_media)
    verdict = F.when(kind.isin(*left_out) if left_out else F.lit(False), "left_out").when(F.col("size") > limit, "too_large").otherwise("ok")
    return files.select("path", kind.alias("kind"), verdict.alias("verdict"))
