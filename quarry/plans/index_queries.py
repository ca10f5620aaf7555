"""Queries on the index itself: files, kinds, changes, statistics, text functions, time spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import render, segments, text
from quarry.operators import catalog, changes, chunking
from quarry.plans.search_queries import CH, CUR, SCOPE
from quarry.session import scratch_folder, table, wide_table
from quarry.streaming.ledger import Ledger

#: A fixed present for ages, so that results can be compared.
NOW = 1_785_000_000


def _files(spark, sf) -> DataFrame:
    return catalog.current_files(table(spark, sf, "files"))


def _chunks(spark, sf) -> DataFrame:
    return catalog.clean_chunks(table(spark, sf, "chunks"))


def scope_statistics(spark, sf):
    return catalog.scope_statistics(_chunks(spark, sf), table(spark, sf, "files"), SCOPE)


def scope_statistics_all(spark, sf):
    return catalog.scope_statistics(_chunks(spark, sf), table(spark, sf, "files"))


def _skipped(spark, sf) -> DataFrame:
    return catalog.skipped_files(table(spark, sf, "files"), table(spark, sf, "chunks").select("file_id"), table(spark, sf, "skipped_files"))


def skipped_files(spark, sf):
    return _skipped(spark, sf)


def skip_reason_groups(spark, sf):
    return catalog.skip_reason_groups(_skipped(spark, sf))


def indexed_roots_merge(spark, sf):
    return catalog.merge_roots(table(spark, sf, "indexed_roots"))


def root_options(spark, sf):
    roots = table(spark, sf, "indexed_roots").select("path", "indexed_at", catalog.root_options(F.col("options")).alias("o"))
    flags = ("include_images", "include_audio", "include_video")
    return roots.select("path", "indexed_at", "o.max_text_size", "o.max_media_size", *[F.col(f"o.{f}").alias(f) for f in flags]).distinct()


def _states(spark, sf) -> DataFrame:
    """Each successful run's sightings against what the run before it saw, the first one's against the index."""
    runs = changes.successful_runs(table(spark, sf, "scan_runs"))
    fields = ("size", "modified_nanoseconds", "content_hash")
    last = F.max_by(F.struct("size", "modified_nanoseconds", changes.plain_hash("content_hash").alias("content_hash")), F.struct("seen_at", "arrived_at"))
    seen = table(spark, sf, "file_sightings").filter("path is not null").join(runs, "scan_id").groupBy("path", "number").agg(last.alias("l")).select("path", "number", "l.*")
    start = _files(spark, sf).select("path", F.lit(1).alias("number"), "size", "modified_nanoseconds", changes.plain_hash("content_hash").alias("content_hash"))
    before = seen.select("path", (F.col("number") + 1).alias("number"), *fields).unionByName(start).join(runs.select("number"), "number", "left_semi")
    return catalog.reconcile(seen, before, keys=("path", "number")).join(runs, "number").select("scan_id", "path", "state")


def reconcile(spark, sf):
    return _states(spark, sf)


def pending_changes(spark, sf):
    return catalog.pending_changes(_states(spark, sf), "scan_id")


def status_samples(spark, sf):
    """T-7: some paths of each state of each run, by path."""
    from pyspark.sql import Window as W

    ranked = _states(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("scan_id", "state").orderBy("path")))
    return ranked.filter("k <= 5").select("scan_id", "state", "k", "path")


def forget_scope(spark, sf):
    return catalog.forget(_files(spark, sf), SCOPE).select("path", "file_id")


def orphan_chunks(spark, sf):
    """JN-4, JN-5: chunks of no file."""
    return _chunks(spark, sf).select("chunk_id", "file_id").join(_files(spark, sf).select("file_id"), "file_id", "left_anti")


def chunk_ids_of_file(spark, sf):
    """PR-5: the chunk ids of each file in the scope."""
    placed = catalog.chunks_with_path(_chunks(spark, sf).select("chunk_id", "file_id"), table(spark, sf, "files"))
    return placed.filter(catalog.in_scope(F.col("path"), SCOPE)).select("path", "chunk_id")


def content_hash_duplicates(spark, sf):
    hashed = table(spark, sf, "documents").filter("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return hashed.filter("copies > 1")


def kind_of_path(spark, sf):
    return _files(spark, sf).select("path", text.kind_of_path(F.col("path")).alias("kind"), text.file_title(F.col("path")).alias("title"))


def size_limits(spark, sf):
    return catalog.sizes_verdict(_files(spark, sf), max_text=20_000, max_media=1_000_000, left_out=("video",))


def decode_flags(spark, sf):
    """SRC-4: what makes a text binary or marked, within its first 8 KiB."""
    own = F.col("text")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.contains(F.substring(own, 1, 8192), F.lit("\0")).alias("is_binary"), own.startswith("\ufeff").alias("has_mark"), F.contains(own, F.lit("\r\n")).alias("has_crlf"))


def display_paths(spark, sf):
    return _files(spark, sf).select("path", text.display_path(F.col("path"), "/home/tel").alias("shown"))


def file_uris(spark, sf):
    return _files(spark, sf).select("path", render.file_uris(F.col("path")).alias("uri"))


def readable_sizes(spark, sf):
    return _files(spark, sf).filter("size is not null").select("path", text.readable_size(F.col("size")).alias("size"))


def readable_ages(spark, sf):
    return table(spark, sf, "indexed_roots").filter("indexed_at is not null").select("path", "indexed_at", text.readable_age(F.lit(NOW) - F.col("indexed_at")).alias("age"))


def line_features(spark, sf):
    """S-10 over whole documents: how many lines are blank, headings, closings, and the deepest indentation."""
    own = table(spark, sf, "documents").filter("text is not null").select("doc_id", text.lines(F.col("text")).alias("lines"))
    count = lambda f: F.size(F.filter("lines", f))
    deepest = F.coalesce(F.array_max(F.transform("lines", lambda x: F.length(F.regexp_extract(x, "^([ \t]*)", 1)))), F.lit(0))
    return own.select("doc_id", F.size("lines").alias("n_lines"), count(text.is_blank_line).alias("blank"), count(text.is_heading).alias("headings"), count(text.is_closing_line).alias("closing"), deepest.alias("deepest"))


def meaningful_chars(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", text.meaningful_characters(F.col("text")).alias("characters"))


def numbered_lines(spark, sf):
    own = _chunks(spark, sf).filter("text is not null and text <> ''")
    each = own.select("chunk_id", F.explode(text.numbered_lines(F.coalesce("start_line", F.lit(1)), F.col("text"))).alias("l"))
    return each.select("chunk_id", "l.line_number", "l.line")


def time_ranges(spark, sf):
    spans = _chunks(spark, sf).filter("start_ms is not null and end_ms is not null")
    return spans.select("chunk_id", text.time_range(F.col("start_ms") / 1000, F.col("end_ms") / 1000).alias("span"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("seconds"))


def document_prompts(spark, sf):
    """S-3, S-12: what an encoder is given of each document's beginning, as the feature is defined on it."""
    shown = text.document_prompt(text.file_title(F.col("path")), F.substring("text", 1, 4000))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2(shown.cast("binary"), 256).alias("prompt_hash"), F.length(shown).alias("length"))


def result_json(spark, sf):
    """SNK-9: every chunk as the JSON of a result; the fields are read back from it."""
    rows = catalog.chunks_with_path(_chunks(spark, sf).drop("embedding"), table(spark, sf, "files")).withColumn("similarity", F.lit(0.5)).filter("kind is not null")
    parsed = rows.select("chunk_id", F.from_json(render.result_json(F.col("kind")), "path string, kind string, page int, start_line int, start_seconds double, text string").alias("j"))
    return parsed.select("chunk_id", "j.path", "j.kind", "j.page", "j.start_line", "j.start_seconds", F.length("j.text").alias("text_length"))


def headlines(spark, sf):
    rows = catalog.chunks_with_path(_chunks(spark, sf).drop("embedding", "text"), table(spark, sf, "files")).withColumn("similarity", F.lit(0.5)).filter("kind is not null")
    return rows.select("chunk_id", render.headline(F.col("kind")).alias("headline"))


def _durations(spark, sf) -> DataFrame:
    media = _chunks(spark, sf).filter("kind in ('audio', 'video') and end_ms is not null and file_id is not null")
    return media.groupBy("file_id").agg(F.max("end_ms").alias("duration"))


def _spans(rows: DataFrame, spans) -> DataFrame:
    return rows.select("file_id", F.explode(spans).alias("s")).select("file_id", "s.start_ms", "s.end_ms")


def audio_windows(spark, sf):
    return _spans(_durations(spark, sf), segments.audio_windows(F.col("duration")))


def video_segments(spark, sf):
    return _spans(_durations(spark, sf), segments.video_segments(F.col("duration")))


def overlapping_spans(spark, sf):
    """PR-13: consecutive spans of a file that overlap."""
    from pyspark.sql import Window as W

    media = _chunks(spark, sf).filter("start_ms is not null and end_ms is not null and file_id is not null").select("file_id", "chunk_id", "start_ms", "end_ms")
    order = W.partitionBy("file_id").orderBy("start_ms", "chunk_id")
    before = media.withColumn("a", F.lag("start_ms").over(order)).withColumn("b", F.lag("end_ms").over(order)).filter("a is not null")
    return before.filter(segments.overlaps(F.col("a"), F.col("b"), F.col("start_ms"), F.col("end_ms"))).select("file_id", "chunk_id")


def fit_within(spark, sf):
    size = _files(spark, sf).filter("size is not null").select("path", (F.col("size") % 5000 + 1).alias("w"), (F.floor(F.col("size") / 7) % 3000 + 1).alias("h"))
    fitted = segments.fit_within(F.col("w"), F.col("h"), 768)
    return size.select("path", "w", "h", fitted["width"].alias("width"), fitted["height"].alias("height"))


def text_chunks(spark, sf):
    return chunking.chunk_texts(wide_table(spark, sf, "documents", "doc_id", "text"), "doc_id")


def plan_batches(spark, sf):
    return chunking.batched_lengths(table(spark, sf, "documents"), "doc_id", "n_chars", budget=100_000)


def incremental_index(spark, sf):
    """ST-4: three runs of a ledger over what arrived by three days, the last without an end.

    Rows get their numbers once, in order of arrival, those without one last.
    """
    folder = scratch_folder(spark, "incremental")
    order = [F.col("arrived_at").asc_nulls_last(), *[F.col(c) for c in ("scan_id", "path", "seen_at", "content_hash", "size", "modified_nanoseconds")]]
    numbered = table(spark, sf, "file_sightings").dropDuplicates().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    numbered.write.parquet(f"{folder}/rows")
    rows, ledger = spark.read.parquet(f"{folder}/rows"), Ledger(spark, f"{folder}/ledger")
    for day in ("2026-07-20", "2026-07-26", None):
        known = rows if day is None else rows.filter(F.col("arrived_at") < F.lit(day))
        ledger.run(known, "number", lambda new: new.groupBy("scan_id", "path").agg(F.count("*").alias("sightings")))
    output = ledger.output()
    if output is None:
        return rows.select("scan_id", "path", F.lit(0).cast("long").alias("sightings"))
    return output.groupBy("scan_id", "path").agg(F.sum("sightings").alias("sightings"))


QUERIES = {
    f.__name__: f
    for f in (
        scope_statistics, scope_statistics_all, skipped_files, skip_reason_groups, indexed_roots_merge, root_options, reconcile, pending_changes, status_samples, forget_scope,
        orphan_chunks, chunk_ids_of_file, content_hash_duplicates, kind_of_path, size_limits, decode_flags, display_paths, file_uris, readable_sizes, readable_ages, line_features,
        meaningful_chars, numbered_lines, time_ranges, document_prompts, result_json, headlines, audio_windows, video_segments, overlapping_spans, fit_within, text_chunks,
        plan_batches, incremental_index,
    )
}

_KIND = "CASE " + " ".join(f"WHEN ending IN ({', '.join(repr(e) for e in endings)}) THEN '{kind}'" for kind, endings in text.ENDINGS.items()) + " ELSE 'text' END"
_KINDS = f"kinds AS (SELECT *, {_KIND} AS kind FROM (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ending FROM cur))"
_REASON = "CASE WHEN reason IN (" + ", ".join(f"'{r}'" for r in text.SKIP_REASONS) + ") THEN reason END"
_ORDER = "list_position([" + ", ".join(f"'{r}'" for r in text.SKIP_REASONS) + "], reason)"
_SKIPPED = f"""{CUR}, reasons AS (SELECT file_id, arg_min(reason, {_ORDER}) AS reason FROM (SELECT file_id, {_REASON} AS reason FROM skipped_files) WHERE reason IS NOT NULL GROUP BY 1),
skipped AS (SELECT path, reason FROM cur LEFT JOIN reasons USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = cur.file_id))"""
_TOLD = "CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SKIP_REASONS.items()) + f" ELSE '{text.UNKNOWN_SKIP}' END"
_HASH = r"lower(regexp_replace(content_hash, '^\s*[A-Za-z][A-Za-z0-9_-]*:', ''))"
_STATES = f"""{CUR}, runs AS (SELECT scan_id, row_number() OVER (ORDER BY started_at, scan_id) AS number FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY recorded_at DESC, finished_at DESC NULLS LAST) AS k FROM scan_runs) WHERE k = 1 AND run_status = 'succeeded'),
found AS (SELECT number, path, size, modified_nanoseconds, {_HASH} AS h FROM (SELECT s.*, number, row_number() OVER (PARTITION BY number, path ORDER BY seen_at DESC, arrived_at DESC) AS k FROM file_sightings s JOIN runs r ON s.scan_id = r.scan_id WHERE path IS NOT NULL) WHERE k = 1),
earlier AS (SELECT 1 AS number, path, size, modified_nanoseconds, {_HASH} AS h FROM cur UNION ALL SELECT number + 1, path, size, modified_nanoseconds, h FROM found WHERE number < (SELECT max(number) FROM runs)),
states AS (SELECT r.scan_id, coalesce(f.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted'
  WHEN f.size IS NOT DISTINCT FROM c.size AND f.modified_nanoseconds IS NOT DISTINCT FROM c.modified_nanoseconds THEN 'unchanged' WHEN f.h = c.h THEN 'touched' ELSE 'modified' END AS state
  FROM found f FULL JOIN earlier c ON f.path = c.path AND f.number = c.number JOIN runs r ON r.number = coalesce(f.number, c.number))"""
_IN = f"(path = '{SCOPE}' OR starts_with(path, '{SCOPE}/'))"
_STAT = "count(DISTINCT file_id) AS files, count(DISTINCT CASE WHEN kind = 'image' THEN file_id END) AS images, count(DISTINCT CASE WHEN kind IN ('audio', 'video') THEN file_id END) AS recordings, count(chunk_id) AS chunks"
_LINES = "CASE WHEN text = '' THEN []::VARCHAR[] WHEN ends_with(text, chr(10)) THEN string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[:-2] ELSE string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) END"
_DURATION = f"{CH}, d AS (SELECT file_id, max(end_ms) AS d FROM ch WHERE kind IN ('audio', 'video') AND file_id IS NOT NULL AND end_ms IS NOT NULL GROUP BY 1)"
_TIME = "CASE WHEN {t} >= 3600 THEN printf('%d:%02d:%02d', {t} // 3600, {t} // 60 % 60, {t} % 60) ELSE printf('%d:%02d', {t} // 60, {t} % 60) END"
_FROM, _TO = _TIME.format(t="floor(start_ms / 1000 + 0.5)::BIGINT"), _TIME.format(t="floor(end_ms / 1000 + 0.5)::BIGINT")
_PLACED = f"{CUR}, {CH}, placed AS (SELECT ch.*, cur.path FROM ch JOIN cur USING (file_id) WHERE kind IS NOT NULL)"

SQL = {
    "scope_statistics": f"WITH {CUR}, {CH} SELECT {_STAT} FROM ch JOIN cur USING (file_id) WHERE {_IN}",
    "scope_statistics_all": f"WITH {CUR}, {CH} SELECT {_STAT} FROM ch JOIN cur USING (file_id)",
    "skipped_files": f"WITH {_SKIPPED} SELECT path, reason FROM skipped",
    "skip_reason_groups": f"WITH {_SKIPPED} SELECT reason, {_TOLD} AS description, count(*) AS files, array_to_string(list(path ORDER BY path)[1:5], chr(10)) AS samples FROM skipped GROUP BY 1, 2",
    "indexed_roots_merge": r"""WITH once AS (SELECT regexp_replace(path, '(.)/+$', '\1') AS path, max(coalesce(indexed_at, 0)) AS indexed_at FROM indexed_roots WHERE path IS NOT NULL GROUP BY 1),
tops AS (SELECT a.path, arg_min(b.path, length(b.path)) AS root FROM once a JOIN once b ON a.path = b.path OR starts_with(a.path, b.path || '/') OR b.path = '/' GROUP BY 1)
SELECT o.path, count(*) - 1 AS merged, o.indexed_at FROM tops JOIN once o ON o.path = tops.root GROUP BY o.path, o.indexed_at""",
    "root_options": "SELECT DISTINCT path, indexed_at, " + ", ".join(f"CASE WHEN ok THEN (o->>'$.{f}')::{t} END AS {f}" for f, t in (("max_text_size", "BIGINT"), ("max_media_size", "BIGINT"), ("include_images", "BOOLEAN"), ("include_audio", "BOOLEAN"), ("include_video", "BOOLEAN"))) + " FROM (SELECT *, o IS NOT NULL AND json_type(o, '$.max_text_size') = 'UBIGINT' AS ok FROM (SELECT path, indexed_at, CASE WHEN json_valid(options) THEN options::JSON END AS o FROM indexed_roots))",
    "reconcile": f"WITH {_STATES} SELECT scan_id, path, state FROM states",
    "pending_changes": f"""WITH {_STATES}, s AS (SELECT *, {_KIND} AS kind FROM (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ending FROM states)),
n AS (SELECT scan_id, count_if(state = 'new') AS new_files, count_if(state = 'modified') AS modified_files, count_if(state = 'deleted') AS deleted_files, count_if(state = 'touched') AS touched_files, count_if(state = 'unchanged') AS unchanged_files, count_if(state IN ('new', 'modified') AND kind NOT IN ('text', 'pdf')) AS changed_media FROM s GROUP BY 1)
SELECT *, changed_media = 0 AND new_files + modified_files <= 25 AS updates_itself FROM n""",
    "status_samples": f"WITH {_STATES} SELECT scan_id, state, k, path FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, state ORDER BY path) AS k FROM states) WHERE k <= 5",
    "incremental_index": "SELECT scan_id, path, count(*) AS sightings FROM (SELECT DISTINCT * FROM file_sightings) GROUP BY 1, 2",
    "forget_scope": f"WITH {CUR} SELECT path, file_id FROM cur WHERE NOT {_IN}",
    "orphan_chunks": f"WITH {CUR}, {CH} SELECT chunk_id, file_id FROM ch WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.file_id = ch.file_id)",
    "chunk_ids_of_file": f"WITH {CUR}, {CH} SELECT path, chunk_id FROM ch JOIN cur USING (file_id) WHERE {_IN}",
    "content_hash_duplicates": "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "kind_of_path": f"WITH {CUR}, {_KINDS} SELECT path, kind, string_split(path, '/')[-1] AS title FROM kinds",
    "size_limits": f"WITH {CUR}, {_KINDS} SELECT path, kind, CASE WHEN kind = 'video' THEN 'left_out' WHEN kind = 'text' AND size > 20000 OR kind IN ('image', 'pdf') AND size > 1000000 THEN 'too_large' ELSE 'ok' END AS verdict FROM kinds",
    "decode_flags": "SELECT doc_id, contains(text[1:8192], chr(0)) AS is_binary, starts_with(text, chr(65279)) AS has_mark, contains(text, chr(13) || chr(10)) AS has_crlf FROM documents WHERE text IS NOT NULL",
    "display_paths": f"WITH {CUR} SELECT path, CASE WHEN path = '/home/tel' THEN '.' WHEN starts_with(path, '/home/tel/') THEN path[11:] ELSE path END AS shown FROM cur",
    "file_uris": f"WITH {CUR} SELECT path, 'file://' || replace(replace(url_encode(path), '%2F', '/'), '%3A', ':') AS uri FROM cur",
    "readable_sizes": f"WITH {CUR} SELECT path, CASE WHEN size < 1000000 THEN ((size + 999) // 1000) || ' KB' ELSE (size // 1000000) || ' MB' END AS size FROM cur WHERE size IS NOT NULL",
    "readable_ages": f"SELECT path, indexed_at, CASE WHEN s < 60 THEN 'just now' ELSE n || ' ' || u || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM (SELECT *, CASE WHEN s < 3600 THEN s // 60 WHEN s < 86400 THEN s // 3600 ELSE s // 86400 END AS n, CASE WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' ELSE 'day' END AS u FROM (SELECT *, greatest({NOW} - indexed_at, 0) AS s FROM indexed_roots WHERE indexed_at IS NOT NULL))",
    "line_features": rf"SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: NOT regexp_matches(x, '\S'))) AS blank, len(list_filter(l, lambda x: regexp_matches(x, '^#+ '))) AS headings, len(list_filter(l, lambda x: regexp_matches(x, '^[\s}})\];,]*$'))) AS closing, coalesce(list_max(list_transform(l, lambda x: length(regexp_extract(x, '^([ \t]*)', 1)))), 0) AS deepest FROM (SELECT doc_id, {_LINES} AS l FROM documents WHERE text IS NOT NULL)",
    "meaningful_chars": r"SELECT doc_id, length(regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS characters FROM documents WHERE text IS NOT NULL",
    "numbered_lines": rf"""WITH {CH}, l AS (SELECT chunk_id, coalesce(start_line, 1) AS start_line, list_transform({_LINES}, lambda x: regexp_replace(x, '[\s\x{{0B}}]+$', '')) AS l FROM ch WHERE text <> ''),
m AS (SELECT *, coalesce(list_min(list_transform(list_filter(l, lambda x: x <> ''), lambda x: length(regexp_extract(x, '^(\s*)', 1)))), 0) AS shared FROM l),
each AS (SELECT chunk_id, (start_line + i - 1)::INT AS line_number, l[i][shared + 1:] AS line FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM m))
SELECT chunk_id, line_number, CASE WHEN length(line) > 160 THEN line[1:160] || '…' ELSE line END AS line FROM each""",
    "time_ranges": f"WITH {CH} SELECT chunk_id, {_FROM} || '-' || {_TO} AS span, (end_ms - start_ms) / 1000 AS seconds FROM ch WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL",
    "document_prompts": "SELECT doc_id, sha256(p) AS prompt_hash, length(p) AS length FROM (SELECT doc_id, 'title: ' || CASE WHEN trim(string_split(path, '/')[-1]) = '' OR path IS NULL THEN 'none' ELSE string_split(path, '/')[-1] END || ' | text: ' || text[1:4000] AS p FROM documents WHERE text IS NOT NULL)",
    "result_json": f"WITH {_PLACED} SELECT chunk_id, path, kind, CASE WHEN kind = 'pdf' THEN coalesce(page, 1) END AS page, CASE WHEN kind = 'text' THEN start_line END AS start_line, CASE WHEN kind IN ('audio', 'video') AND start_ms IS NOT NULL AND end_ms IS NOT NULL THEN start_ms / 1000 END AS start_seconds, CASE WHEN kind IN ('text', 'pdf') THEN length(text) END AS text_length FROM placed",
    "headlines": f"WITH {_PLACED} SELECT chunk_id, CASE kind WHEN 'text' THEN path || ':' || coalesce(start_line::VARCHAR, '') || '-' || coalesce(end_line::VARCHAR, '') || '  0.50' WHEN 'pdf' THEN path || '  page ' || coalesce(page, 1) || '  0.50' WHEN 'image' THEN path || '  0.50  [image]' ELSE concat_ws('  ', path, {_FROM} || '-' || {_TO}, '0.50', '[' || kind || ']') END AS headline FROM placed",
    "audio_windows": f"""WITH {_DURATION}, n AS (SELECT *, CASE WHEN d >= 30000 THEN (d - 30000) // 25000 + 1 ELSE 0 END AS n FROM d),
s AS (SELECT file_id, k * 25000 AS start_ms, k * 25000 + 30000 AS end_ms FROM (SELECT *, unnest(range(0, n)) AS k FROM n) UNION ALL SELECT file_id, n * 25000, d FROM n WHERE CASE WHEN n > 0 THEN d - n * 25000 > 5000 ELSE d > 0 END)
SELECT file_id, start_ms, end_ms FROM s WHERE end_ms - start_ms >= 1000""",
    "video_segments": f"WITH {_DURATION} SELECT file_id, k * 9000 AS start_ms, least(k * 9000 + 9000, d) AS end_ms FROM (SELECT *, unnest(range(0, (d + 8999) // 9000)) AS k FROM d)",
    "overlapping_spans": f"WITH {CH} SELECT file_id, chunk_id FROM (SELECT *, lag(start_ms) OVER w AS a, lag(end_ms) OVER w AS b FROM ch WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL AND file_id IS NOT NULL WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, chunk_id)) WHERE a < end_ms AND start_ms < b",
    "fit_within": f"WITH {CUR}, s AS (SELECT path, size % 5000 + 1 AS w, (size // 7) % 3000 + 1 AS h FROM cur WHERE size IS NOT NULL) SELECT path, w, h, (CASE WHEN greatest(w, h) <= 768 THEN w ELSE greatest((w * 1536 + greatest(w, h)) // (2 * greatest(w, h)), 1) END)::INT AS width, (CASE WHEN greatest(w, h) <= 768 THEN h ELSE greatest((h * 1536 + greatest(w, h)) // (2 * greatest(w, h)), 1) END)::INT AS height FROM s",
}
