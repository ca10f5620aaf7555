"""The engine: index folders, search, find similar, report, forget (EP-1..EP-5, section 2.11)."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quarry.functions import text, vectors
from quarry.functions.encoders import BagOfWords, Encoder
from quarry.operators import catalog, retrieval
from quarry.operators.batch_search import batch_topk
from quarry.operators.chunking import ChunkLimits, chunk_texts
from quarry.session import shared_folder, ship_package
from quarry.sources import media
from quarry.sources.folders import discover
from quarry.sources.snapshots import Snapshots


@dataclass(frozen=True)
class IndexOptions:
    """What of a folder is indexed; kept as JSON with its root."""

    max_text_size: int = 1 << 20
    max_media_size: int = 64 << 20
    include_images: bool = True
    include_audio: bool = True
    include_video: bool = True

    def left_out(self) -> tuple[str, ...]:
        return tuple(k for k, on in (("image", self.include_images), ("audio", self.include_audio), ("video", self.include_video)) if not on)


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    keyword_weight: float = 1.0
    one_result_per_file: bool = True
    kind: str | None = None
    relevance_cutoff: bool = True


#: Characters of an example's text that are encoded.
EXAMPLE_CHARACTERS = 4000


class Engine:
    def __init__(self, spark: SparkSession, folder: str, encoder: Encoder | None = None, limits: ChunkLimits = ChunkLimits(), pdf_reader=media.pdf_pages):
        """``pdf_reader`` gives the texts of a PDF's pages from its bytes, None where it can't."""
        ship_package(spark)
        shared_folder(spark)
        self.spark, self.encoder, self.limits, self.pdf_reader = spark, encoder or BagOfWords(), limits, pdf_reader
        self.store = Snapshots(spark, folder, self.encoder.identity, self.encoder.dimensions)

    # ---- indexing

    def scan(self, root: str, options: IndexOptions = IndexOptions(), found: DataFrame | None = None) -> DataFrame:
        """EP-4: ``path, state`` of the folder against the index by size and time only, without reading contents.

        Files over a limit are ``too_large`` (indexed ones count as ``deleted`` too), those of excluded kinds ``left_out``.
        """
        found = discover(self.spark, root) if found is None else found
        verdicts = catalog.sizes_verdict(found, options.max_text_size, options.max_media_size, options.left_out())
        fit = found.join(verdicts.filter("verdict = 'ok'"), "path", "left_semi").withColumn("content_hash", F.lit(None).cast("string"))
        indexed = self.store.table("files").filter(catalog.in_scope(F.col("path"), root))
        return catalog.reconcile(fit, indexed).unionByName(verdicts.filter("verdict <> 'ok'").select("path", F.col("verdict").alias("state")))

    def index(self, root: str, options: IndexOptions = IndexOptions(), rebuild: bool = False, now: int | None = None) -> dict[str, int]:
        """EP-3, ST-4: brings the index up to date with a folder; gives counts of what was done.

        Files whose size or time changed are hashed; only those whose content changed are read, cut and encoded.
        """
        root = os.path.abspath(root)
        if rebuild:
            self.store.rebuild()
        self.store.check()
        listing = discover(self.spark, root).checkpoint()  # one look at the folder: what changes meanwhile waits for the next run
        states = self.scan(root, options, listing).checkpoint()
        found = listing.join(states.filter("state in ('new', 'modified')"), "path")
        old = self.store.table("files")
        hashed = media.with_hashes(found.drop("state")).filter("content_hash is not null")
        before = old.select("path", F.col("content_hash").alias("old_hash"), F.col("file_id").alias("old_id"))
        base = old.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0] + 1
        # Ids are given once: what follows reads this several times.
        listed = hashed.join(before, "path", "left").withColumn("file_id", F.coalesce("old_id", F.monotonically_increasing_id() + base)).withColumn("touched", F.coalesce(F.col("old_hash") == F.col("content_hash"), F.lit(False))).withColumn("kind", text.kind_of_path(F.col("path"))).checkpoint()
        changed = listed.filter("not touched")
        chunks, skipped = self._contents(changed)
        columns = ["file_id", "path", "size", "modified_nanoseconds", "content_hash"]
        removed = states.filter("state = 'deleted'").select("path")
        touched = listed.filter("touched").select(columns)
        # A touched file gets its new time; its chunks and its reason stay.
        keep = touched.select("file_id")
        chunks = chunks.unionByName(self.store.table("chunks").join(keep, "file_id", "left_semi"))
        skipped = skipped.unionByName(self.store.table("skipped").join(keep, "file_id", "left_semi"))
        summary = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        self.store.replace_files(changed.select(columns).unionByName(touched), chunks, skipped, removed, self._roots_with(root, options, now))
        done = listed.groupBy("touched").count().collect()
        embedded = sum(r["count"] for r in done if not r["touched"])
        reasons = {f"skipped_{r['reason']}": r["count"] for r in self.store.table("skipped").join(changed.select("file_id"), "file_id", "left_semi").groupBy("reason").count().collect()}
        return {"indexed": embedded, "unchanged": summary.get("unchanged", 0) + sum(r["count"] for r in done if r["touched"]), "removed": summary.get("deleted", 0), "too_large": summary.get("too_large", 0), "left_out": summary.get("left_out", 0), **reasons}

    def _contents(self, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Chunks and skip reasons of changed files, each kind by its own plan."""
        base = self.store.table("chunks").agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0] + 1
        ids = changed.select("file_id", "path", "kind")
        texts = media.read_texts(ids.filter("kind = 'text'")).join(ids.select("file_id", "path"), "path").checkpoint()
        cut = chunk_texts(texts.filter("text is not null"), "file_id", limits=self.limits).join(ids.select("file_id", "path"), "file_id")
        encode = self.encoder.documents_udf()
        none = lambda kind: F.lit(None).cast(kind)
        columns = ["file_id", "kind", "page", "start_ms", "end_ms", "start_line", "end_line", "text", "embedding"]
        parts = [cut.withColumn("embedding", encode(text.file_title(F.col("path")), "text")).select("file_id", F.lit("text").alias("kind"), none("int").alias("page"), none("long").alias("start_ms"), none("long").alias("end_ms"), "start_line", "end_line", "text", "embedding")]
        reasons = [texts.filter("reason is not null").select("file_id", "reason")]
        waves = ids.filter((F.col("kind") == "audio") & (text.file_ending(F.col("path")) == "wav"))
        heard = media.read_waves(waves, self.encoder).join(ids.select("file_id", "path"), "path").checkpoint()
        blank = [none("int").alias("page"), "start_ms", "end_ms", none("int").alias("start_line"), none("int").alias("end_line"), F.lit("").alias("text"), "embedding"]
        parts.append(heard.filter("embedding is not null").select("file_id", F.lit("audio").alias("kind"), *blank))
        reasons.append(heard.filter("reason is not null").select("file_id", "reason"))
        pictures = self._images(ids.filter("kind = 'image'"))
        if pictures is not None:
            parts.append(pictures.filter("embedding is not null").select("file_id", F.lit("image").alias("kind"), none("int").alias("page"), none("long").alias("start_ms"), none("long").alias("end_ms"), none("int").alias("start_line"), none("int").alias("end_line"), F.lit("").alias("text"), "embedding"))
            reasons.append(pictures.filter("reason is not null").select("file_id", "reason"))
        pages = media.read_pdfs(ids.filter("kind = 'pdf'"), self.pdf_reader).join(ids.select("file_id", "path"), "path").withColumn("page_id", F.monotonically_increasing_id()).checkpoint()
        sheets = chunk_texts(pages.filter("text is not null"), "page_id", limits=self.limits).join(pages.select("page_id", "file_id", "path", "page"), "page_id")
        parts.append(sheets.withColumn("embedding", encode(text.file_title(F.col("path")), "text")).select("file_id", F.lit("pdf").alias("kind"), "page", none("long").alias("start_ms"), none("long").alias("end_ms"), "start_line", "end_line", "text", "embedding"))
        reasons.append(pages.filter("reason is not null").select("file_id", "reason"))
        # Without a decoder videos and other recordings are unreadable here.
        reasons.append(ids.filter("kind = 'video' or kind = 'audio' and not lower(path) like '%.wav'").select("file_id", F.lit("recording_unreadable").alias("reason")))
        chunks, skipped = parts[0], reasons[0]
        for part in parts[1:]:
            chunks = chunks.unionByName(part)
        for reason in reasons[1:]:
            skipped = skipped.unionByName(reason)
        chunks = chunks.select(*columns).withColumn("chunk_id", F.monotonically_increasing_id() + base).checkpoint()
        return chunks, skipped

    def _images(self, ids: DataFrame) -> DataFrame | None:
        import pandas as pd

        folders = [r["folder"] for r in ids.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().collect()]  # folders with pictures
        if not folders:
            return None
        encoder = self.encoder

        @F.pandas_udf("array<float>")
        def encode(pixels: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
            return pd.Series([encoder.encode_image(media.to_rgb(*p)) for p in zip(pixels, width, height, channels)])

        loaded = media.load_images(self.spark, folders).join(ids.select("file_id", "path"), "path")
        good = loaded.filter("reason is null").withColumn("embedding", encode("pixels", "width", "height", "channels"))
        bad = loaded.filter("reason is not null").withColumn("embedding", F.lit(None).cast("array<float>"))
        return good.unionByName(bad).select("file_id", "embedding", "reason")

    def _roots_with(self, root: str, options: IndexOptions, now: int | None) -> DataFrame | None:
        """SNK-6, A13: roots inside the new one merge into it; a root inside a known one is not recorded (None)."""
        roots = self.store.table("roots")
        if roots.filter(F.lit(root).startswith(F.concat("path", F.lit("/")))).limit(1).count():
            return None
        row = self.spark.createDataFrame([(root, json.dumps(asdict(options)), int(time.time()) if now is None else now)], "path string, options string, indexed_at long")
        return roots.filter(~catalog.in_scope(F.col("path"), root)).unionByName(row)

    def pending(self, root: str, options: IndexOptions = IndexOptions()) -> dict:
        """EP-4, AG-7."""
        return catalog.pending_changes(self.scan(root, options)).first().asDict()

    def refresh(self, root: str, options: IndexOptions = IndexOptions()) -> str:
        """ST-5: ``up to date``, ``updated`` if little text had changed, else ``stale``."""
        changes = self.pending(root, options)
        if not changes["new_files"] + changes["modified_files"] + changes["deleted_files"]:
            return "up to date"
        if changes["updates_itself"]:
            self.index(root, options)
            return "updated"
        return "stale"

    def forget(self, scope: str) -> int:
        """SNK-5."""
        return self.store.forget(os.path.abspath(scope))

    # ---- searching

    def search(self, query: str, scope: str | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
        """EP-1: ``place, path, kind, similarity, page, start_line, end_line, start_ms, end_ms, text, chunk_id``."""
        vector = self.encoder.encode_query(query)
        keywords = None
        if options.kind in (None, "text", "pdf"):  # PR-6
            asked = self.spark.createDataFrame([(0, query)], "query_id int, query_text string")
            terms = retrieval.query_words(asked)
            hits = self.store.postings_of([r["term"] for r in terms.collect()]).select("term", "chunk_id", "tf", "length")  # the words of one query
            matched = retrieval.rank_postings(hits, terms)
            in_reach = self._scoped(scope, options.kind).select("chunk_id")
            keywords = retrieval.top_per_query(matched.join(in_reach, "chunk_id", "left_semi"), retrieval.CANDIDATES, F.desc("score"), F.col("chunk_id"))
        return self._rank(vector, keywords, None, scope, options)

    def similar(self, path: str, scope: str | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
        """EP-2, X-6: results like a file: indexed media by the mean of their vectors, texts by their beginning."""
        path = os.path.abspath(path)
        own = self.store.table("chunks").join(self.store.table("files").filter(F.col("path") == path).select("file_id"), "file_id", "left_semi")
        if media_kind(path) in ("image", "audio", "video"):
            row = retrieval.mean_direction(own).first()
            vector = self._media_vector(path) if row is None else row["embedding"]
        else:
            with open(path, "rb") as file:
                content = media.decode_text(file.read())
            if content is None or not content.strip():
                raise ValueError(f"{path} has no text")
            vector = self.encoder.encode_query(content[:EXAMPLE_CHARACTERS])
        return self._rank(vector, None, own.select("chunk_id"), scope, options)

    def _media_vector(self, path: str) -> list[float]:
        """X-6: the vector of a picture, or of the beginning of a recording, that is not in the index."""
        kind = media_kind(path)
        if kind == "audio" and path.lower().endswith(".wav"):
            first = next(iter(media.wave_windows(path)), None)
            if first is not None and len(first[2]):
                return self.encoder.encode_audio(first[2])
        if kind == "image":
            row = media.load_images(self.spark, path).filter("reason is null").first()
            if row is not None:
                return self.encoder.encode_image(media.to_rgb(row["pixels"], row["width"], row["height"], row["channels"]))
        raise ValueError(f"{path} is not indexed and can't be read")

    def nearest(self, vector: list[float], k: int = 10, scope: str | None = None) -> DataFrame:
        """EP-5."""
        return retrieval.vector_topk(self._scoped(scope, None), vectors.literal_vector(vector), k)

    def _scoped(self, scope: str | None, kind: str | None) -> DataFrame:
        files = self.store.table("files").filter(catalog.in_scope(F.col("path"), scope)).select("file_id", "path")
        chunks = self.store.table("chunks")
        return (chunks if kind is None else chunks.filter(F.col("kind") == kind)).join(files, "file_id")

    def _rank(self, vector: list[float], keywords: DataFrame | None, excluded: DataFrame | None, scope: str | None, options: SearchOptions) -> DataFrame:
        placed = self._scoped(scope, options.kind)
        asked = self.spark.createDataFrame([(0, [float(v) for v in vector])], "query_id int, embedding array<double>")
        light = placed.select("chunk_id", "embedding")
        out = None if excluded is None else excluded.select(F.lit(0).alias("query_id"), "chunk_id")
        by_vector = batch_topk(light, asked, retrieval.CANDIDATES, excluded=out).select("query_id", "chunk_id", "similarity", "rank")
        legs = [(by_vector, F.lit(1.0))]
        if keywords is not None:
            legs.append((keywords, F.lit(float(options.keyword_weight))))
        fused = retrieval.reciprocal_rank_fusion(*legs)
        matched = F.lit(False)
        if keywords is not None:
            fused = fused.join(keywords.select("query_id", "chunk_id", F.lit(True).alias("is_keyword")), ["query_id", "chunk_id"], "left")
            matched = F.coalesce("is_keyword", F.lit(False))
        full = placed.join(F.broadcast(fused), "chunk_id")  # at most two candidate lists
        similar = vectors.dot(F.col("embedding"), vectors.literal_vector(vector))
        full = full.withColumn("similarity", similar)
        if options.relevance_cutoff:
            moments = retrieval.similarity_moments(retrieval.similarities(light, vectors.literal_vector(vector)))
            floors = retrieval.relevance_floor(by_vector, moments.select(F.lit(0).alias("query_id"), "spread"))
            full = full.join(F.broadcast(floors), "query_id").filter(retrieval.passes_cutoff(F.col("floor"), F.col("similarity"), matched, F.col("fused_rank")))
        if options.one_result_per_file:
            kept = retrieval.best_per_file(full)
        else:
            chosen = retrieval.suppress_overlaps(full, F.lit(options.limit)).select("query_id", "chunk_id")
            kept = full.join(chosen, ["query_id", "chunk_id"], "left_semi")
        place = F.row_number().over(W.partitionBy("query_id").orderBy("fused_rank"))
        shown = kept.withColumn("place", place).filter(F.col("place") <= options.limit)
        return shown.select("place", "path", "kind", "similarity", "page", "start_line", "end_line", "start_ms", "end_ms", "text", "chunk_id").orderBy("place")

    # ---- reports

    def statistics(self, scope: str | None = None) -> dict:
        return catalog.scope_statistics(self.store.table("chunks"), self._dated(), scope).first().asDict()

    def _dated(self) -> DataFrame:
        return self.store.table("files").withColumn("recorded_at", F.lit(0))

    def status(self, root: str | None = None, options: IndexOptions = IndexOptions(), now: int | None = None) -> str:
        """SNK-10: the indexed folders with their age, or one folder with what of it is not indexed."""
        if root is None:
            now = int(time.time()) if now is None else now
            rows = self.store.table("roots").select("path", text.readable_age(F.lit(now) - F.col("indexed_at")).alias("age")).orderBy("path").collect()
            return "".join(f"{r['path']}  {r['age']}\n" for r in rows) or "nothing is indexed\n"
        root = os.path.abspath(root)
        s = self.statistics(root)
        out = [f"{s['files']} files ({s['images']} images, {s['recordings']} audio and video), {s['chunks']} chunks"]
        told = [(("new", "modified"), "new or changed"), (("too_large",), "too large"), (("left_out",), "left out"), (("deleted",), "deleted")]
        states = self.scan(root, options)
        counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        samples = states.withColumn("k", F.row_number().over(W.partitionBy("state").orderBy("path"))).filter("k <= 5").orderBy("path").collect()
        for of, label in told:
            total = sum(counts.get(s, 0) for s in of)
            if total:
                shown = [r["path"] for r in samples if r["state"] in of][:5]
                more = [f"  and {total - len(shown)} more"] if total > len(shown) else []
                out += [f"{total} {label}:", *[f"  {p}" for p in shown], *more]
        skipped = catalog.skip_reason_groups(catalog.skipped_files(self._dated(), self.store.table("chunks").select("file_id"), self.store.table("skipped"), root)).orderBy(text.reason_order(F.col("reason"))).collect()
        for r in skipped:
            out += [f"{r['files']} {r['description']}:", *[f"  {p}" for p in r["samples"].split("\n")]]
        return "\n".join(out) + "\n"


def summary_line(done: dict[str, int]) -> str:
    """SNK-11: what an index run did, in one line; what did not happen is not told."""
    told = [(done.get("indexed", 0), "indexed"), (done.get("unchanged", 0), "unchanged"), (done.get("removed", 0), "removed"), (done.get("too_large", 0), "too large"), (done.get("left_out", 0), "left out")]
    skipped = sum(n for k, n in done.items() if k.startswith("skipped_"))
    shown = [f"{n} {what}" for n, what in [*told, (skipped, "without content")] if n]
    return ", ".join(shown) or "nothing to index"


def media_kind(path: str) -> str:
    ending = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return next((kind for kind, endings in text.ENDINGS.items() if ending in endings), "text")
