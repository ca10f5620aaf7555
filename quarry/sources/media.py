"""SRC-4..SRC-10: contents of files: text, PDFs, images, recordings. What can't be read is a reason, never an error."""

from __future__ import annotations

import hashlib
import json
import subprocess
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes looked at for a NUL; the least edge of a photo.
PROBED_BYTES, LEAST_EDGE = 8192, 64
READ_BYTES = 1 << 20


def decode_text(raw: bytes) -> str | None:
    """SRC-4: None for binary contents (a NUL among the first 8 KiB); bad bytes are replaced, a mark is dropped."""
    if b"\0" in raw[:PROBED_BYTES]:
        return None
    return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def content_hash(path: str) -> str | None:
    """SRC-10: SHA-256 of a file read in parts; None if it can't be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as file:
            while part := file.read(READ_BYTES):
                digest.update(part)
    except OSError:
        return None
    return digest.hexdigest()


def with_hashes(files: DataFrame) -> DataFrame:
    """Adds ``content_hash`` to files with a ``path``, reading each in its task."""

    @F.pandas_udf("string")
    def hashed(paths: pd.Series) -> pd.Series:
        return paths.map(content_hash, na_action="ignore")

    return files.withColumn("content_hash", hashed("path"))


#: Bytes of text that one Arrow batch of contents holds, about.
BATCH_BYTES = 8 << 20


def read_texts(files: DataFrame) -> DataFrame:
    """``path, text, reason`` of text files: the text, or why there is none (``binary``; null where it can't be read)."""

    def one(path: str) -> tuple:
        try:
            with open(path, "rb") as file:
                text = decode_text(file.read())
        except OSError:
            return path, None, None
        return path, text, "binary" if text is None else None

    return _read(files, one, pa.schema([("path", pa.string()), ("text", pa.string()), ("reason", pa.string())]), "path string, text string, reason string")


def _read(files: DataFrame, one, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows made of each path by ``one`` (a row or a list of rows), in batches of about ``BATCH_BYTES``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                made = one(path)
                for row in made if isinstance(made, list) else [made]:
                    rows.append(row)
                    size += 100 + sum(len(x) for x in row if isinstance(x, (str, list)))
                if size >= BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return files.select("path").mapInArrow(read, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def read_pdfs(files: DataFrame, reader) -> DataFrame:
    """JN-12: ``path, page, text, reason``: a row for each page with text, pages from 1, or one with the reason there is none.

    ``reader`` gives the texts of a PDF's pages from its bytes, or None where it can't.
    """

    def one(path: str) -> list[tuple]:
        try:
            with open(path, "rb") as file:
                pages = reader(file.read())
        except OSError:
            return [(path, None, None, None)]
        if pages is None:
            return [(path, None, None, "pdf_unreadable")]
        return [(path, n, page, None) for n, page in enumerate(pages, 1) if page.strip()] or [(path, None, None, "pdf_without_text")]

    return _read(files, one, pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("reason", pa.string())]), "path string, page int, text string, reason string")


def pdf_pages(raw: bytes) -> list[str] | None:
    """SRC-5, ER-2: the text of each page by an installed PDF library; None if there is none or it fails on the file."""
    try:
        import io

        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages]
    except Exception:  # parsers fail in many ways on broken files
        return None


def has_text(pages: list[str]) -> bool:
    """PR-12."""
    return any(page.strip() for page in pages)


def load_images(spark, paths: list[str] | str) -> DataFrame:
    """SRC-6: ``path, width, height, pixels (RGB bytes), reason``: too small, unreadable, or null. By Spark's image source."""
    images = spark.read.format("image").option("dropInvalid", False).load(paths)
    i = F.col("image")
    reason = F.when(F.coalesce(i["height"], F.lit(-1)) < 0, "image_unreadable").when(F.least(i["width"], i["height"]) < LEAST_EDGE, "image_too_small")
    path = F.regexp_replace(F.url_decode(F.regexp_replace(i["origin"], r"\+", "%2B")), "^file:/*", "/")
    return images.select(path.alias("path"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), i["data"].alias("pixels"), reason.alias("reason"))


def to_rgb(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Rows of red, green, blue from the source's blue, green, red; transparent pixels are laid on white."""
    raw = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(raw, 3, axis=2)
    colour = raw[:, :, 2::-1].astype(np.float64)
    if channels == 4:
        alpha = raw[:, :, 3:].astype(np.float64) / 255
        colour = colour * alpha + 255 * (1 - alpha)
    return np.rint(colour).astype(np.uint8)


def parse_probe(text: str) -> dict:
    """SRC-7: ``duration`` in seconds (0 if unknown), ``has_audio``, ``width, height`` as shown (turned ones swapped; cover art is no video)."""
    probe = json.loads(text)
    out = {"duration": 0.0, "has_audio": False, "width": None, "height": None}
    try:
        out["duration"] = max(0.0, float(probe.get("format", {}).get("duration", 0)))
    except (TypeError, ValueError):
        pass
    for stream in probe.get("streams", []):
        if stream.get("codec_type") == "audio":
            out["has_audio"] = True
        cover = stream.get("disposition", {}).get("attached_pic")
        if stream.get("codec_type") == "video" and not cover and out["width"] is None and stream.get("width") and stream.get("height"):
            turns = [d.get("rotation") for d in stream.get("side_data_list", [])] + [stream.get("tags", {}).get("rotate")]
            turned = any(t is not None and abs(int(float(t))) % 180 == 90 for t in turns)
            out["width"], out["height"] = (stream["height"], stream["width"]) if turned else (stream["width"], stream["height"])
    return out


def probe(path: str, tool: str = "ffprobe") -> dict | None:
    """SRC-7, DE-1: facts of a recording by an installed tool; None if it can't be read. A missing tool is an error."""
    done = subprocess.run([tool, "-v", "error", "-print_format", "json", "-show_streams", "-show_format", path], capture_output=True, timeout=60)
    return parse_probe(done.stdout.decode("utf-8", "replace")) if done.returncode == 0 else None


#: Fixed value: samples a second that encoders hear.
HEARD_RATE = 16_000


def resampled(samples: np.ndarray, rate: int, to: int = HEARD_RATE) -> np.ndarray:
    """The same sound at another rate: its spectrum cut off or continued with zeros."""
    if rate == to or not len(samples):
        return samples
    wanted = max(1, round(len(samples) * to / rate))
    spectrum = np.fft.rfft(samples)[: wanted // 2 + 1]
    return np.fft.irfft(spectrum, wanted) * (wanted / len(samples))


def wave_windows(path: str, window: int = 30_000, hop: int = 25_000) -> Iterator[tuple[int, int, np.ndarray]]:
    """SRC-8 for WAV files: start and end in milliseconds and the mono samples of each window at 16 kHz; the tail only if uncovered."""
    with wave.open(path, "rb") as file:
        rate, total, width, channels = file.getframerate(), file.getnframes(), file.getsampwidth(), file.getnchannels()
        kinds = {1: np.uint8, 2: np.int16, 4: np.int32}
        if width not in kinds:
            raise wave.Error(f"samples of {width} bytes")
        long, step, start = window * rate // 1000, hop * rate // 1000, 0
        covered = 0
        while start < total and (start == 0 or covered < total):
            file.setpos(start)
            raw = np.frombuffer(file.readframes(long), kinds[width]).reshape(-1, channels).astype(np.float64).mean(1)
            samples = (raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))
            yield start * 1000 // rate, (start + len(samples)) * 1000 // rate, resampled(samples, rate)
            covered = start + len(samples)
            start += step


def read_waves(files: DataFrame, encoder) -> DataFrame:
    """``path, start_ms, end_ms, embedding, reason`` of WAV files: audible windows of a second or more (PR-11, AG-9), encoded.

    A file without any is ``recording_without_content``; what can't be decoded is ``recording_unreadable``, and what was
    decoded before stays (ER-1).
    """
    schema = pa.schema([("path", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("embedding", pa.list_(pa.float32())), ("reason", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, reason = [], None
                try:
                    for start, end, samples in wave_windows(path):
                        if end - start >= 1000 and len(samples) and np.sqrt(np.mean(samples * samples)) >= 0.001:
                            rows.append({"path": path, "start_ms": start, "end_ms": end, "embedding": encoder.encode_audio(samples), "reason": None})
                    reason = None if rows else "recording_without_content"
                except (OSError, EOFError, wave.Error, ValueError):
                    reason = None if rows else "recording_unreadable"
                yield pa.RecordBatch.from_pylist(rows or [{"path": path, "start_ms": None, "end_ms": None, "embedding": None, "reason": reason}], schema=schema)

    return files.select("path").mapInArrow(read, "path string, start_ms long, end_ms long, embedding array<float>, reason string")
