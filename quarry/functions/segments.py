"""Time spans of recordings as column expressions, in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Seconds of an audio window and between their starts; frames of a video segment, seconds a frame.
AUDIO_WINDOW, AUDIO_HOP, FRAMES, FRAME_SECONDS = 30_000, 25_000, 3, 3_000
SHORTEST_AUDIO, SILENT = 1_000, 0.001


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))


def audio_windows(duration: Column, window: int = AUDIO_WINDOW, hop: int = AUDIO_HOP) -> Column:
    """ST-1, W-9: full windows from 0, and a tail where they leave something uncovered; no span under a second."""
    full = F.when(duration >= window, F.floor((duration - window) / hop) + 1).otherwise(0).cast("int")
    spans = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(full, F.lit(1))), 1, full), lambda k: _span(k * hop, k * hop + window))
    tail = F.when(full > 0, duration - full * hop > window - hop).otherwise(duration > 0)
    rest = F.array(_span(full * hop, duration))
    all_spans = F.when(tail, F.concat(spans, rest)).otherwise(spans)
    return F.filter(all_spans, lambda s: s["end_ms"] - s["start_ms"] >= SHORTEST_AUDIO)


def video_segments(duration: Column, frames: int = FRAMES, frame: int = FRAME_SECONDS) -> Column:
    """ST-2: segments of some frames each, the last one clipped to the duration."""
    step = frames * frame
    count = F.ceil(duration / step).cast("int")
    starts = F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), 1, F.greatest(count, F.lit(0)))
    return F.transform(starts, lambda k: _span(k * step, F.least(k * step + step, duration)))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """PR-13: half open."""
    return (a_start < b_end) & (b_start < a_end)


def contains_second(start: Column, end: Column, second: Column) -> Column:
    """PR-13: closed."""
    return (second * 1000 >= start) & (second * 1000 <= end)


def to_milliseconds(seconds: Column) -> Column:
    """V-4: negative times are 0, halves round up."""
    return F.when(seconds.isNotNull(), F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long"))


def samples_to_span(first: Column, count: Column, rate: int = 16_000) -> Column:
    """V-5."""
    return _span(F.floor(first * 1000 / rate), F.floor((first + count) * 1000 / rate))


def fit_within(width: Column, height: Column, most: int) -> Column:
    """V-3: scaled down so that no edge is over ``most``, halves rounded up, at least 1, never scaled up."""
    longest = F.greatest(width, height)

    def scaled(x: Column) -> Column:
        return F.greatest(F.floor((x * most * 2 + longest) / (longest * 2)), F.lit(1)).cast("int")

    fits = longest <= most
    return F.struct(F.when(fits, width).otherwise(scaled(width)).cast("int").alias("width"), F.when(fits, height).otherwise(scaled(height)).cast("int").alias("height"))
