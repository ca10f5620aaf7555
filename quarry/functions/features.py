"""V-6..V-8, SRC-13, S-13: what models are given, as numpy on whole arrays."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed values of the sound features: samples a second, of a frame, between frames and of a transform; mel bands, the
#: floor under the logarithm, seconds at most, and the multiple of samples a clip is filled up to.
RATE, FRAME, HOP, TRANSFORM, BANDS, FLOOR, MOST_SECONDS, FILL = 16_000, 320, 160, 512, 128, 1e-3, 30, 128
#: Token budgets of pictures.
BUDGETS = (70, 140, 280, 560, 1120)


def encode_vector(vector: np.ndarray) -> bytes:
    """SRC-13: little-endian 32-bit floats."""
    return np.asarray(vector, "<f4").tobytes()


def decode_vector(raw: bytes) -> np.ndarray:
    if len(raw) % 4:
        raise ValueError(f"{len(raw)} bytes are no vector of 32-bit floats")
    return np.frombuffer(raw, "<f4")


def encoder_identity(model: str, dimensions: int, vision_budget: int) -> str:
    """S-13."""
    return f"{model}@{dimensions}/vision{vision_budget}"


@lru_cache
def _mel_bands() -> np.ndarray:
    """Triangles with peaks evenly spaced on the mel scale (2595 log10(1 + f / 700)), at the transform's frequencies."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), BANDS + 2) / 2595) - 1)
    at = np.linspace(0, RATE / 2, TRANSFORM // 2 + 1)[:, None]
    low, peak, high = edges[:-2], edges[1:-1], edges[2:]
    return np.clip(np.minimum((at - low) / (peak - low), (high - at) / (high - peak)), 0, None)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """V-7: ``(frames, 128)`` features and which frames lie on real samples; the first frame is centred on the start."""
    samples = np.asarray(samples, np.float32)[: MOST_SECONDS * RATE]
    half, filled = FRAME // 2, -(-len(samples) // FILL) * FILL
    wave = np.concatenate([np.zeros(half, np.float32), samples, np.zeros(filled - len(samples), np.float32)])
    if len(wave) <= FRAME:
        return np.zeros((0, BANDS), np.float32), np.zeros(0, bool)
    starts = np.arange(0, len(wave) - FRAME, HOP)
    real = starts + FRAME < half + len(samples)
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(wave, FRAME)[starts] * window
    energy = np.abs(np.fft.rfft(frames.astype(np.float64), TRANSFORM, axis=1)) @ _mel_bands()
    return np.where(real[:, None], np.log(energy + FLOOR), 0).astype(np.float32), real


@dataclass(frozen=True)
class PatchGrid:
    """V-6: how a picture is cut into patches: their edge, how many are pooled into a token, tokens at most."""

    patch: int = 16
    pooling: int = 3
    budget: int = 280

    def __post_init__(self):
        if self.budget not in BUDGETS:
            raise ValueError(f"a picture takes one of {BUDGETS} tokens, not {self.budget}")

    @property
    def most_patches(self) -> int:
        return self.budget * self.pooling**2

    def target_size(self, width: int, height: int) -> tuple[int, int]:
        """The size, in whole pooled patches, that comes nearest the budget from below at the same shape."""
        if width <= 0 or height <= 0:
            raise ValueError(f"a picture of {width}x{height}")
        side, pixels = self.pooling * self.patch, self.most_patches * self.patch**2
        scale = (pixels / (width * height)) ** 0.5
        across, down = int(scale * width / side), int(scale * height / side)
        if not across and not down:
            raise ValueError(f"a picture of {width}x{height} fills no patch")
        if not down:  # a strip of one row
            across, down = min(width // height, self.budget), 1
        elif not across:
            across, down = 1, min(height // width, self.budget)
        if across * down * side * side > pixels:
            raise ValueError(f"a picture of {width}x{height} exceeds the budget")
        return across * side, down * side

    def patches(self, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of a picture of target size: patches in rows of values from 0 to 1, their (column, row), -1 beyond the last; tokens."""
        high, wide = pixels.shape[0] // self.patch, pixels.shape[1] // self.patch
        cut = pixels.reshape(high, self.patch, wide, self.patch, 3).transpose(0, 2, 1, 3, 4).reshape(high * wide, -1)
        values = np.zeros((self.most_patches, cut.shape[1]), np.float32)
        values[: len(cut)] = cut / np.float32(255)
        places = np.full((self.most_patches, 2), -1, np.int64)
        places[: len(cut)] = np.stack([np.tile(np.arange(wide), high), np.repeat(np.arange(high), wide)], 1)
        return values, places, len(cut) // self.pooling**2


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic with the window widened when made smaller, one axis after the other."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        reach = max(scale, 1.0)
        centre = (np.arange(new) + 0.5) * scale - 0.5
        x = np.abs((np.arange(old)[None, :] - centre[:, None]) / reach)
        w = np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
        return w / w.sum(1, keepdims=True)

    out = np.einsum("nh,hwc->nwc", weights(pixels.shape[0], height), pixels.astype(np.float64))
    return np.clip(np.rint(np.einsum("nw,hwc->hnc", weights(pixels.shape[1], width), out)), 0, 255).astype(np.uint8)


def pad_batch(sequences: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """V-8: ids filled up to the longest, and which of them are real."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    real = np.arange(sizes.max(initial=0))[None, :] < sizes[:, None]
    ids = np.full(real.shape, pad, np.int64)
    ids[real] = np.concatenate([np.asarray(s, np.int64) for s in sequences]) if len(sequences) else []
    return ids, real.astype(np.int64)


def truncate_tokens(ids: list[int], most: int) -> list[int]:
    """V-8: the first ones and the last, which ends the sequence."""
    return ids if len(ids) <= most else [*ids[: most - 1], ids[-1]]


def splice(embedded: np.ndarray, ids: np.ndarray, placeholder: int, soft: np.ndarray) -> np.ndarray:
    """V-8: the soft tokens in the places of the placeholder, in order; their numbers must agree."""
    at = np.asarray(ids).reshape(-1) == placeholder
    if at.sum() != len(soft):
        raise ValueError(f"{at.sum()} places for {len(soft)} soft tokens")
    flat = embedded.reshape(-1, embedded.shape[-1]).copy()
    flat[at] = soft
    return flat.reshape(embedded.shape)
