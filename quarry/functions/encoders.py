"""X-1..X-3, X-5: encoders of texts and media to unit vectors."""

from __future__ import annotations

import hashlib
import os
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import vectors


class ModelSource(Protocol):
    """X-5, SRC-14: where a model's files are."""

    def file(self, name: str) -> str: ...


class LocalModel:
    """Files of a model in a folder; a missing one is an error."""

    def __init__(self, folder: str):
        self.folder = folder

    def file(self, name: str) -> str:
        path = os.path.join(self.folder, name)
        if not os.path.exists(path):
            raise FileNotFoundError(f"the model lacks {name}: {path}")
        return path


class Encoder(ABC):
    """X-1: what an index needs of an encoder; all vectors have length one."""

    @property
    @abstractmethod
    def identity(self) -> str: ...

    @property
    @abstractmethod
    def dimensions(self) -> int: ...

    @abstractmethod
    def encode_query(self, query: str) -> list[float]: ...

    @abstractmethod
    def encode_documents(self, documents: list[tuple[str, str]]) -> list[list[float]]:
        """Of (title, text) pairs."""

    def encode_image(self, pixels: np.ndarray) -> list[float]:
        raise NotImplementedError(f"{self.identity} encodes no images")

    def encode_video(self, frames: list[np.ndarray]) -> list[float]:
        raise NotImplementedError(f"{self.identity} encodes no video")

    def encode_audio(self, samples: np.ndarray) -> list[float]:
        raise NotImplementedError(f"{self.identity} encodes no audio")

    def documents_udf(self):
        """A Pandas function (title, text) to vector; the encoder travels once to each worker."""
        encoder = self

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for titles, texts in batches:
                yield pd.Series(encoder.encode_documents(list(zip(titles.fillna(""), texts.fillna("")))))

        return encode


_WORD = re.compile(r"[^\W_]+")


def bucket(word: str, dimensions: int = 64) -> int:
    return hashlib.sha256(word.encode("utf-8")).digest()[0] % dimensions


class BagOfWords(Encoder):
    """X-3: counts of words by a hash of the word. Titles are ignored; the underscore parts words.

    Images are told by their strongest channel, recordings by whether their tones are low or high.
    """

    identity = "bag-of-words@64"
    dimensions = 64

    def encode_query(self, query: str) -> list[float]:
        return self.encode_documents([("", query)])[0]

    def encode_documents(self, documents: list[tuple[str, str]]) -> list[list[float]]:
        out = []
        for _, text in documents:
            vector = np.zeros(self.dimensions)
            for word in _WORD.findall(text.lower()):
                vector[bucket(word)] += 1
            out.append(self._unit(vector))
        return out

    def encode_image(self, pixels: np.ndarray) -> list[float]:
        channel = ("red", "green", "blue")[int(np.argmax(pixels.reshape(-1, pixels.shape[-1])[:, :3].sum(0)))]
        return self.encode_query(channel)

    def encode_video(self, frames: list[np.ndarray]) -> list[float]:
        return self._unit(np.mean([self.encode_image(f) for f in frames], axis=0))

    def encode_audio(self, samples: np.ndarray, rate: int = 16_000) -> list[float]:
        crossings = np.count_nonzero(np.diff(np.signbit(samples)))
        return self.encode_query("bass" if crossings * rate / max(1, len(samples)) / 2 < 1000 else "treble")

    @staticmethod
    def _unit(vector: np.ndarray) -> list[float]:
        length = float(np.linalg.norm(vector))
        return (vector / length if length else vector).tolist()


def bag_of_words(text: Column, dimensions: int = 64) -> Column:
    """X-3 as an expression, without Python: the vector of one text, from its words' hashes. Texts of any length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.sha2(w.cast("binary"), 256), 1, 2), 16, 10).cast("int") % dimensions))
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), dimensions), lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1).otherwise(x)))
    return vectors.let(counts, vectors.normalized)


def bag_of_words_table(rows: DataFrame, key: str, text: str = "text", dimensions: int = 64) -> DataFrame:
    """X-3 over a table: ``key, bucket, weight`` of the elements that aren't 0; words are counted before the shuffle."""
    words = F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    at = F.conv(F.substring(F.sha2(F.col("word").cast("binary"), 256), 1, 2), 16, 10).cast("int") % dimensions
    counts = rows.select(key, words.alias("word")).groupBy(key, at.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    lengths = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(lengths, key).select(key, "bucket", (F.col("n") / F.col("length")).alias("weight"))
