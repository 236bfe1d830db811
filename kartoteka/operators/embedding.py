"""Item text, its vectors, and which items have them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.text import is_blank

# Fixed values of the composed text.
PART_SEPARATOR = " | "
ENCODER_BATCH = 32

# Words counted at a time; a batch of long texts has many more.
WORDS_AT_ONCE = 1 << 18


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class WordHashing:
    """Counts of hashed words: a model-free encoder whose vectors are exact whole numbers."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self._bucket: dict[str, int] = {}

    def _of(self, word: str) -> int:
        if word not in self._bucket:
            if len(self._bucket) > 1_000_000:
                self._bucket.clear()
            self._bucket[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimension
        return self._bucket[word]

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        counts = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for row, text in zip(counts, texts):
            buckets = [self._of(w) for w in re.findall(r"[^\W_]+", text.lower())]
            row += np.bincount(buckets, minlength=self.dimension) if buckets else 0
        return counts


def compose_text(name: str, place: str, region: str, instructions: str, components: str,
                 label: str = "Recipe", component_limit: int | None = None) -> Column:
    """One text per item; parts that are missing leave no trace, a region needs its place.

    Nothing is cut, unless `component_limit` says after how many characters the components are.
    """
    listed = F.col(components) if component_limit is None else F.substring(components, 1, component_limit)
    place_text = F.concat(F.lit("Country: "), F.col(place),
                          F.coalesce(F.concat(F.lit(" ("), F.col(region), F.lit(")")), F.lit("")))
    return F.concat_ws(
        PART_SEPARATOR,
        F.concat(F.lit(f"{label}: "), F.col(name)),
        place_text,
        F.when(~is_blank(instructions), F.concat(F.lit("Instructions: "), F.col(instructions))),
        F.when(~is_blank(components),
               F.concat(F.lit("Ingredients: "), listed)),
    )


def word_buckets(text: str, dimension: int) -> Column:
    """The bucket of every word of a text, in the JVM; the same ones as `WordHashing`'s."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    number = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")
    return F.transform(words, lambda w: F.pmod(number(w), F.lit(dimension)).cast("int"))


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1)


def embed_words(df: DataFrame, text: str, out: str = "embedding", dimension: int = 64, unit: bool = False) -> DataFrame:
    """Add the hashed word counts of a text. Words are cut and hashed in the JVM; only counting is left to Arrow."""

    @F.arrow_udf("array<float>")
    def count(buckets: pa.Array) -> pa.Array:
        starts = buckets.offsets.to_numpy().astype(np.int64)
        words, sizes = buckets.values.to_numpy(), np.diff(starts)
        counts = np.zeros(len(sizes) * dimension, np.float32)
        for a in range(int(starts[0]), int(starts[-1]), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, int(starts[-1]))
            first, last = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b)  # texts with these words
            own = np.diff(np.clip(starts[first:last + 1], a, b))
            flat = np.repeat(np.arange(last - first), own) * dimension + words[a:b]
            counts[first * dimension:last * dimension] += np.bincount(flat, minlength=(last - first) * dimension)
        counts = counts.reshape(-1, dimension)
        offsets = np.arange(len(sizes) + 1, dtype=np.int32) * dimension
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((_unit_rows(counts) if unit else counts).astype(np.float32).ravel()))

    return df.withColumn(out, count.asNondeterministic()(word_buckets(text, dimension)))


def embed(df: DataFrame, text: str, make_encoder: Callable[[], Encoder] = WordHashing, out: str = "embedding",
          batch_size: int = ENCODER_BATCH, unit: bool = False) -> DataFrame:
    """Add a vector per row, with `unit` of length one. An encoder is made once per task and fed in batches; nothing is shuffled.

    The function is marked nondeterministic only to keep it from running again for
    every filter on its result.
    """
    if make_encoder is WordHashing:
        return embed_words(df, text, out, unit=unit)

    @F.arrow_udf("array<float>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for column in texts:
            words = column.to_pylist()
            vectors = [encoder.encode([t or "" for t in words[i:i + batch_size]])
                       for i in range(0, len(words), batch_size)]
            dim = vectors[0].shape[1] if vectors else 0
            rows = np.concatenate(vectors) if vectors else np.zeros((0, 0))
            flat = (_unit_rows(rows) if unit else rows).astype(np.float32).ravel()
            offsets = np.arange(len(words) + 1, dtype=np.int32) * dim
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return df.withColumn(out, encode.asNondeterministic()(F.col(text)))
