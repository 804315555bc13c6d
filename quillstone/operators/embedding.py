"""Embedding providers: texts to vectors.

What a provider can't embed is null and is dropped later with its place kept. Equal texts of a slice of a batch are embedded once;
embedded_once() embeds the different texts of a whole table and joins them back, for providers whose work outweighs a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.config import SUPPORTED_LANGUAGES
from quillstone.functions.vectors import cosine


#: Rows, and bytes of their texts about, that a task gives to a provider at once, however large Spark's batches are.
SLICE, SLICE_BYTES = 1024, 8 << 20


def _slices(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(text_col)).nbytes
        rows = max(1, min(SLICE, batch.num_rows * SLICE_BYTES // max(1, size)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


@dataclass(frozen=True)
class ModelInfo:
    version: str
    strategy: str
    dimension: int
    language: str
    model: str | None = None

    def column(self):
        """The descriptor as a literal struct of schemas.EMBEDDING_METADATA."""
        return F.struct(F.lit(self.version).alias("version"), F.lit(self.language).alias("language"), F.lit(self.dimension).alias("dimension"), F.lit(self.strategy).alias("strategy"), F.lit(self.model).alias("model"), F.lit(None).cast("timestamp").alias("created_at"))


class Provider(Protocol):
    info: ModelInfo

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class _Places(dict):
    """Of a word twice its place, and one more if its sign is positive. At MOST words it is begun anew."""

    MOST = 100_000

    def __init__(self, dimension: int) -> None:
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = int(hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)
        if len(self) >= self.MOST:
            self.clear()
        self[word] = at = h % self.dimension * 2 + (h >> 59)
        return at


class HashingProvider:
    """Signed counts of a text's lower-case words in hashed places, over their length: offline, and the same everywhere.

    Of a word's sha256 the first 60 bits count: the highest gives the sign, the number modulo the dimension the place. A text
    whose words cancel each other has a vector of zeros, which matches nothing; one without words has none.
    """

    def __init__(self, dimension: int = 64, language: str = "en") -> None:
        self.info = ModelInfo("hashing-2", "word_v1", dimension, language, f"hashing-{dimension}")

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        places, size = _Places(self.info.dimension), 2 * self.info.dimension
        for text in texts:
            words = text.lower().split()
            if not words:
                out.append(None)
                continue
            n = np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=size)
            v = (n[1::2] - n[::2]).astype(np.float64)
            length = np.sqrt(v @ v)
            out.append((v / length if length else v).tolist())
        return out


class Directed:
    """A provider without vectors for texts to which it, or by in its place, gives no direction: a vector of zeros."""

    def __init__(self, provider: Provider, by: Provider | None = None) -> None:
        self.provider, self.by, self.info = provider, by, provider.info

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        made = self.provider.embed(texts)
        ruling = made if self.by is None else self.by.embed(texts)
        return [v if r is not None and any(r) else None for v, r in zip(made, ruling, strict=True)]


class Chain:
    """The first provider that embeds a text does."""

    def __init__(self, *providers: Provider) -> None:
        self.providers, self.info = providers, providers[0].info

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = [None] * len(texts)
        for p in self.providers:
            todo = [i for i, v in enumerate(out) if v is None]
            for i, v in zip(todo, p.embed([texts[i] for i in todo]), strict=True):
                out[i] = v
        return out


class Guarded:
    """A provider that rests after a failure: for cool_down seconds, or for good if it isn't permitted. While it rests it embeds nothing, so that the next of a Chain does."""

    def __init__(self, provider: Provider, cool_down: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.provider, self.info, self.cool_down, self.clock = provider, provider.info, cool_down, clock
        self.until, self.reason = 0.0, None

    @property
    def healthy(self) -> bool:
        return self.clock() >= self.until

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        if not self.healthy:
            return [None] * len(texts)
        try:
            return self.provider.embed(texts)
        except Exception as e:  # noqa: BLE001  whatever a model raises
            forbidden = isinstance(e, PermissionError) or "permission" in str(e).lower()
            self.until = math.inf if forbidden else self.clock() + self.cool_down
            self.reason = "permission denied" if forbidden else "runtime error"
            return [None] * len(texts)


class Registry:
    """Providers by language; a text of another language goes to the fallback's."""

    def __init__(self, providers: dict[str, Provider], fallback: str = "en") -> None:
        self.providers, self.fallback, self.info = providers, fallback, providers[fallback].info

    def available(self, language: str) -> bool:
        return language in self.providers

    def of(self, language: str | None) -> Provider:
        return self.providers.get(language, self.providers[self.fallback])

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return self.of(self.fallback).embed(texts)


def languages(provider: Provider) -> list[str]:
    """The languages that a provider is made for, sorted."""
    return sorted(provider.providers) if isinstance(provider, Registry) else [provider.info.language]


def embedded_by_language(df: DataFrame, registry: Registry, language_col: str, text_col: str = "content") -> DataFrame:
    """df with vector, and vector_language, the language of the provider that made it; both null where there is no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            asked = batch.column(batch.schema.get_field_index(language_col)).to_pylist()
            made: list[tuple] = [(None, None)] * len(texts)
            used = [x if registry.available(x) else registry.fallback for x in asked]
            for language in set(used):
                some = [i for i, x in enumerate(used) if x == language and (texts[i] or "").strip()]
                for i, v in zip(some, registry.of(language).embed([texts[i] for i in some]), strict=True):
                    made[i] = (v, language if v is not None else None)
            batch = batch.append_column("vector", pa.array([v for v, _ in made], pa.list_(pa.float32())))
            yield batch.append_column("vector_language", pa.array([x for _, x in made], pa.string()))

    from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

    df = df.drop("vector", "vector_language")
    return df.mapInArrow(run, StructType([*df.schema.fields]).add("vector", ArrayType(FloatType())).add("vector_language", StringType()))


def embedded(df: DataFrame, provider: Provider, text_col: str = "content") -> DataFrame:
    """df with vector (array<float>, null where the provider has none or the text is blank). The provider is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = [t or "" for t in batch.column(at).to_pylist()]
            order = list(dict.fromkeys(t for t in texts if t.strip()))
            vectors = dict(zip(order, provider.embed(order), strict=True))
            yield batch.append_column("vector", pa.array([vectors.get(t) for t in texts], pa.list_(pa.float32())))

    from pyspark.sql.types import ArrayType, FloatType, StructType

    df = df.drop("vector")
    return df.mapInArrow(run, StructType([*df.schema.fields]).add("vector", ArrayType(FloatType())))


def embedded_once(df: DataFrame, provider: Provider, text_col: str = "content") -> DataFrame:
    """embedded(), with each different text of df given to the provider once. Texts are told apart by 128 bits of hash."""
    keys = (F.xxhash64(F.lit(3), text_col).alias("__t1"), F.xxhash64(F.lit(4), text_col).alias("__t2"))
    rows = df.drop("vector").withColumns({"__t1": keys[0], "__t2": keys[1]})
    texts = rows.groupBy("__t1", "__t2").agg(F.first(text_col).alias("__text"))
    vectors = embedded(texts, provider, "__text").drop("__text")
    return rows.join(vectors, ["__t1", "__t2"]).drop("__t1", "__t2")


def similarities(df: DataFrame, provider: Provider, a: str = "a", b: str = "b") -> DataFrame:
    """df with similarity, the cosine of the texts a and b; null where either can't be embedded."""
    both = embedded(embedded(df, provider, a).withColumnRenamed("vector", "__a"), provider, b)
    return both.withColumn("similarity", cosine(F.col("__a"), F.col("vector"))).drop("__a", "vector")


def mean_vectors(df: DataFrame, key: str = "text_id") -> DataFrame:
    """key, vector: the mean of df's word vectors (key, vector) by place. Vectors of another length than the first's are skipped but count in the divisor."""
    sized = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("dim", F.first(F.size("vector")).over(Window.partitionBy(key).orderBy("place")))
    parts = sized.where(F.size("vector") == F.col("dim")).select(key, "n", F.posexplode("vector").alias("i", "x"))
    sums = parts.groupBy(key, "i").agg((F.sum(F.col("x").cast("double")) / F.first("n")).alias("x"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def dominant_language(df: DataFrame, key: str, order: str, first: int = 10) -> DataFrame:
    """key, language: the most frequent language of a key's first texts that aren't blank, supported ones alone; ties by name; en for none."""
    rows = df.where(F.rlike("text", F.lit(r"\S")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("r") <= first)
    votes = rows.where(F.col("lang").isin(*SUPPORTED_LANGUAGES)).groupBy(key, "lang").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(key).agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("language"))
    return df.select(key).distinct().join(best, key, "left").select(key, F.coalesce("language", F.lit("en")).alias("language"))


def to_base64(v: str = "vector"):
    """A column of little-endian 32-bit floats in base64, made from all floats of a batch at once."""

    @F.arrow_udf("binary")
    def raw(vectors: pa.Array) -> pa.Array:
        flat = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype="<f4")
        sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(at), pa.py_buffer(flat.tobytes())])
        return pc.if_else(vectors.is_valid(), made, None)

    return F.base64(raw(F.col(v)))


def from_base64(c: str = "encoded"):
    """The floats of to_base64(); trailing bytes that make no float are dropped."""

    @F.arrow_udf("array<float>")
    def floats(raw: pa.Array) -> pa.Array:
        sizes = np.nan_to_num(pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64) // 4
        flat = b"".join(x.as_buffer().to_pybytes()[: 4 * n] for x, n in zip(raw, sizes.tolist(), strict=True) if n)
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(np.array(raw.is_null()), False))
        return pa.ListArray.from_arrays(at, pa.array(np.frombuffer(flat, dtype="<f4")))

    return floats(F.unbase64(F.col(c)))
