"""What several operators of this subpackage need: shared tables, text hashing, column hygiene."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Characters that part words: the space and \t \n \v \f \r, which bytes.split() parts at as well.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a temporary one, if driver and executors are one process; on a cluster that is an error, as each
    executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillstone-"))
    return f"file://{_LOCAL[0]}"


#: The temporary folder of sessions that have no shared one and no executors.
_LOCAL: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: what reads it survives a lost executor and doesn't compute it anew."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, most: int = 200_000) -> DataFrame:
    """df stored, to be joined: broadcast if it is found to have most rows at most, else left to a shuffled join."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= most else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with what an operator adds; Spark resolves names without regard to case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def fingerprint(kind: DataType, value: Column, seed: Column) -> Column:
    """A 64-bit hash of a value of any type but a map, in which a null is a value: Spark's own hash passes nulls over, also within arrays and structs."""
    marks = [F.isnull(value)]
    if isinstance(kind, ArrayType):
        marks += [F.size(value), F.transform(value, lambda x: fingerprint(kind.elementType, x, seed))]
    elif isinstance(kind, StructType):
        marks += [fingerprint(f.dataType, value.getField(f.name), seed) for f in kind.fields]
    else:
        marks += [value]
    return F.xxhash64(seed, *marks)


def crc32_text(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def unit(*cols: Column) -> Column:
    """A number in (0, 1) drawn by hashing cols."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


# Hashing of words, with numpy, of whole texts at once.

def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class _Rolling:
    """Polynomial hashes modulo 2**64 of ranges of a sequence; what it gives is mixed before it is used as a value of the next level."""

    def __init__(self, base: int) -> None:
        self.base, self.back = base, _inverse(base)
        self.up, self.down = _powers(base, 1 << 12), _powers(self.back, 1 << 12)

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values) + 1:
            n = 1 << (len(values) + 1).bit_length()
            self.up, self.down = _powers(self.base, n), _powers(self.back, n)
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_WORDS = _Rolling(0xD6E8FEB86659FD93)
_OF_WORDS_2 = _Rolling(0xA0761D6478BD642F)


def word_pairs(text: str | bytes | None) -> np.ndarray:
    """128 bits of each word of text, in order, as (n, 2): the halves of a digest of its bytes, independent of each other."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw.split())), dtype="<u8").reshape(-1, 2)


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of text, in order."""
    return np.ascontiguousarray(word_pairs(text)[:, 0])


def window_hashes(words: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """A hash of each run of size words; second takes another base, for the other halves of word_pairs()."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    start = np.arange(n)
    return (_OF_WORDS_2 if second else _OF_WORDS).ranges(words, start, start + size)
