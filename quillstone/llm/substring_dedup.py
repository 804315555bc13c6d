"""Operator 10, substring dedup by difference-cover anchors.

A passage that occurs twice with WINDOW words or more shares an aligned anchor: a run of ANCHOR words that starts, in both
places, at a word number which is in the cover modulo PERIOD. The cover holds every difference modulo PERIOD, so among the
first PERIOD words of any two equal windows there is one offset that is a cover position in both. Only anchors are hashed and
counted over the corpus; only windows around anchors that occur again are then compared, by 128 bits, which extends the shared
anchors to whole passages.

Texts are dealt once into blocks and stay there. A block sends a bucket of hashes a sorted array in one row, each hash once,
and gets back those that occur elsewhere. So a passage that every third document holds is one entry a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._shared import documents, small, stored, window_hashes, word_hashes, word_pairs

WINDOW = 35
PERIOD = 21
#: Fixed value: a perfect difference set modulo 21, each difference from 1 to 20 occurs once.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text in a block, and of hashes in a bucket, about; blocks that a task takes one after the other.
BLOCK_BYTES, BUCKET_BYTES, BLOCKS_A_TASK = 4 << 20, 8 << 20, 16
#: Rows equal in id and text, above which one of them stands for all.
COPIES = 64
DEALT = "bucket int, block long, hashes binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_AT_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors."""
    hashes = window_hashes(words, ANCHOR)
    at = np.flatnonzero(_AT_COVER[np.arange(len(hashes)) % PERIOD])
    return at, hashes[at]


def _pairs(words: np.ndarray) -> np.ndarray:
    """128-bit hashes of the windows of words (n, 2), as (n, 2), from independent halves of the words' own 128 bits."""
    first, second = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
    return np.stack([window_hashes(first, WINDOW), window_hashes(second, WINDOW, second=True)], axis=1)


def _spread(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of n places lie from before places ahead of one in at to after places behind it."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, np.maximum(at - before, 0), 1)
    np.add.at(marks, np.minimum(at + after + 1, n), -1)
    return np.cumsum(marks[:-1]) > 0


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of pairs, sorted and each once, and how often each occurs."""
    if not len(pairs):
        return pairs, np.zeros(0, dtype=np.int64)
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1)))
    return pairs[first], np.diff(np.append(first, len(pairs)))


def _among(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows of pairs are rows of known (sorted, each once)."""
    if not len(known) or not len(pairs):
        return np.zeros(len(pairs), dtype=bool)
    low = np.searchsorted(known[:, 0], pairs[:, 0], "left")
    high = np.searchsorted(known[:, 0], pairs[:, 0], "right")
    out = np.zeros(len(pairs), dtype=bool)
    one = high - low == 1
    out[one] = known[low[one], 1] == pairs[one, 1]
    for k in np.flatnonzero(high - low > 1):  # equal in the first half by chance
        out[k] = (known[low[k] : high[k], 1] == pairs[k, 1]).any()
    return out


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in known, which is sorted."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _deal(found: np.ndarray, block: int, n_buckets: int) -> pa.RecordBatch:
    """found (n, width) of a block by bucket: each row once, and behind them one byte a row, 1 if it occurs more than once here."""
    found, times = _distinct(found)
    bucket = (found[:, 0] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    rows = [(b, found[order[x:y]].astype("<u8").tobytes() + (times[order[x:y]] > 1).astype(np.uint8).tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "block", "hashes"])


def _read(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // (8 * width + 1)
    return np.frombuffer(raw, dtype="<u8", count=n * width).reshape(n, width), np.frombuffer(raw, dtype=np.uint8, offset=n * width * 8).astype(bool)


def _again(width: int) -> Callable[[pa.Table], pa.Table]:
    """For a bucket: which of a block's hashes occur more than once in all, back to that block. Hashes that occur once are left out."""

    def run(table: pa.Table) -> pa.Table:
        sent = [_read(raw.as_py(), width) for raw in table.column("hashes")]
        every, times = _distinct(np.concatenate([h for h, _ in sent]))
        here = [h[twice] for h, twice in sent]
        again = _distinct(np.concatenate([every[times > 1], *here]))[0]
        back = []
        for block, (h, _) in zip(table.column("block").to_pylist(), sent, strict=True):
            hit = _among(h, again) if width == 2 else _member(h[:, 0], again[:, 0])
            if hit.any():
                back.append((block, h[hit].astype("<u8").tobytes()))
        return pa.table({"block": pa.array([b for b, _ in back], pa.int64()), "again": pa.array([x for _, x in back], pa.binary())})

    return run


def _known(table: pa.Table, width: int) -> np.ndarray:
    got = [np.frombuffer(x.as_py(), dtype="<u8").reshape(-1, width) for x in table.column("again")]
    return _distinct(np.concatenate([*got, np.zeros((0, width), dtype="<u8")]))[0]


def _candidates(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of windows that hold an anchor which occurs again."""
    at, hashes = anchors(np.ascontiguousarray(words[:, 0]))
    at = at[_member(hashes, known[:, 0])]
    n = len(words) - WINDOW + 1
    return np.flatnonzero(_spread(at, WINDOW - ANCHOR, 0, n)) if len(at) and n > 0 else np.zeros(0, dtype=np.int64)


def _singled(slim: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(slim (doc_id, text) with copies, those of its rows that copies isn't 1 for): of rows that are there more than COPIES times one is left, with their number."""
    rows = slim.select("doc_id", "text", F.xxhash64("doc_id", F.isnull("doc_id"), F.isnull("text"), "text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    heavy = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > COPIES)
    heavy = small(heavy, "passages-copies")
    if heavy.isEmpty():
        return slim.withColumn("copies", F.lit(1).cast("long")), None
    rest = rows.join(heavy, ["h1", "h2"], "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    one = rows.join(heavy, ["h1", "h2"]).groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "copies")])
    one = stored(one.select("doc_id", "text", "copies"), "passages-copied")
    return rest.unionAll(one), one


def _in_blocks(slim: DataFrame, block_bytes: int) -> tuple[DataFrame, int, int]:
    """Rows with their block, dealt to tasks by it; the number of tasks, and that of buckets: both grow with the bytes of text."""
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    parts = max(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (block_bytes * BLOCKS_A_TASK)))
    n = max(parts, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    return slim.withColumn("block", block).repartition(parts, "block"), parts, max(parts, total // 2 // BUCKET_BYTES)


def removed(docs: DataFrame, emit: Callable[[int, bytes | None, np.ndarray], tuple], schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row of schema for each row of docs (doc_id, text): what emit(doc_id, text, removed) gives; removed tells which words go.

    A word goes if a window of WINDOW words covers it whose words occur, in that order, at another place, in the same or
    another document. Words are runs of characters but the blanks \\x20 and \\x09 to \\x0D, compared as they are. A null text,
    an empty one and one of fewer than WINDOW words lose nothing. Repeated rows are documents like others, and so lose every
    word from WINDOW on; however many they are, no task holds them together. An empty table gives no rows; other columns are
    ignored.
    """
    slim, copied = _singled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    texts, parts, n_buckets = _in_blocks(slim, block_bytes)

    def raw(table: pa.Table) -> Iterator[tuple[int, bytes | None, int]]:
        for i, text, n in zip(table.column("doc_id").to_pylist(), table.column("text"), table.column("copies").to_pylist(), strict=True):
            yield i, text.as_buffer().to_pybytes() if text.is_valid else None, n

    def first(key: tuple, table: pa.Table) -> pa.Table:
        found = [a for _, text, n in raw(table) for a in [anchors(word_hashes(text))[1]] * min(n, 2)]
        return pa.Table.from_batches([_deal(np.concatenate(found)[:, None], key[0].as_py(), n_buckets)])

    def second(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        known, found = _known(back, 1), [np.zeros((0, 2), dtype=np.uint64)]
        for _, text, n in raw(table) if len(known) else ():
            words = word_pairs(text)
            if len(words) >= WINDOW:
                found += [_pairs(words)[_candidates(words, known)]] * min(n, 2)
        block = key[0].as_py() if key[0].is_valid else -1
        return pa.Table.from_batches([_deal(np.concatenate(found), block, n_buckets)])

    def last(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        known, rows = _known(back, 2), []
        for i, text, n in raw(table):
            if n > 1:
                continue
            words = word_pairs(text)
            gone = np.zeros(len(words), dtype=bool)
            if len(known) and len(words) >= WINDOW:
                gone = _spread(np.flatnonzero(_among(_pairs(words), known)), 0, WINDOW - 1, len(words))
            rows.append(emit(i, text, gone))
        return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    def of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, n in raw(pa.Table.from_batches([batch])):
                many = len((text or b"").split())
                row = dict(zip(names, emit(i, text, np.full(many, many >= WINDOW)), strict=True))
                yield pa.RecordBatch.from_pylist([row | {"__copies": n}], schema=arrow.append(pa.field("__copies", pa.int64())))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names
    by_block = texts.groupBy("block")
    dealt = lambda df, by: df.repartition(parts, by).groupBy(by)
    repeated = dealt(by_block.applyInArrow(first, DEALT), "bucket").applyInArrow(_again(1), "block long, again binary")
    windows = by_block.cogroup(dealt(repeated, "block")).applyInArrow(second, DEALT)
    found = dealt(windows, "bucket").applyInArrow(_again(2), "block long, again binary")
    out = by_block.cogroup(dealt(found, "block")).applyInArrow(last, schema)
    if copied is None:
        return out
    # What each copy loses is known from the row itself; copies are made COPIES at a time, in several tasks.
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__copies - 1) div {COPIES}")))
    each = copied.mapInArrow(of_copies, f"{schema}, __copies long").withColumn("__part", some).repartition(parts, names[0], "__part")
    copy = F.explode(F.sequence(F.col("__part") * COPIES + 1, F.least("__copies", (F.col("__part") + 1) * COPIES)))
    return out.unionAll(each.withColumn("__copy", copy).select(*names))


def _digest(doc_id: int, text: bytes | None, gone: np.ndarray) -> tuple:
    words = (text or b"").split()
    kept = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x) if gone.any() else b" ".join(words)
    return doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def _kept(doc_id: int, text: bytes | None, gone: np.ndarray) -> tuple:
    if text is None or not gone.any():
        return doc_id, text.decode() if text is not None else None, 0
    return doc_id, b" ".join(w for w, x in zip(text.split(), gone.tolist(), strict=True) if not x).decode(), int(gone.sum())


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text without its repeated passages (words joined by a space, unless nothing went), n_removed."""
    return removed(docs, _kept, "doc_id long, text string, n_removed long")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each document has and loses, and a digest of those it keeps."""
    return removed(documents(spark, sf_dir), _digest, RESULT)
