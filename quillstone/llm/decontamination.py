"""Operator 3, benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as lower-case words without punctuation; a character of a script that doesn't part
words is a word. A run of ``least`` words that both hold is a seed. Where seeds could cover enough of an item, Running
Karp-Rabin greedy string tiling marks the longest matches that don't overlap, again and again, down to ``least`` words; the
share of the item's words under tiles decides. Tiles may come in any order, so an item whose passages were reordered is found
as well.

The benchmark is a stated query set: it is taken in blocks of bounded size, one at a time, which is broadcast to tasks; each
document is read once for a block, and what a block finds is stored before the next is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._shared import documents, small, stored, window_hashes, word_hashes

LEAST, COVERAGE = 4, 0.6
#: UTF-8 bytes of the items in a block, about; a block has one item at least.
BLOCK_BYTES = 8 << 20
FOUND = "doc_id long, item_id long, item_words int, covered int, coverage double, tiles int, longest int"
_SLOTS = 1 << 20
_BLANKED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: Beyond ASCII: characters that part words, and such of scripts without blanks (Thai to Burmese, Khmer, kana, Han), each a word.
_MARKS = "\x80-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u02c2-\u02df\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3004\u3008-\u3020\u3030\ufe10-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u302f\u3031-\u312f\u31a0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_ODD, _PARTING, _ALONE = re.compile(f"[{_MARKS}{_SOLID}]"), re.compile(f"[{_MARKS}]"), re.compile(f"([{_SOLID}])")


def plain_words(text: str | None) -> np.ndarray:
    text = (text or "").lower()
    if not text.isascii() and _ODD.search(text):
        text = _ALONE.sub(r" \1 ", _PARTING.sub(" ", text))
    return word_hashes(text.encode("utf-8", "surrogatepass").translate(_BLANKED))


def _windows(words: np.ndarray, used: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words, 0 for those with a used word."""
    out = window_hashes(words, size)
    before = np.concatenate([[0], np.cumsum(used)])
    out[before[size:] != before[:-size]] = 0
    return out


def _common(text: np.ndarray, used_t: np.ndarray, pattern: np.ndarray, used_p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in text whose run of size words the pattern has as well, hashes of text's runs, hashes of the pattern's)."""
    p = _windows(pattern, used_p, size)
    t = _windows(text, used_t, size)
    return np.flatnonzero((t != 0) & np.isin(t, p[p != 0])), t, p


def greedy_tiles(text: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in pattern, place in text, words), longest first, by Running Karp-Rabin matching.

    The longest match of free words is found by hashes of runs, its length by bisection; all that have it are marked, by
    place in the text and then in the pattern; and so on down to least words. Time is in proportion to the words, their
    logarithm and the number of different lengths, also where one word is repeated.
    """
    used_t, used_p, tiles = np.zeros(len(text), dtype=bool), np.zeros(len(pattern), dtype=bool), []
    most = min(len(text), len(pattern))
    while most >= least and len(_common(text, used_t, pattern, used_p, least)[0]):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(_common(text, used_t, pattern, used_p, middle)[0]) else (low, middle - 1)
        most = low
        places, t, p = _common(text, used_t, pattern, used_p, most)
        spots: dict[int, list[int]] = {}
        for i in np.flatnonzero(np.isin(p, t[places]))[::-1].tolist():
            spots.setdefault(int(p[i]), []).append(i)
        reach = 0
        for j in places.tolist():
            at = spots[int(t[j])]
            while j >= reach and at and used_p[at[-1] : at[-1] + most].any():
                at.pop()
            if j < reach or not at:
                continue
            i = at.pop()
            if (text[j : j + most] == pattern[i : i + most]).all():
                used_t[j : j + most] = used_p[i : i + most] = True
                tiles.append((i, j, most))
                reach = j + most
        most -= 1
    return tiles


class Items:
    """A block of benchmark items, to find in texts."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int = LEAST, coverage: float = COVERAGE) -> None:
        self.least, self.coverage = least, coverage
        self.items = [(i, w) for i, t in rows if len(w := plain_words(t)) >= least]
        seeds = [window_hashes(w, least) for _, w in self.items]
        flat = np.concatenate([*seeds, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.owner = np.repeat(np.arange(len(seeds), dtype=np.int32), [len(s) for s in seeds])[order]
        self.at = np.concatenate([*[np.arange(len(s), dtype=np.int32) for s in seeds], np.zeros(0, dtype=np.int32)])[order]
        self.slots = np.zeros(_SLOTS, dtype=bool)
        self.slots[self.seeds & np.uint64(_SLOTS - 1)] = True

    def find(self, text: str | None) -> list[tuple[int, int, int, float, int, int]]:
        """(item, its words, words covered, coverage, tiles, longest tile) of each item that is covered enough."""
        words = plain_words(text)
        grams = window_hashes(words, self.least)
        near = np.flatnonzero(self.slots[grams & np.uint64(_SLOTS - 1)])
        if not len(near) or not len(self.seeds):
            return []
        # Each different seed once, however often text or items repeat it.
        met, which = np.unique(grams[near], return_inverse=True)
        low, high = np.searchsorted(self.seeds, met, "left"), np.searchsorted(self.seeds, met, "right")
        count = high - low
        if not count.any():
            return []
        each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        seed, owner, at = np.repeat(np.arange(len(met)), count), self.owner[each], self.at[each]
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        found = []
        for mine in np.split(order, cuts):
            item, pattern = self.items[owner[mine[0]]]
            covered = np.zeros(len(pattern) + 1, dtype=np.int64)
            np.add.at(covered, at[mine], 1)
            np.add.at(covered, at[mine] + self.least, -1)
            if (np.cumsum(covered)[:-1] > 0).sum() < self.coverage * len(pattern):
                continue  # tiles lie where seeds are
            has = np.zeros(len(met), dtype=bool)
            has[seed[mine]] = True
            spots = near[has[which]]
            runs = [words[a[0] : a[-1] + self.least] for a in np.split(spots, np.flatnonzero(np.diff(spots) > self.least) + 1)]
            gap = [np.asarray([g], dtype=np.uint64) for g in range(len(runs))]  # no word has so small a hash but by chance
            tiles = greedy_tiles(np.concatenate([x for r, g in zip(runs, gap, strict=True) for x in (r, g)]), pattern, self.least)
            n = sum(x[2] for x in tiles)
            if n >= self.coverage * len(pattern):
                found.append((item, len(pattern), n, n / len(pattern), len(tiles), tiles[0][2]))
        return found


def _blocks(benchmark: DataFrame, least: int, coverage: float) -> Iterator[tuple[int, Broadcast]]:
    """(number of blocks, items of one), one after the other: the driver holds one block."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().collect()
        block = Items(sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), least, coverage)
        yield n, benchmark.sparkSession.sparkContext.broadcast(block)


def _each_block(benchmark: DataFrame, least: int, coverage: float, scan: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """What scan gives for the blocks, together. Of several, each is stored and its items are let go before the next."""
    out = None
    for n, items in _blocks(benchmark, least, coverage):
        if n == 1:
            return scan(items)
        part = stored(scan(items), "benchmark-found")
        items.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """Rows of FOUND: each document and benchmark item with tiles over coverage of the item's words or more.

    A null or short text holds nothing; items of fewer than least words are too short to tell and match nothing. Repeated
    documents are reported each; items that are equal in id and text once. Empty tables give no rows. Other columns are ignored.
    """
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
    names = [f.split()[0] for f in FOUND.split(", ")]
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def scan(items: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in items.value.find(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        return slim.mapInArrow(run, FOUND)

    return _each_block(benchmark, least, coverage, scan)


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns, in which contaminated() finds no item. No row moves between tasks.

    Where the benchmark is one block the rows are filtered as they are read; else the texts in which some block finds an item
    are gathered by 128 bits, and the rows that have them are left out by a join.
    """
    at = docs.columns.index("text")
    hashes = (F.xxhash64(F.lit(5), "text").alias("__t1"), F.xxhash64(F.lit(6), "text").alias("__t2"))

    def scan(items: Broadcast, clean: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([(not items.value.find(text.as_py())) == clean for text in batch.column(at)], pa.bool_()))

        return run

    blocks = _blocks(benchmark, least, coverage)
    n, items = next(blocks)
    if n == 1:
        return docs.mapInArrow(scan(items, True), docs.schema)
    found = None
    for _, block in chain([(n, items)], blocks):
        part = stored(docs.mapInArrow(scan(block, False), docs.schema).select(*hashes).distinct(), "benchmark-texts")
        block.destroy()
        found = part if found is None else found.unionAll(part)
    found = small(found.distinct(), "benchmark-texts", 2_000_000)
    return docs.withColumns({"__t1": hashes[0], "__t2": hashes[1]}).join(found, ["__t1", "__t2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how much of it they hold."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
