"""Operator 5, token ids in ORC.

Documents are ordered by id in range partitions, encoded, and written as ORC: ids in integer run-length encoding, a row index
and a Bloom filter on doc_id in every stripe. Readers take stripes in parallel, and a lookup by doc_id skips the files,
stripes and row groups whose statistics or Bloom filters rule it out.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm._shared import documents, fresh_path, small, stored

#: The id that ends each document.
END = 0
#: Text that is encoded at once, about.
SLICE_BYTES = 4 << 20
#: Different units of text that a worker remembers from call to call, at most, and the bytes of the longest.
REMEMBERED, LONGEST_KEPT = 400_000, 48
#: Units that are encoded in one string.
JOINED = 1 << 15
STORE = "doc_id long, block int, pos long, ids array<int>"
ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20)}


def _of_worker(key) -> list:
    """A list that a Python worker keeps from task to task; what a task is sent is new each time."""
    return sys.modules.setdefault("_quillstone_worker", types.ModuleType("_quillstone_worker")).__dict__.setdefault(key, [])


def load(path: str):
    """The tokenizer of a file, read once a worker, as the library reads it: a special token's string in a text is that token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not (kept := _of_worker(path)):
        kept.append(Tokenizer.from_file(path))
        kept[0].no_truncation()
        kept[0].no_padding()
    return kept[0]


# Characters beyond ASCII, and control characters, that count as white space somewhere.
_ODD_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
_ODD_BYTE = np.zeros(256, dtype=bool)
_ODD_BYTE[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True  # what any of them begins with in UTF-8
_NO_IDS = np.zeros(0, dtype=np.int32)
_NO_PLACES = np.zeros(0, dtype=np.int64)
_NO_UNITS = pa.array([], pa.large_binary())
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True  # an apostrophe may belong to letters


def _offsets(units: pa.Array) -> np.ndarray:
    """Where each of some units begins in their bytes, and the end of all."""
    return np.frombuffer(units.buffers()[1], dtype=np.int64)[units.offset : units.offset + len(units) + 1] if len(units) else np.zeros(1, dtype=np.int64)


def _decoded(units: pa.Array) -> list[str]:
    return [u.decode() for u in units.to_pylist()]


def _within(place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """place[0], place[0] + 1, ... up to n[0] of them, then those from place[1], and so on."""
    total = np.cumsum(n)
    return np.repeat(place - total + n, n) + np.arange(total[-1] if len(total) else 0)


class Encoder:
    """Ids of whole texts, all the texts of a call together.

    A byte-level pre-tokenizer always parts a text at a single space that has no other blank beside it, and between a letter
    and a mark, and never joins across; so the text's units between such places can be encoded apart. Units are told apart by their bytes: equal ones of
    a call are encoded once, many of them in one string, in which each begins with the one token that has a space in front;
    a worker remembers a bounded number of them, those that most calls have. Units that don't fit this (a text's first, those with other blanks) are
    encoded one by one; texts that hold unusual blanks or the string of an added token, and all texts of a tokenizer of
    another kind, are encoded whole.
    """

    def __init__(self, tokenizer, end: int) -> None:
        self.tokenizer, self.end = tokenizer, end
        if not (kept := _of_worker(id(tokenizer))):
            made = json.loads(tokenizer.to_str())
            pre, model = made.get("pre_tokenizer") or {}, made["model"]
            added = [t["content"].encode() for t in made.get("added_tokens") or ()]
            plain_model = model["type"] == "BPE" and not model.get("dropout") and not made.get("normalizer")
            by_bytes = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            vocab = tokenizer.get_vocab()
            starts = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
            starts[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
            in_units = plain_model and by_bytes and all(t and not _BLANK[list(t)].any() for t in added)
            kept += [in_units, added, starts, (_NO_UNITS, _NO_PLACES, _NO_PLACES, _NO_PLACES, _NO_IDS)]
        self.in_units, self.added, self.starts, _ = self.kept = kept

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of each text's)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32), sizes

    def _joined(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that hold one space each, in front."""
        ids, sizes, at = [_NO_IDS], [_NO_PLACES], _offsets(units)
        for k in range(0, len(units), JOINED):
            part = at[k : k + JOINED + 1]
            x, _ = self._apart([str(memoryview(units.buffers()[2])[part[0] : part[-1]], "utf-8")])
            n = np.diff(np.append(np.flatnonzero(self.starts[x]), len(x)))
            if len(n) != len(part) - 1:
                x, n = self._apart(_decoded(units.slice(k, JOINED)))
            ids.append(x)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _ids_of(self, units: pa.Array, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in table, number, table) of the ids of different units; what the worker has met and kept isn't encoded again."""
        kept, kept_place, kept_n, uses, table = self.kept[3]
        short = np.diff(_offsets(units)) <= LONGEST_KEPT
        slot = pc.index_in(units, value_set=kept).fill_null(-1).to_numpy()
        met = slot >= 0
        place, n = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        place[met], n[met] = kept_place[slot[met]], kept_n[slot[met]]

        def encode(which: np.ndarray, how) -> np.ndarray:
            nonlocal table
            k = np.flatnonzero(which & ~met)
            ids, many = how(units.take(pa.array(k)))
            place[k], n[k] = len(table) + np.cumsum(many) - many, many
            table = np.concatenate([table, ids])
            return k

        def one_by_one(some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return self._apart(_decoded(some))

        new = np.concatenate([encode(short & ~apart, self._joined), encode(short & apart, one_by_one)])
        uses = np.concatenate([uses, np.zeros(len(new), dtype=np.int64)])
        uses[slot[met]] += 1
        self.kept[3] = pa.concat_arrays([kept, units.take(pa.array(new))]), np.append(kept_place, place[new]), np.append(kept_n, n[new]), uses, table
        encode(~short, one_by_one)
        if len(uses) > REMEMBERED:
            self._forget()
        return place, n, table

    def _forget(self) -> None:
        """Keeps half of what may be remembered: the units that most calls had, earlier ones counting less; among equals the latest."""
        kept, place, n, uses, table = self.kept[3]
        best = np.sort(np.argsort(uses, kind="stable")[len(uses) - REMEMBERED // 2 :])
        many = n[best]
        self.kept[3] = kept.take(pa.array(best)), np.cumsum(many) - many, many, uses[best] // 2, table[_within(place[best], many)]

    def _cuts(self, texts: list[str], flat: bytes, b: np.ndarray, first: np.ndarray, last: np.ndarray, space: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """Where units begin: each text, its single spaces, its marks behind letters."""
        cut = np.zeros(len(b) + 1, dtype=bool)
        cut[1 : len(b) - 1] = space[1:-1] & ~blank[:-2] & ~blank[2:]
        cut[1 : len(b)] |= _LETTER[b[:-1]] & _MARK[b[1:]]
        odd = [_ODD_BLANKS.search] if _ODD_BYTE[b].any() else []
        odd += [re.compile(re.escape(t.decode())).search for t in self.added if t in flat]
        for i in (i for i, t in enumerate(texts) if any(found(t) for found in odd)) if odd else ():
            cut[first[i] : last[i]] = False
        cut[first] = True
        return np.flatnonzero(cut[: len(b)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text's followed by end; where each text's begin, and the end of all)."""
        if not self.in_units:
            ids, n = self._apart(texts)
            return np.insert(ids, np.cumsum(n), self.end), np.concatenate([[0], np.cumsum(n + 1)])
        raw = [t.encode() for t in texts]
        flat = b"".join(raw)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        last = np.cumsum(size)
        first = last - size
        b = np.frombuffer(flat, dtype=np.uint8)
        if not len(b):
            return np.full(len(raw), self.end, dtype=np.int32), np.arange(len(raw) + 1)
        space, blank = b == 32, _BLANK[b]
        start = self._cuts(texts, flat, b, first, last, space, blank)
        stop = np.append(start[1:], len(b))
        # Equal bytes, equal unit: Arrow's dictionary compares them.
        offsets = pa.py_buffer(np.append(start, len(b)).astype(np.int64))
        units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, offsets, pa.py_buffer(flat)]).dictionary_encode()
        unit = units.indices.to_numpy().astype(np.int64)
        at = np.empty(len(units.dictionary), dtype=np.int64)
        at[unit[::-1]] = np.arange(len(unit))[::-1]
        spaces = np.zeros(len(b) + 1, dtype=np.int32)
        np.cumsum(space, dtype=np.int32, out=spaces[1:])
        apart = (spaces[stop[at]] - spaces[start[at]] != 1) | ~space[start[at]] | blank[stop[at] - 1]
        place, n, table = self._ids_of(units.dictionary, apart)
        # The end, as one more unit behind each text.
        place, n, table = np.append(place, len(table)), np.append(n, 1), np.append(table, np.int32(self.end))
        ends = np.searchsorted(start, last, "left")
        unit = np.insert(unit, ends, len(n) - 1)
        many = n[unit]
        total = np.concatenate([[0], np.cumsum(many)])
        ids = table[_within(place[unit], many)]
        return ids, np.concatenate([[0], total[ends + np.arange(1, len(raw) + 1)]])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text) in slices of about SLICE_BYTES of text, a row at least."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float))
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def write_tokens(docs: DataFrame, path_of_tokenizer: str, path: str, end: int = END) -> None:
    """docs (doc_id, text) as ORC of STORE under path: ids of the whole text and then end; a null text is an empty one.

    block numbers the files in ascending doc_id (nulls first), pos the rows of a block. Rows of equal doc_id follow each other,
    by a hash of their texts. An empty table writes no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, block, at = Encoder(load(path_of_tokenizer), end), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _slices(batch):
                ids, offsets = encoder([t or "" for t in part.column(1).to_pylist()])
                n = part.num_rows
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, block, dtype=np.int32)), pa.array(np.arange(at, at + n)), lists], names=["doc_id", "block", "pos", "ids"])
                at += n

    slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    writer = ordered.mapInArrow(encode, STORE).write
    for k, v in ORC.items():
        writer = writer.option(k, v)
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens() wrote; filters on doc_id are pushed to statistics and Bloom filters."""
    return spark.read.schema(STORE).orc(path)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, at = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4"), ids.offsets.to_numpy()
        raw = memoryview(flat).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), batch.column("pos"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "block", "pos", "n_tokens", "ids_crc32"])


def spans(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document of read_tokens()."""
    each = stored(tokens.mapInArrow(_summed, "doc_id long, block int, pos long, n_tokens long, ids_crc32 long"), "token-spans")
    blocks = each.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    blocks = small(blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base")), "token-blocks")
    within = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("pos")) - F.col("n_tokens")
    return each.withColumn("within", within).join(blocks, "block").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number and checksum of ids, from the ORC files."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return spans(read_tokens(spark, path))
