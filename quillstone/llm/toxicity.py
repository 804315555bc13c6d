"""Operator 7, toxicity by class-conditional Kneser-Ney models.

Two models of the letters of a word given the up to five before them, one of toxic and one of ordinary documents. Each
interpolates its class's counts of six letters with continuation counts that both classes share, so an expression that is rare
in either falls back to the same probabilities and only evidence of its own tells the classes apart. A word's log-likelihood
ratio is the sum over its letters. A document's ratios, normalised for its length (the mean over its words, the
highest words, the density of telling words), are weighed by a logistic regression.

Counts are taken from all labelled documents that may be learnt from, but for a share kept to fit the regression, and stay
distributed. The table of ratios grows with the corpus and keeps every counted code; beyond ``HELD`` entries tasks read it in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm._shared import documents, stored

ORDER, BITS = 6, 10
DISCOUNT = 0.75
#: Set in the keys of contexts, which share a table with six-letter codes.
CONTEXT = np.uint64(1 << (ORDER * BITS))
#: Codes and contexts that a task has in memory; more are looked up in parts, for about LOOKED_UP codes of documents at a time.
HELD, LOOKED_UP = 1 << 22, 1 << 22
#: Documents that the regression is fitted on, at most: those of least hash.
FITTED = 20_000
#: A labels table of more rows is joined by a shuffle.
LABELS_BROADCAST = 2_000_000
THRESHOLD = 0.3
#: Weights of the features and 1 where the labels don't hold both classes: nothing is known, every score is 0.018.
UNFITTED = np.array([0.0, 0.0, 0.0, 0.0, 0.0, -4.0])
#: The same where the models know both classes, but the documents left for the regression are of one: the mean ratio decides.
BY_RATIO = np.array([2.0, 0.0, 0.0, 1.0, 0.0, -1.5])
_LETTER = np.array([chr(c).isalpha() or c >= 512 for c in range(1024)])


def crc32_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 modulo 4. A null id isn't held out, and has no label."""
    return F.coalesce(F.pmod(crc32_id(doc_id), F.lit(4)) == 2, F.lit(False))


def letter_codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each letter and each blank after a word: a code of it and the five letters before it in its word, and whether it is a blank.

    Letters are code points of the lower-case text, those from 1024 on folded into 512 classes; below, what isn't a letter is
    a blank. Before a word's start stand blanks (0).
    """
    raw = f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass")
    letters = np.frombuffer(raw, dtype="<u4")
    letters = np.where(letters < 1024, letters, 512 + letters % 512).astype(np.uint64)
    blank = ~_LETTER[letters]
    letters[blank] = 0
    n, at = len(letters), np.arange(len(letters), dtype=np.int32)
    last = np.maximum.accumulate(np.where(blank, at, -1)).astype(np.int32)
    depth = np.empty(n, dtype=np.int32)  # letters of the same word before this one
    depth[0] = 0
    depth[1:] = at[1:] - 1 - last[:-1]
    code = letters.copy()
    for j in range(1, ORDER):
        code[j:] |= np.where(depth[j:] >= j, letters[:-j], 0) << np.uint64(BITS * j)
    return code[1:], blank[1:]


def _mixed(code: np.ndarray) -> np.ndarray:
    """One to one, so tables are sorted and looked up by it."""
    h = code * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Ratios:
    """Log-likelihood ratios by code: of seen six-letter codes, else of their contexts' backoff weights (keys from CONTEXT on), else 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, bits = keys, values, max(len(keys).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    @staticmethod
    def table(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = _mixed(codes.astype(np.uint64))
        order = np.argsort(keys)
        return keys[order], values[order].astype(np.float32)

    def find(self, code: np.ndarray) -> np.ndarray:
        """The values of codes, NaN of those that aren't in the table."""
        key, out = _mixed(code), np.full(len(code), np.nan, dtype=np.float32)
        bucket = (key >> self.shift).astype(np.int64)
        at, end, rest = self.start[bucket], self.start[bucket + 1], np.arange(len(code))
        while len(rest):
            more = at < end
            at, end, key, rest = at[more], end[more], key[more], rest[more]
            same = self.keys[at] == key
            out[rest[same]] = self.values[at[same]]
            at, end, key, rest = at[~same] + 1, end[~same], key[~same], rest[~same]
        return out

    def of(self, code: np.ndarray) -> np.ndarray:
        out = self.find(code)
        rest = np.flatnonzero(np.isnan(out))
        out[rest] = np.nan_to_num(self.find((code[rest] >> np.uint64(BITS)) | CONTEXT))
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Mean, highest, mean of the three highest, density of telling words, log of the number of words; zeros without words."""
        code, blank = letter_codes(text)
        ends = np.flatnonzero(blank) + 1
        starts = np.concatenate([[0], ends[:-1]])
        total = np.concatenate([[0.0], np.cumsum(self.of(code), dtype=np.float64)])
        words = (total[ends] - total[starts])[ends - starts > 1]
        if not len(words):
            return np.zeros(5)
        top = np.sort(words[np.argpartition(words, -3)[-3:]] if len(words) > 3 else words)[::-1]
        return np.array([words.mean(), top[0], top.mean(), (words > 3).sum() / len(words) ** 0.5, np.log1p(len(words))])


def _opened(part: Broadcast) -> Ratios:
    """A part read from the executor's disk; the broadcast itself doesn't hold on to it."""
    arrays = part.value
    part.__dict__.pop("_value", None)
    return Ratios(*arrays)


class Parts:
    """Ratios of all counted codes, in broadcast parts of about HELD: the only one is kept open, of several one at a time is in memory."""

    def __init__(self, parts: list[Broadcast]) -> None:
        self.parts, self.whole = parts, None

    def __getstate__(self) -> dict:
        return {"parts": self.parts, "whole": None}

    def _needed(self, code: np.ndarray) -> Ratios:
        """Of several parts, what these codes find in any of them."""
        code = np.unique(code)
        code = np.concatenate([code, np.unique(code >> np.uint64(BITS)) | CONTEXT])
        found = np.full(len(code), np.nan, dtype=np.float32)
        for part in self.parts:
            got = _opened(part).find(code)
            found = np.where(np.isnan(got), found, got)
        there = ~np.isnan(found)
        return Ratios(*Ratios.table(code[there], found[there]))

    def features(self, texts: pa.Array | list) -> Iterator[np.ndarray]:
        """The features of each text, in order."""
        texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        if len(self.parts) == 1:
            self.whole = self.whole or _opened(self.parts[0])
            yield from map(self.whole.features, texts)
            return
        held, codes, n = [], [], 0
        for k, text in enumerate(texts):
            held.append(text)
            codes.append(np.unique(letter_codes(text)[0]))
            n += len(codes[-1])
            if n >= LOOKED_UP or k == len(texts) - 1:
                yield from map(self._needed(np.concatenate(codes)).features, held)
                held, codes, n = [], [], 0


class Model:
    def __init__(self, ratios: Parts, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> None:
        self.ratios, self.mean, self.scale, self.weights = ratios, mean, scale, weights

    def scores(self, texts: pa.Array | list) -> list[float]:
        rows = (np.append((x - self.mean) / self.scale, 1.0) for x in self.ratios.features(texts))
        return [float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))) for x in rows]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a task's documents with their counts by class."""
    held: dict[bool, list] = {True: [], False: []}
    sums: dict[bool, tuple] = {}
    empty = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

    def fold(toxic: bool) -> None:
        codes, counts = sums.get(toxic, empty)
        fresh = np.concatenate([codes, *held[toxic]])
        weights = np.concatenate([counts, np.ones(len(fresh) - len(codes), dtype=np.int64)])
        found, back = np.unique(fresh, return_inverse=True)
        sums[toxic], held[toxic] = (found, np.bincount(back, weights, len(found)).astype(np.int64)), []

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            held[bool(toxic)].append(letter_codes(text.as_py())[0])
            if sum(map(len, held[bool(toxic)][-1:])) > 1 << 20 or len(held[bool(toxic)]) >= 512:
                fold(bool(toxic))
    for toxic in (True, False):
        fold(toxic)
        codes, counts = sums[toxic]
        for k in range(0, len(codes), 1 << 16):
            part, n = codes[k : k + (1 << 16)].astype(np.int64), pa.array(counts[k : k + (1 << 16)])
            none = pa.array(np.zeros(len(part), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(part), *((n, none) if toxic else (none, n))], names=["code", "toxic", "ordinary"])


def ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From grams (code, toxic, ordinary): (code, ratio) and (context, ratio of backoff weights), natural logarithms of toxic to ordinary."""
    suffix = lambda k: F.col("code").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
    of_context = Window.partitionBy(F.shiftright("code", BITS))
    kinds, levels = grams.select("code"), {}
    for k in range(ORDER - 1, 0, -1):
        kinds = stored(kinds.groupBy(suffix(k).alias("code")).agg(F.count(F.lit(1)).cast("double").alias("n")), "toxicity-kinds")
        levels[k], kinds = kinds, kinds.select("code")
    lower = None
    for k in range(1, ORDER):
        level = levels[k].withColumn("all", F.sum("n").over(of_context)).withColumn("types", F.count(F.lit(1)).over(of_context))
        if lower is None:
            level = level.withColumn("low", F.lit(1.0 / (1 << BITS)))
        else:
            level = level.withColumn("s", suffix(k - 1)).join(lower.select(F.col("code").alias("s"), F.col("p").alias("low")), "s")
        lower = level.select("code", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("low")) / F.col("all")).alias("p"))
    full = grams.withColumn("s", suffix(ORDER - 1)).join(lower.select(F.col("code").alias("s"), "p"), "s")
    for c in ("toxic", "ordinary"):
        full = full.withColumn(f"{c}_all", F.sum(c).over(of_context)).withColumn(f"{c}_types", F.count_if(F.col(c) > 0).over(of_context))
        seen = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}_types") * F.col("p")) / F.col(f"{c}_all")
        full = full.withColumn(f"{c}_p", F.when(F.col(f"{c}_all") > 0, seen).otherwise(F.col("p")))
        full = full.withColumn(f"{c}_w", F.when(F.col(f"{c}_all") > 0, DISCOUNT * F.col(f"{c}_types") / F.col(f"{c}_all")).otherwise(1.0))
    full = stored(full.select("code", F.shiftright("code", BITS).alias("context"), F.log(F.col("toxic_p") / F.col("ordinary_p")).alias("ratio"), F.log(F.col("toxic_w") / F.col("ordinary_w")).alias("backoff")), "toxicity-ratios")
    return full.select("code", "ratio"), full.select(F.col("context").alias("code"), F.col("backoff").alias("ratio")).distinct()


def parts(seen: DataFrame, contexts: DataFrame) -> Parts:
    """All codes of what ratios() gives, broadcast in as many parts of about HELD as they take. The driver holds one at a time."""
    both = seen.unionAll(contexts.select(F.col("code").bitwiseOR(F.lit(int(CONTEXT))), "ratio"))
    n, out = max(1, -(-both.count() // HELD)), []
    for k in range(n):
        got = both.where(F.pmod(F.xxhash64("code"), F.lit(n)) == k).select("code", F.col("ratio").cast("float").alias("ratio")).toArrow()
        out.append(seen.sparkSession.sparkContext.broadcast(Ratios.table(got.column("code").to_numpy(), got.column("ratio").to_numpy())))
    return Parts(out)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), held-out rows left alone.

    Of the rest, 9 of 16 parts by crc32 of the id are counted, and up to FITTED documents of the other 3 fit the regression.
    A document with several labels is toxic if one says so; null labels are left out. Without both classes among those that
    fit the regression, the mean ratio is weighed by BY_RATIO; without both among the counted ones, every score is the same
    low one.
    """
    labels = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = F.pmod(crc32_id(F.col("doc_id")), F.lit(16))
    counted = labels.where(part < 12)
    fitted = labels.where(part >= 12).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FITTED)
    if labels.count() <= LABELS_BROADCAST:
        counted = F.broadcast(counted)
    texts = docs.select("doc_id", F.col("text").cast("string"))
    grams = texts.join(counted, "doc_id").select("text", "toxic").mapInArrow(_counted, "code long, toxic long, ordinary long")
    grams = stored(grams.groupBy("code").agg(F.sum("toxic").cast("double").alias("toxic"), F.sum("ordinary").cast("double").alias("ordinary")), "toxicity-grams")
    table = parts(*ratios(grams))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(table.features(batch.column(0))), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    got = texts.join(F.broadcast(fitted), "doc_id").select("text", F.col("toxic").cast("int")).mapInArrow(measured, "x array<double>, y int").toArrow()
    x, y = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, 5), got.column("y").to_numpy().astype(float)
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(5), np.ones(5))
    if len(np.unique(y)) < 2:
        both = grams.agg(F.max("toxic") * F.max("ordinary")).first()[0] or 0.0
        return Model(table, np.zeros(5), np.ones(5), BY_RATIO if both > 0 else UNFITTED)
    return Model(table, mean, scale, logistic(np.c_[(x - mean) / scale, np.ones(len(x))], y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row of docs; a null text is an empty one, and its score that of no evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def ordinary(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below threshold. No row moves between tasks."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in model.scores(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and verdict for every document."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, fit(docs, labels.select("doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
