"""Hybrid search of many queries at once.

Embedding score, then a keyword score for the head by embedding, threshold, re-ranking, diversification, top k. A row beyond the
head can't come before one of the head (a keyword score only raises), so the first stage keeps the head of each query and
everything after it works on a few dozen rows a query. Queries are a stated set: they are taken in blocks that tasks hold, and each
task puts out its best rows alone, so no pair of query and chunk is ever a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.config import EngineConfig, SearchConfig
from quillstone.functions.text import bm25, bm25_total, normalized_hash, rerank_score, tokens
from quillstone.functions.vectors import rounded

#: Query vectors in a block, about, and blocks that a task holds at once.
BLOCK, HELD = 4096, 8
#: Ids of found chunks, at most, that are broadcast to fetch the chunks' texts; more are joined by a shuffle.
FOUND_BROADCAST = 200_000
DIGITS = 9


def _units(rows: list) -> np.ndarray:
    """Rows over their lengths; what has no length is zero."""
    m = np.asarray(rows, dtype=np.float64)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the given width, and their rows; others, and such that hold nulls, are left out."""
    flat, at = column.values, column.offsets.to_numpy()
    sizes = np.diff(at)
    good = np.flatnonzero((sizes == width) & np.asarray(column.is_valid()))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.stack([values[at[i] : at[i + 1]] for i in good]) if len(good) else np.zeros((0, width))
    whole = ~np.isnan(m).any(axis=1)
    return m[whole], good[whole]


class _Block:
    """Query vectors of one width that tasks hold: those of a query lie side by side, from starts on."""

    def __init__(self, rows: list[tuple], width: int) -> None:
        self.ids = [i for i, _ in rows]
        self.width = width
        self.starts = np.cumsum([0, *[len(v) for _, v in rows[:-1]]])
        self.vectors = _units([x for _, v in rows for x in v])


def _blocks(queries: DataFrame, most: int) -> Iterator[_Block]:
    """queries (query_id, vector) in blocks of about most vectors, those without direction left out; the driver holds one block."""
    by_query = queries.where(F.exists("vector", lambda x: x != 0)).groupBy("query_id", F.size("vector").alias("width")).agg(F.collect_list(F.col("vector").cast("array<double>")).alias("vectors"))
    held: dict[int, list] = {}
    for r in by_query.toLocalIterator():
        rows = held.setdefault(r["width"], [])
        rows.append((r["query_id"], r["vectors"]))
        if sum(len(v) for _, v in rows) >= most:
            yield _Block(held.pop(r["width"]), r["width"])
    for width, rows in held.items():
        yield _Block(rows, width)


def best_matches(queries: DataFrame, chunks: DataFrame, n: int, floor: float | None = 0.0, block: int = BLOCK, probes: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: for each query the n chunks of highest cosine, ties by chunk_id.

    queries (query_id, vector) may hold several vectors of a query: the highest counts. chunks (chunk_id, vector). A score is never below floor. Zero, null
    and mismatched vectors match nothing. Scores are rounded to 9 digits, so that equal vectors tie. With probes (query_id,
    cluster_id) a query looks at the chunks of its clusters alone, and chunks have a cluster_id.

    Query vectors are broadcast in blocks. HELD blocks are searched in one reading of the chunks; a task puts out its best
    rows of each query, and ranking those is all that is shuffled.
    """
    spark = queries.sparkSession
    near: dict | None = None
    if probes is not None:
        near = {}
        for r in probes.select("query_id", "cluster_id").toLocalIterator():
            near.setdefault(r["query_id"], []).append(r["cluster_id"])
    columns = ["chunk_id", F.col("vector").cast("array<double>").alias("vector"), *(["cluster_id"] if near is not None else [])]
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    parts, held = [], []
    for b in _blocks(queries, block):
        held.append(spark.sparkContext.broadcast((b, None if near is None else [frozenset(near.get(i, ())) for i in b.ids])))
        if len(held) == HELD:
            parts.append(held)
            held = []
    parts += [held] if held else []
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    found = None
    for some in parts:
        p = chunks.select(*columns).mapInArrow(_scan(some, n, floor, kind), schema)
        found = p if found is None else found.unionAll(p)
    return ranked(found, n)


def ranked(found: DataFrame, n: int) -> DataFrame:
    """The n rows of highest score for each query, ties by chunk_id, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


class _Best:
    """The best rows of each query so far, as flat arrays: query, whole score, chunk id."""

    def __init__(self, n: int) -> None:
        self.n, self.query, self.score, self.name = n, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None

    def add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        if not len(query):
            return
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        name = name if self.name is None else np.concatenate([self.name, name])
        order = np.lexsort((name, -score, query))
        query = query[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1])
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        order = order[place < self.n]
        self.query, self.score, self.name = query[place < self.n], score[order], name[order]

    def least(self, many: int) -> np.ndarray:
        """Of each query the score that a row must reach to be among its best."""
        out = np.full(many, np.iinfo(np.int64).min)
        last = np.flatnonzero(np.append(np.diff(self.query) != 0, True)) if len(self.query) else np.zeros(0, dtype=np.int64)
        full = np.bincount(self.query, minlength=many)[self.query[last]] == self.n
        out[self.query[last[full]]] = self.score[last[full]]
        return out


def _scan(blocks: list[Broadcast], n: int, floor: float | None, id_kind: pa.DataType):
    unit = 10**DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(*b.value, _Best(n)) for b in blocks]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                for block, near, best in held:
                    m, rows = _matrix(part.column(1), block.width)
                    lengths = np.sqrt((m * m).sum(axis=1))
                    m, rows, lengths = m[lengths > 0], rows[lengths > 0], lengths[lengths > 0]
                    if not len(rows):
                        continue
                    names = np.array(part.column(0).take(pa.array(rows)).to_pylist())
                    score = np.maximum.reduceat((m / lengths[:, None]) @ block.vectors.T, block.starts, axis=1)
                    score = np.rint((score if floor is None else np.maximum(score, floor)) * unit).astype(np.int64)
                    good = score >= best.least(len(block.ids))[None, :]
                    if near is not None:
                        clusters = part.column(2).take(pa.array(rows)).to_pylist()
                        of = {c: np.array([c in some for some in near]) for c in set(clusters)}
                        good &= np.stack([of[c] for c in clusters])
                    if good.sum() > 4 * n * len(block.ids):  # the first rows: those beyond the n-th of this part can't stay
                        least = np.partition(np.where(good, score, np.iinfo(np.int64).min), -min(n, len(rows)), axis=0)[-min(n, len(rows))]
                        good &= score >= least[None, :]
                    row, query = np.nonzero(good)
                    best.add(query, score[row, query], names[row])
        for block, _, best in held:
            if len(best.query):
                ids = pa.array([block.ids[q] for q in best.query.tolist()], id_kind)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.name.tolist(), kind), pa.array(best.score / unit)], names=["query_id", "chunk_id", "score"])

    return run


def fused(embedding: Column, keyword: Column) -> Column:
    return F.greatest(embedding, F.lit(0.7) * embedding + F.lit(0.3) * keyword)


def scored(queries: DataFrame, chunks: DataFrame, config: SearchConfig = SearchConfig(), content: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The head of each query with score_embedding, score_keyword, score_combined, score_final and rank among the coarse rows.

    queries: query_id, text, vector (one row each, or one for each expansion, text the original's). chunks: chunk_id,
    document_id, chunk_index, content, vector. Rows under the threshold and beyond the coarse cut are gone. score_final is the
    re-ranked one only for queries of which more than top_k rows survive. Texts are read for the head alone and not shuffled
    before, if it has FOUND_BROADCAST rows at most: by a broadcast of its ids (chunk_id), from chunks or by content, which gives
    the columns of chunks but vector for a few ids (for chunks that are a join, whose texts would be shuffled).
    """
    head = best_matches(queries, chunks, config.head).select("query_id", "chunk_id", F.col("score").alias("score_embedding"))
    asked = queries.select("query_id", F.col("text").alias("query")).distinct()
    ids = head.select("chunk_id").distinct()
    few = asked.count() * config.head <= FOUND_BROADCAST
    if few and content is not None:
        some = content(F.broadcast(ids))
    else:
        some = chunks.drop("vector").join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")
    rows = head.join(matched(asked, some, head), ["query_id", "chunk_id"], "left")
    if config.hybrid:
        keyword = F.when(F.col("__sum").isNotNull(), rounded(bm25_total(F.col("__sum"), F.col("__n_terms")), DIGITS)).otherwise(0.0)
        rows = rows.withColumn("score_keyword", keyword).withColumn("score_combined", rounded(fused(F.col("score_embedding"), keyword), DIGITS))
    else:
        rows = rows.withColumn("score_keyword", F.lit(0.0)).withColumn("score_combined", F.col("score_embedding"))
    rows = rows.where(F.col("score_combined") >= config.min_score)
    of = Window.partitionBy("query_id")
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(of)).withColumn("__r", F.row_number().over(of.orderBy(F.desc("score_combined"), "chunk_id")))
    rows = rows.where(F.col("__r") <= config.coarse).join(some, "chunk_id").join(asked, "query_id")
    final = rounded(rerank_score(F.col("score_combined"), F.col("query"), F.coalesce("__overlap", F.lit(0.0)), F.col("content"), F.col("chunk_index")), DIGITS)
    rows = rows.withColumn("score_final", F.when(F.col("__n") > config.top_k, final).otherwise(F.col("score_combined")))
    rank = F.row_number().over(of.orderBy(F.desc("score_final"), "chunk_id"))
    return rows.withColumn("rank", rank).drop("__sum", "__n_terms", "__overlap", "__n", "__r")


def matched(queries: DataFrame, chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (query_id, chunk_id) with a term in common: __sum of the terms' scores, __n_terms of the query, __overlap, the share of its terms.

    queries (query_id, query), chunks (chunk_id, content). Each text is parted into terms once, however many pairs it is in.
    """
    q = queries.select("query_id", tokens(F.col("query")).alias("t"))
    q = q.select("query_id", F.size("t").alias("__n_terms"), F.size(F.array_distinct("t")).alias("__different"), F.explode(F.array_distinct("t")).alias("term"))
    c = chunks.select("chunk_id", tokens(F.col("content")).alias("t"))
    c = c.select("chunk_id", F.size("t").alias("n"), F.explode("t").alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("n").alias("n"))
    hits = pairs.select("query_id", "chunk_id").join(q, "query_id").join(c, ["chunk_id", "term"])
    overlap = (F.count(F.lit(1)) / F.first("__different")).alias("__overlap")
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(bm25(F.col("tf"), F.col("n"))).alias("__sum"), F.first("__n_terms").alias("__n_terms"), overlap)


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rank, score: the k rows of docs (doc_id, ts) of highest keyword score for queries (query_id, ts).

    ts are terms. The queries' terms are a stated set that tasks hold; a task scores its documents and puts out its best rows,
    so a term that all documents and queries have makes no pairs. Documents without a query's terms have no row.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    id_kind, held, parts = to_arrow_type(queries.schema["query_id"].dataType), [], []

    def hold() -> None:
        terms: dict[str, list] = {}
        for i, (_, ts) in enumerate(held):
            for t in set(ts):
                terms.setdefault(t, []).append(i)
        ready = ({t: np.array(v) for t, v in terms.items()}, [i for i, _ in held], np.array([len(ts) for _, ts in held], dtype=float))
        parts.append(docs.select("doc_id", "ts").mapInArrow(_terms(queries.sparkSession.sparkContext.broadcast(ready), k, id_kind), kinds))
        held.clear()

    for r in queries.where(F.size("ts") > 0).select("query_id", "ts").toLocalIterator():
        held.append((r["query_id"], r["ts"]))
        if len(held) == BLOCK:
            hold()
    if held:
        hold()
    if not parts:
        return queries.sparkSession.createDataFrame([], f"{kinds}, rank int").select("query_id", "doc_id", "rank", "score")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return ranked(found.withColumnRenamed("doc_id", "chunk_id"), k).select("query_id", F.col("chunk_id").alias("doc_id"), "rank", "score")


def _terms(queries: Broadcast, k: int, id_kind: pa.DataType):
    unit = 10**DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, size = queries.value
        best, kind = _Best(k), None
        for batch in batches:
            kind = batch.column(0).type
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                names, rows, cols, scores = np.array(part.column(0).to_pylist()), [], [], []
                for row, ts in enumerate(part.column(1).to_pylist()):
                    found = [(terms[t], 2.0 * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / 200.0))) for t, tf in Counter(ts or ()).items() if t in terms]
                    if not found:
                        continue
                    of, much = np.concatenate([q for q, _ in found]), np.repeat([s for _, s in found], [len(q) for q, _ in found])
                    total = np.bincount(of, much, len(ids))
                    has = np.flatnonzero(total > 0)
                    rows.append(np.full(len(has), row))
                    cols.append(has)
                    scores.append(np.rint(np.minimum(1.0, total[has] / (size[has] * 3.0)) * unit).astype(np.int64))
                if rows:
                    row, query, score = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
                    good = score >= best.least(len(ids))[query]
                    best.add(query[good], score[good], names[row[good]])
        if len(best.query):
            made = [pa.array([ids[q] for q in best.query.tolist()], id_kind), pa.array(best.name.tolist(), kind), pa.array(best.score / unit)]
            yield pa.RecordBatch.from_arrays(made, names=["query_id", "doc_id", "score"])

    return run


def diversified(rows: DataFrame, top_k: int) -> DataFrame:
    """rows (query_id, rank, document_id, content, ...; a few dozen a query) in their new order: place 1 .. top_k of each query.

    A document gives at most half of top_k, three at most, and no normalised content comes twice. If that leaves places free, the
    rest is filled by rank without regard to documents. One document alone, or one row, is left as it is.
    """
    most = max(1, min(3, (top_k + 1) // 2))
    slim = F.struct(F.col("rank").alias("r"), F.col("document_id").cast("string").alias("d"), normalized_hash(F.col("content")).alias("h"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(slim)).alias("rows"))
    start = F.expr("named_struct('taken', cast(array() as array<int>), 'docs', cast(array() as array<string>), 'seen', cast(array() as array<string>))")

    def step(limit_documents: bool):
        def walk(acc: Column, x: Column) -> Column:
            full = (F.size(acc["taken"]) >= top_k) | F.array_contains(acc["seen"], x["h"])
            if limit_documents:
                full = full | (F.size(F.filter(acc["docs"], lambda d: d == x["d"])) >= most)
            more = F.struct(F.concat(acc["taken"], F.array(x["r"])).alias("taken"), F.concat(acc["docs"], F.array(x["d"])).alias("docs"), F.concat(acc["seen"], F.array(x["h"])).alias("seen"))
            return F.when(full, acc).otherwise(more)

        return walk

    lists = lists.withColumn("one", F.aggregate("rows", start, step(True)))
    both = F.aggregate("rows", F.col("one"), step(False))
    taken = F.when(F.size("one.taken") >= F.least(F.lit(top_k), F.size("rows")), F.col("one.taken")).otherwise(both["taken"])
    as_is = (F.size("rows") <= 1) | (F.size(F.array_distinct(F.transform("rows", lambda x: x["d"]))) <= 1)
    ranks = F.when(as_is, F.slice(F.transform("rows", lambda x: x["r"]), 1, top_k)).otherwise(taken)
    places = lists.select("query_id", F.posexplode(ranks).alias("place", "rank"))
    return places.join(rows, ["query_id", "rank"]).withColumn("rank", F.col("place") + 1).drop("place")


def search(queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, config: SearchConfig = SearchConfig(), source_types: tuple[str, ...] | None = None, document_ids: tuple[str, ...] | None = None, engine: EngineConfig = EngineConfig(), content: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, rank, score and the columns of the chunk, with its document's attributes if documents (document_id, ...) is given.

    One source type and document ids restrict what is searched; several source types restrict what was found, unless the
    engine pushes them down. content is scored()'s. A document that is missing gives source_type unknown and nulls. A disabled engine finds nothing.
    """
    if not engine.enabled:
        queries = queries.limit(0)
    if document_ids is not None:
        chunks = chunks.where(F.col("document_id").isin(*document_ids))
    pushed = source_types is not None and (len(source_types) == 1 or engine.push_source_types)
    if pushed:
        chunks = chunks.where(F.col("source_type").isin(*source_types))
    found = diversified(scored(queries, chunks, config, content), config.top_k)
    found = found.select("query_id", "rank", F.col("score_final").alias("score"), *[c for c in chunks.columns if c != "vector"])
    if source_types is not None and not pushed:
        found = found.where(F.col("source_type").isin(*source_types))
    if documents is not None:
        found = found.drop("source_type", "title", "source_path").join(documents, "document_id", "left").withColumn("source_type", F.coalesce("source_type", F.lit("unknown")))
    return found
