"""The chunk index: building, upsert, delete, stale vectors, statistics, quantised vectors.

An index is a set of DataFrames (documents, chunks, vectors); every change gives new ones, to be written by sources.tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.config import WindowChunkConfig
from quillstone.functions.text import canonical_id, chunk_id, content_hash, strip_ws
from quillstone.functions.vectors import dequantized, quantized
from quillstone.operators.chunking import window_chunks
from quillstone.operators.embedding import ModelInfo, Provider, embedded


def _with_ids(df: DataFrame) -> DataFrame:
    """Input rows with text, under their canonical ids, with id_strategy. A row without id and path gets an id from all its content."""
    doc_id, strategy = canonical_id(F.col("doc_id"), F.col("source_type"), F.col("source_path"))
    rows = df.where(F.coalesce(F.rlike("text", F.lit(r"\S")), F.lit(False))).withColumn("id_strategy", strategy)
    return rows.withColumn("doc_id", F.coalesce(doc_id, F.concat(F.lit("doc_"), content_hash(_whole())))).withColumn("source_path", F.coalesce("source_path", F.lit("")))


def _whole() -> Column:
    return F.concat_ws("\x01", "title", "source_type", "source_path", "text")


def identified(df: DataFrame) -> DataFrame:
    """Input rows (doc_id, title, source_type, source_path, text) with text, under their canonical ids, each (doc_id, content) once.

    A row without id and path gets an id from all its content.
    """
    return _with_ids(df).withColumn("content_hash", content_hash(_whole())).dropDuplicates(["doc_id", "content_hash"])


def hashed_sources(df: DataFrame) -> DataFrame:
    """doc_id, source_type, source_path of input rows whose id comes from type and path; contents are neither hashed nor shuffled."""
    return _with_ids(df).where(F.col("id_strategy") == "source_path_hash").select("doc_id", "source_type", "source_path")


def _one_each(df: DataFrame) -> DataFrame:
    """Input rows under their ids, of several contents under one id that of least hash.

    The ids are counted first: texts are shuffled for those alone that several rows have.
    """
    rows = _with_ids(df).select("doc_id", "title", "source_type", "source_path", "text", "id_strategy")
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return rows
    again = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id")
    again = again.agg(F.min_by(F.struct("title", "source_type", "source_path", "text", "id_strategy"), content_hash(_whole())).alias("r")).select("doc_id", "r.*")
    return rows.join(repeated, "doc_id", "left_anti").unionByName(again)


def built(df: DataFrame, provider: Provider, now: Column, config: WindowChunkConfig = WindowChunkConfig(), keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks with vectors) of input rows. Of several contents under one id the one of least hash stays.

    Chunks that can't be embedded are dropped, with gaps in the index; a document without any chunk left isn't in either. keep
    may store the chunks, as both results come from them, and reads what it stored.
    """
    rows = _one_each(df)
    chunks = embedded(window_chunks(rows, config), provider).where(F.col("vector").isNotNull())
    chunks = chunks.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "content", "chunk_index", "start_offset", "end_offset", now.alias("created_at"), "vector")
    chunks = keep(chunks) if keep is not None else chunks
    documents = rows.select("doc_id", "title", "source_type", "source_path", now.alias("created_at"), now.alias("updated_at"), provider.info.column().alias("embedding_metadata"))
    return documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi"), chunks


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents: those of new in place of old ones with the same id, whose created_at stays."""
    kept = old.select("doc_id", F.col("created_at").alias("__created"))
    fresh = new.join(kept, "doc_id", "left").withColumn("created_at", F.coalesce("__created", "created_at")).drop("__created")
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(fresh.select(*old.columns))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks or vectors: all of a document's are replaced by new ones."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def deleted(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def same_source(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id of documents with the type and trimmed path of one in kept (doc_id, source_type, source_path) under another id."""
    new = kept.select(F.col("doc_id").alias("__id"), F.col("source_type").alias("__t"), strip_ws(F.col("source_path")).alias("__p"))
    same = (F.col("source_type") == F.col("__t")) & (strip_ws(F.col("source_path")) == F.col("__p"))
    found = documents.join(new, same & (F.col("doc_id") != F.col("__id")), "left_semi").select("doc_id")
    return found.join(kept.select("doc_id"), "doc_id", "left_anti")


def is_stale(meta: Column, now: ModelInfo) -> Column:
    """Whether vectors with this metadata were made otherwise than now; null metadata are stale, a null strategy is the empty one."""
    same = (meta["version"] == now.version) & (meta["dimension"] == now.dimension) & (meta["language"] == now.language) & (F.coalesce(meta["strategy"], F.lit("")) == now.strategy)
    return ~F.coalesce(same, F.lit(False))


def refreshed(documents: DataFrame, chunks: DataFrame, provider: Provider, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stale documents embedded anew, all of a document's chunks or none; keep as in built().

    After a change of model all documents are stale: then chunks aren't joined with their ids, so they aren't shuffled for it.
    """
    is_old = is_stale(F.col("embedding_metadata"), provider.info)
    stale = documents.where(is_old).select("doc_id")
    every = documents.where(~is_old).isEmpty()
    new = embedded(chunks if every else chunks.join(stale, "doc_id", "left_semi"), provider)
    new = keep(new) if keep is not None else new
    failed = new.where(F.col("vector").isNull()).select("doc_id").distinct()
    done = new.select("doc_id").distinct()
    if failed.isEmpty():
        rest = chunks.limit(0) if every else chunks.join(done, "doc_id", "left_anti")
    else:
        new, done = new.join(failed, "doc_id", "left_anti"), done.join(failed, "doc_id", "left_anti")
        rest = chunks.join(failed, "doc_id", "left_semi") if every else chunks.join(done, "doc_id", "left_anti")
    marked = documents.join(done.withColumn("__done", F.lit(True)), "doc_id", "left").withColumn("embedding_metadata", F.when(F.col("__done"), provider.info.column()).otherwise(F.col("embedding_metadata"))).drop("__done")
    return marked, rest.unionByName(new.select(*chunks.columns))


def quantized_vectors(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """vectors (key, chunk_id, vector) with q (array<int>), q_min, q_max, dim: one range for a key's vectors."""
    values = F.transform("vector", lambda x: x.cast("double"))
    ranges = vectors.where(F.size("vector") > 0).groupBy(key).agg(F.min(F.array_min(values)).alias("q_min"), F.max(F.array_max(values)).alias("q_max"))
    return vectors.join(ranges, key).withColumn("q", quantized(F.col("vector"), F.col("q_min"), F.col("q_max"))).withColumn("dim", F.size("vector"))


def restored(q: DataFrame) -> DataFrame:
    return q.withColumn("vector", dequantized(F.col("q"), F.col("q_min"), F.col("q_max")))


def document_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_chars of every document, zeros without chunks."""
    per = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))
    return documents.select("doc_id").join(per, "doc_id", "left").na.fill(0, ["n_chunks", "n_chars"])


def store_stats(documents: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """One row: documents, chunks, chunks a document, bytes of float and of quantised vectors, chunks and documents with vectors."""
    d = documents.agg(F.count(F.lit(1)).alias("n_documents"))
    has = F.col("vector").isNotNull() if "vector" in chunks.columns else F.lit(False)
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("v"))
    sums = (F.sum("n").alias("n_chunks"), F.sum("v").alias("n_vectors"), F.count_if(F.col("v") > 0).alias("n_embedded_documents"))
    both = d.crossJoin(c.agg(*sums)).na.fill(0)  # one row each
    mean = F.when(F.col("n_documents") > 0, F.round(F.col("n_chunks") / F.col("n_documents"), 6)).otherwise(0.0)
    sizes = ((F.col("n_chunks") * dimension * 4).alias("float_bytes"), (F.col("n_chunks") * dimension).alias("quantized_bytes"))
    return both.select("n_documents", "n_chunks", mean.alias("chunks_per_document"), *sizes, "n_vectors", "n_embedded_documents")


def chunks_in_order(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")))
