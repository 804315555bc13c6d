"""The index as one object: index, search, context, maintenance."""

from __future__ import annotations

import contextlib
import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.config import CONTEXT_PRESETS, ContextConfig, EngineConfig, SearchConfig, WindowChunkConfig
from quillstone.functions.text import expanded, strip_ws
from quillstone.operators import index as I
from quillstone.operators.context import contexts
from quillstone.operators.embedding import HashingProvider, Provider, embedded, languages
from quillstone.operators.search import search
from quillstone.sources.tables import COMPRESSION, Store, clear, packed, stored_bytes, write_table

log = logging.getLogger("quillstone")
CHUNKS = f"{schemas.CHUNKS}, vector array<float>"


class Engine:
    """An index under path, a folder that all executors share.

    Every change is a new version of the store: a failure leaves the old index, readers never see half of a change. One writer
    at a time. Queries are DataFrames (query_id, text). after_commit gets the ids of changed documents (doc_id), as a
    DataFrame that can be read until it returns; it must bear being called again.
    """

    def __init__(self, spark: SparkSession, path: str, provider: Provider | None = None, config: EngineConfig = EngineConfig(), chunking: WindowChunkConfig = WindowChunkConfig()) -> None:
        self.spark, self.path, self.provider, self.config, self.chunking = spark, path.rstrip("/"), provider or HashingProvider(), config, chunking
        self.store = Store(spark, f"{self.path}/index")
        self.after_commit: Callable[[DataFrame], None] | None = None

    # Tables.

    @property
    def documents(self) -> DataFrame:
        return self.store.read("documents", schemas.DOCUMENTS)

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks", CHUNKS)

    def _commit(self, new: dict[str, DataFrame], touched: DataFrame | None, stage: str) -> None:
        """Puts new tables in place of the old ones, in the buckets of touched (doc_id); tells after_commit which of them are there now."""
        if touched is not None:
            touched = self._kept(touched.select("doc_id").distinct(), f"{stage}/touched")
        self.store.commit(new, touched)
        if self.after_commit is not None:
            ids = self.documents.select("doc_id")
            self.after_commit(ids if touched is None else touched.join(ids, "doc_id", "left_semi"))

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", COMPRESSION).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def _stage(self) -> Iterator[str]:
        stage = f"{self.path}/staging-{uuid.uuid4().hex}"
        try:
            yield stage
        finally:
            clear(self.spark, stage)

    # Changes.

    def index(self, df: DataFrame) -> None:
        """Indexes input rows (schemas.INPUT), in place of documents with the same ids. Documents of the same type and path under other ids go, for rows that were given no id.

        Texts are chunked and embedded once: what the model gives is stored before it is put in place.
        """
        if not self.config.enabled:
            return
        with self._stage() as stage:
            df = self._kept(df, f"{stage}/input")
            documents, chunks = I.built(df, self.provider, F.current_timestamp(), self.chunking, lambda c: self._kept(c, f"{stage}/chunks"))
            documents = self._kept(documents, f"{stage}/documents")
            gone = self._kept(I.same_source(self.documents, I.hashed_sources(df)), f"{stage}/gone")
            kept_documents, kept_chunks = I.deleted(self.documents, gone), I.deleted(self.chunks, gone)
            touched = documents.select("doc_id").unionAll(gone)
            self._commit({"documents": I.upserted(kept_documents, documents), "chunks": I.replaced(kept_chunks, chunks)}, touched, stage)

    def delete(self, ids: DataFrame) -> None:
        """Documents of ids (doc_id) with their chunks."""
        with self._stage() as stage:
            ids = self._kept(ids.select("doc_id").distinct(), f"{stage}/ids")
            self._commit({"documents": I.deleted(self.documents, ids), "chunks": I.deleted(self.chunks, ids)}, ids, stage)

    def delete_source(self, source_type: str, source_path: str, except_id: str | None = None) -> None:
        found = self.documents.where((F.col("source_type") == source_type) & (strip_ws(F.col("source_path")) == strip_ws(F.lit(source_path))))
        self.delete(found.where(F.col("doc_id") != except_id) if except_id is not None else found)

    def reconcile(self) -> None:
        """Embeds documents anew whose vectors another model made."""
        with self._stage() as stage:
            stale = self._kept(self.documents.where(I.is_stale(F.col("embedding_metadata"), self.provider.info)).select("doc_id"), f"{stage}/stale")
            documents, chunks = I.refreshed(self.documents, self.chunks, self.provider, lambda c: self._kept(c, f"{stage}/chunks"))
            self._commit({"documents": documents, "chunks": chunks}, stale, stage)

    def save_all(self) -> None:
        """Writes every bucket anew: many small files become few."""
        with self._stage() as stage:
            self._commit({"documents": self.documents, "chunks": self.chunks}, None, stage)

    def clear(self) -> None:
        clear(self.spark, self.store.path, f"{self.path}/vectors")

    def export_vectors(self) -> None:
        """All vectors in 8 bits each, one range a document, under vectors."""
        vectors = self.chunks.where(F.col("vector").isNotNull()).select("chunk_id", "doc_id", "vector")
        write_table(packed(I.quantized_vectors(vectors)), f"{self.path}/vectors", self.store.current()["buckets"] or 1)

    # Queries.

    def search(self, queries: DataFrame, config: SearchConfig = SearchConfig(), source_types: tuple[str, ...] | None = None, document_ids: tuple[str, ...] | None = None) -> DataFrame:
        """Rows of schemas.RESULT. A query that can't be embedded finds nothing."""
        texts = queries.select("query_id", "text", F.explode(expanded(F.col("text")) if config.expand and self.config.query_expansion else F.array("text")).alias("content"))
        vectors = embedded(texts, self.provider).where(F.col("vector").isNotNull()).select("query_id", "text", "vector")
        attributes = self.documents.select(F.col("doc_id").alias("document_id"), "title", "source_type", "source_path")
        chunks = self.chunks.withColumnRenamed("doc_id", "document_id").drop("created_at")
        kinds = attributes.select("document_id", "source_type")
        chunks = chunks.join(kinds, "document_id", "left")
        found = search(vectors, chunks, attributes, replace(config, hybrid=config.hybrid and self.config.hybrid), source_types, document_ids, self.config)
        return found.select("query_id", "rank", "score", "chunk_id", "document_id", "source_type", "title", "source_path", "content", "start_offset", "end_offset")

    def context(self, queries: DataFrame, config: ContextConfig = CONTEXT_PRESETS["standard"]) -> DataFrame:
        """A block of context for each of queries, an empty one where nothing was found."""
        if self.config.push_context_filters:
            found = self.search(queries, SearchConfig(top_k=max(SearchConfig().top_k, config.top_k), min_score=config.min_score), config.source_types)
        else:
            found = self.search(queries)
        made = queries.select("query_id").join(contexts(found, config), "query_id", "left")
        return made.na.fill({"context": "", "source_count": 0, "printed_count": 0, "character_count": 0, "has_context": False})

    def flashcard_context(self, queries: DataFrame) -> DataFrame:
        return self.context(queries, CONTEXT_PRESETS["standard"])

    def quiz_context(self, queries: DataFrame) -> DataFrame:
        return self.context(queries, CONTEXT_PRESETS["quiz"])

    def notes_context(self, queries: DataFrame) -> DataFrame:
        return self.context(queries, CONTEXT_PRESETS["rich"])

    # What there is.

    def exists(self, doc_id: str) -> bool:
        return not self.documents.where(F.col("doc_id") == doc_id).isEmpty()

    def has_embeddings(self, doc_id: str) -> bool:
        return not self.chunks.where((F.col("doc_id") == doc_id) & F.col("vector").isNotNull()).isEmpty()

    def document(self, doc_id: str) -> DataFrame:
        return self.documents.where(F.col("doc_id") == doc_id)

    def chunks_of(self, doc_id: str) -> DataFrame:
        return self.chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index")

    def all_documents(self) -> DataFrame:
        return self.documents.orderBy(F.desc("created_at"), "doc_id")

    def indexed_ids(self) -> DataFrame:
        return self.documents.select("doc_id")

    def vectors_of(self, ids: DataFrame) -> DataFrame:
        """chunk_id, doc_id, vector of the documents or chunks in ids (doc_id or chunk_id); other columns aren't read."""
        return self.chunks.select("chunk_id", "doc_id", "vector").join(ids.distinct(), ids.columns[0], "left_semi")

    def stats(self) -> DataFrame:
        """I.store_stats(), and what is stored, in bytes and in units of 1,000,000."""
        size = {name: sum(stored_bytes(self.spark, f"{self.store.path}/{f}") for f in folders.values()) for name, folders in self.store.current()["tables"].items()}
        documents, chunks = size.get("documents", 0), size.get("chunks", 0)
        found = I.store_stats(self.documents, self.chunks, self.provider.info.dimension)
        mb = {"storage_mb": documents + chunks, "metadata_mb": documents, "embeddings_mb": chunks}
        return found.withColumn("storage_bytes", F.lit(documents + chunks)).withColumns({k: F.lit(v / 1e6) for k, v in mb.items()})

    def document_stats(self) -> DataFrame:
        return I.document_stats(self.documents, self.chunks)

    def diagnostics(self) -> DataFrame:
        """One row: the engine's flags, its provider, and stats()."""
        i, known = self.provider.info, languages(self.provider)
        flags = {"enabled": self.config.enabled, "available": bool(known), "language": i.language, "strategy": i.strategy, "version": i.version, "model": i.model, "dimension": i.dimension}
        columns = {k: F.lit(v) for k, v in flags.items()} | {"languages": F.array(*[F.lit(x) for x in known])}
        return self.stats().withColumns(columns)

    def describe(self) -> dict:
        return self.diagnostics().first().asDict() | {"bytes": stored_bytes(self.spark, self.path)}
