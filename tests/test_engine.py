"""The index as one object, and the functions in SQL."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.config import ContextConfig, EngineConfig, SearchConfig, WindowChunkConfig
from quillstone.engine import Engine
from quillstone.functions.register import register
from quillstone.operators import embedding, index
from quillstone.operators.chunking import with_summaries
from quillstone.operators.embedding import Chain, Guarded, HashingProvider, Registry, embedded, embedded_by_language, embedded_once, mean_vectors
from quillstone.sources import tables
from quillstone.sources.tables import Store, names, read_legacy, read_table, read_vector_files, vector_files

INPUT = "doc_id string, title string, source_type string, source_path string, text string"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/index", HashingProvider(128), chunking=WindowChunkConfig(suffix_cascade=False))


def rows(spark, *some):
    return spark.createDataFrame(list(some), INPUT)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_life(spark, engine):
    assert engine.search(ask(spark, "anything")).count() == 0 and engine.stats().first()["n_documents"] == 0
    told = []
    engine.after_commit = lambda ids: told.extend(r["doc_id"] for r in ids.collect())
    engine.index(rows(spark, ("a", "Cells", "ai_note", "/a", "Mitochondria make energy. Cells hold many of them."), (None, "Rocks", "document", "/r", "Granite is a hard rock. Basalt is dark."), ("empty", "E", "document", "/e", " ")))
    assert engine.stats().first()["n_documents"] == 2 and "a" in told and engine.exists("a") and engine.has_embeddings("a") and not engine.exists("empty")
    found = engine.search(ask(spark, "granite rock", "")).collect()
    assert [r["title"] for r in found if r["rank"] == 1] == ["Rocks"] and {r["query_id"] for r in found} == {0}
    assert engine.search(ask(spark, "granite rock"), source_types=("ai_note",)).where("title = 'Rocks'").count() == 0
    created = engine.document("a").first()["created_at"]
    engine.index(rows(spark, ("a", "Cells again", "ai_note", "/a", "Something else.")))
    again = engine.document("a").first()
    assert again["title"] == "Cells again" and again["created_at"] == created and again["updated_at"] > created
    assert [r["content"] for r in engine.chunks_of("a").collect()] == ["Something else."]
    made = {r["query_id"]: r for r in engine.context(ask(spark, "granite rock", "zzz"), ContextConfig(source_types=None)).collect()}
    assert "[Document: Rocks]" in made[0]["context"] and made[0]["has_context"] and made[1]["context"] == "" and not made[1]["has_context"]
    engine.delete(spark.createDataFrame([("a",)], "doc_id string"))
    assert not engine.exists("a") and engine.chunks_of("a").count() == 0 and engine.stats().first()["n_documents"] == 1
    engine.delete_source("document", "/r \n")
    assert engine.all_documents().count() == 0 and engine.chunks.count() == 0
    engine.clear()
    assert engine.describe()["dimension"] == 128


def test_reconcile_and_vectors(spark, engine):
    engine.index(rows(spark, *[(str(i), "t", "quiz", f"/{i}", f"Text number {i} is here.") for i in range(20)]))
    other = Engine(spark, engine.path, HashingProvider(16), chunking=engine.chunking)
    other.reconcile()
    assert {len(r["vector"]) for r in other.chunks.collect()} == {16} and other.stats().first()["n_chunks"] == 20
    other.export_vectors()
    assert read_table(spark, f"{other.path}/vectors", "chunk_id string, doc_id string, q binary, q_min float, q_max float, dim int").where("length(q) = 16").count() == 20


def test_a_commit_that_fails_leaves_the_index(spark, engine, monkeypatch):
    engine.index(rows(spark, ("a", "A", "quiz", "/a", "First text here."), ("b", "B", "quiz", "/b", "Second text here.")))
    before = sorted((r["doc_id"], r["title"]) for r in engine.documents.collect())
    chunks = sorted(r["content"] for r in engine.chunks.collect())

    def fail(self, version):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", fail)
        with pytest.raises(OSError):
            engine.index(rows(spark, ("a", "Changed", "quiz", "/a", "Other words.")))
    assert sorted((r["doc_id"], r["title"]) for r in engine.documents.collect()) == before
    assert sorted(r["content"] for r in engine.chunks.collect()) == chunks
    held = engine.documents  # of this version
    engine.index(rows(spark, ("a", "Changed", "quiz", "/a", "Other words.")))
    assert sorted((r["doc_id"], r["title"]) for r in held.collect()) == before and engine.document("a").first()["title"] == "Changed"


def test_buckets_follow_the_documents(spark, engine, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_DOCUMENTS", 4)
    many = lambda a, b: rows(spark, *[(str(i), "t", "quiz", f"/{i}", f"Text number {i} is here.") for i in range(a, b)])
    engine.index(many(0, 3))
    assert engine.store.current()["buckets"] == 1
    engine.index(many(3, 40))
    first = engine.store.current()
    assert first["buckets"] == 16 and first["documents"] == 40
    engine.delete(spark.createDataFrame([("7",)], "doc_id string"))
    after = engine.store.current()
    same = [b for b in first["tables"]["chunks"] if after["tables"]["chunks"].get(b) == first["tables"]["chunks"][b]]
    assert len(same) >= len(first["tables"]["chunks"]) - 1  # one bucket was written
    engine.save_all()
    assert engine.documents.count() == engine.chunks.count() == 39 and len(names(spark, f"{engine.store.path}/versions")) == 2
    s = engine.stats().first()
    assert (s["n_documents"], s["n_vectors"], s["n_embedded_documents"]) == (39, 39, 39) and s["storage_bytes"] > 0 and s["storage_mb"] > s["embeddings_mb"] > 0
    assert engine.indexed_ids().count() == 39 and engine.vectors_of(spark.createDataFrame([("1",)], "doc_id string")).count() == 1
    assert engine.diagnostics().first()["languages"] == ["en"]


def test_texts_are_embedded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    class Counting(HashingProvider):
        def embed(self, texts):
            seen.add(len(texts))
            return super().embed(texts)

    e = Engine(spark, f"file://{tmp_path}/counted", Counting(8), chunking=WindowChunkConfig(suffix_cascade=False))
    e.index(rows(spark, *[(str(i), "t", "quiz", f"/{i}", f"Text {i}.") for i in range(10)]))
    assert seen.value == 10
    df = spark.createDataFrame([("same",)] * 30 + [("other",), (None,)], "content string").repartition(5)
    got = embedded_once(df, Counting(8)).collect()
    assert seen.value == 12 and len(got) == 32 and sum(r["vector"] is None for r in got) == 1


def test_a_provider_gets_slices_of_a_batch(spark):
    """It got whole batches of Spark's, up to 10,000 texts of any length, and kept every word of them."""
    class Asked(HashingProvider):
        def embed(self, texts):
            if len(texts) > embedding.SLICE or sum(map(len, texts)) > 2 * embedding.SLICE_BYTES:
                raise ValueError("too much at once")
            return super().embed(texts)

    df = spark.range(6000).coalesce(1).select(F.concat(F.lit("word w"), "id", F.lit(" "), F.repeat(F.lit("long "), 1000)).alias("content"))
    assert embedded(df, Asked(8)).where("vector is not null").count() == 6000
    places = embedding._Places(8)
    places.MOST = 10
    kept = {f"w{i}": places[f"w{i}"] for i in range(100)}
    assert len(places) <= 10 and all(places[w] == at for w, at in kept.items())


def _shuffled(df):
    """What a plan exchanges, and the columns of each exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_texts_are_not_shuffled_to_build_an_index(spark):
    """All texts were hashed and shuffled twice to find rows under one id, and for the chunks and the documents again."""
    single = rows(spark, ("a", "A", "quiz", "/a", "Some text."), (None, "B", "quiz", "/b", "Other text."), ("c", "C", "quiz", "/c", " "))
    _, chunks = index.built(single, HashingProvider(8), F.current_timestamp())
    assert _shuffled(chunks) == 0 and chunks.count() == 2
    twice = single.unionByName(rows(spark, ("a", "A", "quiz", "/a", "Some more."), (" a ", "A", "quiz", "/a", "Some text.")))
    documents, chunks = index.built(twice, HashingProvider(8), F.current_timestamp())
    least = index.identified(twice).where("doc_id = 'a'").orderBy("content_hash").first()["text"]
    assert [r["content"] for r in chunks.where("doc_id = 'a'").collect()] == [least] and documents.count() == 2


def test_a_change_of_model_leaves_chunks_where_they_are(spark, engine):
    """All chunks were shuffled by the joins with the ids of stale documents, and of those embedded anew."""
    engine.index(rows(spark, ("a", "A", "quiz", "/a", "Some text."), ("b", "B", "quiz", "/b", "Other text.")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, chunks = index.refreshed(engine.documents, engine.chunks, HashingProvider(16))
        assert _shuffled(chunks) == 0 and {len(r["vector"]) for r in chunks.collect()} == {16}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _cancelling(dimension):
    """Two words that cancel each other in so many places, but not in twice as many."""
    p, wide = HashingProvider(dimension), HashingProvider(2 * dimension)
    return next(t for i in range(9999) if not any(p.embed([t := f"word w{i}"])[0]) and any(wide.embed([t])[0]))


def test_texts_whose_words_cancel_stay_in_the_index(spark, tmp_path):
    """They had no vector: their chunks were dropped, and their documents stayed stale after a change of model."""
    e = Engine(spark, f"file://{tmp_path}/cancel", HashingProvider(64), chunking=WindowChunkConfig(suffix_cascade=False))
    e.index(rows(spark, ("a", "t", "quiz", "/a", _cancelling(64)), ("b", "t", "quiz", "/b", _cancelling(32)), ("c", "t", "quiz", "/c", "Plain text.")))
    assert e.stats().first()["n_vectors"] == 3
    e.provider = HashingProvider(32)
    e.reconcile()
    assert {(r["doc_id"], len(r["vector"])) for r in e.chunks.collect()} == {("a", 32), ("b", 32), ("c", 32)}
    assert e.documents.where("embedding_metadata.dimension <> 32").count() == 0
    found = e.search(spark.createDataFrame([(1, _cancelling(32)), (2, "plain text.")], "query_id long, text string"))
    assert {r["query_id"] for r in found.collect()} == {2}


@pytest.mark.parametrize("name", ["live_index", "index_events", "index_statistics", "index_lookups", "vector_store", "providers_by_language", "embedded_texts", "text_search", "text_similarity"])
def test_queries_on_texts_whose_words_cancel(spark, tmp_path, name):
    import duckdb

    import __spark_entry__

    texts = [_cancelling(32), _cancelling(64), "der die und " + _cancelling(40), "plain words of text here", " \n ", "le les des " + _cancelling(48)] + [_cancelling(n) for n in (40, 48)]
    d = spark.createDataFrame([(100 * i + k, t, "en", "src1") for i, t in enumerate(texts) for k in (0, 2, 5)], "doc_id long, text string, lang string, source string")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "plain words"), (2, _cancelling(64)), (100, "text here")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_vector_files(spark, tmp_path):
    q = spark.createDataFrame([("c1", "d", 1, [0, 255, 7], 0.5, 1.5), ("c0", "d", 0, [1, 2, 3], 0.5, 1.5), ("e0", "e", 0, [9], -1.0, 1.0)], "chunk_id string, doc_id string, chunk_index int, q array<int>, q_min double, q_max double")
    for r in vector_files(q).collect():
        (tmp_path / f"{r['doc_id']}.bin").write_bytes(bytes(r["content"]))
    raw = (tmp_path / "d.bin").read_bytes()
    n = int.from_bytes(raw[:4], "little")
    assert json.loads(raw[4 : 4 + n]) == {"version": 1, "chunkIds": ["c0", "c1"], "params": {"minValue": 0.5, "maxValue": 1.5, "dimension": 3}} and raw[4 + n :] == bytes([1, 2, 3, 0, 255, 7])
    (tmp_path / "cut.bin").write_bytes(raw[:-2])
    (tmp_path / "bad.bin").write_bytes(b"\x01")
    got = sorted((r["chunk_id"], r["q"], r["q_min"]) for r in read_vector_files(spark, f"file://{tmp_path}").collect())
    assert got == [("c0", [1, 2, 3], 0.5), ("c0", [1, 2, 3], 0.5), ("c1", [0, 255, 7], 0.5), ("e0", [9], -1.0)]


def test_vector_files_of_a_large_document_are_parts(spark, monkeypatch):
    """One row a document once held all of its vectors, and each row read from it the whole file."""
    monkeypatch.setattr(tables, "VOLUME", 50)
    q = spark.range(1000).select(F.concat(F.lit("c"), F.lpad(F.col("id"), 4, "0")).alias("chunk_id"), F.when(F.col("id") < 990, "large").otherwise("small").alias("doc_id"), (F.col("id") * 3).cast("int").alias("chunk_index"), F.array((F.col("id") % 256).cast("int"), F.lit(7)).alias("q"), F.lit(0.5).alias("q_min"), F.lit(1.5).alias("q_max"))
    files = vector_files(q).cache()
    assert files.where("doc_id = 'small'").count() == 1 and files.where("doc_id = 'large'").count() > 5
    assert files.agg(F.max(F.octet_length("content"))).first()[0] < 2500
    got = sorted((r["chunk_id"], r["chunk_index"], r["q"]) for r in tables.parsed_vector_files(files).collect())
    assert got == [(f"c{i:04}", i if i < 990 else i - 990, [i % 256, 7]) for i in range(1000)]


def test_a_failing_provider_rests(spark):
    class Failing:
        info = HashingProvider(4).info

        def __init__(self, error):
            self.error, self.calls = error, 0

        def embed(self, texts):
            self.calls += 1
            raise self.error

    now = [0.0]
    f = Failing(RuntimeError("broken"))
    g = Guarded(f, 300, lambda: now[0])
    chain = Chain(g, HashingProvider(32))
    assert chain.embed(["a b"])[0] is not None and not g.healthy and g.reason == "runtime error"
    assert g.embed(["a"]) == [None] and f.calls == 1
    now[0] = 301.0
    assert g.healthy and g.embed(["a"]) == [None] and f.calls == 2
    p = Guarded(Failing(RuntimeError("no Permission to read")), 300, lambda: now[0])
    p.embed(["a"])
    now[0] = 1e12
    assert not p.healthy and p.reason == "permission denied"


def test_providers_by_language(spark):
    r = Registry({"en": HashingProvider(32), "fr": HashingProvider(48, "fr")})
    df = spark.createDataFrame([("a b", "en"), ("c d", "fr"), ("e", "de"), (" ", "fr"), (None, None)], "content string, lang string")
    got = [(r["vector"] and len(r["vector"]), r["vector_language"]) for r in embedded_by_language(df, r, "lang").collect()]
    assert got == [(32, "en"), (48, "fr"), (32, "en"), (None, None), (None, None)]
    assert r.available("fr") and not r.available("de") and r.of("de") is r.providers["en"]


def test_summaries(spark):
    chunks = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y")], "doc_id string, chunk_index int, content string")
    said = spark.createDataFrame([("d", 0, "about x")], "doc_id string, chunk_index int, summary string")
    assert sorted((r["chunk_index"], r["previous_summary"]) for r in with_summaries(chunks, said).collect()) == [(0, None), (1, "about x")]


def test_disabled(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/off", config=EngineConfig(enabled=False))
    e.index(rows(spark, ("a", "t", "quiz", "", "text")))
    assert e.documents.count() == 0 and e.search(ask(spark, "text"), SearchConfig()).count() == 0


def test_sql(spark):
    register(spark)
    r = spark.sql("select text_tokens('It is the END') as t, estimate_tokens('12345') as n, vector_cosine(array(1D, 0D), array(1D, 1D)) as c, content_hash('a') = content_hash('a') as h").first()
    assert r["t"] == ["the", "end"] and r["n"] == 2 and round(r["c"], 6) == 0.707107 and r["h"]
    text = "One sentence of this text. Another one follows it here."
    spark.createDataFrame([(1, text)], "doc_id long, text string").createOrReplaceTempView("texts")
    assert spark.sql("select w.* from texts, lateral window_chunks(text) w").count() == 2
    assert spark.sql("select s.content from texts, lateral sentence_chunks(text, 'standard') s").first()["content"] == text
    assert spark.sql("select c.estimated_tokens from texts, lateral token_chunks(text, 'default') c").first()[0] == 14


def test_legacy_file(spark, tmp_path):
    old = [{"id": "c1", "documentId": "d", "content": "x", "index": 0, "startOffset": 0, "endOffset": 1, "createdAt": "2024-01-02T03:04:05Z", "embedding": [0.5, 1.0]}, {"documentId": "d", "content": "y", "index": 1, "startOffset": 1, "endOffset": 2, "embedding": []}]
    (tmp_path / "chunks.json").write_text(json.dumps(old))
    chunks, vectors = read_legacy(spark, f"file://{tmp_path}/chunks.json")
    assert sorted(r["chunk_id"] for r in chunks.collect()) == ["c1", "chunk_d_1"] and chunks.where("chunk_id = 'c1'").first()["created_at"].year == 2024
    assert [r["vector"] for r in vectors.collect()] == [[0.5, 1.0]]


def test_providers(spark):
    class Never:
        info = HashingProvider(4).info

        def embed(self, texts):
            return [None] * len(texts)

    df = spark.createDataFrame([("same words",), ("same words",), (" ",), (None,)], "content string")
    got = [r["vector"] for r in embedded(df, Chain(Never(), HashingProvider(4))).collect()]
    assert got[0] == got[1] is not None and got[2:] == [None, None]
    words = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [9.0])], "text_id int, place int, vector array<float>")
    assert [round(x, 6) for x in mean_vectors(words).first()["vector"]] == [0.333333, 0.333333]
    assert F is not None
