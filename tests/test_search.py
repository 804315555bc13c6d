"""Search against a plain version in Python, clusters, and the index."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.config import EngineConfig, SearchConfig, WindowChunkConfig
from quillstone.functions.vectors import rounded
from quillstone.operators import ann, embedding, index
from quillstone.operators.search import best_matches, diversified, search
from quillstone.streaming.ingest import ingest


def frames(spark, n=300, q=7, d=8, seed=5):
    rng = np.random.default_rng(seed)
    chunks = [(i, rng.normal(size=d).tolist()) for i in range(n)] + [(n, [0.0] * d), (n + 1, None), (n + 2, [1.0])]
    queries = [(i, rng.normal(size=d).tolist()) for i in range(q)]
    return chunks, queries, spark.createDataFrame(chunks, "chunk_id long, vector array<double>"), spark.createDataFrame(queries, "query_id int, vector array<double>")


def test_best_matches(spark):
    chunks, queries, c, q = frames(spark)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in best_matches(q, c.repartition(5), 9, block=3).collect()}
    for i, v in queries:
        scores = [(-max(0.0, round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9)), k) for k, w in chunks[:300]]
        assert [got[i, r] for r in range(1, 10)] == [k for _, k in sorted(scores)[:9]]
    assert best_matches(q.limit(0), c, 3).count() == 0 and best_matches(q, c.limit(0), 3).count() == 0


def test_ties_and_floor(spark):
    c = spark.createDataFrame([(i, [-1.0, 0.0]) for i in range(20)], "chunk_id long, vector array<double>").repartition(4)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert sorted((r["rank"], r["chunk_id"], r["score"]) for r in best_matches(q, c, 3).collect()) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]


def test_diversify(spark):
    def run(rows, k):
        df = spark.createDataFrame([(1, i + 1, d, c) for i, (d, c) in enumerate(rows)], "query_id int, rank int, document_id string, content string")
        return [r["content"] for r in sorted(diversified(df, k).collect(), key=lambda r: r["rank"])]

    assert run([("a", "1"), ("a", "2"), ("a", "3"), ("b", "4"), ("a", "5")], 3) == ["1", "2", "4"]
    assert run([("a", "1"), ("a", "2"), ("a", "3"), ("b", "4"), ("a", "5")], 5) == ["1", "2", "3", "4", "5"]
    assert run([("a", "x"), ("b", " X "), ("b", "y")], 3) == ["x", "y"]
    assert run([("a", "x"), ("a", "x")], 3) == ["x", "x"]


def test_disabled_and_unknown(spark):
    c = spark.createDataFrame([("c1", "d1", 0, "text", "note", [1.0, 0.0])], "chunk_id string, document_id string, chunk_index int, content string, source_type string, vector array<double>")
    q = spark.createDataFrame([(1, "text", [1.0, 0.0])], "query_id int, text string, vector array<double>")
    assert search(q, c, engine=EngineConfig(enabled=False)).count() == 0
    docs = spark.createDataFrame([], "document_id string, source_type string, title string")
    assert search(q, c, docs).first()["source_type"] == "unknown"
    assert search(q, c, source_types=("other",)).count() == 0
    assert search(q, c, config=SearchConfig(hybrid=False, min_score=1.1)).count() == 0


def test_recall_of_clusters(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")).cache()
    q = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    centers = ann.fitted(chunks)
    assert len(centers) <= ann.CLUSTERS
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster_id int, centroid array<double>")
    labelled = ann.assigned(chunks, centers)
    assert labelled.count() == chunks.count() and labelled.where("cluster_id is null").count() == 0
    pairs = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    exact, found = pairs(best_matches(q, chunks, 6)), pairs(ann.clustered_matches(q, labelled, table, 6, ann.THOROUGH))
    assert len(exact & found) >= 0.9 * len(exact)


def test_texts_are_fetched_for_the_head_alone(spark, sf):
    """The texts of all documents were shuffled to be joined with embeddings, and again with what was found."""
    from quillstone.operators.search import scored
    from quillstone.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        asked, corpus = catalog.asked(spark, sf), catalog.corpus(spark, sf)
        plain, fetched = scored(asked, corpus), scored(asked, corpus, content=catalog.contents(spark, sf))
        joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin [doc_id")
        assert joins(fetched) < joins(plain)
        key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "document_id", "content", "source_type", "score_final").collect()))
        assert key(plain) == key(fetched)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_are_rounded_as_in_sql(spark):
    """0.5047875 is a double just below its tie: SQL takes it down, F.round() took it up."""
    import duckdb

    values = [0.5047875, 0.5047885, 0.1234565, 0.2500005, 1.0, 0.0, -0.5047875]
    want = duckdb.execute("select [round(x::double, 6) for x in $1::double[]]", [values]).fetchall()[0][0]
    got = [r["x"] for r in spark.createDataFrame([(x,) for x in values], "x double").select(rounded("x", 6).alias("x")).collect()]
    assert got == want and got[0] == 0.504787


def test_leaders():
    centers, labels = ann.leaders(np.array([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]))
    assert labels.tolist() == [0, 0, 1] and np.allclose(centers, [[0.95, 0.05], [0, 1]])


def test_index_life(spark):
    p, now = embedding.HashingProvider(16), F.timestamp_seconds(F.lit(100))
    rows = [("a", "A", "note", "/x", "Some words here. More of them."), (" ", "B", "note", "/y", "Other words."), ("c", "C", "note", "/z", " \n "), (None, None, None, None, "No id at all.")]
    df = spark.createDataFrame(rows, "doc_id string, title string, source_type string, source_path string, text string")
    docs, chunks = index.built(df, p, now, WindowChunkConfig(suffix_cascade=False))
    ids = sorted(r["doc_id"] for r in docs.collect())
    assert "a" in ids and len(ids) == 3 and any(i.startswith("note_") for i in ids) and any(i.startswith("doc_") for i in ids)
    assert chunks.count() == 3
    assert docs.where(index.is_stale(F.col("embedding_metadata"), p.info)).count() == 0
    later = embedding.HashingProvider(32)
    assert docs.where(index.is_stale(F.col("embedding_metadata"), later.info)).count() == 3
    marked, vectors = index.refreshed(docs, chunks, later)
    assert {len(r["vector"]) for r in vectors.collect()} == {32}
    assert marked.where(index.is_stale(F.col("embedding_metadata"), later.info)).count() == 0
    assert index.deleted(chunks, docs.where("doc_id = 'a'")).where("doc_id = 'a'").count() == 0


def test_streaming(spark, tmp_path):
    schema = "doc_id string, title string, source_type string, source_path string, text string, ts timestamp"
    source = str(tmp_path / "in")
    rows = [("a", "t", "n", "p", "x", 1), ("a", "t", "n", "p", "x", 2), ("a", "t2", "n", "p", "x", 3), ("b", "t", "n", "p", "x", 4)]
    df = spark.createDataFrame(rows, "doc_id string, title string, source_type string, source_path string, text string, s long")
    df.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(source)
    got, ids = [], []
    q = ingest(spark.readStream.schema(schema).parquet(source), lambda b, n: got.extend(b.collect()), str(tmp_path / "ck"), after=lambda some: ids.extend(r["doc_id"] for r in some.collect()))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["doc_id"], r["title"]) for r in got) == [("a", "t"), ("a", "t2"), ("b", "t")] and sorted(set(ids)) == ["a", "b"]
