"""Scalar functions on cases that the tables don't hold."""

from pyspark.sql import functions as F

from quillstone.config import CONTEXT_HEADER, SearchConfig
from quillstone.functions import text as T
from quillstone.functions import vectors as V
from quillstone.operators.context import formatted


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_white_space(spark):
    assert one(spark, T.strip_ws(F.col("a")), a="\n\t a b \r\n") == "a b"
    assert one(spark, T.normalized_hash(F.col("a")), a=" A\n\nb ") == one(spark, T.normalized_hash(F.col("a")), a="a b")


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("a")), a="It's the ÉCOLE-21, no: the end_ing") == ["the", "école", "the", "end", "ing"]
    assert one(spark, T.tokens(F.col("a")), a="") == []


def test_expansion(spark):
    assert one(spark, T.expanded(F.col("a")), a="show how") == ["show how", "smethod method", "sprocess process"]
    assert one(spark, T.expanded(F.col("a")), a="plain") == ["plain"]
    assert len(one(spark, T.expanded(F.col("a")), a="learn study explain example")) == 4


def test_keyword_score(spark):
    score = lambda q, c: one(spark, T.keyword_score(T.tokens(F.col("q")), T.tokens(F.col("c"))), q=q, c=c)
    assert score("cell", "cell " + "word " * 199) == 2 / 3
    assert score("cell", "cell " + "word " * 9) == 1.0
    assert score("cell", "") == score("", "cell") == score("cell", "nothing here") == 0.0


def test_rerank(spark):
    final = lambda q, c, i: one(spark, T.rerank_score(F.lit(0.8), F.col("q"), T.term_overlap(T.tokens(F.col("q")), T.tokens(F.col("c"))), F.col("c"), F.lit(i)), q=q, c=c)
    half = "alpha " + "x" * 294
    assert round(final("alpha beta", half, 0), 9) == 0.85
    assert round(final("alpha beta", half, 10), 6) == 0.566667
    assert round(final("alpha", "alpha " + "x" * 74, 0), 9) == 0.96


def test_identifiers(spark):
    doc_id, strategy = T.canonical_id(F.col("a"), F.lit("document"), F.col("b"))
    assert one(spark, F.struct(doc_id, strategy), a=" id ", b="p")[:] == ("id", "explicit")
    assert one(spark, F.struct(doc_id, strategy), a=" ", b="")[:] == (None, None)
    assert one(spark, doc_id, a=" ", b=" p ").startswith("document_")


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, V.cosine(v(1, 0), v(0, 2))) == 0.0
    assert one(spark, V.cosine(v(1, 0), v(1))) is None and one(spark, V.cosine(v(0, 0), v(1, 0))) is None
    assert one(spark, V.unit(v(3, 4))) == [0.6, 0.8] and one(spark, V.unit(v(0, 0))) is None
    assert one(spark, V.quantized(v(-1, 0, 1), F.lit(-1.0), F.lit(1.0))) == [0, 127, 255]


def test_context(spark):
    rows = F.array(F.struct(F.lit(1).alias("rank"), F.lit("ai_note").alias("source_type"), F.lit("A").alias("title"), F.lit("word " * 100).alias("content")))
    got = one(spark, formatted(rows, 200, True))
    assert got["text"].startswith(CONTEXT_HEADER + "[Notes: A]\n") and got["text"].endswith("word...\n\n") and got["printed"] == 1
    assert one(spark, formatted(rows, 90, True))["printed"] == 0


def test_head_is_no_less_than_coarse():
    for k in (1, 6, 20, 100):
        assert SearchConfig(top_k=k).head >= SearchConfig(top_k=k).coarse > k


def test_language(spark, sf):
    assert one(spark, T.detected_language(F.col("a")), a="12 34") == "en"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 300")
    right = docs.where(T.detected_language(F.col("text")) == F.col("lang")).count()
    assert right >= 0.8 * docs.count()


def test_language_goes_through_the_words_once(spark):
    """Each language's count went through all words, and again for each comparison: a plan with 13 filters or more over the split text."""
    df = spark.createDataFrame([("the and of le les",), ("le les the and",), ("nothing known",), ("",), (None,), ("\u3072",), ("\u6f22",), ("der die und THE",)], "text string")
    got = df.select(T.detected_language(F.col("text")).alias("l"))
    assert [r["l"] for r in got.collect()] == ["en", "en", "en", "en", "en", "ja", "zh-Hans", "de"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
