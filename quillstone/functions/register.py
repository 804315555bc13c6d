"""The library's functions in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillstone import schemas
from quillstone.config import SENTENCE_PRESETS, SYNONYMS, TOKEN_PRESETS, WindowChunkConfig

SCALARS = {
    "content_hash(t STRING) RETURNS STRING": "substring(sha2(t, 256), 1, 32)",
    "normalized_hash(t STRING) RETURNS STRING": r"substring(sha2(lower(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', ''), '\\s+', ' ')), 256), 1, 32)",
    "text_tokens(t STRING) RETURNS ARRAY<STRING>": r"filter(split(lower(t), '[^\\p{L}\\p{M}\\p{N}]+'), x -> length(x) > 2)",
    "estimate_tokens(t STRING) RETURNS INT": "cast(ceil(length(t) / 4.0D) as int)",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "case when size(a) = size(b) then aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) end",
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "case when size(a) = size(b) and size(a) > 0 then try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))) end",
    "truncate_words(t STRING, n INT) RETURNS STRING": "case when length(t) <= n then t when instr(left(t, n), ' ') > 0 then concat(regexp_replace(left(t, n), ' [^ ]*$', ''), '...') else concat(left(t, n), '...') end",
    "bm25_term(tf DOUBLE, n_terms DOUBLE) RETURNS DOUBLE": "2D * tf * 2.5D / (tf + 1.5D * (0.25D + 0.75D * n_terms / 200D))",
    "quantize_vector(v ARRAY<DOUBLE>, low DOUBLE, high DOUBLE) RETURNS ARRAY<INT>": "transform(v, x -> least(255, greatest(0, cast((x - low) / (greatest(high - low, 1e-6D) / 255D) as int))))",
    "dequantize_vector(q ARRAY<INT>, low DOUBLE, high DOUBLE) RETURNS ARRAY<DOUBLE>": "transform(q, x -> x * (greatest(high - low, 1e-6D) / 255D) + low)",
}


def register(spark: SparkSession) -> None:
    """Temporary functions of SCALARS, and table functions window_chunks(text), sentence_chunks(text, preset), token_chunks(text, preset)."""
    from quillstone.operators.chunking import _count_words, sentence_chunk_rows, token_chunk_rows, window_spans

    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    pairs = ", ".join(f"'{w}', array('{a}', '{b}')" for w, (a, b) in SYNONYMS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION synonyms(w STRING) RETURNS ARRAY<STRING> RETURN try_element_at(map({pairs}), lower(w))")

    @udtf(returnType=schemas.WINDOW_CHUNK)
    class Window:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, (a, b) in enumerate(window_spans(text or "", WindowChunkConfig())):
                yield i, a, b, text[a:b], _count_words(text[a:b])

    @udtf(returnType=schemas.SENTENCE_CHUNK)
    class Sentence:
        def eval(self, text: str, preset: str) -> Iterator[tuple]:
            yield from sentence_chunk_rows(text or "", SENTENCE_PRESETS[preset])

    @udtf(returnType=schemas.TOKEN_CHUNK)
    class Token:
        def eval(self, text: str, preset: str) -> Iterator[tuple]:
            yield from token_chunk_rows(text or "", TOKEN_PRESETS[preset])

    for name, made in (("window_chunks", Window), ("sentence_chunks", Sentence), ("token_chunks", Token)):
        spark.udtf.register(name, made)
