"""A bounded block of context from search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.config import CONTEXT_HEADER, ContextConfig
from quillstone.functions.text import source_label, strip_ws, truncated


def formatted(results: Column, max_chars: int, attribution: bool) -> Column:
    """Of an array of struct(rank, source_type, title, content), by rank: the header and an entry each while room is left."""

    def entry(acc: Column, x: Column) -> Column:
        title = F.when(F.coalesce(x["title"], F.lit("")) != "", F.concat(F.lit(": "), x["title"])).otherwise("")
        head = F.concat(F.lit("["), F.coalesce(source_label(x["source_type"]), F.lit("")), title, F.lit("]\n")) if attribution else F.lit("")
        room = F.lit(max_chars) - acc["used"] - F.length(head) - 4
        text = F.concat(head, truncated(strip_ws(x["content"]), room), F.lit("\n\n"))
        stop = acc["stop"] | (room <= 50)
        used = acc["used"] + F.length(text)
        more = F.struct(F.concat(acc["text"], text).alias("text"), used.alias("used"), (acc["printed"] + 1).alias("printed"), (used >= max_chars).alias("stop"))
        kept = F.struct(acc["text"].alias("text"), acc["used"].alias("used"), acc["printed"].alias("printed"), F.lit(True).alias("stop"))
        return F.when(stop, kept).otherwise(more)

    start = F.struct(F.lit(CONTEXT_HEADER).alias("text"), F.lit(len(CONTEXT_HEADER)).alias("used"), F.lit(0).alias("printed"), F.lit(False).alias("stop"))
    return F.aggregate(results, start, entry)


def contexts(found: DataFrame, config: ContextConfig = ContextConfig()) -> DataFrame:
    """query_id, context, source_count, printed_count, character_count, has_context, for each query that found (search()) has rows of.

    Results under min_score, of the excluded document and of other source types go, then top_k stay. source_count counts
    results, printed_count those that there was room for.
    """
    rows = found.where(F.col("score") >= config.min_score)
    if config.exclude_document is not None:
        rows = rows.where(F.col("document_id") != config.exclude_document)
    if config.source_types is not None:
        rows = rows.where(F.col("source_type").isin(*config.source_types))
    title = F.col("title") if "title" in found.columns else F.lit(None).cast("string")
    slim = F.struct("rank", "source_type", title.alias("title"), "content")
    lists = rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(slim)), 1, config.top_k).alias("results"))
    made = lists.select("query_id", F.size("results").alias("source_count"), formatted(F.col("results"), config.max_chars, config.attribution).alias("f"))
    made = made.select("query_id", strip_ws(F.col("f.text")).alias("context"), "source_count", F.col("f.printed").alias("printed_count"))
    return made.withColumn("character_count", F.length("context")).withColumn("has_context", (F.col("context") != "") & (F.col("source_count") > 0))
