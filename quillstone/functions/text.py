"""Text functions as Column expressions; all run inside generated code or as built-in functions, none in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import CHARS_PER_TOKEN, FREQUENT_WORDS, MAX_EXPANSIONS, SOURCE_LABELS, SUPPORTED_LANGUAGES, SYNONYMS

NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def strip_ws(c: Column) -> Column:
    """Without white space, line ends included, at either end; trim() takes blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def normalized_hash(c: Column) -> Column:
    """Of the text in lower case with single blanks: equal for texts that differ in those alone."""
    return content_hash(F.lower(F.regexp_replace(strip_ws(c), r"\s+", " ")))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, marks and digits, of three characters at least; repeated ones stay."""
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda x: F.length(x) > 2)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def has_text(c: Column) -> Column:
    """Whether there is a letter or digit."""
    return F.rlike(c, F.lit(r"[\p{L}\p{N}]"))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(CHARS_PER_TOKEN)).cast("int")


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(F.lit("chunk_"), doc_id.cast("string"), F.lit("_"), index.cast("string"))


def canonical_id(explicit: Column, source_type: Column, path: Column) -> tuple[Column, Column]:
    """(doc_id, strategy): the trimmed explicit id; else type and hash of type and trimmed path; else nulls."""
    given, where = F.nullif(strip_ws(explicit), F.lit("")), F.nullif(strip_ws(path), F.lit(""))
    hashed = F.concat(source_type, F.lit("_"), content_hash(F.concat(source_type, F.lit("|"), where)))
    strategy = F.when(given.isNotNull(), "explicit").when(hashed.isNotNull(), "source_path_hash")
    return F.coalesce(given, hashed), strategy


def cache_key(language: Column, strategy: Column, text: Column) -> Column:
    """By which a text's vector can be kept: language, strategy and the first 256 characters."""
    return F.concat_ws("|", language, strategy, F.left(text, F.lit(256)))


def search_key(query: Column, top_k: Column, min_score: Column, expand: Column, hybrid: Column, filters: Column) -> Column:
    """By which a search's results can be kept: a hash of the query in lower case with single blanks, the parameters (no least score: -1), and the filters (a map) by name."""
    entries = F.array_sort(F.transform(F.map_entries(filters), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    flag = lambda c: F.when(c, "1").otherwise("0")
    normal = F.lower(F.regexp_replace(strip_ws(query), r"\s+", " "))
    parts = [normal, F.concat(F.lit("k="), top_k.cast("string")), F.concat(F.lit("min="), F.coalesce(min_score, F.lit(-1.0)).cast("string"))]
    parts += [F.concat(F.lit("qe="), flag(expand)), F.concat(F.lit("hy="), flag(hybrid)), F.concat(F.lit("f="), F.coalesce(F.array_join(entries, "&"), F.lit("")))]
    return content_hash(F.concat_ws("|", *parts))


def source_label(source_type: Column) -> Column:
    out = F.initcap(source_type)
    for name, label in SOURCE_LABELS.items():
        out = F.when(source_type == name, label).otherwise(out)
    return out


def language_supported(lang: Column) -> Column:
    return lang.isin(*SUPPORTED_LANGUAGES)


def detected_language(c: Column) -> Column:
    """The language whose frequent words a text holds most of, the first in FREQUENT_WORDS' order if several do.

    With none of them: Japanese if there is kana, Chinese if there are Han characters, else en. A text's words are gone through
    once, whatever the languages: what is counted for each is the frequent words that are left.
    """
    frequent = sorted({w for some in FREQUENT_WORDS.values() for w in some})
    words = F.filter(F.split(F.lower(c), NOT_WORD), lambda x: x.isin(*frequent))
    count = lambda w, some: F.size(F.filter(w, lambda x: x.isin(*some)))
    counts = bound(words, lambda w: F.array(*[count(w, some) for some in FREQUENT_WORDS.values()]))
    script = F.when(F.rlike(c, F.lit(r"[\p{IsHiragana}\p{IsKatakana}]")), "ja").when(F.rlike(c, F.lit(r"\p{IsHan}")), "zh-Hans").otherwise("en")
    names = F.array(*[F.lit(lang) for lang in FREQUENT_WORDS])
    return bound(counts, lambda n: F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))).otherwise(script))


def truncated(c: Column, budget: Column) -> Column:
    """Cut to budget characters at the last blank, and dots; a text that fits stays as it is."""
    cut = F.left(c, budget.cast("int"))
    at_blank = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(c) > budget, F.concat(at_blank, F.lit("..."))).otherwise(c)


def expanded(query: Column) -> Column:
    """The query and what it becomes with synonyms put for its words: MAX_EXPANSIONS different texts at most, in order.

    A word is replaced wherever its letters occur, within longer words as well, whatever their case.
    """
    table = F.create_map(*[x for word, (a, b) in SYNONYMS.items() for x in (F.lit(word), F.array(F.lit(a), F.lit(b)))])
    pairs = F.flatten(
        F.transform(
            F.filter(tokens(query), lambda w: F.map_contains_key(table, w)),
            lambda w: F.transform(F.element_at(table, w), lambda s: F.struct(w.alias("w"), s.alias("s"))),
        )
    )
    # Words in the table are letters alone, so they are patterns as they stand.
    grown = F.aggregate(
        pairs,
        F.array(query),
        lambda acc, p: F.array_distinct(F.concat(acc, F.array(F.regexp_replace(query, F.concat(F.lit("(?i)"), p["w"]), p["s"])))),
    )
    return F.slice(grown, 1, MAX_EXPANSIONS)


def bm25(tf: Column, n_terms: Column) -> Column:
    """A matching term's part of the score: constant inverse document frequency 2, average length 200, k1 1.5, b 0.75."""
    return F.lit(2.0) * tf * F.lit(2.5) / (tf + F.lit(1.5) * (F.lit(0.25) + F.lit(0.75) * n_terms / F.lit(200.0)))


def bm25_total(parts: Column, n_query_terms: Column) -> Column:
    """Of the sum of parts and the number of the query's terms, repeated ones counted; 1 at most."""
    return F.least(F.lit(1.0), parts / (n_query_terms * F.lit(3.0)))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, computed once though f uses it often or within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def keyword_score(query_tokens: Column, content_tokens: Column) -> Column:
    """The BM25-like score of one row, for the few rows whose query and content stand side by side."""
    n, k = F.size(content_tokens), F.size(query_tokens)
    common = bound(F.array_distinct(query_tokens), lambda terms: F.filter(content_tokens, lambda x: F.array_contains(terms, x)))
    of_term = lambda m, t: bm25(F.size(F.filter(m, lambda x: x == t)).cast("double"), n)
    parts = bound(common, lambda m: F.aggregate(F.array_distinct(m), F.lit(0.0), lambda acc, t: acc + of_term(m, t)))
    return F.when((k == 0) | (n == 0), 0.0).otherwise(bm25_total(parts, k))


def term_overlap(query_tokens: Column, content_tokens: Column) -> Column:
    """The share of the query's different terms that the content has."""
    return F.size(F.array_intersect(query_tokens, content_tokens)) / F.greatest(F.lit(1), F.size(F.array_distinct(query_tokens)))


def rerank_score(score: Column, query: Column, overlap: Column, content: Column, index: Column) -> Column:
    """Overlap (the share of the query's different terms that the content has), then place in the document, then length, then the whole query as a phrase."""
    n = F.length(content)
    size = F.when(n < 100, 0.9).when(n > 500, 0.95).otherwise(1.0)
    phrase = F.when(F.contains(F.lower(content), F.lower(query)), 0.15).otherwise(0.0)
    return (score + overlap * F.lit(0.1)) * (F.lit(1.0) / (F.lit(1.0) + index * F.lit(0.05))) * size + phrase
