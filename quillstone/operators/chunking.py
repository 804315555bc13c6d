"""Chunkers: one text to many chunks with places in the text.

Sentences are runs up to and with ``.``, ``!`` or ``?`` and the white space behind them; together they are the text. Slices and
estimates are plain expressions. The packing chunkers carry state along a text of any length, so they run in Arrow batches.
Offsets are code points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.config import CHARS_PER_TOKEN, LONGEST_SENTENCE, SHORTEST_SENTENCE, SentenceChunkConfig, TokenChunkConfig, WindowChunkConfig
from quillstone.functions.text import has_text, word_count

SENTENCE = re.compile(r"[^.!?]*[.!?]*\s*")
_LETTERS = re.compile(r"[^\W_]+")
SPANS = "sentence_index int, start_offset int, end_offset int, sentence string"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start()]


def exploded(df: DataFrame, make: Callable[[str], list[tuple]], schema: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of df and those of schema, a row for each tuple that make gives for a row's text; a null text is an empty one."""
    fields = [f.split()[0].strip() for f in re.sub(r"<[^>]*>", "", schema).split(",")]
    n_keep = len(keep)
    out_schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), schema])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(out_schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [make(t.as_py() or "") for t in part.column(n_keep)]
                at = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64())
                flat = [r for rows in made for r in rows]
                columns = [part.column(c).take(at) for c in range(n_keep)]
                columns += [pa.array([r[f] for r in flat], arrow.field(n_keep + f).type) for f in range(len(fields))]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, out_schema)


def split_sentences(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """sentence_index, start_offset, end_offset, sentence; an empty or null text has none."""
    return exploded(df, lambda t: [(i, a, b, t[a:b]) for i, (a, b) in enumerate(sentence_spans(t))], SPANS, text_col, keep)


def slice_starts(n: Column, config: WindowChunkConfig) -> Column:
    """Where slices of max_chars begin over n characters, overlap apart from the end of each to the start of the next."""
    step = config.max_chars - config.overlap if config.overlap else config.max_chars
    many = F.when(n <= config.max_chars, 1).otherwise(F.ceil((n - config.max_chars) / step).cast("int") + 1)
    if config.max_chunks is not None:
        many = F.least(many, F.lit(config.max_chunks + 1))
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: i * step)


def naive_slices(df: DataFrame, config: WindowChunkConfig = WindowChunkConfig(), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Slices of equal size, and one more of all that remains beyond the ceiling. Texts without a letter or digit have none."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(has_text(t)).select(*keep, t.alias("t"), F.length(t).alias("n"))
    rows = rows.select(*keep, "t", "n", F.posexplode(slice_starts(F.col("n"), config)).alias("chunk_index", "start_offset"))
    rows = rows.withColumn("end_offset", F.least(F.col("n"), F.col("start_offset") + config.max_chars))
    if config.max_chunks is not None:
        last = (F.col("chunk_index") == config.max_chunks) & (F.col("end_offset") < F.col("n"))
        both = F.array(F.struct("chunk_index", "start_offset", "end_offset"), F.struct((F.col("chunk_index") + 1).alias("chunk_index"), F.col("end_offset").alias("start_offset"), F.col("n").alias("end_offset")))
        one = F.slice(both, 1, 1)
        rows = rows.select(*keep, "t", F.inline(F.when(last, both).otherwise(one)))
    content = F.substring(F.col("t"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return rows.select(*keep, "chunk_index", "start_offset", "end_offset", content.alias("content")).withColumn("word_count", word_count(F.col("content")))


# Overlapping sentence windows.


def window_spans(text: str, config: WindowChunkConfig) -> list[tuple[int, int]]:
    if config.max_chars <= 0 or not _LETTERS.search(text):
        return []
    spans, size, overlap = sentence_spans(text), config.max_chars, config.overlap
    limit = math.inf if config.max_chunks is None else config.max_chunks
    step = size - overlap if overlap else size

    def sliced(low: int, high: int) -> list[tuple[int, int]]:
        out, at = [], low
        while True:
            out.append((at, min(at + size, high)))
            if at + size >= high:
                return out
            at += step

    found: list[tuple[int, int]] = []
    first = last = 0
    while first < len(spans):
        last = max(last, first)
        while last + 1 < len(spans) and spans[last + 1][1] - spans[first][0] <= size:
            last += 1
        low, high = spans[first][0], spans[last][1]
        if last == first and high - low > size:
            found += sliced(low, high)
            first += 1
            continue
        found.append((low, high))
        if not config.suffix_cascade and last == len(spans) - 1:
            break
        if overlap:
            back = max(low, high - overlap)
            new = last
            while new > first and spans[new][0] > back:
                new -= 1
            first = max(first + 1, new)
        else:
            first = last + 1
        if len(found) > limit:
            break
    if not found or len(found) > limit:
        found = sliced(0, len(text))
        if len(found) > limit + 1:
            found = found[: int(limit) + 1]
    if found[-1][1] < len(text):
        found.append((found[-1][1], len(text)))
    return found


def _count_words(text: str) -> int:
    return sum(1 for _ in _LETTERS.finditer(text))


def window_chunks(df: DataFrame, config: WindowChunkConfig = WindowChunkConfig(), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Windows of whole sentences up to max_chars that overlap; a longer sentence is sliced.

    After the window that reaches the end the start still moves on, a sentence at a time, and each gives a suffix, unless
    suffix_cascade is off. Above the ceiling the text is sliced instead.
    """
    return exploded(df, lambda t: [(i, a, b, t[a:b], _count_words(t[a:b])) for i, (a, b) in enumerate(window_spans(t, config))], schemas.WINDOW_CHUNK, text_col, keep)


# Sentence chunks.


def tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text).replace("...", ".").replace("..", ".").strip()


def _shortened(sentence: str) -> list[str]:
    if len(sentence) <= LONGEST_SENTENCE:
        return [sentence]
    parts, line = [], ""
    for word in sentence.split():
        if line and len(line) + 1 + len(word) > LONGEST_SENTENCE:
            parts.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [p for p in [*parts, line] if len(p) >= SHORTEST_SENTENCE]


def clean_sentences(text: str) -> list[str]:
    text = tidy(text)
    found = [s for s in (text[a:b].strip() for a, b in sentence_spans(text)) if len(s) >= SHORTEST_SENTENCE]
    if not found:
        found = [s for s in map(str.strip, re.split("[.!?]", text)) if len(s) >= SHORTEST_SENTENCE]
    return [p for s in found for p in _shortened(s)]


def packed(sizes: list[int], config: SentenceChunkConfig, budget: int) -> list[list[int]]:
    """[first sentence, number of sentences, sentences before it that no earlier chunk was merged with] of each chunk."""
    chunks: list[list[int]] = []
    at = 0
    while at < len(sizes):
        n, chars = 0, 0
        while at + n < len(sizes) and n < config.per_chunk:
            more = sizes[at + n] + (1 if chars else 0)
            if n and chars + more > budget:
                break
            n, chars = n + 1, chars + more
        if n < config.least and at + n < len(sizes) and chunks:
            chunks[-1][1] += n
        else:
            chunks.append([at, n])
        at += n
    return chunks


def sentence_chunk_rows(text: str, config: SentenceChunkConfig) -> list[tuple]:
    sentences = clean_sentences(text)
    if not sentences:
        return []
    sizes = [len(s) for s in sentences]
    if len(sizes) <= config.per_chunk and sum(sizes) + len(sizes) - 1 <= config.max_chars:
        chunks = [[0, len(sizes)]]
    else:
        chunks = packed(sizes, config, config.max_chars)
        if len(chunks) > config.max_chunks:
            chunks = packed(sizes, config, int(config.max_chars * (len(chunks) / config.max_chunks) * 1.1))
    rows = []
    for i, (at, n) in enumerate(chunks):
        content = " ".join(sentences[at : at + n])
        before = " ".join(sentences[max(0, at - config.overlap) : at]) if i and config.overlap else None
        rows.append((i, sentences[at : at + n], content, n, at, at + n - 1, before, math.ceil(len(content) / CHARS_PER_TOKEN)))
    return rows


def sentence_chunks(df: DataFrame, config: SentenceChunkConfig = SentenceChunkConfig(), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks of whole sentences by count and budget; the sentences before a chunk are its context, not its content.

    A pack of fewer than least sentences that isn't the last joins the chunk before it. If there are more chunks than
    max_chunks, they are packed once more with a larger budget.
    """
    return exploded(df, lambda t: sentence_chunk_rows(t, config), schemas.SENTENCE_CHUNK, text_col, keep)


def estimated_chunks(sentences: Column, config: SentenceChunkConfig) -> Column:
    """Number of chunks expected of an array of sentences, 1 for none."""
    n, chars = F.size(sentences), F.length(F.array_join(sentences, " "))
    mean = F.floor(chars / F.greatest(F.lit(1), n))
    fit = F.greatest(F.lit(1), F.floor(F.lit(config.max_chars) / F.greatest(F.lit(1), mean)))
    step = F.greatest(F.lit(1), F.least(F.lit(config.per_chunk), fit) - config.overlap)
    many = F.least(F.lit(config.max_chunks), F.greatest(F.lit(1), F.ceil(n / step)))
    return F.when((n <= config.per_chunk) & (chars <= config.max_chars), 1).otherwise(many).cast("int")


# Token-budget chunks. A chunk is [content, start, end, tokens].


def _tokens(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN)


def overlap_tail(text: str, config: TokenChunkConfig) -> str:
    """The last characters of text, from after their last period if something follows it; empty if the text is no longer."""
    size = int(config.overlap_tokens * CHARS_PER_TOKEN)
    if len(text) <= size:
        return ""
    tail = text[len(text) - size :]
    head, dot, rest = tail.rpartition(".")
    return rest.strip(" \t") if dot and rest else tail


def tidy_lines(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"[ \t]{2,}", " ", text).strip()


def _pieces(text: str, pattern: str) -> list[tuple[str, int]]:
    """Trimmed pieces with the place where each begins."""
    out = []
    for m in re.finditer(pattern, text):
        if piece := m.group().strip():
            out.append((piece, m.start() + len(m.group()) - len(m.group().lstrip())))
    return out


def _made(content: str, start: int, end: int) -> list:
    return [content, start, end, _tokens(content)]


def _packed_pieces(pieces: list[tuple[str, int]], config: TokenChunkConfig, joint: str, cost: int, alone: bool) -> list[list]:
    """Pieces packed up to the budget, each chunk headed by the tail of the one before. alone: a piece beyond the budget is a chunk of its own."""
    out: list[list] = []
    content, start, end, tail = "", 0, 0, ""

    def headed(piece: str) -> str:
        return tail + joint + piece if tail else piece

    for piece, at in pieces:
        if alone and _tokens(piece) > config.max_tokens:
            if content:
                out.append(_made(content, start, end))
                tail = overlap_tail(content, config)
            out.append(_made(headed(piece), at, at + len(piece)))
            content, tail = "", overlap_tail(piece, config)
        elif content and _tokens(content) + _tokens(piece) + cost > config.max_tokens:
            out.append(_made(content, start, end))
            tail = overlap_tail(content, config)
            content, start, end = headed(piece), at, at + len(piece)
        elif content:
            content, end = content + joint + piece, at + len(piece)
        else:
            content, start, end, tail = headed(piece), at, at + len(piece), ""
    if content:
        out.append(_made(content, start, end))
    return out


def token_chunk_rows(text: str, config: TokenChunkConfig) -> list[tuple]:
    text = tidy_lines(text)
    if not text:
        return []
    if _tokens(text) <= config.max_tokens:
        chunks = [_made(text, 0, len(text))]
    else:
        chunks = _packed_pieces(_pieces(text, r"[^\n]+"), config, "\n\n", 10, True)
        finer: list[list] = []
        for c in chunks:
            if c[3] <= config.max_tokens:
                finer.append(c)
                continue
            shift = c[2] - len(c[0])  # what heads a chunk comes from before it
            inner = _packed_pieces(_pieces(c[0], SENTENCE.pattern), config, " ", 2, False)
            finer += [[x, max(0, shift + a), max(0, shift + b), n] for x, a, b, n in inner]
        size, step = int(config.max_tokens * CHARS_PER_TOKEN), max(1, int((config.max_tokens - config.overlap_tokens) * CHARS_PER_TOKEN))
        chunks = []
        for c in finer:
            if c[3] <= config.max_tokens:
                chunks.append(c)
                continue
            at = 0
            while True:
                part = c[0][at : at + size]
                shift = c[2] - len(c[0])
                chunks.append(_made(part, max(0, shift + at), max(0, shift + at + len(part))))
                if at + size >= len(c[0]):
                    break
                at += step
        chunks = _merged(chunks, config)
    return [(i, x, n, a, b) for i, (x, a, b, n) in enumerate(chunks)]


def _merged(chunks: list[list], config: TokenChunkConfig) -> list[list]:
    """A chunk under the least size takes those behind it while their tokens sum up to the budget at most."""
    if len(chunks) < 2:
        return chunks
    out: list[list] = []
    held: list | None = None
    for c in chunks:
        if held is not None and held[3] + c[3] <= config.max_tokens:
            held = [held[0] + "\n\n" + c[0], held[1], c[2], held[3] + c[3]]
            continue
        if held is not None:
            out.append(held)
        held = c if c[3] < config.least_tokens else None
        if held is None:
            out.append(c)
    return out if held is None else [*out, held]


def token_chunks(df: DataFrame, config: TokenChunkConfig = TokenChunkConfig(), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks of at most max_tokens of four characters: by lines, then sentences, then slices; small ones merged.

    Offsets are places in the tidied text that a chunk's own part comes from; the tail of the chunk before, which heads it, isn't counted.
    """
    return exploded(df, lambda t: token_chunk_rows(t, config), schemas.TOKEN_CHUNK, text_col, keep)


def with_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Token chunks (doc_id, chunk_index, ...) with previous_summary: what summaries (doc_id, chunk_index, summary) say of the chunk before; null for the first, and where nothing is said."""
    before = summaries.select("doc_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("summary").alias("previous_summary"))
    return chunks.join(before, ["doc_id", "chunk_index"], "left")
