"""Invariants and worked examples of the chunkers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.config import SENTENCE_PRESETS, TOKEN_PRESETS, SentenceChunkConfig, WindowChunkConfig
from quillstone.operators.chunking import clean_sentences, overlap_tail, sentence_chunk_rows, sentence_chunks, sentence_spans, tidy, token_chunk_rows, window_chunks, window_spans

REPEATED = "x" * 50 + ". "
SHORT = "The mitochondria make most of a cell's energy. " + "They have a double membrane and their own DNA. " + "Their number differs from one tissue to the next."


def test_windows_of_nothing():
    for text in ("", "   \n\t ", "...!?"):
        assert window_spans(text, WindowChunkConfig()) == []
    assert window_spans("One short sentence.", WindowChunkConfig(1000)) == [(0, 19)]
    assert window_spans("text", WindowChunkConfig(0)) == []


def test_suffix_cascade():
    assert window_spans(REPEATED * 30, WindowChunkConfig()) == [(0, 884), (728, 1560), (1404, 1560), (1456, 1560), (1508, 1560)]
    assert window_spans(REPEATED * 30, WindowChunkConfig(suffix_cascade=False)) == [(0, 884), (728, 1560)]
    assert [len(window_spans(SHORT, WindowChunkConfig())), len(window_spans(SHORT, WindowChunkConfig(suffix_cascade=False)))] == [3, 1]


def test_unbroken_text_is_sliced():
    spans = window_spans("a" * 4000, WindowChunkConfig(500, 0.2))
    assert len(spans) == 10 and spans[-1] == (3600, 4000) and all(b - a <= 500 for a, b in spans)
    spans = window_spans("Hello world. " * 100, WindowChunkConfig(200))
    assert (len(spans), spans[0], spans[-1]) == (12, (0, 195), (1287, 1300))


def test_ceiling():
    spans = window_spans(REPEATED * 20000, WindowChunkConfig())
    assert len(spans) == 402 and spans[-1] == (306900, 1040000)
    spans = window_spans(REPEATED * 20000, WindowChunkConfig(max_chunks=None))
    assert max(b - a for a, b in spans) <= 900 and spans[-1][1] == 1040000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n1é", max_size=400), st.integers(5, 60), st.sampled_from([0.0, 0.15, 0.5]))
def test_windows_cover_without_gaps(text, size, ratio):
    spans = window_spans(text, WindowChunkConfig(size, ratio))
    assert sentence_spans(text) == [] or sentence_spans(text)[-1][1] == len(text)
    if spans:
        assert spans[0][0] == 0 and max(b for _, b in spans) == len(text)
        assert all(a < b for a, b in spans)
        reach = 0
        for a, b in spans:
            assert a <= reach
            reach = max(reach, b)


def counts(text, config):
    return [r[3] for r in sentence_chunk_rows(text, config)]


def test_sentence_packing():
    assert counts(REPEATED * 30, SENTENCE_PRESETS["standard"]) == [6] * 5
    assert counts(REPEATED * 30, SENTENCE_PRESETS["dense"]) == [4] * 7 + [2]
    assert counts(REPEATED * 100, SentenceChunkConfig(max_chars=100, max_chunks=5)) == [99, 1]
    rows = sentence_chunk_rows(REPEATED * 50, SentenceChunkConfig(max_chars=500))
    assert len(rows) == 13 and all(len(r[2]) <= 207 for r in rows)
    assert len(sentence_chunk_rows(REPEATED * 1000, SENTENCE_PRESETS["standard"])) == 167
    assert counts("", SentenceChunkConfig()) == counts(" \n\t", SentenceChunkConfig()) == []


def test_sentence_rows_hang_together():
    rows = sentence_chunk_rows(REPEATED * 50, SENTENCE_PRESETS["standard"])
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert rows[0][6] is None and all(r[6] for r in rows[1:])
    for r in rows:
        assert r[2] == " ".join(r[1]) and r[5] - r[4] + 1 == r[3] == len(r[1]) and r[7] == -(-len(r[2]) // 4)


def test_tidying():
    assert tidy("a\r\nb\rc\nd  e... f.. g") == "a b c d e. f. g"
    assert all(len(s) <= 500 for s in clean_sentences("word " * 500))
    assert clean_sentences("Short. Long enough this one.") == ["Long enough this one."]


def test_token_chunks():
    rows = token_chunk_rows("a" * 5000, TOKEN_PRESETS["foundation"])
    assert [(n, a, b) for _, _, n, a, b in rows] == [(500, 0, 2000), (500, 1760, 3760), (370, 3520, 5000)]
    assert [r[1] for r in token_chunk_rows(" a  b\r\n\r\n\r\n\r\nc ", TOKEN_PRESETS["default"])] == ["a b\n\nc"]
    assert token_chunk_rows("", TOKEN_PRESETS["default"]) == []
    text = "\n".join("Sentence number %d of this paragraph has some words. " % i * 9 for i in range(40))
    rows = token_chunk_rows(text, TOKEN_PRESETS["aggressive"])
    assert all(0 <= a <= b for *_, a, b in rows) and [r[0] for r in rows] == list(range(len(rows)))
    assert all(n <= 350 for _, _, n, _, _ in rows)


def test_overlap_tail():
    config = TOKEN_PRESETS["foundation"]
    assert overlap_tail("a" * 240, config) == ""
    assert overlap_tail("b" * 300 + ". tail here", config) == "tail here"
    assert overlap_tail("c" * 300 + ".", config) == "c" * 239 + "."


@pytest.mark.parametrize("make", [window_chunks, sentence_chunks])
def test_frames(spark, make):
    df = spark.createDataFrame([(1, SHORT, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, extra string")
    assert {r["doc_id"] for r in make(df).collect()} == {1}
    assert "extra" in make(df, keep=("doc_id", "extra")).columns
    assert make(df.limit(0)).count() == 0
