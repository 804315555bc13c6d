"""Token files and media: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import media, token_store
from quillstone.llm._shared import documents
from quillstone.llm.token_store import load, op5_token_store, read_tokens, spans, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens(spark, sf):
    plain = Tokenizer.from_file(PATH)
    docs = sorted((r["doc_id"], r["text"]) for r in documents(spark, sf).collect())
    got = {r["doc_id"]: r for r in op5_token_store(spark, sf).collect()}
    start = 0
    for i, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def held(texts):
    """Asserts that the encoder's ids are the library's for each text, all encoded in one call."""
    plain, encoder = Tokenizer.from_file(PATH), token_store.Encoder(load(PATH), 0)
    ids, at = encoder(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


def test_encoder_gives_the_librarys_ids():
    random.seed(3)
    parts = ["a", " ", "  ", "\n", "\t", "é", "it's ", "12", "<|endoftext|>", "\xa0", "日本", " the", "\r\n", "!", "_", "\x1c", "\u200b", "<|end", "oftext|>", " x", ""]
    for _ in range(150):
        held(["".join(random.choices(parts, k=random.randint(0, 15))) for _ in range(20)])


@pytest.mark.parametrize("n", [(1 << 20) - 1, 1 << 20, (1 << 20) + 1, (1 << 21) + 30])
def test_texts_of_a_mebibyte_and_more(n):
    held(["ab " * (n // 3) + "x" * (n % 3), "q w"])
    held(["s " * (n // 2 - 9) + "word" * 12])  # the last word lies across the boundary
    held(["w\xa0 x y " + "v " * (n // 2)])


def test_one_unbroken_word():
    held(["u" * ((1 << 20) + 1), "a", ""])


def complement(text):
    return text.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_take_for_one_another():
    word, words = "a", []
    for n in range(1, 13):
        word += complement(word)
        words += [word] if n > 9 else []
    held([" ".join([*words, *map(complement, words), *words]), "x " + " ".join(map(complement, words))])


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 50)
    for k in range(12):
        held([" ".join(f"w{r}" for r in range(k * 40, k * 40 + 60)), "again the same words"])


def test_units_that_calls_have_in_common_are_remembered(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 200)
    plain, asked = Tokenizer.from_file(PATH), []

    class Asked:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(w for text in texts for w in text.split())
            return plain.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder = token_store.Encoder(plain, 0)
    encoder.tokenizer = Asked()
    early, late = [f"early{k}" for k in range(210)], [f"late{k}" for k in range(60)]
    for words in [early, *([*early[:60], *late, *(f"once{r}x{k}" for k in range(20))] for r in range(12))]:
        text = " ".join(["Words", *words])
        ids, _ = encoder([text])
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]
    assert sum(w.startswith("late") for w in asked) <= 2 * len(late)
    assert len(encoder.kept[3][0]) <= 200


def test_units_are_remembered_over_strings_and_forgotten_in_part(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 40)
    monkeypatch.setattr(token_store, "JOINED", 7)
    random.seed(5)
    for _ in range(60):
        held([" ".join(random.choices(["über", "a.b", "it's", "日本", "x" * 60, *(f"w{random.randint(0, 90)}" for _ in range(30))], k=40)) for _ in range(3)])


def test_tokens_edges(spark, tmp_path):
    rows = [(5, "b"), (None, None), (2, ""), (2, "twice"), (2, "twice"), (9, "x " * 50_000), (-1, "é\u0000z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    path = str(tmp_path / "t")
    write_tokens(df.repartition(3), PATH, path)
    tokens = read_tokens(spark, path)
    got = sorted(spans(tokens).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -1, 2, 2, 2, 5, 9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0 and got[0]["n_tokens"] == 1
    plain = Tokenizer.from_file(PATH)
    back = {r["doc_id"]: plain.decode(r["ids"][:-1]) for r in tokens.where("doc_id in (5, 9, -1)").collect()}
    assert back == {i: t for i, t in rows if i in back}
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)" in tokens.where("doc_id = 5")._jdf.queryExecution().toString().replace("In(doc_id, [5])", "EqualTo(doc_id,5)")
    empty = str(tmp_path / "e")
    write_tokens(df.limit(0), PATH, empty)
    assert spans(read_tokens(spark, empty)).count() == 0


def payload(text):
    raw = (text or "").encode()
    return raw, raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))


def test_media(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    rows = media.op4_media(spark, sf).collect()
    assert len(rows) == len(docs)
    seen = {}
    for r in rows:
        raw, full = payload(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        image = media.to_png(full)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert (r["position"], r["n_items"], r["before"], r["after"]) == (1, 3, "Text as an image", "End") and r["caption"] == f"{len(raw)} bytes"
        assert seen.setdefault(raw, r["feature"]) == r["feature"]


def test_png():
    for n in (1, 7):
        raw = bytes(np.random.default_rng(n).integers(0, 256, 576 * n, dtype=np.uint8))
        assert media.from_png(media.to_png(raw)).tobytes() == raw
    bad = bytearray(media.to_png(raw))
    bad[40] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(bad))
    with pytest.raises(ValueError):
        media.from_png(b"GIF89a")


def test_sequence():
    html = '<title>T</title><p>One<script>no()</script> two <b>three</b></p><figure><img src="a.png" alt="alt"><figcaption>Cap &amp; tion</figcaption></figure><p>after</p><img src="urn:sha256:abc" alt="B"><img><p>'
    items = media.parse(html)
    assert [(i["kind"], i.get("text") or i.get("caption")) for i in items] == [("text", "T One two three"), ("media", "Cap & tion"), ("text", "after"), ("media", "B")]
    assert items[3]["digest"] == "abc" and items[1]["digest"] == hashlib.sha256(b"a.png").hexdigest()
    assert media.parse(None) == media.parse("") == media.parse("<p> </p>") == []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<figure><img src="a"><figcaption>c<p>x</figure>behind', [("media", "c x"), ("text", "behind")]),
        ("<figure><pre>code</pre><figcaption>Listing 1</figcaption></figure>after", [("text", "code Listing 1 after")]),
        ("a<figcaption>left open <b>b</b>", [("text", "a left open b")]),
        ('<figure><img src="a"><figcaption>one</figcaption><img src="b"></figure>', [("media", "one"), ("media", None)]),
        ('<figcaption>of no figure</figcaption><img src="a" alt="A">', [("text", "of no figure"), ("media", "A")]),
    ],
)
def test_no_text_is_lost(html, want):
    assert [(i["kind"], i.get("text") or i.get("caption")) for i in media.parse(html)] == want


def test_media_hold_the_text_beside_them(spark):
    pages = spark.createDataFrame([(1, '<p>x y</p><img src="a"><img src="b"><p>z</p>')], "page_id long, html string")
    rows = sorted(media.sequences(pages).collect(), key=lambda r: r["position"])
    assert [(r["kind"], r["before"], r["after"], r["n_items"]) for r in rows] == [("text", None, None, 4), ("media", "x y", None, 4), ("media", None, "z", 4), ("text", None, None, 4)]


def test_resolving(spark, sf):
    pages = spark.createDataFrame([(1, '<p>x</p><img src="urn:sha256:d1"><img src="urn:sha256:d2"><img src="urn:sha256:gone">', 0), (2, None, 0), (1, "", 0)], "page_id long, html string, position int")
    stored = spark.createDataFrame([("d1", media.to_png(b"\x01" * 576)), ("d1", media.to_png(b"\x01" * 576)), ("d2", b"damaged")], "digest string, media binary")
    rows = sorted(media.resolved(media.sequences(pages), media.described(stored)).collect(), key=lambda r: r["position"])
    assert [(r["position"], r["kind"], r["payload_bytes"], r["media_bytes"]) for r in rows] == [(0, "text", None, None), (1, "media", 576, rows[1]["media_bytes"]), (2, "media", None, 7), (3, "media", None, None)]
    real = spark.read.parquet(f"{sf}/pages.parquet")
    assert media.sequences(real).select("page_id").distinct().count() == real.count()
    assert media.sequences(real.limit(0)).count() == 0


def test_media_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "ü" * 1000, 1), (2, "ü" * 1000, 1)], "doc_id long, text string, html int")
    media.store_texts(df, str(tmp_path / "m"))
    kept = spark.read.parquet(str(tmp_path / "m"))
    found = media.resolved(media.sequences(kept.select("page_id", "html")).where("kind = 'media'"), media.described(kept.where(F.col("media").isNotNull())))
    assert sorted(((r["page_id"] or 0, r["n_bytes"]) for r in found.collect())) == [(0, 2000), (1, 0), (1, 0), (2, 2000)]
