"""Near copies, repeated passages and benchmark passages against brute force."""

import hashlib
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import ngram_join, substring_dedup
from quillstone.llm._shared import documents, window_hashes, word_hashes, word_pairs
from quillstone.llm.decontamination import Items, contaminated, decontaminated, greedy_tiles, op3_decontamination, plain_words
from quillstone.llm.ngram_join import one_of_each, op2_ngram_join, shingles, similar
from quillstone.llm.substring_dedup import ANCHOR, COVER, PERIOD, WINDOW, deduplicated, op10_substring_dedup, removed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, kinds=500):
    r = random.Random(seed)
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def test_hashes():
    assert (word_hashes("a bc\td") == word_hashes(b"a  bc d")).all() and len(word_hashes(None)) == len(word_hashes(" \n")) == 0
    a, b = word_hashes("x " + "p q r s t " * 2), word_hashes("y z " + "p q r s t")
    assert window_hashes(a, 5)[1] == window_hashes(b, 5)[2] == window_hashes(a, 5)[6]
    assert len(set(window_hashes(word_hashes(" ".join(f"v{i}" for i in range(9000))), 5).tolist())) == 8996


# Repeated passages.


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD)) and ANCHOR + PERIOD - 1 == WINDOW


def brute_repeats(docs):
    split = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + WINDOW]) for w in split for i in range(len(w) - WINDOW + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if seen[tuple(w[k : k + WINDOW])] > 1:
                gone[k : k + WINDOW] = [True] * WINDOW
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    assert sorted(map(tuple, op10_substring_dedup(spark, sf).collect()), key=repr) == brute_repeats(docs)


def complement(text):
    return text.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_take_for_one_another():
    word = "a"
    for _ in range(12):
        word += complement(word)
    both = word_pairs(f"{word} {complement(word)}")
    assert len(np.unique(both)) == 4
    a, b = (word_pairs(" ".join([*(f"x{i}" for i in range(34)), w])) for w in (word, complement(word)))
    assert (substring_dedup._pairs(a) != substring_dedup._pairs(b)).all()


def planted():
    p, docs = words(60, 1), []
    for k in range(24):
        w = words(150, 100 + k)
        docs.append((k, " ".join(w[:k] + p[: 34 + k % 4] + w[k:])))
    docs += [(100, " ".join(p + words(7, 9) + p)), (101, "\n".join(words(35, 55))), (102, "\t ".join(words(35, 55)))]
    docs += [(103, None), (None, ""), (104, "ü ü"), (105, " ".join(["same"] * 200)), (106, " ".join(["same"] * 35)), (107, " ".join(words(20_000, 77, 10**6)))]
    return docs + [(108, " ".join(words(50, 5)))] * 3


def test_planted_passages(spark, tmp_path):
    docs = planted()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, block string, hashes int").repartition(5).write.parquet(path)
    assert sorted(map(tuple, op10_substring_dedup(spark, str(tmp_path)).collect()), key=repr) == brute_repeats(docs)
    texts = deduplicated(spark.read.parquet(path)).collect()
    assert {r["text"] for r in texts if r["doc_id"] == 108} == {""} and {r["text"] for r in texts if r["doc_id"] == 104} == {"ü ü"}
    assert deduplicated(spark.read.parquet(path).limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [1, 7])
def test_rows_repeated_many_times(spark, monkeypatch, blocks):
    monkeypatch.setattr(substring_dedup, "COPIES", 3)
    p = words(40, 3)
    docs = [(1, " ".join(p))] * 50 + [(2, "too short")] * 20 + [(None, None)] * 9 + [(None, "")] * 4 + [(3, " ".join(["z", *p]))] + [(4, " ".join(words(60, 9)))] * 3 + [(5, " ".join(words(50, 11)))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, copies int")
    got = removed(df, substring_dedup._digest, substring_dedup.RESULT, 4000 // blocks).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(docs)
    assert Counter(r["doc_id"] for r in deduplicated(df).collect()) == Counter(i for i, _ in docs)


# Near copies.


def brute_classes(docs):
    ids = defaultdict(list)
    for i, t in docs:
        ids[t or ""].append(i)
    texts = list(ids)
    sets = []
    for t in texts:
        w = WORD.findall(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, t in enumerate(texts):
        known = [i for i in ids[t] if i is not None]
        least[find(k)] = min([*known, *([least[find(k)]] if least.get(find(k)) is not None else [])], default=None)
    return sorted(((i, least[find(k)], links[k], len(ids[t])) for k, t in enumerate(texts) for i in ids[t]), key=repr)


def near_copies(n=60):
    r, out = random.Random(2), []
    for g in range(6):
        base = words(120, g)
        for k in range(n // 6):
            w = list(base)
            for _ in range(k % 5):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def test_join(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    assert sorted(map(tuple, op2_ngram_join(spark, sf).collect()), key=repr) == brute_classes(docs)


def test_join_edges(spark):
    docs = [(10 + i, t) for i, t in enumerate(near_copies())] + [(1, "a b c"), (2, "a b c"), (3, "a  b\nc"), (4, None), (5, ""), (6, "a b d"), (None, "alone here now for once")]
    docs += [(7, "solo text of several words"), (7, "solo text of several words"), (8, " ".join(words(30_000, 3, 10**6)))]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, k1 string, tokens int")
    assert sorted(map(tuple, similar(df).collect()), key=repr) == brute_classes(docs)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    want = {c for _, c, _, _ in brute_classes(docs)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)
    assert similar(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2, 5, 12])
def test_tiles_of_a_large_leaf(spark, monkeypatch, tile):
    docs = list(enumerate(near_copies(90)))
    for name, value in (("LEAF", 4), ("TILE", tile)):
        monkeypatch.setattr(ngram_join, name, value)
    got = sorted(map(tuple, similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    want = brute_classes(docs)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    found, all_ = sum(x[2] for x in got), sum(x[2] for x in want)
    assert 0.98 * all_ <= found <= all_


def test_recall_on_a_large_family(spark):
    """1,500 near copies of one text, about 0.8 to 1 alike, with the operator's own constants: their links, against all pairs."""
    r, base = random.Random(9), words(140, 77, 10**6)
    docs = []
    for i in range(1500):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in docs]
    every, column = np.unique(np.concatenate(sets), return_inverse=True)
    matrix = np.zeros((len(sets), len(every)), dtype=np.float32)
    matrix[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column] = 1
    both, size = matrix @ matrix.T, np.array([len(s) for s in sets])
    want = ((both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6) & ~np.eye(len(sets), dtype=bool)).sum(1)
    got = {r["doc_id"]: r for r in similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = np.array([got[i]["n_links"] for i in range(1500)])
    assert 0.3 < want.sum() / 1500**2 < 0.99 and (found <= want).all() and found.sum() >= 0.9999 * want.sum()
    assert {r["class_id"] for r in got.values()} == {0}


def test_families_are_linked_throughout():
    """Whatever a family takes in is linked with all of it: random sets around a consensus."""
    r = np.random.default_rng(5)
    agreed = np.sort(r.integers(1, 1 << 60, 100, dtype=np.uint64))
    sets = []
    for _ in range(300):
        own = np.concatenate([r.choice(agreed, int(r.integers(80, 101)), replace=False), r.integers(1, 1 << 60, int(r.integers(0, 20)), dtype=np.uint64)])
        sets.append(np.sort(own))
    batch = pa.RecordBatch.from_pylist([{"k1": i, "k2": 0, "family": 1, "set": x.tobytes(), "agreed": agreed.tobytes()} for i, x in enumerate(sets)])
    (kept,) = ngram_join._close(iter([batch]))
    near = [set(sets[i].tolist()) for i in kept.column("k1").to_pylist()]
    assert 20 < len(near) < 250 and all(len(a & b) >= 0.8 * len(a | b) for a in near for b in near)


def test_work_on_a_family_grows_with_its_size(spark):
    """5,000 near copies of one text: no tile compares them with each other, and all of their links are counted."""
    r, base = random.Random(3), words(300, 21, 10**6)
    docs = []
    for i in range(5000):
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = f"n{r.randrange(10**12)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    seen = []
    tile = ngram_join._sides
    try:
        ngram_join._sides = lambda rows: seen.append(tile(rows)) or seen[0]
        got = similar(df).collect()
    finally:
        ngram_join._sides = tile
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 4999)}
    assert seen[0].count() < 5000 * ngram_join.RUNS


def test_shingles():
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(" ")) == 0


# Benchmark passages.


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), min_size=1, max_size=20))
def test_tiles(text, pattern):
    t, p = (word_hashes(" ".join(map(str, x))) for x in (text, pattern))
    used_t, used_p = set(), set()
    for i, j, n in greedy_tiles(t, p, 3):
        assert n >= 3 and (p[i : i + n] == t[j : j + n]).all()
        a, b = set(range(i, i + n)), set(range(j, j + n))
        assert not a & used_p and not b & used_t
        used_p |= a
        used_t |= b
    for i in range(len(p) - 2):  # nothing free is left to match
        for j in range(len(t) - 2):
            if (p[i : i + 3] == t[j : j + 3]).all():
                assert used_p & set(range(i, i + 3)) or used_t & set(range(j, j + 3))


def test_seeds_decide_like_tiling_everything():
    rng = random.Random(8)
    items = [(i, " ".join(words(25, 40 + i, 60))) for i in range(12)]
    index = Items(items)
    for k in range(150):
        text = words(80, 200 + k, 60)
        w = items[rng.randrange(12)][1].split()
        for part in (w[:9], w[9:17], w[17:]):
            at = rng.randrange(len(text))
            text[at:at] = part if rng.random() < 0.7 else []
        text = " ".join(text)
        want = set()
        for i, t in items:
            p = plain_words(t)
            if sum(n for *_, n in greedy_tiles(plain_words(text), p, 4)) >= 0.6 * len(p):
                want.add(i)
        assert {hit[0] for hit in index.find(text)} == want


def naive_tiles(t, p, least):
    """Greedy string tiling as it is defined: the longest match of free words, the first in the text and then in the pattern, one at a time."""
    free_t, free_p, tiles = [True] * len(t), [True] * len(p), []
    while True:
        best = (0, 0, 0)
        for j in range(len(t)):
            for i in range(len(p)):
                k = 0
                while i + k < len(p) and j + k < len(t) and free_p[i + k] and free_t[j + k] and p[i + k] == t[j + k]:
                    k += 1
                best = max(best, (k, -j, -i))
        k, j, i = best[0], -best[1], -best[2]
        if k < least:
            return tiles
        tiles.append((i, j, k))
        free_t[j : j + k] = free_p[i : i + k] = [False] * k


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=20))
def test_tiles_are_those_of_the_definition(text, pattern):
    t, p = (word_hashes(" ".join(map(str, x))) for x in (text, pattern))
    assert greedy_tiles(t, p, 2) == naive_tiles(t.tolist(), p.tolist(), 2)


def test_tiling_repeated_words_takes_linear_time():
    began = time.process_time()
    items = Items([(1, "same " * 400), (2, "same other " * 300)])
    assert [hit[:3] for hit in items.find("same " * 100_000)] == [(1, 400, 400)]
    assert {hit[0] for hit in items.find("same other " * 50_000 + "same " * 1000)} == {1, 2}
    assert time.process_time() - began < 20


def plain_split(text):
    """Words as the operator sees them, written apart from it: letters and digits of any script; unspaced scripts by character."""
    out, word = [], ""
    for c in (text or "").lower():
        solid = "\u0e00" <= c <= "\u0eff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff"
        if solid or not (c.isalnum() or (ord(c) > 127 and unicodedata.category(c)[0] in "LMN")):
            out += [word] if word else []
            word = ""
            out += [c] if solid else []
        else:
            word += c
    return out + ([word] if word else [])


def test_query_against_brute_force(spark, tmp_path):
    """op3's rows against tiling every document with every item."""
    r = random.Random(12)
    texts = [" ".join(words(24, 40 + i, 90)) for i in range(8)] + ["东西南北春夏秋冬天地玄黄", "the «café» isn’t open — ask “Zoë” at ten"]
    docs = []
    for k in range(60):
        text, w = words(50, 300 + k, 90), plain_split(r.choice(texts))
        parts = [w[: len(w) // 3], w[len(w) // 3 : len(w) * 2 // 3], w[len(w) * 2 // 3 :]]
        r.shuffle(parts)
        for part in parts:
            text[(at := r.randrange(len(text))) : at] = part if r.random() < 0.8 else []
        docs.append((k, " ".join(text)))
    docs += [(60, "x" + texts[8] + "y"), (61, "THE CAFÉ ISN'T OPEN, ASK ZOË AT TEN"), (62, None), (63, ""), (61, "twice: " + texts[0])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = []
    for i, text in docs:
        for k, item in enumerate(texts):
            p = plain_split(item)
            tiles = naive_tiles(plain_split(text), p, 4)
            n = sum(x[2] for x in tiles)
            if tiles and n >= 0.6 * len(p):
                want.append((i, k, len(p), n, n / len(p), len(tiles), tiles[0][2]))
    assert len(want) > 20 and {k for _, k, *_ in want} >= {8, 9}
    assert sorted(map(tuple, op3_decontamination(spark, str(tmp_path)).collect())) == sorted(want)


def test_decontamination(spark, sf):
    bench = dict(map(tuple, spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()))
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op3_decontamination(spark, sf).collect()}
    whole = {(i, k) for i, t in docs for k, item in bench.items() if " ".join(item.lower().split()) in " ".join((t or "").lower().split())}
    assert whole and whole <= got
    clean = decontaminated(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_decontamination_edges(spark):
    item = " ".join(words(40, 4))
    w = item.split()
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (None, "five words make an item")], "item_id long, text string")
    docs = [(1, "x " + item.upper().replace(" ", ", ") + " y"), (2, " ".join(w[20:] + ["between"] + w[:20])), (3, " ".join(w[:20])), (4, None), (5, ""), (1, "x " + item), (None, "Five words make; an item"), (6, "too short")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    got = Counter((r["doc_id"], r["item_id"]) for r in contaminated(df, bench).collect())
    assert got == Counter({(1, 1): 2, (2, 1): 1, (None, None): 1})
    assert sorted(r["doc_id"] for r in decontaminated(df, bench).collect()) == [3, 4, 5, 6]
    assert decontaminated(df, bench.limit(0)).count() == len(docs) and contaminated(df.limit(0), bench).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    from quillstone.llm import decontamination

    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    items = [(i, " ".join(words(12, i))) for i in range(20)]
    docs = [(i, "a b " + t) for i, t in items]
    bench, df = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((items, "item_id"), (docs, "doc_id")))
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(df, bench).collect()) == [(i, i) for i in range(20)]
    assert decontaminated(df, bench).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a"])
def test_nothing_to_find(text):
    assert Items([(1, "a b c d e")]).find(text) == []
