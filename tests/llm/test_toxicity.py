"""The toxicity models against a plain Kneser-Ney in Python, and on held-out documents."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import toxicity
from quillstone.llm.toxicity import BITS, DISCOUNT, ORDER, fit, held_out, letter_codes, op7_toxicity, ordinary, ratios, scored


def grams(text):
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = " " * (ORDER - 1) + word + " "
        out += [padded[i : i + ORDER] for i in range(len(word) + 1)]
    return out


def code(gram):
    return sum((0 if c == " " else ord(c)) << (BITS * (ORDER - 1 - i)) for i, c in enumerate(gram))


def test_codes():
    for text in ("", "a", "Hello, wörld! 12 x", "ab\tc"):
        codes, blank = letter_codes(text)
        got = [c for c, b, prev in zip(codes.tolist(), blank, [True, *blank], strict=False) if not (b and prev)]
        assert got == [code(g) for g in grams(text)]
    assert len(letter_codes("日本")[0]) == 3 and len(letter_codes(None)[0]) == 1


def plain_ratios(toxic, common):
    """The same models, written down with dictionaries."""
    counts = {"t": Counter(toxic), "o": Counter(common)}
    kinds, levels = set(toxic) | set(common), {}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = Counter(g[-k:] for g in kinds)
        kinds = set(levels[k])

    def lower(g):
        if not g:
            return 1 / (1 << BITS)
        same = [x for x in levels[len(g)] if x[:-1] == g[:-1]]
        total = sum(levels[len(g)][x] for x in same)
        return (max(levels[len(g)][g] - DISCOUNT, 0) + DISCOUNT * len(same) * lower(g[1:])) / total

    out = {}
    for g in set(toxic) | set(common):
        p = {}
        for c, n in counts.items():
            same = [x for x in n if x[:-1] == g[:-1]]
            total = sum(n[x] for x in same)
            p[c] = (max(n[g] - DISCOUNT, 0) + DISCOUNT * len(same) * lower(g[1:])) / total if total else lower(g[1:])
        out[code(g)] = math.log(p["t"] / p["o"])
    return out


def test_kneser_ney(spark):
    r = random.Random(1)
    toxic, common = (sum((grams(" ".join("".join(r.choices(a, k=r.randint(1, 6))) for _ in range(60))) for _ in range(2)), []) for a in ("abc", "bcd"))
    both = [(code(g), float(toxic.count(g)), float(common.count(g))) for g in set(toxic) | set(common)]
    seen, contexts = ratios(spark.createDataFrame(both, "code long, toxic double, ordinary double"))
    got = {x["code"]: x["ratio"] for x in seen.collect()}
    want = plain_ratios(toxic, common)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert contexts.count() == len({c >> BITS for c in got})


def plain_features(text, seen, counts):
    """A document's features by dictionaries of the counted grams: each word's sum of ratios, unseen grams by their context's backoff weights."""

    def weight(context, c):
        same = [x for x in counts[c] if x[:-1] == context]
        total = sum(counts[c][x] for x in same)
        return DISCOUNT * len(same) / total if total else 1.0

    contexts = {g[:-1] for n in counts.values() for g in n}
    words = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        ratio = 0.0
        for g in grams(word):
            ratio += seen[code(g)] if code(g) in seen else math.log(weight(g[:-1], "t") / weight(g[:-1], "o")) if g[:-1] in contexts else 0.0
        words.append(ratio)
    if not words:
        return [0.0] * 5
    top = sorted(words, reverse=True)[:3]
    return [sum(words) / len(words), top[0], sum(top) / len(top), sum(w > 3 for w in words) / len(words) ** 0.5, math.log1p(len(words))]


def test_scores_against_plain_python(spark):
    r = random.Random(4)
    make = lambda a: " ".join("".join(r.choices(a, k=r.randint(1, 7))) for _ in range(12))
    rows = [(i, make("abcx" if i % 4 == 0 else "abcd")) for i in range(120)]
    labels = [(i, int(i % 4 == 0)) for i in range(120)]
    crc = lambda i: zlib.crc32(str(i).encode())
    learnt = [i for i in range(120) if crc(i) % 4 != 2]
    counted = [i for i in learnt if crc(i) % 16 < 12]
    toxic, common = (sum((grams(rows[i][1]) for i in counted if labels[i][1] == c), []) for c in (1, 0))
    seen, counts = plain_ratios(toxic, common), {"t": Counter(toxic), "o": Counter(common)}
    model = fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fitted = [i for i in learnt if crc(i) % 16 >= 12]
    x, y = np.array([plain_features(rows[i][1], seen, counts) for i in fitted]), np.array([labels[i][1] for i in fitted], dtype=float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(6)
    for _ in range(20000):  # gradient ascent on the ridge-penalised likelihood
        w += 0.02 * (z.T @ (y - 1 / (1 + np.exp(-z @ w))) - w)
    for text in [rows[0][1], rows[1][1], "abc unseen zzz", "", make("abcx")]:
        logit = np.append((np.array(plain_features(text, seen, counts)) - mean) / scale, 1.0) @ w
        want = 1 / (1 + math.exp(-np.clip(logit, -30, 30)))
        assert math.isclose(model.score(text), want, abs_tol=2e-4)


def corpus(n=900):
    r = random.Random(5)
    common = ["".join(r.choices("aeiou" + "bcdfgl", k=r.randint(2, 7))) for _ in range(300)]
    insults = ["scumzq", "trashvx", "wretchk", "vermjn"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 9 == 0
        w = r.choices(common, k=r.randint(20, 90))
        for _ in range(r.randint(1, 3) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(insults) + r.choice(["", "s", "en", "o"])
        rows.append((i, " ".join(w)))
        if i % 5 != 4:
            labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learnt(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(spark, learnt):
    docs, labels = learnt
    model = fit(docs, labels)
    got = scored(docs, model).withColumn("held", held_out(toxicity.F.col("doc_id"))).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    fresh = [r for r in got if r["held"] or r["doc_id"] % 5 == 4]
    right = [(r["score"] >= 0.3) == (r["doc_id"] % 9 == 0) for r in fresh]
    assert sum(right) / len(right) >= 0.95
    assert {r["doc_id"] for r in ordinary(docs, model).collect()} == {r["doc_id"] for r in got if r["score"] < 0.3}


def test_only_allowed_labels_count(spark, learnt):
    docs, labels = learnt
    turned = labels.withColumn("toxic", toxicity.F.when(held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (sorted(map(tuple, scored(docs, fit(docs, x)).collect())) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("held", [1 << 22, 1 << 17])
def test_every_counted_code_keeps_its_ratio(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD", held)
    seen = spark.range(1, 200_001).selectExpr("id * 1234577 as code", "double(id) as ratio")
    contexts = spark.range(1, 100_001).selectExpr("id * 7654321 as code", "double(-id) as ratio")
    table = toxicity.parts(seen, contexts)
    assert len(table.parts) == -(-300_000 // held)
    codes = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(1234577)
    shared = np.arange(1, 100_001, dtype=np.uint64) * np.uint64(7654321) << np.uint64(BITS)
    unseen = shared[~np.isin(shared, codes)]
    got = table._needed(np.concatenate([codes, unseen, [np.uint64(1 << 59)]]))
    assert (got.of(codes) == np.arange(1, 200_001)).all()
    assert (got.of(unseen) == -np.arange(1, 100_001)[~np.isin(shared, codes)]).all() and got.of(np.array([1 << 59], dtype=np.uint64))[0] == 0


def test_scores_by_parts(spark, learnt, monkeypatch):
    docs, labels = learnt
    one = fit(docs, labels)
    monkeypatch.setattr(toxicity, "HELD", 500)
    many = fit(docs, labels)
    assert len(one.ratios.parts) == 1 and len(many.ratios.parts) > 3
    a, b = (dict(map(tuple, scored(docs, m).collect())) for m in (one, many))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_toxicity_edges(spark, learnt):
    docs, labels = learnt
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "scumzq " * 20_000, 3), (1, "scumzq " * 20_000, 3), (2, "12 %% !!", 4)], "doc_id long, text string, score int")
    model = fit(docs, labels)
    rows = scored(odd, model).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r["score"])
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows) and max(by[1]) > 0.3 > min(by[1])
    assert ordinary(odd, model).columns == odd.columns
    assert scored(docs.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert all(r["score"] < 0.3 for r in scored(docs.limit(50), fit(docs, none)).collect())
    assert fit(docs.limit(0), labels).score("x") < 0.3
    twice = labels.unionAll(labels).unionAll(spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert np.isclose(fit(docs, twice).score("a scumzq"), model.score("a scumzq"))


def test_one_class_left_for_the_regression(spark, learnt):
    docs, labels = learnt
    part = toxicity.F.pmod(toxicity.crc32_id(toxicity.F.col("doc_id")), toxicity.F.lit(16))
    some = labels.where((part < 12) | (toxicity.F.col("toxic") == 0))
    got = scored(docs, fit(docs, some)).collect()
    means = [np.mean([r["score"] for r in got if (r["doc_id"] % 9 == 0) == t]) for t in (True, False)]
    assert means[0] > means[1] + 0.1


def test_held_out_quality_on_the_given_table(spark):
    """Of held-out documents with labels, at sf0.1: most toxic ones are caught, few others are."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["predicted"]) for r in op7_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, rest = [p for y, p in got if y == 1], [p for y, p in got if y == 0]
    assert len(toxic) > 20 and sum(toxic) >= 0.8 * len(toxic) and sum(rest) <= 0.03 * len(rest), (sum(toxic), len(toxic), sum(rest), len(rest))


def test_query(spark, sf):
    rows = op7_toxicity(spark, sf).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows) and len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
