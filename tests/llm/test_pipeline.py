"""The pipeline: each stage on all that the one before it kept."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillstone.llm import mixing, toxicity  # noqa: E402
from quillstone.llm._shared import documents, stored  # noqa: E402
from quillstone.llm.decontamination import op3_decontamination  # noqa: E402
from quillstone.llm.ngram_join import similar  # noqa: E402
from test_copies import brute_classes, naive_tiles, plain_split  # noqa: E402
from test_sharding_mixing_secrets import filled, laws  # noqa: E402


def fixture(path, spark, seed=3):
    """Tables in which every stage has something to do, with nulls, repeated rows and columns of clashing names."""
    r = random.Random(seed)
    common = ["".join(r.choices("aeioubcdfglmnprst", k=r.randint(3, 8))) for _ in range(400)]
    insults = ["scumzq", "trashvx", "wretchk"]
    item = " ".join(r.choices(common, k=30))
    docs, labels = [], []
    for i in range(260):
        w = r.choices(common, k=r.randint(40, 80))
        if i % 8 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(insults) + r.choice(["", "s", "en"])
        if i % 8 == 1 and i > 8:
            w = docs[i - 8][1].split()[:]
            w[r.randrange(len(w))] = f"new{i}"
        if i % 29 == 3:
            w[5:5] = item.split()
        docs.append((i, " ".join(w), r.choice(["en", None]), r.choice(["a", "b", None]), i, "x", 7))
        labels.append((i, int(i % 8 == 0)))
    docs += [(500, None, "en", "a", 0, None, None), (501, "", None, None, 0, "y", 1), (502, docs[2][1], "en", "b", 0, "x", 1), (2, docs[2][1], "en", "b", 2, "x", 7), (None, "of no id at all but some words here", "en", "a", 1, "x", 7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, taken string, shard int").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() against each stage written down in plain Python over all rows; the trained model alone is the operator's."""
    fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {t: model.score(t) for t in {r[1] for r in rows}}
    left = [r for r in rows if score[r[1]] < 0.3]
    assert 10 < len(rows) - len(left) < 80
    classes = {(i, t): c for (i, t), (_, c, _, _) in zip([(r[0], r[1]) for r in left], near_classes(left), strict=True)}
    chosen = {}
    for r in left:  # of each class the row with its least id
        c = classes[r[0], r[1]]
        if r[0] == c:
            chosen.setdefault((c, None if c is not None else r[1]), r)
    kept = list(chosen.values())
    assert len(kept) < len(left) - 5
    item = plain_split(spark.read.parquet(f"{tmp_path}/benchmark.parquet").where("item_id = 1").first()["text"])
    clean = [r for r in kept if sum(x[2] for x in naive_tiles(plain_split(r[1]), item, 4)) < 0.6 * len(item)]
    assert len(clean) < len(kept)
    df = spark.createDataFrame(clean, docs.schema)
    key, tie = mixing.draws(df.drop("taken"), 23, mixing.quality(F.col("text")))
    draws = {tuple(r)[:7]: (r["__k"], r["__t"]) for r in df.withColumns({"__k": key, "__t": tie}).collect()}
    sizes = Counter()
    for r in clean:
        sizes[r[3]] += len((r[1] or "").split())
    want = Counter()
    for s, target in filled(dict(sizes)).items():
        epochs, at = int(target / sizes[s] + 1e-9) if sizes[s] else 0, 0
        for r in sorted((r for r in clean if r[3] == s), key=lambda r: draws[r]):
            n = len((r[1] or "").split())
            more = epochs < 2 and target - epochs * sizes[s] > 0 and at + n / 2 <= target - epochs * sizes[s]
            at += n
            want[r[:5]] += epochs + more if sizes[s] else 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in got) == Counter({k: n for k, n in want.items() if n})
    laws(got, 24, len(got))


def near_classes(rows):
    """brute_classes() in the order of rows."""
    found = {}
    for (i, c, links, copies), (j, t) in zip(brute_classes([(k, r[1]) for k, r in enumerate(rows)]), sorted(((k, r[1]) for k, r in enumerate(rows)), key=repr), strict=True):
        found[i] = c
    of = {}
    for k, r in enumerate(rows):
        of.setdefault(found[k], []).append(r[0])
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in of.items()}
    return [(r[0], least[found[k]], None, None) for k, r in enumerate(rows)]


def test_pipeline_of_nothing(spark, tmp_path):
    fixture(tmp_path, spark)
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(empty))
    assert out.count() == 0 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    for name in ("labels", "benchmark"):  # nothing to learn or to look for
        some = tmp_path / f"without-{name}"
        for t in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{tmp_path}/{t}.parquet")
            (df.limit(0) if t == name else df).write.parquet(f"{some}/{t}.parquet")
        assert corpus_pipeline.run(spark, str(some)).count() > 100


def test_stages(spark, sf):
    docs, before = documents(spark, sf), None
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, sf), "t")
        had, has = Counter(r["doc_id"] for r in before.collect()), Counter(r["doc_id"] for r in docs.collect())
        assert set(has) <= set(had)
        if k < 4:
            assert docs.columns == documents(spark, sf).columns
        if k == 1:
            classes = {r["doc_id"]: r["class_id"] for r in similar(before).collect()}
            assert set(has) == set(classes.values()) and max(has.values()) == 1
        if k == 2:
            dirty = {r["doc_id"] for r in op3_decontamination(spark, sf).collect()}
            assert set(has) == set(had) - dirty
        if k == 3:
            assert max(has.values()) <= 2
        if k == 4:
            assert has == had and {"shard", "slot"} <= set(docs.columns)
    whole = corpus_pipeline.run(spark, sf)
    key = lambda df: Counter((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert key(whole) == key(docs)
