"""Operator 2, n-gram Jaccard join by chosen paths.

Texts are sets of word shingles. In each of several runs a text goes down a path of sampled tokens: at a node it chooses, by the
node's random order of all tokens, the first that it holds, so two texts choose the same one with the probability of their
Jaccard similarity. A node whose bucket is small is a leaf; a larger one is split by the next token, ``DEPTH`` times at most.
Within leaves all texts are compared, first by their sampled tokens, then exactly by their sets. Runs are repeated as often as it takes for
a pair at the threshold to meet in a leaf of the deepest level with the probability ``RECALL``.

Equal texts are one text, with its number of copies. A pair that meets in several runs counts in the first. What leaves put out
is a row for a text and not for a pair: how many links it gained and the least text that it hangs together with, so a
group of thousands of near copies makes no more rows than it has texts.

A leaf that tokens can't split holds texts that are nearly the same. They are first held against the shingles that most of a
sample of the leaf share, its consensus P. Of texts i and j that share a and b shingles with P at least a + b - |P| are common
to both; where that is enough for a link whatever the pair, the texts are a family: all of them are linked, and counting them is
all there is to do. What is left of the leaf is compared with each other and with the families, in tiles that different tasks
take; so the work on a family grows with its size and not with its square.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm._shared import documents, mix, stored, window_hashes, word_hashes

SHINGLE, THRESHOLD, RECALL, DEPTH = 5, 0.8, 0.99999, 3
#: Texts in a leaf above which a node is split; texts of a tile's side; texts of a larger leaf that its consensus comes from.
LEAF, TILE, SAMPLE = 256, 512, 128
#: Marks by which documents are left out before their texts are shuffled: rows of a broadcast, at most.
MARKS = 1 << 21
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - THRESHOLD**DEPTH))
TOKENS = RUNS * DEPTH
#: Sampled tokens by which two texts of a leaf are held against each other before their sets are.
CHECKED = min(30, TOKENS)
_MULTIPLIERS = np.random.default_rng(4711).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's runs of size words, as sorted hashes; of fewer words, all of them are one run; of none, none."""
    words = word_hashes(text)
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else words


def sampled(tokens: np.ndarray, n: int = TOKENS) -> np.ndarray:
    """The first token of a set in each of n random orders, as 32 bits of its rank; -1 for an empty set."""
    if not len(tokens):
        return np.full(n, -1, dtype=np.int32)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(tokens), 1 << 14):
        part = mix(tokens[k : k + (1 << 14), None] * _MULTIPLIERS[None, :n])
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least) >> np.uint64(33)).astype(np.int32)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and 128 bits that tell texts apart; a null text is an empty one."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), t.alias("text"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [sampled(shingles(t.as_buffer().to_pybytes())) for t in batch.column("text")]
        flat = pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.int32)]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TOKENS), flat)], names=["doc_id", "k1", "k2", "tokens"])


def _same(values: np.ndarray) -> np.ndarray:
    return values[:, None] == values[None, :]


def _fresh(table: pa.Table) -> np.ndarray:
    """Pairs of a tile, as a matrix, which are to be compared here: from its two sides, of no common family, and not met in an earlier run (leaves)."""
    run, side, family = table.column("run")[0].as_py(), table.column("side").to_numpy(), table.column("family").to_numpy()
    leaves = np.array(table.column("leaves").to_pylist(), dtype=np.int64).reshape(table.num_rows, run)
    pairs = ~np.eye(len(side), dtype=bool) if table.column("a")[0] == table.column("b")[0] else ~_same(side)
    pairs &= ~(_same(family) & (family != 0)[:, None])
    for r in range(run):
        pairs &= ~(_same(leaves[:, r]) & (leaves[:, r] != 0)[:, None])
    return pairs


_TILE = "leaf long, a int, b int, run int, side int, family long, k1 long, k2 long, leaves array<long>"


def _plausible(table: pa.Table) -> pa.Table:
    """The texts of a tile that share enough sampled tokens with one to be compared. At the threshold fewer come about twice in a million pairs."""
    tokens = np.array(table.column("tokens").to_pylist(), dtype=np.int32).reshape(table.num_rows, CHECKED)
    agree = np.zeros((len(tokens), len(tokens)), dtype=np.int8)
    for t in range(CHECKED):
        agree += _same(tokens[:, t])
    need = math.floor(CHECKED * THRESHOLD - 5 * math.sqrt(CHECKED * THRESHOLD * (1 - THRESHOLD)))
    mask = ((agree >= need) & _fresh(table)).any(axis=1)
    out = table.filter(pa.array(mask)).select([f.split()[0] for f in _TILE.split(", ")])
    return out.set_column(out.num_columns - 1, "leaves", out.column("leaves").cast(pa.list_(pa.int64())))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of sets share."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], column[keep]
    found, column = np.unique(column, return_inverse=True)
    out, width = np.zeros((n, n), dtype=np.float32), 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, len(found), width):
        low, high = np.searchsorted(column, [c, c + width])
        block = np.zeros((n, width), dtype=np.float32)
        block[owner[low:high], column[low:high] - c] = 1
        out += block @ block.T
    return out


def _linked(table: pa.Table) -> pa.Table:
    """For each text of a tile with links of at least THRESHOLD: how many, and the least text that it hangs together with here."""
    k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), dtype="<u8") for s in table.column("set")]
    size, shared = np.array([len(s) for s in sets]), _shared(sets)
    links = (shared >= THRESHOLD * (size[:, None] + size[None, :] - shared) - 1e-6) & (size > 0)[:, None] & _fresh(table)
    order = np.lexsort((k2, k1))
    rank = np.empty(len(k1), dtype=np.int64)
    rank[order] = np.arange(len(k1))
    label = rank.copy()
    while True:
        near = np.where(links, label[None, :], len(k1)).min(axis=1)
        lower = np.minimum(label, near)
        lower = np.minimum(lower, lower[order[lower]])
        if (lower == label).all():
            break
        label = lower
    n = links.sum(axis=1)
    at = np.flatnonzero(n)
    root = order[label[at]]
    return pa.table({"k1": k1[at], "k2": k2[at], "links": n[at].astype(np.int64), "r1": k1[root], "r2": k2[root]})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_buffer().to_pybytes()).astype("<u8").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(sets, pa.binary())], names=["k1", "k2", "set"])


def _leaves(texts: DataFrame) -> DataFrame:
    """leaf, size, run, k1, k2: of each run, where a text isn't alone."""
    paths = []
    for level in range(1, DEPTH + 1):
        chosen = [F.element_at("tokens", F.col("run") * DEPTH + (k + 1)) for k in range(level)]
        paths.append(F.xxhash64(F.col("run"), *chosen).alias(f"p{level}"))
    rows = texts.where(F.element_at("tokens", 1) >= 0).select("k1", "k2", "tokens", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run")).select("k1", "k2", "run", *paths)
    done = None
    for level in range(1, DEPTH + 1):
        path = f"p{level}"
        # Stored, so that Spark can split a path that many texts go in the join that follows.
        sizes = stored(rows.groupBy(path).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "join-sizes")
        # Few rows share a node with another text; stored, they serve both the leaves and the next level.
        rows = stored(rows.join(sizes, path), "join-nodes")
        leaf = rows.where(F.col("size") <= LEAF) if level < DEPTH else rows
        leaf = leaf.select(F.col(path).alias("leaf"), "size", "run", "k1", "k2")
        done = leaf if done is None else done.unionAll(leaf)
        if level < DEPTH:
            rows = rows.where(F.col("size") > LEAF).drop("size", path)
    return done


def _sets_of(base: DataFrame, texts: DataFrame) -> DataFrame:
    """k1, k2, set of texts (k1, k2, rep), from the one document of base that each is named after.

    Documents whose mark no text has aren't moved. The marks are MARKS numbers at most, whatever the input; where texts have
    them all, the join alone decides.
    """
    texts = stored(texts, "join-wanted")
    mark = lambda doc_id: F.pmod(F.xxhash64("k1", doc_id), F.lit(MARKS)).cast("int").alias("mark")
    base = base.withColumn("mark", mark("doc_id")).join(F.broadcast(texts.select(mark("rep")).distinct()), "mark", "left_semi")
    same = (F.col("d.k1") == F.col("w.k1")) & (F.col("d.k2") == F.col("w.k2")) & F.col("d.doc_id").eqNullSafe(F.col("w.rep"))
    one = base.alias("d").join(texts.alias("w"), same, "left_semi").dropDuplicates(["k1", "k2", "doc_id"])
    return one.select("k1", "k2", "text").mapInArrow(_sets, "k1 long, k2 long, set binary")


def _agreed(table: pa.Table) -> pa.Table:
    """The shingles that more than half of a leaf's sample have, as bytes, and a hash of them: leaves that agree on them have one family."""
    sets = [np.frombuffer(s.as_buffer(), dtype="<u8") for s in table.column("set")]
    found, times = np.unique(np.concatenate(sets), return_counts=True)
    most = found[2 * times > len(sets)]
    family = int.from_bytes(hashlib.blake2b(most.tobytes(), digest_size=8).digest(), "little", signed=True) or 1
    return pa.table({"leaf": table.column("leaf").slice(0, 1), "family": pa.array([family], pa.int64()), "agreed": pa.array([most.astype("<u8").tobytes()], pa.binary())})


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (k1, k2, family, set, agreed) those that are linked with all others of their family."""
    for batch in batches:
        keep = []
        for own, agreed in zip(batch.column("set"), batch.column("agreed"), strict=True):
            own, agreed = (np.frombuffer(x.as_buffer(), dtype="<u8") for x in (own, agreed))
            at = np.searchsorted(agreed, own)
            both = int((agreed[np.minimum(at, max(len(agreed) - 1, 0))] == own).sum()) if len(agreed) else 0
            # t (n + m - c) <= c for c = a + b - p common ones: so it is for any two with (1 + t) a - t n >= (1 + t) p / 2.
            keep.append(len(agreed) > 0 and 2 * ((10 + _TENTHS) * both - _TENTHS * len(own)) >= (10 + _TENTHS) * len(agreed))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["k1", "k2", "family"])


_TENTHS = round(THRESHOLD * 10)


def _families(base: DataFrame, texts: DataFrame, leaves: DataFrame) -> DataFrame | None:
    """k1, k2, family of texts in leaves of more than TILE: any two of a family are linked. None if there is no such leaf."""
    large = leaves.where(F.col("size") > TILE)
    if large.isEmpty():
        return None
    home = large.groupBy("k1", "k2").agg(F.min_by("leaf", "run").alias("leaf"))
    home = stored(home.join(texts.select("k1", "k2", "rep"), ["k1", "k2"]), "join-homes")
    sets = stored(_sets_of(base, home), "join-home-sets")
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("k1", "k2"), "k1", "k2"))
    some = home.select("leaf", "k1", "k2").withColumn("place", place).where(F.col("place") <= SAMPLE).join(sets, ["k1", "k2"])
    agreed = stored(some.groupBy("leaf").applyInArrow(_agreed, "leaf long, family long, agreed binary"), "join-agreed")
    rows = home.join(agreed, "leaf").join(sets, ["k1", "k2"]).select("k1", "k2", "family", "set", "agreed")
    return stored(rows.mapInArrow(_close, "k1 long, k2 long, family long"), "join-families")


def _sides(rows: DataFrame) -> DataFrame:
    """rows (leaf, size, family, k2, ...) with the tiles (a, b) that each is compared in, and its side of them.

    A leaf of more than TILE texts has sides of about TILE texts each; a family of so many has sides of its own, which aren't
    compared with each other.
    """
    large = rows.where(F.col("size") > TILE).groupBy("leaf", "family").agg(F.count(F.lit(1)).alias("m"))
    large = stored(large.withColumn("group", F.when(F.col("m") >= TILE, F.col("family")).otherwise(0).cast("long")), "join-groups")
    groups = large.groupBy("leaf", "group").agg(F.ceil(F.sum("m") / TILE).cast("int").alias("sides"))
    of = Window.partitionBy("leaf")
    groups = groups.withColumn("first", (F.sum("sides").over(of.orderBy("group")) - F.col("sides")).cast("int")).withColumn("all", F.sum("sides").over(of).cast("int"))
    layout = stored(large.select("leaf", "family", "group").join(groups, ["leaf", "group"]), "join-layout")
    rows = rows.join(layout, ["leaf", "family"], "left").na.fill({"group": 0, "sides": 1, "first": 0, "all": 1})
    apart = (F.col("group") != 0) & (F.col("family") != 0)
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda y: ~apart | (y < F.col("first")) | (y >= F.col("first") + F.col("sides")))
    rows = rows.withColumn("side", (F.col("first") + F.pmod(F.xxhash64("k2"), F.col("sides"))).cast("int")).withColumn("other", F.explode(others))
    return rows.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it hangs together with) for the nodes of edges (u, v), by alternating stars until nothing changes."""
    both = lambda e: e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges, last = stored(edges.where("u <> v").distinct(), "components"), None
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        small = small.join(least, "u")
        edges = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    nodes = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _key(a: str, b: str) -> Column:
    return F.concat_ws(":", F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def classes(docs: DataFrame) -> DataFrame:
    """A row for each text of docs (doc_id, text): k1, k2, rep (its least doc_id), copies, n_links, class_id.

    n_links: other texts whose similarity is at least THRESHOLD. class_id: the least doc_id of the texts that hang together by
    links. Null ids are least of none; a text whose ids are all null has the rep null. Null and empty texts are one text
    without links; extra columns are ignored; an empty table gives no rows.
    """
    base = keyed(docs)
    signed = base.mapInArrow(_signed, "doc_id long, k1 long, k2 long, tokens array<int>")
    texts = stored(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens")), "join-texts")
    leaves = stored(_leaves(texts), "join-leaves")
    met = leaves.groupBy("k1", "k2").agg(F.collect_list(F.struct("leaf", "run", "size")).alias("at"))
    met = met.withColumn("of", F.map_from_entries(F.transform("at", lambda x: F.struct(x["run"], x["leaf"]))))
    met = met.join(texts.select("k1", "k2", F.slice("tokens", 1, CHECKED).alias("tokens")), ["k1", "k2"])
    all_leaves = F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.coalesce(F.try_element_at("of", r), F.lit(0).cast("long")))
    rows = met.select("k1", "k2", "tokens", all_leaves.alias("leaves"), F.explode("at").alias("l"))
    rows = rows.select("k1", "k2", "tokens", F.slice("leaves", F.lit(1), F.col("l.run")).alias("leaves"), "l.*")
    families = _families(base, texts, leaves)
    rows = rows.withColumn("family", F.lit(0).cast("long")) if families is None else rows.join(families, ["k1", "k2"], "left").na.fill({"family": 0})
    rows = _sides(rows).select("leaf", "a", "b", "run", "side", "family", "k1", "k2", "leaves", "tokens")
    tiles = stored(rows.groupBy("leaf", "a", "b").applyInArrow(_plausible, _TILE), "join-tiles")
    sets = _sets_of(base, tiles.select("k1", "k2").distinct().join(texts.select("k1", "k2", "rep"), ["k1", "k2"]))
    full = tiles.join(sets, ["k1", "k2"]).groupBy("leaf", "a", "b")
    links = stored(full.applyInArrow(_linked, "k1 long, k2 long, links long, r1 long, r2 long"), "join-links")
    if families is not None:
        sizes = families.groupBy("family").agg((F.count(F.lit(1)) - 1).alias("links"), F.min(F.struct("k1", "k2")).alias("r")).where("links > 0")
        of_family = families.join(stored(sizes, "join-family-sizes"), "family")
        links = links.unionByName(of_family.select("k1", "k2", "links", F.col("r.k1").alias("r1"), F.col("r.k2").alias("r2")))
    together = components(links.select(_key("k1", "k2").alias("u"), _key("r1", "r2").alias("v")))
    counted = links.groupBy("k1", "k2").agg(F.sum("links").alias("n_links")).withColumn("node", _key("k1", "k2")).join(together, "node", "left")
    rooted = texts.drop("tokens").join(counted.select("k1", "k2", "n_links", "root"), ["k1", "k2"], "left").withColumn("root", F.coalesce("root", _key("k1", "k2")))
    ids = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    return rooted.join(ids, "root").select("k1", "k2", "rep", "copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class_id")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row of docs; n_copies counts the rows with the same text, itself included."""
    found = classes(docs)
    return keyed(docs).drop("text").join(found, ["k1", "k2"]).select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, for each class: that with the class's least doc_id."""
    found = stored(classes(docs), "join-classes")
    kept = found.groupBy("class_id", F.when(F.col("class_id").isNull(), _key("k1", "k2")).alias("alone")).agg(F.min(F.when(F.col("rep").eqNullSafe(F.col("class_id")), F.struct("k1", "k2"))).alias("k"))
    kept = kept.select(F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"), F.col("class_id").alias("kept_id"))
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), F.col("doc_id").cast("long").alias("id"))
    same = (F.col("r.k1") == F.col("k.k1")) & (F.col("r.k2") == F.col("k.k2")) & F.col("r.id").eqNullSafe(F.col("k.kept_id"))
    return rows.alias("r").join(kept.alias("k"), same, "left_semi").dropDuplicates(["k1", "k2", "id"]).select("rec.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links at a Jaccard similarity of 0.8 over shingles of five words."""
    return similar(documents(spark, sf_dir))
