"""Operator 1, sharding: a two-pass external shuffle in DataFrame operations only.

Pass one scatters records by a seeded hash into buckets that fit in memory. Pass two permutes each bucket by
Fisher-Yates. The permuted buckets, one after the other, are the shuffled order, which is cut into shards whose row counts
differ by one at most (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm._shared import crc32_text, documents, fingerprint, small, stored, without

#: Buckets whose offsets are summed in one task.
FAN = 4096
#: Copies of one record that a task makes or joins at a time.
COPIES = 4096


def _swapped(order: Column, i: Column, seed: int, bucket: Column) -> Column:
    """One step of the inside-out Fisher-Yates shuffle: i comes to a drawn place j <= i, what stood there goes to the end."""
    j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), (i + 1).cast("long")).cast("int")
    moved = F.concat(F.slice(order, F.lit(1), j), F.array(i), F.slice(order, j + 2, F.greatest(i - j - 1, F.lit(0))), F.array(F.element_at(order, j + 1)))
    return F.when(j == i, F.concat(order, F.array(i))).otherwise(moved)


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """A permutation of 0 .. n-1 (n at least 1), decided by seed and bucket alone."""
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.expr("cast(array() as array<int>)"), lambda order, i: _swapped(order, i, seed, bucket))


def _copies(counted: DataFrame) -> DataFrame:
    """A row (h1, h2, copy, many) for each copy of the rows of counted (h1, h2, m); many marks what has more than COPIES.

    Copies are made COPIES at a time; those of one record that has more are dealt to several tasks.
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {COPIES}"))).alias("part")
    few = counted.where(F.col("m") <= COPIES).select("h1", "h2", "m", F.lit(0).cast("long").alias("part"))
    many = counted.where(F.col("m") > COPIES).select("h1", "h2", "m", blocks).repartition("h1", "h2", "part")
    last = F.least(F.col("m"), (F.col("part") + 1) * COPIES)
    copy = F.explode(F.sequence(F.col("part") * COPIES + 1, last)).alias("copy")
    return few.unionAll(many).select("h1", "h2", (F.col("m") > COPIES).alias("many"), copy)


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 17, bucket_rows: int = 1024) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (0, 1, ... within the shard), in a uniformly shuffled order.

    Both passes move 128-bit hashes of the records (collected for bucket_rows of them at a time); the records move once, to
    join their places. Rows equal in every column are counted first and each copy draws a bucket of its own, so copies of one
    row never fill a bucket; nor do they meet in one task, as those of a record with more than COPIES join their places by
    COPIES. An empty table gives no rows. Nulls are values like others, in arrays and structs as well. Columns named shard or
    slot are replaced; columns of maps aren't supported. The result depends on the rows and the parameters alone, not on
    partitions, so a recomputed task gives the same. ``write_shards`` puts it into files.
    """
    docs = without(docs, "shard", "slot")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    hashes = [F.xxhash64(*[fingerprint(f.dataType, c, F.lit(s)) for f, c in zip(docs.schema.fields, cols, strict=True)]) for s in (seed, ~seed)]
    rec = docs.select(hashes[0].alias("h1"), hashes[1].alias("h2"), F.struct(*cols).alias("rec"))
    rows = docs.count()
    counted = rec.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"))
    n_buckets = max(1, -(-rows // bucket_rows))
    place = F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "copy"), F.lit(n_buckets)).alias("bucket")
    scattered = _copies(counted).select(place, F.struct("h1", "h2", "copy", "many").alias("r"))
    bucket = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    order = fisher_yates(F.size("rs"), seed, F.col("bucket"))
    bucket = stored(bucket.select("bucket", "rs", order.alias("order"), F.size("rs").cast("long").alias("n")), "sharding")
    counts = bucket.select("bucket", "n", (F.col("bucket") / FAN).cast("long").alias("g"))
    inner = counts.withColumn("before", F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n"))
    outer = counts.groupBy("g").agg(F.sum("n").alias("n"))
    outer = outer.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("base"))
    starts = inner.join(outer, "g").select("bucket", (F.col("before") + F.col("base")).alias("start"))
    at = (
        bucket.join(starts, "bucket")
        .select("start", "rs", F.posexplode("order").alias("pos", "i"))
        .select(F.expr("rs[i]").alias("r"), (F.col("start") + F.col("pos")).alias("at"))
        .withColumn("shard", F.expr(f"cast(at * {n_shards} div {max(rows, 1)} as int)"))
        .withColumn("slot", F.expr(f"at - (cast(shard as bigint) * {rows} + {n_shards - 1}) div {n_shards}"))
    )
    once = rec.dropDuplicates(["h1", "h2"])
    few = once.join(at.where("not r.many").select("r.h1", "r.h2", "shard", "slot"), ["h1", "h2"]).select("rec.*", "shard", "slot")
    heavy = small(counted.where(F.col("m") > COPIES), "sharding-heavy")
    if heavy.isEmpty():
        return few
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {COPIES}"))).alias("part")
    dealt = rec.join(heavy, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("m").alias("m"), F.first("rec").alias("rec")).select("h1", "h2", "rec", parts)
    places = at.where("r.many").select("r.h1", "r.h2", F.expr(f"(r.copy - 1) div {COPIES}").alias("part"), "shard", "slot")
    return few.unionAll(dealt.join(places, ["h1", "h2", "part"]).select("rec.*", "shard", "slot"))


def write_shards(sharded: DataFrame, path: str, files: int | None = None) -> None:
    """One folder of Parquet a shard, its files in the order of their names and rows within them in the order of slots.

    Tasks take ranges of (shard, slot), about files of them in all (by default as many as shuffles have, merged by their
    size), so a shard may be of any size.
    """
    by = ["shard", "slot"]
    ranged = sharded.repartitionByRange(files, *by) if files else sharded.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by law ``rows``. A null text has size 8 and the crc32 of no bytes, 0."""
    docs = documents(spark, sf_dir)
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), crc32_text(F.col("text")).alias("text_crc32"))
    out = shard(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
