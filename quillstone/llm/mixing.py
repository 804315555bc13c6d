"""Operator 9, mixing sources to target weights, in DataFrame operations only.

Every source gets a target in words. Complete epochs of a source come first; the fraction that remains is an
Efraimidis-Spirakis sample: each document draws an exponential key divided by its quality weight, the keys are sorted within
the source, and documents are taken until the prefix sum of their sizes meets the budget.

No task sorts a whole source. Keys are whole numbers; a histogram of a source's keys, summed up before it is shuffled, tells
the range in which the budget runs out, and that range is parted again until few keys are left in it. Only those are sorted,
which gives the source's last key to take. Documents are then taken by comparing their key to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm._shared import WORD, documents, fingerprint, small, stored, unit, without

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Keys of a source that are sorted in a task, at most; ranges that keys are parted into at a time.
SORTED, RANGES = 2_000, 1024
#: What a key is multiplied by to be a whole number, and the rows of one split record that a task makes at a time.
SCALE, COPIES = float(1 << 40), 4096
SYMBOLS = "0123456789#$%&*@|<>{}[]=_~^\\"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """A document's weight in the draw, 0.05 to 1: less the more of its characters are digits and symbols."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(3.0) * symbols / F.greatest(F.length(t), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size, ...) with weight and target.

    Sources in the order of their code points, a null one last, take the weights in turn. Together they get share times all
    sizes by weight; none more than most times its own size. What exceeds that goes to the others by weight until none is
    above: the target is least(most * size, level * weight) for the level at which the targets sum up to the whole.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(F.lit(0)), full.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(whole) * F.lit(share)).withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("rest_weight"))
    # Those whose cap lies below the level that they would get are full; the first that isn't fixes the level.
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole).getField("level"))
    return s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))).drop("all", "rest_weight", "level", "cap")


def draws(docs: DataFrame, seed: int, weight: Column) -> tuple[Column, Column]:
    """(key, tie) of the rows of docs: their order in the draw. Only rows that are equal in every column agree in both."""
    first, second = ([fingerprint(f.dataType, F.col(f"`{f.name}`"), F.lit(s)) for f in docs.schema.fields] for s in (seed, ~seed))
    return (-F.log(unit(F.lit(seed), *first)) / weight * SCALE).cast("long"), F.xxhash64(F.lit(~seed), *second)


def _of(source: str, rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of table, which has a row for each source."""
    return rows.join(table, F.col(source).eqNullSafe(F.col("source")))


def _narrowed(slim: DataFrame, state: DataFrame) -> DataFrame:
    """state (source, budget, low, high, n, before): the n keys from low to high, SORTED at most, among which budget runs out; before is the size of lower ones."""
    wide = (F.col("n") > SORTED) & (F.col("high") > F.col("low"))
    width = F.expr(f"(high - low) div {RANGES} + 1")
    while not (todo := state.where(wide)).isEmpty():
        rows = _of("of", slim, todo).where(F.col("key").between(F.col("low"), F.col("high")))
        rows = rows.withColumn("range", F.expr(f"(key - low) div ((high - low) div {RANGES} + 1)"))
        ranges = rows.groupBy("source", "budget", "low", "high", "before", "range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("m"))
        upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("range"))
        found = ranges.withColumn("upto", upto).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("size") <= F.col("budget")))
        low = F.col("low") + F.col("range") * width
        found = found.select("source", "budget", low.alias("low"), F.least("high", low + width - 1).alias("high"), F.col("m").alias("n"), (F.col("upto") - F.col("size")).alias("before"))
        state = small(state.where(~wide).unionByName(found), "mixing-ranges")
    return state


def _cuts(slim: DataFrame, budget: DataFrame) -> DataFrame:
    """source, cut_key, cut_tie, some, group: the last of a source's keys that the sample takes, and how many it takes of the group rows that have it."""
    state = budget.where(F.col("budget") > 0).select("source", "budget", "low", "high", "n", F.lit(0).cast("long").alias("before"))
    state = _narrowed(slim, state)
    edge = _of("of", slim, state).where(F.col("key").between(F.col("low"), F.col("high")))
    edge = edge.groupBy("source", "budget", "low", "before", "key", "tie").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("group"))
    prior = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "tie")) - F.col("size")
    # A row is taken if at least half of it fits; those of a group are equal.
    fit = F.floor((F.col("budget") - prior) * F.col("group") / F.col("size") + 0.5)
    some = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least("group", fit))).otherwise(F.when(prior <= F.col("budget"), F.col("group")).otherwise(0))
    edge = edge.withColumn("some", some.cast("long"))
    last = F.max(F.when(F.col("some") > 0, F.struct("key", "tie", "some", "group")))
    # Below every key of the range, if none of it fits.
    none = F.struct((F.col("low") - 1).alias("key"), F.lit((1 << 63) - 1).alias("tie"), F.lit(0).cast("long").alias("some"), F.lit(0).cast("long").alias("group"))
    last = edge.groupBy("source", "low").agg(last.alias("last")).select("source", F.coalesce("last", none).alias("last"))
    return last.select("source", F.col("last.key").alias("cut_key"), F.col("last.tie").alias("cut_tie"), F.col("last.some").alias("some"), F.col("last.group").alias("group"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 23, weight: Column | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with size, source_size, target, repeats and taken (= size * repeats).

    docs needs source and text. A null text has size 0 and adds nothing; a null source is a source. Rows that are equal in
    every column are drawn as one, and the sample may take some of them; which ones can't be told. A source of size 0 has
    target 0 and its rows have repeats 0. The document at which a budget runs out is taken if at least half of it fits.
    Columns with the result's names are replaced; columns of maps aren't supported. Rows, seed and parameters decide the
    result, partitions don't. An empty table gives no rows. keep names columns for the result to have in place of all of
    docs; what it needs besides is then stored with them, and texts are read once.
    """
    docs = without(docs, "size", "source_size", "target", "repeats", "taken")
    key, tie = draws(docs, seed, quality(F.col("text")) if weight is None else weight)
    names = [F.col(f"`{c}`") for c in docs.columns if keep is None or c in keep]
    rec = F.struct(*names).alias("rec")
    drawn = docs.select(rec, F.col("source").alias("of"), words(F.col("text")).alias("size"), key.alias("key"), tie.alias("tie"))
    slim = stored(drawn if keep is not None else drawn.drop("rec"), "mixing")
    drawn = slim if keep is not None else drawn
    of_source = (F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    sizes = slim.groupBy(F.col("of").alias("source")).agg(*of_source)
    budget = targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0).cast("int")
    budget = budget.withColumn("epochs", epochs).withColumn("budget", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    budget = small(budget, "mixing-budget")
    cuts = _cuts(slim, budget.where(F.col("epochs") < most))
    same = F.col("b.source").eqNullSafe(F.col("c.source"))
    cuts = budget.alias("b").join(cuts.alias("c"), same, "left").select(F.col("b.source").alias("source"), "source_size", "target", "epochs", "cut_key", "cut_tie", "some", "group")
    cuts = small(cuts, "mixing-cuts")
    order, cut = F.struct("key", "tie"), F.struct(F.col("cut_key").alias("key"), F.col("cut_tie").alias("tie"))
    split = (order == cut) & (F.col("some") < F.col("group"))
    rows = _of("of", drawn, cuts)
    sampled = F.coalesce((order <= cut).cast("int"), F.lit(0))

    def out(df: DataFrame, more: Column) -> DataFrame:
        repeats = F.when(F.col("source_size") > 0, F.col("epochs") + more).otherwise(0)
        return df.select("rec.*", "size", "source_size", "target", repeats.cast("int").alias("repeats"), (F.col("size") * repeats).cast("long").alias("taken"))

    whole = out(rows.where(~F.coalesce(split, F.lit(False))), sampled)
    parted = cuts.where(F.col("some").between(1, F.col("group") - 1))
    if parted.isEmpty():
        return whole
    # Of a group that the sample takes some of, one row stands for all.
    one = _of("of", drawn, F.broadcast(parted)).where(order == cut).groupBy("of").agg(*[F.first(c).alias(c) for c in ("rec", "size", "source_size", "target", "epochs", "some", "group")])
    parts = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`group` - 1) div {COPIES}")))).repartition("of", "part")
    copies = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least("group", (F.col("part") + 1) * COPIES))))
    return whole.unionAll(out(copies, (F.col("copy") <= F.col("some")).cast("int")))


def expanded(mixed: DataFrame) -> DataFrame:
    """A row for each time that a document is taken: complete epochs and then the sample, without mix()'s columns."""
    names = [F.col(f"`{c}`") for c in without(mixed, "size", "source_size", "target", "repeats", "taken").columns]
    return mixed.where("repeats > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("__epoch")).drop("__epoch")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words: sources weigh 3, 1, 2 in turn and come to twice their size at most."""
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"), keep=("doc_id", "source"))
    return mixed.select("doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), F.col("target").cast("double"), "taken", "source", "repeats")
