"""Operator 8, secret scans by multipart credential linking, in DataFrame operations only.

Strong patterns are found everywhere. Weak candidates (a bare 40-character secret, an endpoint) are reported only where the
complementary part of a credential lies within ``SCOPE`` characters: a bare secret needs an access identifier or an endpoint,
an endpoint needs an access identifier or a secret. The link is an interval join along each text: parts sorted by place carry
the end of the last and the start of the next part of each role, so it takes time in proportion to the parts and no pair is
ever put out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm._shared import documents, without

#: Characters between the parts of one credential, at most.
SCOPE = 300
#: Copies of a row that are made at a time.
COPIES = 4096

# The patterns of the scan. kind: (Java pattern, least characters of the match, role)
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = {
    "assign": (ASSIGN, 0, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", 20, "access"),
    "hex": (r"[0-9a-f]{24,}", 24, "secret"),
    "bare": (r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 40, "secret"),
    "endpoint": (r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|jdbc:[a-z]{2,12})://[^\s\"'<>]{4,}", 9, "endpoint"),
}
BASE, WEAK = ("assign", "access", "hex"), ("bare", "endpoint")
#: What a text must hold for a pattern to match at all: cheaper to look for than the pattern.
HINTS = {"access": "AKIA", "endpoint": "://"}


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind, in order: struct(kind, i, gap: characters since the match before, len, ok).

    What split() leaves between matches gives their places. assign keeps matches whose value has 6 characters; one that
    fails still takes its characters, as it would in a left-to-right scan. For access and hex the least length can be part of
    the pattern: they are whole runs.
    """
    pattern, _, _ = KINDS[kind]
    order = list(KINDS).index(kind)
    none = F.expr("cast(array() as array<struct<kind: int, i: int, gap: int, len: int, ok: boolean>>)")
    ok = (lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= 6) if kind == "assign" else (lambda m: F.lit(True))
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.transform(
        F.arrays_zip(gaps.alias("g"), found.alias("m")),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), ok(x["m"]).alias("ok")),
    )
    has = F.rlike(text, F.lit(pattern))
    if kind in HINTS:
        has = F.contains(text, F.lit(HINTS[kind])) & has
    return F.when(has, F.filter(each, lambda x: x["len"].isNotNull())).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each row of docs: the id, n_assign, n_access, n_hex, n_linked, found.

    found: array of struct(start, kind, end), by start and then kind as in KINDS; places are code points, end exclusive. A
    null text is an empty one: no finds. Rows equal in id and text are scanned as one and come back as often as they were. An
    empty table gives no rows; other columns of docs are ignored.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("h"), F.xxhash64(F.lit(1), t).alias("h2"), F.explode_outer(F.concat(*[_found(t, k) for k in KINDS])).alias("p"))
    key = ["id", "h", "h2"]
    parts = base.groupBy(*key, F.col("p.kind").alias("kind"), F.col("p.i").alias("i"), F.col("p.gap").alias("gap"), F.col("p.len").alias("len"), F.col("p.ok").alias("ok")).agg(F.count(F.lit(1)).alias("m"))
    text, along = Window.partitionBy(*key), Window.partitionBy(*key, "kind").orderBy("i")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along)).withColumn("start", F.col("end") - F.col("len"))
    role = F.element_at(F.array(*[F.lit(r) for _, _, r in KINDS.values()]), F.col("kind") + 1)
    parts = parts.where(F.coalesce("ok", F.lit(True)) | (F.col("i") == 0)).withColumn("role", F.when(F.col("ok"), role))
    ahead, back = text.orderBy("start", "kind"), text.orderBy(F.desc("start"), F.desc("kind"))
    for r in ("access", "secret", "endpoint"):
        near_before = F.col("start") - F.max(F.when(F.col("role") == r, F.col("end"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1)) <= scope
        near_after = F.min(F.when(F.col("role") == r, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)) - F.col("end") <= scope
        parts = parts.withColumn(f"by_{r}", F.coalesce(near_before, F.lit(False)) | F.coalesce(near_after, F.lit(False)))
    kinds = list(KINDS)
    is_bare, is_endpoint = F.col("kind") == kinds.index("bare"), F.col("kind") == kinds.index("endpoint")
    linked = (is_bare & (F.col("by_access") | F.col("by_endpoint"))) | (is_endpoint & (F.col("by_access") | F.col("by_secret")))
    keep = F.col("ok") & ((~is_bare & ~is_endpoint) | linked)
    n = lambda k: F.count_if(keep & (F.col("kind") == kinds.index(k))).alias(f"n_{k}")
    found = F.array_sort(F.collect_list(F.when(keep, F.struct("start", "kind", "end")))).alias("found")
    out = parts.groupBy(*key).agg(n("assign"), n("access"), n("hex"), F.count_if(F.coalesce(keep & linked, F.lit(False))).alias("n_linked"), found, F.max("m").alias("m"))
    # As often as the row was there, COPIES at a time, which several tasks make.
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {COPIES}")))).repartition(*key, "part")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("m") - F.col("part") * COPIES))))
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "n_linked", "found")


def spelled(found: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """kind:start:end of each find of these kinds, comma-joined."""
    names, wanted = F.array(*[F.lit(k) for k in KINDS]), [list(KINDS).index(k) for k in kinds]
    chosen = F.filter(found, lambda x: x["kind"].isin(wanted))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each find overwritten by ``*``; found is find_secrets() of docs. Rows without finds come back unchanged; ids must be unique and not null."""
    hide = lambda t, x: F.overlay(t, F.repeat(F.lit("*"), (x["end"] - x["start"]).cast("int")), (x["start"] + 1).cast("int"))
    hits = found.where(F.size("found") > 0).select(F.col(id_col).alias("__id"), "found")
    both = docs.join(hits, docs[id_col] == F.col("__id"), "left")
    clean = F.aggregate(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), F.col(text_col), hide)
    return both.withColumn(text_col, clean).select(*without(docs).columns)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: base kinds assign, access, hex; linked weak candidates as bare and endpoint."""
    out = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spelled(F.col("found"), BASE), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"), "n_linked")
