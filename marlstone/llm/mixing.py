"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key -ln(u)/q: u is uniform in (0, 1), drawn from its id by MD5, and q is its quality weight. Taking
documents in key order is weighted sampling without replacement. A source with target T and size S is first taken
floor(T/S) times whole; what is left of T is then filled in key order by prefix sums, the last document in part.

Prefix sums run in two levels, so no source is gathered in one task however large it is: keys map monotonically to
buckets of equal expected size, sums of (source, bucket) give each bucket its start, and only rows of one bucket are
sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_count, checkpointed

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
#: Characters that prose hardly has; their share lowers a document's quality weight.
JUNK = "*&$%#!|"


def quality(text):
    """Quality weight in (0, 1]: 1 for prose, less the more junk characters there are."""
    n = F.length(text)
    junk = (n - F.length(F.translate(text, JUNK, ""))).cast("double")
    return F.when(n > 0, F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * junk / n)).otherwise(F.lit(1.0))


def sampling_key(doc_id, weight, seed: int = SEED):
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Rows with source and source_size -> with target: shares by weight, capped at max_epochs sizes, the excess reshared.

    Water filling in closed form: in order of cap/weight, a source is full if its cap is at most what its weight would
    get from that which the fuller ones leave. Works on one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    upto = full.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("caps", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("is_full", F.col("cap") * F.col("rest") <= (F.col("total") - F.col("caps")) * F.col("weight"))
    left = F.first("total").over(every) - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(every)
    s = s.withColumn("target", F.when(F.col("is_full"), F.col("cap")).otherwise(left / free * F.col("weight")))
    return s.drop("weight", "cap", "total", "caps", "rest", "is_full")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED, carry: tuple = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, taken, and the columns named in `carry`.

    size counts runs of anything but ASCII white space (null or empty text: 0); taken counts the words that the mix
    takes, whole epochs and the fraction together. Null sources are a source of their own, ordered last. Repeated rows
    each count. Ties of the key go to the smaller doc_id, null last. An empty table gives an empty result; a source of
    size 0 has target 0. `carry` must not name a column of the result.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    # A source's name without null, so that one partitioning serves the join and the window.
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source")
    sized = docs.select("doc_id", "source", name, size.alias("size"), sampling_key(F.col("doc_id"), quality(text), seed).alias("_key"), *carry)
    if not carry:
        sized = checkpointed(sized)
    buckets = max(1024, block_count(docs))
    bucket = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * buckets), F.lit(buckets - 1)).cast("int")
    sized = sized.withColumn("_bucket", bucket)
    sums = sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    sizes = sums.groupBy("_source").agg(F.sum("_sum").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("_source") != "", F.substring("_source", 2, 1 << 30)))
    goal = targets(sizes, weights, share, max_epochs)
    plan = starts.join(goal.drop("source"), "_source")
    rows = sized.join(plan, ["_source", "_bucket"])
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - ahead))
    taken = epochs * F.col("size") + part
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def oracle(weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> str:
    cases = " ".join(f"WHEN {n} THEN {float(x)}" for n, x in enumerate(weights))
    return f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  CASE WHEN length(text) > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(text) - length(translate(text, '{JUNK}', '')))::DOUBLE / length(text)) ELSE 1.0::DOUBLE END AS q,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{seed}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM s),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END::DOUBLE AS weight, source_size * {float(max_epochs)}::DOUBLE AS cap FROM z),
a AS (SELECT *, sum(source_size) OVER () * {float(share)}::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, cap * rest <= (total - caps) * weight AS is_full FROM a),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
  (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) / (sum(weight) FILTER (WHERE NOT is_full) OVER ()) * weight END AS target FROM f),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - ahead)))::BIGINT AS taken FROM p
"""
