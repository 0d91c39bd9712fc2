"""Rolling windows and period-over-period comparisons."""

from __future__ import annotations

from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import quoted
from ..functions.dates import UNIT_SECONDS, interval, interval_sql
from ..functions.predicates import named
from ..model import Metric
from .sizes import planned_bytes

DAY = 86_400_000_000
#: A window's length is cut into so many buckets of time; more of them for an input of more than 256 times BUCKET_BYTES.
LEAST_BUCKETS, MOST_BUCKETS = 256, 8192
BUCKET_BYTES = 64 << 20
# What is kept of a set of rows for each aggregate: (name, from rows, from kept parts).
_PARTS = {
    "sum": (("s", F.sum, F.sum),),
    "avg": (("s", F.sum, F.sum), ("n", F.count, F.sum)),
    "count": (("n", F.count, F.sum),),
    "min": (("m", F.min, F.min),),
    "max": (("m", F.max, F.max),),
}


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone; no session setting bears on it."""
    day = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return day * DAY + (F.hour(t).cast("long") * 60 + F.minute(t)) * 60_000_000 + second


@lru_cache
def _day_spans(months: int) -> tuple[int, ...]:
    """Every number of days that so many months back can be."""
    out = set()
    for first, last in ((1896, 1913), (1996, 2009)):
        day = date(first, 1, 1) + timedelta(days=31 * months)
        while day.year < last + months // 12:
            at = day.year * 12 + day.month - 1 - months
            end = date(at // 12 + (at % 12 == 11), (at + 1) % 12 + 1, 1) - timedelta(days=1)
            out.add((day - end.replace(day=min(day.day, end.day))).days)
            day += timedelta(days=1)
    return tuple(sorted(out))


def cut(window: str, buckets: int) -> tuple[int, tuple[int, ...]]:
    """(bucket width in microseconds, every number of buckets that the window's start can lie before a row's own bucket)."""
    n, unit = interval(window)
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        length = n * UNIT_SECONDS[unit] * 1_000_000
        width = max(1, length // buckets)
        return width, tuple(sorted({length // width, -(-length // width)}))
    days = _day_spans(n * months)
    a_day = next(k for k in (1, 2, 4, 8, 16, 32, 64, 128, 256) if k * days[0] >= buckets or k == 256)
    return DAY // a_day, tuple(d * a_day for d in days)


def rolling(df: DataFrame, metric: Metric, name: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the aggregate over rows whose time is within `window` before the row's, itself included.

    The work is in proportion to the rows, not to the rows in a window, and no task holds a whole window. Rows of equal time
    have equal results, so they are aggregated first. Time is cut into buckets; a window is the end of one bucket,
    the whole buckets between, and the beginning of the row's own. Beginnings are running aggregates within a bucket; ends are
    too, read backwards at the time where a window starts; whole buckets are few rows, windowed in slices of time that are
    as long as the window. Rows without a time are peers of each other.
    """
    parts = _PARTS[metric.aggregate]
    value = quoted(metric.column)
    if metric.filter:
        value = f"CASE WHEN {metric.filter} THEN {value} END"
    by = [f"_p{i}" for i in range(len(metric.partition_by))]
    rows = df.select(
        *[named(c) for c in keep],
        *[named(c).alias(p) for p, c in zip(by, metric.partition_by, strict=True)],
        F.expr(value).alias("_v"),
        named(metric.order_by_column).cast("timestamp_ntz").alias("_t"),
    )
    size = planned_bytes(df)
    buckets = LEAST_BUCKETS if size is None else min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET_BYTES))
    width, spans = cut(metric.window, buckets)
    kind = rows.select(F.expr(f"{metric.aggregate}(_v)").alias("x")).schema["x"].dataType

    timed = rows.groupBy(*by, "_t").agg(*[f(F.col("_v")).alias(k) for k, f, _ in parts]).where(F.col("_t").isNotNull())
    low = F.col("_t") - F.expr(interval_sql(metric.window))
    timed = timed.withColumn("_m", micros(F.col("_t"))).withColumn("_low", micros(low))
    timed = timed.withColumn("_b", F.floor(F.col("_m") / width)).withColumn("_c", F.floor(F.col("_low") / width))
    begun = Window.partitionBy(*by, "_b").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    whole = timed.groupBy(*by, "_b").agg(*[merge(k).alias(k) for k, _, merge in parts])
    between = _between(whole, by, parts, spans)
    timed = timed.select("*", *[merge(k).over(begun).alias(f"a_{k}") for k, _, merge in parts])
    on = F.col("_b") == F.col("_w_b")
    for p in by:
        on = on & F.col(p).eqNullSafe(F.col(f"_w{p}"))
    timed = timed.join(between, on, "left")
    for k, _, _ in parts:
        chosen = F.coalesce(*[F.when(F.col("_b") - F.col("_c") == s, F.col(f"w_{s}_{k}")) for s in spans])
        timed = timed.withColumn(f"b_{k}", chosen)
    # A row stands twice in the last step: as itself in its bucket, and as a question at the time where its window starts.
    keys = [k for k, _, _ in parts]
    own = F.struct(F.lit(False).alias("asks"), F.col("_b").alias("at"), F.col("_m").alias("when"), *[F.col(k).alias(f"c_{k}") for k in keys])
    start = F.struct(F.lit(True).alias("asks"), F.col("_c").alias("at"), F.col("_low").alias("when"), *[F.lit(None).cast(timed.schema[k].dataType).alias(f"c_{k}") for k in keys])
    both = timed.select(*by, "_t", *[f"{side}_{k}" for side in "ab" for k in keys], F.explode(F.array(own, start)).alias("_e")).select("*", "_e.*").drop("_e")
    ended = Window.partitionBy(*by, "at").orderBy(F.desc("when"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("*", *[merge(f"c_{k}").over(ended).alias(f"e_{k}") for k, _, merge in parts]).where("asks")
    result = both.select(*[F.col(p).alias(f"_r{p}") for p in by], F.col("_t").alias("_rt"), _total(metric.aggregate, parts, "abe").cast(kind).alias("_out"))

    names = [*[named(c) for c in keep], F.col("_out").alias(name or metric.id)]
    on = F.col("_t") == F.col("_rt")
    for p in by:
        on = on & F.col(p).eqNullSafe(F.col(f"_r{p}"))
    out = rows.where(F.col("_t").isNotNull()).join(result, on).select(*names)
    if not rows.schema["_t"].nullable:
        return out
    untimed = rows.where(F.col("_t").isNull()).withColumn("_one", F.lit(1))
    peers = untimed.groupBy("_one", *by).agg(F.expr(f"{metric.aggregate}(_v)").alias("_out"))
    peers = peers.select("_out", F.col("_one").alias("_r_one"), *[F.col(p).alias(f"_r{p}") for p in by])
    on = F.col("_one") == F.col("_r_one")
    for p in by:
        on = on & F.col(p).eqNullSafe(F.col(f"_r{p}"))
    return out.unionByName(untimed.join(peers, on).select(*names))


def _between(whole: DataFrame, by: list[str], parts, spans: tuple[int, ...]) -> DataFrame:
    """For each bucket (_w_b, and _w before the names of `by`) and span s, w_s_k: the parts of the s - 1 buckets before it.

    Buckets are windowed in slices that are at least as long as a span; each bucket is lent to the slice after its own.
    """
    length = max(spans)
    slice_ = F.floor(F.col("_b") / length)
    lent = whole.withColumn("_e", F.explode(F.array(F.struct(slice_.alias("at"), F.lit(True).alias("own")), F.struct((slice_ + 1).alias("at"), F.lit(False).alias("own")))))
    lent = lent.select("*", "_e.at", "_e.own")
    order = Window.partitionBy(*by, "at").orderBy("_b")
    columns = []
    for s in spans:
        for k, _, merge in parts:
            # A span of one has no bucket between; an empty frame gives null.
            found = merge(k).over(order.rangeBetween(1 - s, -1)) if s > 1 else F.lit(None).cast(whole.schema[k].dataType)
            columns.append(found.alias(f"w_{s}_{k}"))
    return lent.select(*[F.col(c).alias(f"_w{c}") for c in (*by, "_b")], "own", *columns).where("own").drop("own")


def _total(aggregate: str, parts, sides: str) -> Column:
    """The aggregate from the kept parts of several sets; a part is null for a set without values."""

    def added(k: str) -> Column:
        columns = [F.col(f"{s}_{k}") for s in sides]
        filled = [F.coalesce(c, F.lit(0)) for c in columns]
        return F.when(F.coalesce(*columns).isNotNull(), sum(filled[1:], filled[0]))

    if aggregate in ("min", "max"):
        return (F.least if aggregate == "min" else F.greatest)(*[F.col(f"{s}_m") for s in sides])
    if aggregate == "count":
        return F.coalesce(added("n"), F.lit(0))
    return added("s") / F.nullif(added("n"), F.lit(0)) if aggregate == "avg" else added("s")


def compare(current: Column, before: Column, comparison: str) -> Column:
    current, before = current.cast("double"), before.cast("double")
    if comparison == "delta":
        return current - before
    if comparison == "ratio":
        return current / F.nullif(before, F.lit(0.0))
    return (current - before) / F.nullif(before, F.lit(0.0))


def period_over_period(grouped: DataFrame, base: str, period: str, others: list[str], comparison: str) -> Column:
    """The base metric against the row before in order of period, within equal other dimensions; null for the first."""
    order = Window.partitionBy(*[named(c) for c in others]).orderBy(named(period))
    return compare(named(base), F.lag(named(base)).over(order), comparison)
