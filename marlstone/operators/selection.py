"""Exact order statistics of groups without putting a group in order in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import named

#: Accuracy of the sketch that names two values around the ones sought, and cells that the stretch between them is cut into.
SKETCH, CELLS = 1000, 1 << 16
_NUMBERS = ("long", "integer", "short", "byte", "double", "float", "decimal")


def selectable(df: DataFrame, value: str) -> bool:
    return df.schema[value].dataType.typeName() in _NUMBERS


def position(value: Column) -> Column:
    """A double in the order of the values, nulls first and NaN last."""
    x = value.cast("double")
    return F.when(x.isNull(), F.lit(float("-inf"))).when(F.isnan(x), F.lit(float("inf"))).otherwise(x)


def at_ranks(rows: DataFrame, by: list[str], value: str, share: float, ranks, names: tuple[str, ...] = ("at",)) -> DataFrame:
    """One row per group (columns of `by`, nulls are a group), n, and the value at each rank, under `names`.

    ranks: from the column of n to as many columns of ranks, counted from 0 in ascending order, nulls first; all near the given
    share of n. Three passes: a sketch gives two values around them; counts by cells between the two give the cells that hold
    the ranks; only those cells' values are put in order. Numbers only.
    """
    keys = [f"_g{i}" for i in range(max(1, len(by)))]
    grouped = [named(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(1).alias("_g0")]
    rows = rows.select(*grouped, named(value).alias("_v"), position(named(value)).alias("_x"))
    margin = 4.0 / SKETCH
    around = F.percentile_approx("_x", [max(0.0, share - margin), min(1.0, share + margin)], SKETCH)
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), around.alias("q"))
    low = F.when(F.lit(share > margin), F.col("q")[0]).otherwise(F.lit(float("-inf")))
    high = F.when(F.lit(share + margin < 1), F.col("q")[1]).otherwise(F.lit(float("inf")))
    sought = F.array(*[r.cast("long") for r in ranks(F.col("n"))])
    stats = stats.select(*[F.col(k).alias(f"_s{k}") for k in keys], "n", low.alias("low"), high.alias("high"), F.col("q")[0].alias("a"), (F.col("q")[1] - F.col("q")[0]).alias("width"), sought.alias("sought"))

    def with_stats(left: DataFrame, right: DataFrame, prefix: str) -> DataFrame:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
        return left.join(right, on).drop(*[f"{prefix}{k}" for k in keys])

    celled = with_stats(rows, stats, "_s")
    flat = (F.col("width") > 0) & (F.col("width") < float("inf"))
    inner = F.when(flat, F.least(F.greatest(F.floor((F.col("_x") - F.col("a")) / F.col("width") * CELLS), F.lit(0)), F.lit(CELLS - 1))).otherwise(F.lit(0))
    cell = F.when(F.col("_x") < F.col("low"), F.lit(-1)).when(F.col("_x") > F.col("high"), F.lit(CELLS)).otherwise(inner).cast("int")
    celled = celled.withColumn("cell", cell)
    counts = celled.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("m"), F.first("sought").alias("sought"), F.first("n").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    inside = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m"))
    counts = counts.where(F.exists("sought", inside))
    chosen = counts.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("cell").alias("_c"), "before")
    on = F.col("cell") == F.col("_c")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    values = celled.join(chosen, on).groupBy(*keys, "cell", "_v").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("before", "sought", "n", "_x")])
    ahead = Window.partitionBy(*keys, "cell").orderBy("_x", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.col("before") + F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    found = [F.max(F.when(inside(F.col("sought")[i]), F.col("_v"))).alias(name) for i, name in enumerate(names)]
    out = values.groupBy(*keys).agg(F.first("n").alias("n"), *found)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=False)], "n", *names)
