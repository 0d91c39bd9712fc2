"""Whole-query operators: cohorts, funnels, two-stage filters, cohort intersections and detected anomalies.

Each is a function (source DataFrame, Metric, limit) -> DataFrame, registered by metric type. The source has been filtered by policy
already, so every stage sees only rows that the role may see.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import boundary_diff, truncated
from ..functions.predicates import named
from ..model import Metric
from .selection import at_ranks, selectable

Shape = Callable[[DataFrame, Metric, int], DataFrame]
SHAPES: dict[str, Shape] = {}


def shape(metric_type: str):
    """Registers a shape for a metric type; the extension point for new ones."""

    def put(f: Shape) -> Shape:
        SHAPES[metric_type] = f
        return f

    return put


def _ratio(a, b):
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


@shape("cohort_retention")
def cohort_retention(df: DataFrame, m: Metric, limit: int) -> DataFrame:
    """cohort_start, periods_since_cohort, retained_count, cohort_size, retention_rate.

    Events are reduced to one row per entity and retention period before anything else, so a busy entity costs its
    number of periods; its cohort is the least event time over those rows.
    """
    entity, event = named(m.entity_column), named(m.event_column).cast("timestamp_ntz")
    seen = df.where(entity.isNotNull()).groupBy(entity.alias("entity"), truncated(m.retention_grain, event).alias("period")).agg(F.min(event).alias("first"))
    cohort = truncated(m.cohort_grain, F.min("first").over(Window.partitionBy("entity")))
    rows = seen.withColumn("cohort_start", cohort).withColumn("periods_since_cohort", boundary_diff(m.retention_grain, F.col("cohort_start"), F.col("period")))
    sizes = rows.groupBy("cohort_start").agg(F.countDistinct("entity").alias("cohort_size"))
    if m.max_periods is not None:
        rows = rows.where(F.col("periods_since_cohort").between(0, m.max_periods))
    counts = rows.groupBy("cohort_start", "periods_since_cohort").agg(F.countDistinct("entity").alias("retained_count"))
    out = counts.join(sizes, "cohort_start").withColumn("retention_rate", _ratio(F.col("retained_count"), F.col("cohort_size")))
    out = out.select("cohort_start", "periods_since_cohort", "retained_count", "cohort_size", "retention_rate")
    return out.orderBy("cohort_start", "periods_since_cohort").limit(limit)


def _bucket(df: DataFrame, order: str):
    """Cuts an entity's events into stretches of an hour, or of 65536 units of a number; other types are one stretch."""
    kind = df.schema[order].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_trunc("hour", named(order))
    if kind in ("long", "integer", "short", "byte"):
        return F.shiftright(named(order).cast("long"), 16)
    return F.lit(0)


@shape("funnel")
def funnel(df: DataFrame, m: Metric, limit: int) -> DataFrame:
    """step_name, step_index, entity_count, conversion_from_previous, conversion_from_first.

    A step's time is the entity's earliest matching event not before its time in the step before; one event may be several
    steps. One scan: events of equal time are merged to one set of matched steps, a stretch of an entity's events becomes
    the map from the steps done before it to the steps done after it, and the maps of an entity's stretches are applied in
    order. So an entity with very many events is spread over its stretches.
    """
    entity, t = named(m.funnel_entity_column), named(m.funnel_event_order_column)
    n = len(m.funnel_steps)
    steps = [(name, F.coalesce(F.expr(condition), F.lit(False))) for name, condition in m.funnel_steps]
    matched = F.lit(False)
    for _, c in steps:
        matched = matched | c
    hits = df.where(entity.isNotNull() & t.isNotNull() & matched)
    hits = hits.groupBy(entity.alias("entity"), _bucket(df, m.funnel_event_order_column).alias("stretch"), t.alias("t"))
    hits = hits.agg(F.array(*[F.bool_or(c) for _, c in steps]).alias("did"))
    counts = F.sequence(F.lit(0), F.lit(n))

    def after(done, did):
        """How many steps are done after an event: those before it, and further ones that it matches without a gap."""
        gap = F.array_min(F.transform(counts, lambda k: F.when((k >= done) & ((k == n) | ~F.coalesce(F.get(did, k), F.lit(False))), k)))
        return gap

    events = F.transform(F.array_sort(F.collect_list(F.struct("t", "did"))), lambda e: e["did"])
    each = hits.groupBy("entity", "stretch").agg(events.alias("events"))
    maps = F.aggregate("events", counts, lambda at, did: F.transform(at, lambda done: after(done, did)))
    each = each.select("entity", F.struct("stretch", maps.alias("to")).alias("e"))
    ends = each.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["to"]).alias("maps"))
    ends = ends.select(F.aggregate("maps", F.lit(0), lambda done, to: F.get(to, done)).alias("done"))
    reached = ends.agg(*[F.count_if(F.col("done") > k).alias(f"n{k}") for k in range(n)])
    rows = []
    for k, (name, _) in enumerate(m.funnel_steps):
        now = F.col(f"n{k}")
        before = _ratio(now, F.col(f"n{k - 1}")) if k else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(name).alias("step_name"), F.lit(k).alias("step_index"), now.alias("entity_count"), before.alias("conversion_from_previous"), _ratio(now, F.col("n0")).alias("conversion_from_first")))
    return reached.select(F.inline(F.array(*rows))).orderBy("step_index").limit(limit)


def _top_share(ranked: DataFrame, p: float) -> DataFrame:
    """Rows whose PERCENT_RANK by value, descending and nulls last, is at most p.

    Of n rows, at most m = floor(p (n - 1)) rank before a kept one: kept are the rows with at least the value that has m rows
    before it. Values that are no numbers are counted by value and ranked in one task.
    """
    if selectable(ranked, "value"):
        last = at_ranks(ranked, [], "value", 1 - p, lambda n: [n - 1 - F.floor(F.lit(p) * (n - 1) + 1e-9)], ("least",))
        kept = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(last.select(F.lit(1).alias("_one"), "least")), "_one")
        return kept.where(F.col("least").isNull() | (F.col("value") >= F.col("least")))
    values = ranked.groupBy("value").agg(F.count("*").alias("n"))
    ahead = Window.orderBy(F.col("value").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("above", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    rank = F.when(F.col("total") > 1, F.col("above").cast("double") / (F.col("total") - 1)).otherwise(F.lit(0.0))
    kept = values.where(rank <= p).select(F.col("value").alias("kept"))
    return ranked.join(kept, ranked["value"].eqNullSafe(kept["kept"]), "left_semi")


@shape("multi_stage_filter")
def multi_stage_filter(df: DataFrame, m: Metric, limit: int) -> DataFrame:
    """entity_count, result_value: a raw aggregate over all rows of the best entities; always one row.

    top_n breaks ties by entity. top_percentile keeps entities whose PERCENT_RANK of the ranking, descending and nulls
    last, is at most p, ties included. Those are the entities with at least the value of the last one that rank allows.
    """
    entity = named(m.msf_entity_column)
    ranked = df.groupBy(entity.alias("entity")).agg(F.expr(m.msf_ranking_expression).alias("value"))
    if m.top_n is not None:
        best = ranked.orderBy(F.col("value").desc_nulls_last(), F.col("entity").asc_nulls_last()).limit(m.top_n)
    else:
        best = _top_share(ranked, m.top_percentile)
    best = best.select("entity")
    rows = df.join(best, entity == best["entity"], "left_semi")
    return rows.agg(F.countDistinct(entity).alias("entity_count"), F.expr(m.msf_result_expression).alias("result_value"))


@shape("cohort_filter")
def cohort_filter(df: DataFrame, m: Metric, limit: int) -> DataFrame:
    """How many entities have a row that meets the one condition and a row that meets the other; one scan."""
    entity = named(m.entity_column)
    a, b = F.expr(m.cohort_condition), F.expr(m.result_condition)
    both = df.where(entity.isNotNull() & (a | b)).groupBy(entity.alias("entity")).agg(F.bool_or(a).alias("a"), F.bool_or(b).alias("b"))
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias(m.id))


@shape("anomaly_query")
def anomaly_query(runs: DataFrame, m: Metric, limit: int) -> DataFrame:
    """run_id, observed_value, ran_at, detected_anomaly: failed runs of the rule, newest first. Reads the quality log."""
    value = F.get_json_object("observed_value", "$.value").cast("double")
    failed = runs.where((F.col("rule_id") == m.rule_id) & ~F.col("passed"))
    out = failed.select("run_id", value.alias("observed_value"), "ran_at", F.lit(True).alias("detected_anomaly"))
    return out.orderBy(F.desc("ran_at"), "run_id").limit(limit)
