"""Intents to DataFrames.

compile_intent takes the governed source: rows filtered, hidden columns gone where nothing needs them. It validates the
intent against what the role may see and builds one lazily evaluated DataFrame; Catalyst does the rest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import dependencies, metric_sql
from ..functions.dates import truncated
from ..functions.predicates import COMPARE, check, columns_of, intent_column, named
from ..model import SHAPES as SHAPE_TYPES
from ..model import FilterError, Intent, IntentError, Metric, Source
from ..operators.selection import at_ranks, selectable
from ..operators.shapes import SHAPES
from ..operators.sizes import planned_bytes
from ..operators.windows import period_over_period, rolling

#: Percentiles of inputs of more bytes are selected in three passes; Spark's own keeps a group's distinct values in one task.
PERCENTILE_BYTES = 1 << 30


def validate(intent: Intent, source: Source, metrics: Mapping[str, Metric], visible_columns: frozenset[str], visible_dims: frozenset[str]) -> None:
    """Raises IntentError for anything that the role cannot see or that does not fit together."""
    for m in intent.metrics:
        if m not in metrics or metrics[m].source != source.id:
            raise IntentError(f"unknown metric {m!r}")
    for d in intent.dimensions:
        dim = source.dimension(d.id)
        if dim is None or d.id not in visible_dims:
            raise IntentError(f"unknown dimension {d.id!r}")
        if d.grain and dim.type != "temporal":
            raise IntentError(f"dimension {d.id!r} is not temporal and takes no grain")
    ids = [d.id for d in intent.dimensions]
    if len(set(ids)) < len(ids) or len(set(intent.metrics)) < len(intent.metrics):
        raise IntentError("a metric or dimension appears twice")
    for f in intent.filters:
        try:
            check(f, visible_columns, attributes=False)
        except FilterError as e:
            raise IntentError(str(e)) from e
    for h in intent.having:
        if h.metric not in intent.metrics:
            raise IntentError(f"having names {h.metric!r}, which is not selected")
    for o in intent.order_by:
        if o.key not in intent.metrics and o.key not in ids:
            raise IntentError(f"order_by names {o.key!r}, which is not selected")
    kinds = {metrics[m].type for m in intent.metrics}
    if shapes := kinds & set(SHAPE_TYPES):
        if len(intent.metrics) > 1 or intent.dimensions or intent.filters or intent.having or intent.order_by:
            raise IntentError(f"{shapes.pop()} stands alone: no other metrics, dimensions, filters, having or order")
    if "rolling_window" in kinds:
        if intent.dimensions:
            raise IntentError("a rolling window takes no dimensions")
        if len(intent.metrics) > 1 or intent.having:
            raise IntentError("a rolling window takes no other metric and no having")
    for m in intent.metrics:
        metric = metrics[m]
        if metric.type == "period_over_period" and not any(d.id == metric.period_dim and d.grain == metric.period_unit for d in intent.dimensions):
            raise IntentError(f"metric {m!r} needs dimension {metric.period_dim!r} at grain {metric.period_unit!r}")


def columns_needed(intent: Intent, source: Source, metrics: Mapping[str, Metric], df: DataFrame) -> frozenset[str]:
    """Every source column that an intent reads, those inside SQL fragments included.

    Fragments are resolved by Catalyst against the source's schema, with no rows: what their plan refers to is what they read.
    """
    out = {source.dimension(d.id).column for d in intent.dimensions}
    for f in intent.filters:
        out |= columns_of(f)
    fragments: list[str] = []
    work, seen = list(intent.metrics), set()
    while work:
        m = metrics[work.pop()]
        if m.id in seen:
            continue
        seen.add(m.id)
        work += dependencies(m)
        plain = (m.column, m.weight_column, m.order_column, m.order_by_column, m.entity_column, m.event_column, m.funnel_entity_column, m.funnel_event_order_column, m.msf_entity_column)
        out |= {c for c in (*plain, *m.partition_by) if c}
        if m.type == "period_over_period":
            out.add(source.dimension(m.period_dim).column)
        if m.type != "expression":
            fragments += [x for x in (m.expression, m.filter, m.msf_ranking_expression, m.msf_result_expression, m.cohort_condition, m.result_condition) if x]
        fragments += [c for _, c in m.funnel_steps]
        if m.type == "expression":
            fragments.append(metric_sql(m.id, metrics))
    for text in fragments:
        out |= references(df, text)
    return frozenset(out)


def references(df: DataFrame, fragment: str) -> set[str]:
    """The columns of df that a SQL expression refers to."""
    node = df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(fragment)
    found: set[str] = set()
    work = [node]
    by_lower = {c.lower(): c for c in df.columns}
    while work:
        n = work.pop()
        if n.getClass().getSimpleName() == "UnresolvedAttribute":
            parts = n.nameParts()
            for i in range(parts.size()):
                name = parts.apply(i).lower()
                if name in by_lower:
                    found.add(by_lower[name])
        children = n.children()
        work += [children.apply(i) for i in range(children.size())]
    return found


def _having(h) -> Column:
    c = named(h.metric)
    if h.op in COMPARE:
        return COMPARE[h.op](c, F.lit(h.value))
    return c.isin(list(h.value)) if h.op == "in" else ~c.isin(list(h.value))


def _ordered(df: DataFrame, intent: Intent) -> DataFrame:
    """Nulls last either way. Dimensions break ties, so that a limit keeps the same rows each time."""
    keys = [named(o.key).desc_nulls_last() if o.direction == "desc" else named(o.key).asc_nulls_last() for o in intent.order_by]
    if not keys:
        return df
    used = {o.key for o in intent.order_by}
    return df.orderBy(*keys, *[named(d.id).asc_nulls_last() for d in intent.dimensions if d.id not in used])


def _value(metric: Metric) -> Column:
    value = named(metric.column)
    return (F.when(F.expr(metric.filter), value) if metric.filter else value).alias("_value")


def _with_percentile(out: DataFrame, rows: DataFrame, dims: list[str], metric: Metric) -> DataFrame:
    """`out` with an exact percentile, interpolated between two order statistics that are selected without ordering a group."""
    p = 0.5 if metric.type == "median" else metric.p
    place = lambda n: (n - 1) * F.lit(float(p))
    found = at_ranks(rows.where("_value IS NOT NULL"), dims, "_value", p, lambda n: [F.floor(place(n)), F.ceil(place(n))], ("_low", "_high"))
    up = place(F.col("n")) - F.floor(place(F.col("n")))
    value = F.when(up == 0, F.col("_low").cast("double")).otherwise((1 - up) * F.col("_low") + up * F.col("_high"))
    keys = [f"_d{i}" for i in range(len(dims))]
    found = found.select(*[named(d).alias(k) for d, k in zip(dims, keys, strict=True)], F.lit(1).alias("_one"), value.alias(metric.id))
    on = F.col("_one") == F.lit(1)
    for d, k in zip(dims, keys, strict=True):
        on = on & named(d).eqNullSafe(F.col(k))
    return out.join(found if dims else F.broadcast(found), on, "left").drop("_one", *keys)


def compile_intent(intent: Intent, source: Source, metrics: Mapping[str, Metric], df: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The DataFrame that answers a validated intent. `runs` is the quality log, which anomaly_query reads."""
    types = {m: metrics[m].type for m in intent.metrics}
    if len(types) == 1 and next(iter(types.values())) in SHAPES:
        metric = metrics[intent.metrics[0]]
        rows = runs if metric.type == "anomaly_query" else df
        if rows is None:
            raise IntentError("there is no quality log to read")
        return SHAPES[metric.type](rows, metric, intent.limit)
    for f in intent.filters:
        df = df.where(intent_column(f, frozenset(df.columns)))
    if "rolling_window" in types.values():
        out = rolling(df, metrics[intent.metrics[0]])
        return _ordered(out, intent).limit(intent.limit)
    dims = []
    for d in intent.dimensions:
        c = named(source.dimension(d.id).column)
        dims.append((truncated(d.grain, c) if d.grain else c).alias(d.id))
    if not intent.metrics:
        out = df.select(*dims).distinct()
        return _ordered(out, intent).limit(intent.limit)
    base = {m: metrics[m].base_metric for m, t in types.items() if t == "period_over_period"}
    plain = {m: metric_sql(m, metrics) for m in types if m not in base}
    hidden = {f"_base_{m}": metric_sql(b, metrics) for m, b in base.items()}
    size = planned_bytes(df)
    apart = [m for m in plain if size is not None and size > PERCENTILE_BYTES and metrics[m].type in ("percentile", "median") and selectable(df, metrics[m].column)]
    aggs = [F.expr(sql).alias(name) for name, sql in {**plain, **hidden}.items() if name not in apart]
    aggs = aggs or [F.lit(None).alias("_none")]
    out = df.groupBy(*dims).agg(*aggs) if dims else df.agg(*aggs)
    for m in apart:
        out = _with_percentile(out, df.select(*dims, _value(metrics[m])), [d.id for d in intent.dimensions], metrics[m])
    for m in base:
        others = [d.id for d in intent.dimensions if d.id != metrics[m].period_dim]
        out = out.withColumn(m, period_over_period(out, f"_base_{m}", metrics[m].period_dim, others, metrics[m].comparison))
    for h in intent.having:
        out = out.where(_having(h))
    out = out.select(*[named(d.id) for d in intent.dimensions], *[named(m) for m in intent.metrics])
    return _ordered(out, intent).limit(intent.limit)
