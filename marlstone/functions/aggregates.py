"""Metrics as aggregate expressions in Spark SQL.

Expressions are built as SQL text, because metric definitions hold SQL fragments and templates substitute one metric into
another. A metric's own filter becomes FILTER (WHERE ...) on each aggregate call, so metrics with different filters stand
side by side in one aggregation and groups without a matching row stay.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..model import AGGREGATES, ConfigError, Metric

TEMPLATE = re.compile(r"\{([^{}]+)\}")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def dependencies(metric: Metric) -> list[str]:
    """The metrics that a metric is made of."""
    if metric.type == "ratio":
        return [metric.numerator, metric.denominator]
    if metric.type == "expression":
        return list(dict.fromkeys(TEMPLATE.findall(metric.expression or "")))
    return [metric.base_metric] if metric.type == "period_over_period" else []


# What each aggregate type calls: text over {x} (expression or column) and the other placeholders.
_CALLS = {
    "count": ("count(1)",),
    "sum": ("sum({x})",),
    "avg": ("avg({x})",),
    "min": ("min({x})",),
    "max": ("max({x})",),
    "percentile": ("percentile({x}, {p})",),
    "median": ("median({x})",),
    "stddev_samp": ("stddev_samp({x})",),
    "stddev_pop": ("stddev_pop({x})",),
    "variance": ("var_samp({x})",),
    "count_distinct": ("count(DISTINCT {x})",),
    "count_distinct_approx": ("approx_count_distinct({x})",),
    # Ties go to the smallest value.
    "mode": ("mode({x}, true)",),
    "first_value": ("first({x})", "min_by({x}, {o})"),
    "last_value": ("last({x})", "max_by({x}, {o})"),
}


def aggregate_sql(metric: Metric) -> str:
    """The SQL of a metric that is one aggregate; first and last follow order_column where the metric names one."""
    if metric.type not in AGGREGATES:
        raise ConfigError(f"metric {metric.id!r}: {metric.type} is not one aggregate")
    only = f" FILTER (WHERE {metric.filter})" if metric.filter else ""
    if metric.type == "weighted_avg":
        w = quoted(metric.weight_column)
        value = f"CAST(({metric.expression}) AS DOUBLE) * {w}"
        return f"(sum({value}){only} / nullif(CAST(sum({w}){only} AS DOUBLE), 0))"
    calls = _CALLS[metric.type]
    x = quoted(metric.column) if metric.column else f"({metric.expression})"
    order = quoted(metric.order_column) if metric.order_column else None
    call = calls[-1] if order and len(calls) > 1 else calls[0]
    return call.format(x=x, p=metric.p, o=order) + only


def metric_sql(metric_id: str, metrics: Mapping[str, Metric], seen: tuple[str, ...] = ()) -> str:
    """The SQL of a metric, with ratios and templates resolved through the metrics they name."""
    if metric_id in seen:
        raise ConfigError("metrics depend on each other: " + " -> ".join((*seen, metric_id)))
    if metric_id not in metrics:
        raise ConfigError(f"unknown metric {metric_id!r}")
    metric, seen = metrics[metric_id], (*seen, metric_id)
    if metric.type == "ratio":
        a, b = (metric_sql(m, metrics, seen) for m in (metric.numerator, metric.denominator))
        return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"
    if metric.type == "expression":
        return TEMPLATE.sub(lambda m: f"({metric_sql(m[1], metrics, seen)})", metric.expression)
    return aggregate_sql(metric)
