"""Catalogues from YAML or dicts, validated as a whole."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, field, fields, replace
from datetime import datetime, timezone
from typing import Any

from . import model as M
from .functions.aggregates import dependencies
from .functions.dates import interval
from .functions.predicates import check
from .model import ConfigError

#: For each metric type: the fields it needs, and those it may have besides the common ones.
METRIC_RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "count": ((), ("filter",)),
    **dict.fromkeys(("sum", "avg", "min", "max", "stddev_samp", "stddev_pop", "variance"), (("expression",), ("filter",))),
    "weighted_avg": (("expression", "weight_column"), ("filter",)),
    "percentile": (("column", "p"), ("filter",)),
    **dict.fromkeys(("median", "count_distinct", "count_distinct_approx", "mode"), (("column",), ("filter",))),
    **dict.fromkeys(("first_value", "last_value"), (("column",), ("filter", "order_column"))),
    "ratio": (("numerator", "denominator"), ()),
    "expression": (("expression",), ()),
    "rolling_window": (("column", "aggregate", "window", "order_by_column"), ("partition_by", "filter")),
    "period_over_period": (("base_metric", "period_dim", "period_unit", "comparison"), ()),
    "cohort_retention": (("entity_column", "event_column", "cohort_grain", "retention_grain"), ("max_periods",)),
    "funnel": (("funnel_entity_column", "funnel_event_order_column", "funnel_steps"), ()),
    "multi_stage_filter": (("msf_entity_column", "msf_ranking_expression", "msf_result_expression"), ("top_n", "top_percentile")),
    "cohort_filter": (("entity_column", "cohort_condition", "result_condition"), ()),
    "anomaly_query": (("rule_id",), ()),
}
COMMON = ("id", "source", "type", "display_name", "unit", "description", "owner")
STORED = ("materialized", "materialized_strategy", "watermark_column", "late_arrival_grace_seconds")
COLUMN_FIELDS = (
    "column", "weight_column", "order_column", "order_by_column", "entity_column", "event_column", "funnel_entity_column",
    "funnel_event_order_column", "msf_entity_column", "watermark_column",
)
RULE_TYPES = ("not_null", "unique", "range", "custom_sql", "anomaly")


@dataclass(frozen=True)
class Catalog:
    """Everything declared, by id. `versions` keeps each metric's history."""

    sources: Mapping[str, M.Source] = field(default_factory=dict)
    metrics: Mapping[str, M.Metric] = field(default_factory=dict)
    roles: Mapping[str, M.Role] = field(default_factory=dict)
    policies: Mapping[str, M.Policy] = field(default_factory=dict)
    quality_rules: Mapping[str, M.QualityRule] = field(default_factory=dict)
    freshness_rules: Mapping[str, M.FreshnessRule] = field(default_factory=dict)
    versions: Mapping[str, tuple[M.MetricVersion, ...]] = field(default_factory=dict)
    generation: int = 0

    def policy(self, role_id: str, source_id: str) -> M.Policy | None:
        return next((p for p in self.policies.values() if (p.role, p.source) == (role_id, source_id)), None)

    def metrics_of(self, source_id: str) -> dict[str, M.Metric]:
        return {k: m for k, m in self.metrics.items() if m.source == source_id}


def _record(kind, raw: Any, where: str, convert: Mapping[str, Any] | None = None):
    """A dataclass from a dict: no unknown and no missing fields."""
    if not isinstance(raw, dict):
        raise ConfigError(f"{where}: expected a mapping")
    known = {f.name: f for f in fields(kind)}
    label = f"{where} {raw.get('id', raw.get('name', ''))!r}"
    if extra := sorted(set(raw) - set(known)):
        raise ConfigError(f"{label}: unknown fields {extra}")
    missing = [n for n, f in known.items() if n not in raw and f.default is MISSING and f.default_factory is MISSING]
    if missing:
        raise ConfigError(f"{label}: missing {missing}")
    values = {k: (convert or {}).get(k, lambda v: v)(v) for k, v in raw.items()}
    return kind(**values)


def _one_of(value, allowed, what: str):
    if value not in allowed:
        raise ConfigError(f"{what}: {value!r} is not one of {', '.join(map(str, allowed))}")


def naive_utc(value: datetime | str | None) -> datetime | None:
    """A time without zone, in UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value is not None and value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def _steps(raw) -> tuple[tuple[str, str], ...]:
    if not isinstance(raw, list | tuple):
        raise ConfigError("funnel_steps must be a list")
    out = []
    for step in raw:
        if not isinstance(step, dict) or set(step) != {"name", "condition"}:
            raise ConfigError(f"funnel step {step!r} needs a name and a condition")
        out.append((step["name"], step["condition"]))
    return tuple(out)


def _metric(raw: dict) -> M.Metric:
    lists = {"partition_by": tuple, "funnel_steps": _steps, "materialized": lambda v: None if v is None else tuple(v)}
    m = _record(M.Metric, raw, "metric", lists)
    where = f"metric {m.id!r}"
    _one_of(m.type, M.METRIC_TYPES, where)
    needed, optional = METRIC_RULES[m.type]
    given = {k for k, v in raw.items() if v is not None}
    if missing := [k for k in needed if k not in given]:
        raise ConfigError(f"{where}: {m.type} requires {missing}")
    if extra := sorted(given - set(needed) - set(optional) - set(COMMON) - set(STORED)):
        raise ConfigError(f"{where}: {m.type} cannot have {extra}")
    if m.p is not None and not 0 < m.p < 1:
        raise ConfigError(f"{where}: p must be between 0 and 1, exclusive")
    if m.type == "rolling_window":
        _one_of(m.aggregate, M.ROLLING, where)
        interval(m.window)
    if m.type == "period_over_period":
        _one_of(m.period_unit, M.PERIODS, where)
        _one_of(m.comparison, M.COMPARISONS, where)
    if m.type == "cohort_retention":
        _one_of(m.cohort_grain, M.PERIODS, where)
        _one_of(m.retention_grain, M.PERIODS, where)
        if m.max_periods is not None and m.max_periods <= 0:
            raise ConfigError(f"{where}: max_periods must be positive")
    if m.type == "funnel":
        names = [n for n, _ in m.funnel_steps]
        if len(names) < 2 or len(set(names)) < len(names):
            raise ConfigError(f"{where}: a funnel needs at least two steps with different names")
    if m.type == "multi_stage_filter":
        if (m.top_n is None) == (m.top_percentile is None):
            raise ConfigError(f"{where}: exactly one of top_n and top_percentile")
        if (m.top_n is not None and m.top_n <= 0) or (m.top_percentile is not None and not 0 < m.top_percentile <= 1):
            raise ConfigError(f"{where}: top_n must be positive, top_percentile in (0, 1]")
    _stored(m, where)
    return m


def _stored(m: M.Metric, where: str) -> None:
    """Rules on materialisation."""
    if m.materialized is None:
        if m.materialized_strategy or m.watermark_column or m.late_arrival_grace_seconds is not None:
            raise ConfigError(f"{where}: materialization options need `materialized`")
        return
    if m.type not in M.AGGREGATES:
        raise ConfigError(f"{where}: {m.type} cannot be materialized")
    if m.materialized_strategy is not None:
        _one_of(m.materialized_strategy, ("full", "incremental"), where)
    if m.materialized_strategy == "incremental":
        if not m.watermark_column or not m.materialized:
            raise ConfigError(f"{where}: incremental needs a watermark_column and dimensions")
        if (m.late_arrival_grace_seconds or 0) < 0:
            raise ConfigError(f"{where}: late_arrival_grace_seconds must not be negative")
    elif m.watermark_column is not None or m.late_arrival_grace_seconds is not None:
        raise ConfigError(f"{where}: watermark_column and late_arrival_grace_seconds are for incremental only")


def _rule(raw: dict) -> M.QualityRule:
    r = _record(M.QualityRule, raw, "quality rule")
    where = f"quality rule {r.id!r}"
    _one_of(r.type, RULE_TYPES, where)
    _one_of(r.severity, ("warn", "block"), where)
    if r.cost_class is not None:
        _one_of(r.cost_class, ("cheap", "expensive"), where)
    needed = {"not_null": ["column"], "unique": ["column"], "range": ["column"], "custom_sql": ["sql"], "anomaly": ["sql", "n_sigma", "trailing_periods"]}[r.type]
    if missing := [k for k in needed if k not in r.config]:
        raise ConfigError(f"{where}: config needs {missing}")
    if r.type == "range" and "min" not in r.config and "max" not in r.config:
        raise ConfigError(f"{where}: range needs min or max")
    if r.type == "anomaly" and (r.config["n_sigma"] <= 0 or r.config["trailing_periods"] < 2):
        raise ConfigError(f"{where}: n_sigma must be positive and trailing_periods at least 2")
    return r


def load(raw: dict | str, previous: Catalog | None = None, now: datetime | None = None) -> Catalog:
    """A Catalog from a dict or YAML text. With `previous`, entries add to it; rules are replaced as a whole."""
    if isinstance(raw, str):
        import yaml

        raw = yaml.safe_load(raw) or {}
    kinds = {
        "sources": lambda r: _record(M.Source, r, "source", {"type": lambda t: M.SOURCE_ALIASES.get(t, t), "columns": lambda cs: tuple(_record(M.Column, c, "column") for c in cs), "dimensions": lambda ds: tuple(_record(M.Dimension, d, "dimension") for d in ds)}),
        "metrics": _metric,
        "roles": lambda r: _record(M.Role, r, "role", {"attributes": dict}),
        "policies": lambda r: _record(M.Policy, r, "policy", {"valid_until": naive_utc}),
        "quality_rules": _rule,
        "freshness_rules": lambda r: _record(M.FreshnessRule, r, "freshness rule"),
    }
    if extra := sorted(set(raw) - set(kinds)):
        raise ConfigError(f"unknown sections {extra}")
    found: dict[str, dict] = {}
    for section, build in kinds.items():
        found[section] = {}
        for entry in raw.get(section) or []:
            item = build(entry)
            if item.id in found[section]:
                raise ConfigError(f"{section}: id {item.id!r} appears twice")
            found[section][item.id] = item
    previous = previous or Catalog()
    kept = {s: {**getattr(previous, s), **found[s]} if "rules" not in s else found[s] for s in kinds}
    catalog = Catalog(**kept, versions=_versions(previous, kept["metrics"], now or datetime.now(timezone.utc).replace(tzinfo=None)), generation=previous.generation + 1)
    validate(catalog)
    return catalog


def _versions(previous: Catalog, metrics: Mapping[str, M.Metric], now: datetime) -> dict:
    """A new version for each metric whose definition changed; the one before ends."""
    out = dict(previous.versions)
    for m in metrics.values():
        history = out.get(m.id, ())
        text = m.definition()
        if history and history[-1].definition == text:
            continue
        if history:
            history = (*history[:-1], replace(history[-1], effective_to=now))
        out[m.id] = (*history, M.MetricVersion(m.id, len(history) + 1, text, now))
    return out


def validate(c: Catalog) -> None:
    """Checks across entries: references, columns, dimensions and dependency cycles."""
    for s in c.sources.values():
        _one_of(s.type, M.SOURCE_TYPES, f"source {s.id!r}")
        if len(s.column_names) < len(s.columns):
            raise ConfigError(f"source {s.id!r}: a column appears twice")
        for column in s.columns:
            _one_of(column.sensitivity, M.SENSITIVITIES, f"column {s.id}.{column.name}")
        if len({d.id for d in s.dimensions}) < len(s.dimensions):
            raise ConfigError(f"source {s.id!r}: a dimension appears twice")
        for d in s.dimensions:
            _one_of(d.type, M.DIMENSION_TYPES, f"dimension {d.id!r}")
            if s.columns and d.column not in s.column_names:
                raise ConfigError(f"dimension {d.id!r}: no column {d.column!r}")
    for m in c.metrics.values():
        _validate_metric(m, c)
    _cycles(c.metrics)
    seen: set = set()
    for p in c.policies.values():
        if p.role not in c.roles or p.source not in c.sources:
            raise ConfigError(f"policy {p.id!r}: unknown role or source")
        if (p.role, p.source) in seen:
            raise ConfigError(f"policy {p.id!r}: role {p.role!r} has another policy on {p.source!r}")
        seen.add((p.role, p.source))
        _one_of(p.default_column_mode, ("allow", "deny"), f"policy {p.id!r}")
        names = c.sources[p.source].column_names
        for column, mode in p.column_overrides.items():
            _one_of(mode, ("allow", "deny"), f"policy {p.id!r}")
            if column not in names:
                raise ConfigError(f"policy {p.id!r}: no column {column!r}")
        if p.row_filter is not None:
            check(p.row_filter, names, attributes=True)
    for r in c.quality_rules.values():
        _known_source(c, r)
        column = r.config.get("column")
        if column is not None and column not in c.sources[r.source].column_names:
            raise ConfigError(f"rule {r.id!r}: no column {column!r}")
    for r in c.freshness_rules.values():
        _known_source(c, r)
        _one_of(r.severity, ("warn", "block"), f"rule {r.id!r}")
        if r.watermark_column not in c.sources[r.source].column_names:
            raise ConfigError(f"rule {r.id!r}: no column {r.watermark_column!r}")
    if both := set(c.quality_rules) & set(c.freshness_rules):
        raise ConfigError(f"rule ids used twice: {sorted(both)}")


def _known_source(c: Catalog, r) -> None:
    if r.source not in c.sources:
        raise ConfigError(f"rule {r.id!r}: unknown source {r.source!r}")


def _validate_metric(m: M.Metric, c: Catalog) -> None:
    where = f"metric {m.id!r}"
    if m.source not in c.sources:
        raise ConfigError(f"{where}: unknown source {m.source!r}")
    source = c.sources[m.source]
    for name in COLUMN_FIELDS:
        value = getattr(m, name)
        if value is not None and value not in source.column_names:
            raise ConfigError(f"{where}: {name} {value!r} is not a column of {m.source!r}")
    for column in m.partition_by:
        if column not in source.column_names:
            raise ConfigError(f"{where}: partition_by {column!r} is not a column of {m.source!r}")
    for other in dependencies(m):
        if other not in c.metrics:
            raise ConfigError(f"{where}: unknown metric {other!r}")
        if c.metrics[other].source != m.source:
            raise ConfigError(f"{where}: {other!r} is on another source")
        if c.metrics[other].type in M.WINDOWS + M.SHAPES:
            raise ConfigError(f"{where}: cannot be made of {c.metrics[other].type} {other!r}")
    for dim in m.materialized or ():
        if source.dimension(dim) is None:
            raise ConfigError(f"{where}: unknown dimension {dim!r}")
    if m.type == "period_over_period":
        dim = source.dimension(m.period_dim)
        if dim is None or dim.type != "temporal":
            raise ConfigError(f"{where}: period_dim {m.period_dim!r} is not a temporal dimension of {m.source!r}")
    if m.type == "anomaly_query":
        rule = c.quality_rules.get(m.rule_id)
        if rule is None or rule.type != "anomaly":
            raise ConfigError(f"{where}: {m.rule_id!r} is not an anomaly rule")


def _cycles(metrics: Mapping[str, M.Metric]) -> None:
    done: set[str] = set()
    for start in metrics:
        path: list[str] = []
        work = [(start, iter(dependencies(metrics[start])))]
        path.append(start)
        while work:
            at, rest = work[-1]
            step = next(rest, None)
            if step is None:
                done.add(at)
                path.pop()
                work.pop()
            elif step in path:
                raise ConfigError("metrics depend on each other: " + " -> ".join([*path[path.index(step) :], step]))
            elif step not in done:
                path.append(step)
                work.append((step, iter(dependencies(metrics[step]))))


def slug(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", text)
