"""The catalogue's objects and the query intent. All are plain frozen dataclasses on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import datetime
from enum import Enum
from typing import Any

# Names that the catalogue, intents and the audit log use.
SENSITIVITIES = ("public", "internal", "pii", "restricted", "unclassified")
SENSITIVE = frozenset({"pii", "restricted"})
SOURCE_TYPES = ("parquet", "csv", "json", "orc", "table", "sql_view", "jdbc")
#: Other names of source types that a catalogue may use.
SOURCE_ALIASES = {"duckdb_table": "table", "delta_table": "table", "view": "sql_view"}
DIMENSION_TYPES = ("categorical", "temporal", "numeric_bin")
GRAINS = ("year", "quarter", "month", "week", "day", "hour")
PERIODS = ("year", "quarter", "month", "week", "day")
COMPARISONS = ("delta", "ratio", "pct_change")
ROLLING = ("sum", "avg", "min", "max", "count")
HAVING_OPS = ("eq", "neq", "lt", "lte", "gt", "gte", "in", "not_in")
AGGREGATES = (
    "count", "sum", "avg", "min", "max", "percentile", "median", "weighted_avg", "stddev_samp", "stddev_pop", "variance",
    "count_distinct", "count_distinct_approx", "mode", "first_value", "last_value",
)
DERIVED = ("ratio", "expression")
WINDOWS = ("rolling_window", "period_over_period")
SHAPES = ("cohort_retention", "funnel", "multi_stage_filter", "cohort_filter", "anomaly_query")
METRIC_TYPES = AGGREGATES + DERIVED + WINDOWS + SHAPES
DEFAULT_LIMIT, MAX_LIMIT = 1000, 10000


class DenyReason(str, Enum):
    """Why an attempt was denied; the values are stable and stand in the audit log."""

    NO_POLICY = "policy:no_policy_for_role"
    COLUMN_DENIED = "policy:no_column_access"
    METRIC_DENIED = "policy:no_metric_access"
    AST_INVALID = "policy:ast_invalid"
    ATTRIBUTE_MISSING = "policy:attribute_unresolved"
    POLICY_EXPIRED = "policy:expired"
    RATE_LIMITED = "policy:rate_limited"
    QUALITY_BLOCK = "quality:rule_failed"
    FRESHNESS_BLOCK = "freshness:rule_failed"


class MarlstoneError(Exception):
    """Base of this library's errors."""


class ConfigError(MarlstoneError):
    """The catalogue is not valid."""


class IntentError(MarlstoneError):
    """An intent is malformed or asks for what the role cannot see."""


class FilterError(MarlstoneError):
    """A filter tree is not valid."""


class SourceError(MarlstoneError):
    """A source is unknown or cannot be read."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    sensitivity: str = "unclassified"
    description: str | None = None
    expose_examples: bool | None = None


@dataclass(frozen=True)
class Dimension:
    id: str
    column: str
    type: str = "categorical"
    display_name: str = ""
    description: str | None = None


@dataclass(frozen=True)
class Source:
    id: str
    type: str
    uri: str
    display_name: str = ""
    primary_grain: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    columns: tuple[Column, ...] = ()
    dimensions: tuple[Dimension, ...] = ()

    @property
    def column_names(self) -> frozenset[str]:
        return frozenset(c.name for c in self.columns)

    def dimension(self, dimension_id: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.id == dimension_id), None)


@dataclass(frozen=True)
class Metric:
    """A metric; which fields a type needs is in config.METRIC_RULES."""

    id: str
    source: str
    type: str
    display_name: str = ""
    expression: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    filter: str | None = None
    unit: str | None = None
    description: str | None = None
    owner: str | None = None
    column: str | None = None
    p: float | None = None
    weight_column: str | None = None
    order_column: str | None = None
    aggregate: str | None = None
    window: str | None = None
    order_by_column: str | None = None
    partition_by: tuple[str, ...] = ()
    base_metric: str | None = None
    period_dim: str | None = None
    period_unit: str | None = None
    comparison: str | None = None
    entity_column: str | None = None
    event_column: str | None = None
    cohort_grain: str | None = None
    retention_grain: str | None = None
    max_periods: int | None = None
    funnel_entity_column: str | None = None
    funnel_event_order_column: str | None = None
    funnel_steps: tuple[tuple[str, str], ...] = ()
    msf_entity_column: str | None = None
    msf_ranking_expression: str | None = None
    msf_result_expression: str | None = None
    top_n: int | None = None
    top_percentile: float | None = None
    cohort_condition: str | None = None
    result_condition: str | None = None
    rule_id: str | None = None
    materialized: tuple[str, ...] | None = None
    materialized_strategy: str | None = None
    watermark_column: str | None = None
    late_arrival_grace_seconds: int | None = None

    def definition(self) -> str:
        """What a version of the metric is made of, as canonical JSON."""
        plain = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("display_name", "description", "owner", "unit")}
        return json.dumps({k: v for k, v in plain.items() if v not in (None, ())}, sort_keys=True, default=list)


@dataclass(frozen=True)
class MetricVersion:
    metric_id: str
    version: int
    definition: str
    effective_from: datetime
    effective_to: datetime | None = None


@dataclass(frozen=True)
class Role:
    id: str
    display_name: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    is_break_glass: bool = False


@dataclass(frozen=True)
class Policy:
    id: str
    role: str
    source: str
    default_column_mode: str = "deny"
    column_overrides: dict[str, str] = field(default_factory=dict)
    row_filter: dict[str, Any] | None = None
    valid_until: datetime | None = None


@dataclass(frozen=True)
class QualityRule:
    id: str
    source: str
    type: str
    config: dict[str, Any]
    severity: str = "warn"
    cost_class: str | None = None
    staleness_seconds: int | None = None
    enabled: bool = True
    alert_webhook: str | None = None


@dataclass(frozen=True)
class FreshnessRule:
    id: str
    source: str
    watermark_column: str
    max_age_seconds: int
    severity: str = "warn"
    staleness_seconds: int | None = None


@dataclass(frozen=True)
class Identity:
    user_id: str
    role_id: str
    attributes: dict[str, str] = field(default_factory=dict)
    origin: str = "cli"


@dataclass(frozen=True)
class DimensionRef:
    id: str
    grain: str | None = None


@dataclass(frozen=True)
class Having:
    op: str
    metric: str
    value: Any


@dataclass(frozen=True)
class OrderBy:
    key: str
    direction: str = "asc"


@dataclass(frozen=True)
class Intent:
    """One question: metrics by dimensions, with filters, post-filters, order and a limit."""

    source: str
    metrics: tuple[str, ...] = ()
    dimensions: tuple[DimensionRef, ...] = ()
    filters: tuple[dict, ...] = ()
    having: tuple[Having, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int = DEFAULT_LIMIT

    @staticmethod
    def parse(raw: dict | str | Intent) -> Intent:
        """Checks types and names; unknown fields are errors. A bare string is a dimension without a grain."""
        if isinstance(raw, Intent):
            return raw
        if isinstance(raw, str):
            try:
                raw = json.loads(raw)
            except ValueError as e:
                raise IntentError(f"intent is not JSON: {e}") from e
        if not isinstance(raw, dict):
            raise IntentError("intent must be an object")
        known = {f.name for f in fields(Intent)}
        if extra := sorted(set(raw) - known):
            raise IntentError(f"unknown fields: {', '.join(extra)}")
        if not isinstance(raw.get("source"), str):
            raise IntentError("source is required")

        def items(name):
            value = raw.get(name) or []
            if not isinstance(value, list | tuple):
                raise IntentError(f"{name} must be a list")
            return value

        def record(kind, value, name):
            if not isinstance(value, dict) or set(value) - {f.name for f in fields(kind)}:
                raise IntentError(f"bad entry in {name}: {value!r}")
            try:
                return kind(**value)
            except TypeError as e:
                raise IntentError(f"bad entry in {name}: {value!r}") from e

        dims = tuple(DimensionRef(d) if isinstance(d, str) else record(DimensionRef, d, "dimensions") for d in items("dimensions"))
        having = tuple(record(Having, h, "having") for h in items("having"))
        order = tuple(record(OrderBy, o, "order_by") for o in items("order_by"))
        metrics = tuple(items("metrics"))
        limit = raw.get("limit", DEFAULT_LIMIT)
        if not all(isinstance(m, str) for m in metrics):
            raise IntentError("metrics must be ids")
        if not metrics and not dims:
            raise IntentError("an intent needs metrics or dimensions")
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
            raise IntentError(f"limit must be between 1 and {MAX_LIMIT}")
        for d in dims:
            if d.grain is not None and d.grain not in GRAINS:
                raise IntentError(f"unknown grain {d.grain!r}")
        for h in having:
            if h.op not in HAVING_OPS:
                raise IntentError(f"unknown having operator {h.op!r}")
            if (h.op in ("in", "not_in")) != isinstance(h.value, list | tuple):
                raise IntentError(f"having {h.op} has the wrong kind of value")
        for o in order:
            if o.direction not in ("asc", "desc"):
                raise IntentError(f"unknown direction {o.direction!r}")
        return Intent(raw["source"], metrics, dims, tuple(items("filters")), having, order, limit)

    def to_json(self) -> str:
        from dataclasses import asdict

        return json.dumps(asdict(self), sort_keys=True, default=str)
