"""Who may see what: policies, decisions and the governed source."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame

from ..config import Catalog
from ..functions.aggregates import dependencies
from ..functions.predicates import MissingAttribute, named, policy_column
from ..model import DenyReason, FilterError, Identity, MarlstoneError, Policy


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class ColumnView:
    name: str
    type: str
    sensitivity: str
    description: str | None
    example_values: tuple[str, ...] | None = None

    @property
    def display_name(self) -> str:
        return self.name


@dataclass(frozen=True)
class DimensionView:
    id: str
    column: str
    display_name: str
    type: str


@dataclass(frozen=True)
class MetricView:
    id: str
    display_name: str
    type: str
    unit: str | None
    description: str | None
    depends_on: tuple[str, ...]
    numerator: str | None = None
    denominator: str | None = None


@dataclass(frozen=True)
class AllowedSchema:
    source: str
    display_name: str
    columns: tuple[ColumnView, ...] = ()
    dimensions: tuple[DimensionView, ...] = ()
    metrics: tuple[MetricView, ...] = ()
    version: int = 0


@dataclass(frozen=True)
class Decision:
    allowed: bool
    reason: DenyReason | None = None
    detail: str | None = None
    columns: frozenset[str] = frozenset()
    row_filter: Column | None = None
    metric_versions: tuple[tuple[str, int], ...] = ()
    holds: tuple[str, ...] = ()

    @property
    def deny_text(self) -> str | None:
        if self.reason is None:
            return None
        return f"{self.reason.value}:{self.detail}" if self.detail else self.reason.value


class RateLimiter:
    """A token bucket for each (user, role): `rate` tokens a second, at most `burst` saved."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic):
        self.rate, self.burst, self.clock = rate, burst, clock
        self._state: dict[tuple[str, str], tuple[float, float]] = {}
        self._lock = threading.Lock()

    def acquire(self, user: str, role: str) -> bool:
        with self._lock:
            now = self.clock()
            tokens, at = self._state.get((user, role), (float(self.burst), now))
            tokens = min(float(self.burst), tokens + (now - at) * self.rate)
            ok = tokens >= 1.0
            self._state[user, role] = (tokens - 1.0 if ok else tokens, now)
            return ok


class Governance:
    """Decisions over a catalogue. `blocking` gives a source's failures that block it (quality.blocking_failures)."""

    def __init__(self, catalog: Callable[[], Catalog], blocking=None, limiter: RateLimiter | None = None, examples=None, clock: Callable[[], datetime] = utc_now):
        self._catalog, self._blocking, self._limiter, self._clock = catalog, blocking, limiter, clock
        self._examples = examples or (lambda source_id: {})

    def _columns(self, policy: Policy) -> frozenset[str]:
        source = self._catalog().sources[policy.source]
        return frozenset(c for c in source.column_names if policy.column_overrides.get(c, policy.default_column_mode) == "allow")

    def _expired(self, policy: Policy) -> bool:
        return policy.valid_until is not None and policy.valid_until < self._clock()

    def preview(self, identity: Identity, source_id: str) -> AllowedSchema:
        """What the role sees of a source; nothing without a policy or after it has expired."""
        catalog = self._catalog()
        if source_id not in catalog.sources:
            raise ValueError(f"unknown source {source_id!r}")
        source = catalog.sources[source_id]
        name = source.display_name or source.id
        policy = catalog.policy(identity.role_id, source_id)
        if policy is None or self._expired(policy):
            return AllowedSchema(source_id, name, version=catalog.generation)
        allowed = self._columns(policy)
        examples = self._examples(source_id)
        columns = tuple(ColumnView(c.name, c.type, c.sensitivity, c.description, examples.get(c.name)) for c in source.columns if c.name in allowed)
        dims = tuple(DimensionView(d.id, d.column, d.display_name or d.id, d.type) for d in source.dimensions if d.column in allowed)
        metrics = tuple(
            MetricView(m.id, m.display_name or m.id, m.type, m.unit, m.description, tuple(dependencies(m)), m.numerator, m.denominator) for m in catalog.metrics_of(source_id).values()
        )
        return AllowedSchema(source_id, name, columns, dims, metrics, catalog.generation)

    def evaluate(self, identity: Identity, source_ids: frozenset[str] | set[str], columns: frozenset[str] | set[str] = frozenset(), metrics: tuple[str, ...] = ()) -> Decision:
        """Allowed or denied, checked in a fixed order: rate, policy, expiry, health, columns, metrics, row filter."""
        if len(source_ids) != 1:
            raise NotImplementedError("one source at a time")
        [source_id] = source_ids
        catalog = self._catalog()

        def deny(reason, detail, allowed=frozenset(), holds=()):
            return Decision(False, reason, detail, allowed, holds=holds)

        if self._limiter and not self._limiter.acquire(identity.user_id, identity.role_id):
            return deny(DenyReason.RATE_LIMITED, f"user={identity.user_id} role={identity.role_id}")
        policy = catalog.policy(identity.role_id, source_id)
        if policy is None:
            return deny(DenyReason.NO_POLICY, f"role={identity.role_id} source={source_id}")
        if self._expired(policy):
            return deny(DenyReason.POLICY_EXPIRED, f"valid_until={policy.valid_until.isoformat()}")
        allowed = self._columns(policy)
        failures = self._blocking(source_id) if self._blocking else ()
        if failures:
            kind = DenyReason.QUALITY_BLOCK if failures[0].kind == "quality" else DenyReason.FRESHNESS_BLOCK
            return deny(kind, failures[0].detail or failures[0].reason, allowed, tuple(f.rule_id for f in failures))
        for c in sorted(columns):
            if c not in allowed:
                return deny(DenyReason.COLUMN_DENIED, c, allowed)
        versions = []
        for m in metrics:
            if m not in catalog.metrics or catalog.metrics[m].source != source_id:
                return deny(DenyReason.METRIC_DENIED, m, allowed)
            versions.append((m, catalog.versions[m][-1].version if m in catalog.versions else 1))
        row_filter = None
        if policy.row_filter is not None:
            try:
                row_filter = policy_column(policy.row_filter, catalog.sources[source_id].column_names, identity)
            except MissingAttribute as e:
                return deny(DenyReason.ATTRIBUTE_MISSING, str(e), allowed)
            except FilterError as e:
                return deny(DenyReason.AST_INVALID, str(e), allowed)
        return Decision(True, columns=allowed, row_filter=row_filter, metric_versions=tuple(versions))

    def alternatives(self, identity: Identity, source_ids, candidates) -> tuple[Decision, ...]:
        """A decision for each (columns, metrics)."""
        return tuple(self.evaluate(identity, source_ids, columns, metrics) for columns, metrics in candidates)


def governed(df: DataFrame, decision: Decision) -> DataFrame:
    """The source as a decision lets it be seen: rows filtered first, then hidden columns dropped.

    The filter may use a column that the role cannot see. Both go below every scan of a query, CTEs and self-joins included,
    and Catalyst pushes them into the file reader.
    """
    if not decision.allowed:
        raise MarlstoneError(f"denied: {decision.deny_text}")
    if decision.row_filter is not None:
        df = df.where(decision.row_filter)
    return df.select(*[named(c) for c in df.columns if c in decision.columns])


def resolve_identity(catalog: Catalog, user_id: str, role_id: str, attributes: dict[str, str] | None = None, origin: str = "cli") -> Identity:
    """An identity whose attributes are the role's, overridden by the user's own."""
    role = catalog.roles.get(role_id)
    return Identity(user_id, role_id, {**(role.attributes if role else {}), **(attributes or {})}, origin)


def identity_from_env(catalog: Catalog, prefix: str = "MARLSTONE_", env=None) -> Identity:
    """From <prefix>USER, <prefix>ROLE and <prefix>ATTR_<NAME> variables."""
    env = os.environ if env is None else env
    if f"{prefix}USER" not in env or f"{prefix}ROLE" not in env:
        raise MarlstoneError(f"{prefix}USER and {prefix}ROLE must be set")
    own = {k[len(prefix) + 5 :].lower(): v for k, v in env.items() if k.startswith(f"{prefix}ATTR_")}
    return resolve_identity(catalog, env[f"{prefix}USER"], env[f"{prefix}ROLE"], own, "env")


def identity_from_jwt(catalog: Catalog, token: str, secret: bytes, now: float | None = None) -> Identity:
    """From an HS256 token with sub, role and attributes; exp and nbf are checked."""

    def decoded(part: str) -> bytes:
        return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))

    try:
        head, body, signature = token.split(".")
        header, claims = json.loads(decoded(head)), json.loads(decoded(body))
        good = hmac.compare_digest(decoded(signature), hmac.new(secret, f"{head}.{body}".encode(), hashlib.sha256).digest())
    except ValueError as e:
        raise MarlstoneError("malformed token") from e
    if header.get("alg") != "HS256" or not good:
        raise MarlstoneError("bad token signature")
    now = time.time() if now is None else now
    if claims.get("exp", now + 1) <= now or claims.get("nbf", now) > now:
        raise MarlstoneError("token is not valid now")
    if not claims.get("sub") or not claims.get("role"):
        raise MarlstoneError("token lacks sub or role")
    return resolve_identity(catalog, claims["sub"], claims["role"], {k: str(v) for k, v in (claims.get("attributes") or {}).items()}, "jwt")


class ApprovalQueue:
    """Changes that wait for someone else's yes, kept in a JSON file if a path is given. None can be approved twice."""

    def __init__(self, path: str | None = None):
        self.path = path
        self.entries: list[dict] = []
        if path and os.path.exists(path):
            with open(path) as f:
                self.entries = json.load(f)

    def _save(self) -> None:
        if self.path:
            with open(f"{self.path}.new", "w") as f:
                json.dump(self.entries, f, indent=1, default=str)
            os.replace(f"{self.path}.new", self.path)

    def submit(self, change: dict, by: str) -> str:
        key = hashlib.sha256(json.dumps([change, by, len(self.entries)], sort_keys=True, default=str).encode()).hexdigest()[:16]
        self.entries.append({"id": key, "change": change, "submitted_by": by, "submitted_at": utc_now().isoformat(), "approved_by": None, "approved_at": None})
        self._save()
        return key

    def pending(self) -> list[dict]:
        return [e for e in self.entries if e["approved_by"] is None]

    def approve(self, key: str, by: str) -> dict:
        entry = next((e for e in self.entries if e["id"] == key), None)
        if entry is None:
            raise MarlstoneError(f"no change {key!r}")
        if entry["approved_by"] is not None:
            raise MarlstoneError(f"change {key!r} is approved already")
        entry |= {"approved_by": by, "approved_at": utc_now().isoformat()}
        self._save()
        return entry["change"]
