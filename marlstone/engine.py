"""The engine: a catalogue, its sources, governance, caches and logs in one object."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import config
from .config import Catalog
from .model import SHAPES, Identity, Intent, IntentError, MarlstoneError
from .operators import materialize, quality
from .plans import compiler, nl, redaction, sqlgate
from .plans.audit import AUDIT, RUNS, AppendLog
from .plans.cache import LruCache
from .plans.governance import AllowedSchema, Decision, Governance, RateLimiter, governed, utc_now
from .sources.registry import SourceRegistry, drift, example_values
from .sources.sinks import post_webhook, write


@dataclass
class Result:
    """What an attempt came to: ok with rows, denied with a reason, or error. Nothing is raised."""

    status: str
    columns: tuple[str, ...] = ()
    rows: list[tuple] = field(default_factory=list)
    reason: str | None = None
    stage: str | None = None
    query_id: str = ""
    cached: bool = False
    row_count: int | None = None

    @property
    def count(self) -> int:
        return len(self.rows) if self.row_count is None else self.row_count


@dataclass
class Plan:
    """An allowed question as a lazy DataFrame."""

    df: DataFrame
    decision: Decision
    text: str
    source: str


class Denied(MarlstoneError):
    def __init__(self, decision: Decision, text: str, source: str | None):
        super().__init__(decision.deny_text)
        self.decision, self.text, self.source = decision, text, source


class Engine:
    """Governed questions over Spark.

    `folder` holds the audit log, the quality log and stored metrics; without it logs stay on the driver and nothing is stored.
    Quality and freshness rules block a source only if `enforce_quality` is set.
    """

    def __init__(
        self,
        spark: SparkSession,
        catalog: Catalog | dict | str,
        folder: str | None = None,
        enforce_quality: bool = False,
        limiter: RateLimiter | None = None,
        clock: Callable[[], datetime] = utc_now,
        timeout_ms: int | None = None,
        result_cache: bool = True,
        webhook: Callable[[str, dict], bool] = post_webhook,
    ):
        self.spark = spark
        self.catalog = catalog if isinstance(catalog, Catalog) else config.load(catalog)
        self.registry = SourceRegistry(spark, self.catalog.sources, f"{folder}/touched" if folder else None)
        self.clock, self.timeout_ms, self.webhook = clock, timeout_ms, webhook
        self.audit = AppendLog(spark, AUDIT, f"{folder}/audit" if folder else None)
        self.runs = AppendLog(spark, RUNS, f"{folder}/quality_runs" if folder else None)
        self.store = materialize.MaterializedStore(spark, f"{folder}/materialized") if folder else None
        self.examples: dict[str, dict] = {}
        self.governance = Governance(lambda: self.catalog, self._failures if enforce_quality else None, limiter, lambda s: self.examples.get(s, {}), clock)
        self.plans, self.results, self.use_results = LruCache(256), LruCache(128), result_cache
        self._health: dict[str, tuple] = {}
        self.health_generation = 0

    # Catalogue

    def apply(self, raw: dict | str) -> None:
        """Adds to the catalogue, then refreshes stored metrics; a refresh that fails does not undo the rest."""
        self.catalog = config.load(raw, self.catalog, self.clock())
        self.registry.sources = self.catalog.sources
        self.plans.clear()
        self.refresh_errors = {}
        if self.store:
            for m in self.catalog.metrics.values():
                if m.materialized is not None:
                    try:
                        self.refresh(m.id)
                    except Exception as e:
                        self.refresh_errors[m.id] = str(e)

    def refresh(self, metric_id: str) -> DataFrame:
        if not self.store:
            raise MarlstoneError("there is no folder to store metrics in")
        m = self.catalog.metrics[metric_id]
        return self.store.refresh(m, self.catalog.sources[m.source], self.registry.load(m.source), self.clock())

    def sample_examples(self, source_id: str) -> dict:
        self.examples[source_id] = example_values(self.registry, source_id)
        return self.examples[source_id]

    def drift(self, source_id: str):
        return drift(self.registry, source_id)

    def schema(self, identity: Identity, source_id: str) -> AllowedSchema:
        return self.governance.preview(identity, source_id)

    # Quality

    def check(self, source_id: str) -> list[quality.Outcome]:
        """Runs the source's rules, records the outcomes, and alerts for block rules that failed."""
        c = self.catalog
        rules = [r for r in (*c.quality_rules.values(), *c.freshness_rules.values()) if r.source == source_id]
        df, now = self.registry.load(source_id), self.clock()

        def sql(text: str) -> DataFrame:
            return sqlgate.run(self.spark, text, source_id, df)

        outcomes = quality.run_checks(df, rules, now, sql, lambda rule, n: quality.trailing(self.runs.df(), rule, n))
        for o in outcomes:
            self.runs.append(**quality.log_row(o, now))
        self._health.pop(source_id, None)
        self.health_generation += 1
        for r in rules:
            o = next((x for x in outcomes if x.rule_id == r.id), None)
            if o and not o.passed and r.severity == "block" and getattr(r, "alert_webhook", None):
                self.webhook(r.alert_webhook, {"rule_id": r.id, "source_id": source_id, "kind": o.kind, "reason": "rule_failed", "detail": o.detail})
        return outcomes

    def _failures(self, source_id: str) -> list[quality.Failure]:
        """Blocking failures, remembered until a check runs or a run could have gone stale."""
        c, now = self.catalog, self.clock()
        known = self._health.get(source_id)
        if known and known[0] == c.generation and now < known[1]:
            return known[2]
        rules = [r for r in (*c.quality_rules.values(), *c.freshness_rules.values()) if r.source == source_id]
        found = quality.blocking_failures(self.runs.df(), rules, now, self.spark)
        from datetime import timedelta

        least = min([quality.staleness(r) for r in rules if r.severity == "block"], default=3600)
        self._health[source_id] = (c.generation, now + timedelta(seconds=max(1, least // 10)), found)
        return found

    # Plans

    def plan(self, identity: Identity, raw: dict | str | Intent) -> Plan:
        """A governed lazy DataFrame for an intent; IntentError or Denied otherwise. No query job runs."""
        intent = Intent.parse(raw)
        c = self.catalog
        if intent.source not in c.sources:
            raise IntentError(f"unknown source {intent.source!r}")
        source, text = c.sources[intent.source], intent.to_json()
        view = self.governance.preview(identity, intent.source)
        metrics = c.metrics_of(intent.source)
        shown = frozenset(x.name for x in view.columns)
        if not view.columns:
            decision = self.governance.evaluate(identity, {intent.source}, (), intent.metrics)
            if not decision.allowed:
                raise Denied(decision, text, intent.source)
        compiler.validate(intent, source, metrics, shown, frozenset(d.id for d in view.dimensions))
        df = self.registry.load(intent.source)
        key = (text, c.generation, df.schema.json())
        needed = self.plans.get_or(key, lambda: compiler.columns_needed(intent, source, metrics, df))
        decision = self.governance.evaluate(identity, {intent.source}, needed, intent.metrics)
        if not decision.allowed:
            raise Denied(decision, text, intent.source)
        stored = self._stored(intent, decision)
        if stored is not None:
            return Plan(stored, decision, text, intent.source)
        runs = self.runs.df() if any(metrics[m].type == "anomaly_query" for m in intent.metrics) else None
        return Plan(compiler.compile_intent(intent, source, metrics, governed(df, decision), runs), decision, text, intent.source)

    def _stored(self, intent: Intent, decision: Decision) -> DataFrame | None:
        """The stored metric, if it answers the intent exactly and no row filter stands in the way."""
        if self.store is None or len(intent.metrics) != 1 or decision.row_filter is not None:
            return None
        m = self.catalog.metrics[intent.metrics[0]]
        if m.materialized is None or tuple(d.id for d in intent.dimensions) != m.materialized:
            return None
        if any(d.grain for d in intent.dimensions) or intent.filters or intent.having or intent.order_by:
            return None
        df = self.store.read(m.id)
        if df is None:
            return None
        from .functions.predicates import named

        return df.orderBy(*[named(d).asc_nulls_last() for d in m.materialized]).limit(intent.limit)

    def plan_sql(self, identity: Identity, sql: str) -> Plan:
        source_id = sqlgate.parse(self.spark, sql)
        if source_id not in self.catalog.sources:
            raise sqlgate.SqlError(f"unknown source {source_id!r}")
        df = self.registry.load(source_id)
        used = sqlgate.columns_used(self.spark, sql, source_id, df.schema)
        decision = self.governance.evaluate(identity, {source_id}, used)
        if not decision.allowed:
            raise Denied(decision, sql, source_id)
        return Plan(sqlgate.run(self.spark, sql, source_id, governed(df, decision)), decision, sql, source_id)

    # Answers

    def query(self, identity: Identity, raw: dict | str | Intent, prompt: str | None = None) -> Result:
        """Answers an intent. Every attempt is audited, with sensitive values redacted."""
        import json

        text = raw if isinstance(raw, str) else raw.to_json() if isinstance(raw, Intent) else json.dumps(raw, sort_keys=True, default=str)
        return self._answer(identity, text, lambda: self.plan(identity, raw), redaction.redact_intent, prompt)

    def sql(self, identity: Identity, text: str) -> Result:
        return self._answer(identity, text, lambda: self.plan_sql(identity, text), redaction.redact_sql, None)

    def export(self, identity: Identity, text: str, path: str, kind: str = "parquet") -> Result:
        """Writes the answer to an intent (JSON text) or a SELECT to files, from executors; audited like any other. No rows return."""
        is_intent = text.lstrip().startswith("{")

        def written(plan: Plan) -> Result:
            count = Observation()
            write(plan.df.observe(count, F.count(F.lit(1)).alias("rows")), path, kind)
            return Result("ok", tuple(plan.df.columns), row_count=count.get["rows"])

        make = (lambda: self.plan(identity, text)) if is_intent else (lambda: self.plan_sql(identity, text))
        return self._answer(identity, text, make, redaction.redact_intent if is_intent else redaction.redact_sql, None, written)

    def ask(self, identity: Identity, question: str, source_id: str, today: date | None = None) -> tuple[nl.Match | None, Result | None]:
        """Answers a plain-English question; (None, None) where it is not understood."""
        match = nl.understand(question, self.schema(identity, source_id), today)
        return (None, None) if match is None else (match, self.query(identity, match.intent, prompt=question))

    def explain(self, identity: Identity, raw: dict | str | Intent) -> dict:
        """The decision and the physical plan, without running or auditing anything."""
        try:
            plan = self.plan(identity, raw)
        except Denied as e:
            return {"allowed": False, "reason": e.decision.deny_text}
        except (IntentError, MarlstoneError) as e:
            return {"allowed": False, "reason": str(e)}
        text = plan.df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return {"allowed": True, "columns": plan.df.columns, "metric_versions": plan.decision.metric_versions, "plan": text}

    def _answer(self, identity: Identity, text: str, make: Callable[[], Plan], redact, prompt: str | None, run: Callable[[Plan], Result] | None = None) -> Result:
        """Every attempt is in the audit log before its result is returned."""
        began, query_id = time.monotonic(), uuid.uuid4().hex
        source, versions, result = None, "", None
        try:
            plan = make()
            source, versions = plan.source, ",".join(f"{m}@{v}" for m, v in plan.decision.metric_versions)
            result = run(plan) if run else self._rows(identity, plan)
        except Denied as e:
            source, result = e.source, Result("denied", reason=e.decision.deny_text, stage="governance")
        except (IntentError, sqlgate.SqlError) as e:
            result = Result("error", reason=str(e), stage="intent_invalid" if isinstance(e, IntentError) else "sql_invalid")
        except Exception as e:
            result = Result("error", reason=str(e).splitlines()[0] if str(e) else type(e).__name__, stage="execution")
        result.query_id = query_id
        sensitive = redaction.sensitive_columns(self.catalog, source)
        role = self.catalog.roles.get(identity.role_id)
        reason = result.reason if result.status == "denied" or result.stage == "intent_invalid" else None
        self.audit.append(
            query_id=query_id, user_id=identity.user_id, role_id=identity.role_id, nl_prompt=redaction.redact_prompt(prompt, text, sensitive),
            generated_sql=redact(text, sensitive), status=result.status, deny_reason=redact_reason(reason, text, redact, sensitive), row_count=result.count if result.status == "ok" else None,
            duration_ms=int((time.monotonic() - began) * 1000), created_at=self.clock(), is_break_glass=bool(role and role.is_break_glass), metric_versions=versions,
        )
        return result

    def _rows(self, identity: Identity, plan: Plan) -> Result:
        key = (
            plan.text, plan.source, identity.user_id, identity.role_id, tuple(sorted(identity.attributes.items())), plan.decision.columns,
            self.catalog.generation, self.health_generation, self.registry.version(plan.source),
        )
        fixed = not any(self.catalog.metrics[m].type in SHAPES and self.catalog.metrics[m].type == "anomaly_query" for m, _ in plan.decision.metric_versions)
        if self.use_results and fixed and (known := self.results.get(key)):
            return Result("ok", known[0], list(known[1]), cached=True)
        columns, rows = tuple(plan.df.columns), [tuple(r) for r in self._collect(plan.df)]
        if self.use_results and fixed and len(rows) <= 10000:
            self.results.put(key, (columns, tuple(rows)))
        return Result("ok", columns, rows)

    def _collect(self, df: DataFrame):
        """Rows on the driver; after the timeout the query's own jobs are cancelled."""
        if not self.timeout_ms:
            return df.collect()
        tag, spark = f"marlstone-{uuid.uuid4().hex}", df.sparkSession
        timer = threading.Timer(self.timeout_ms / 1000, lambda: spark.sparkContext.cancelJobsWithTag(tag))
        spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        finally:
            timer.cancel()
            spark.sparkContext.removeJobTag(tag)


def redact_reason(reason: str | None, text: str, redact, sensitive) -> str | None:
    """A reason may quote the query; then it is kept only if nothing in the query was redacted."""
    return reason if reason is None or redact(text, sensitive) == text or ":" in reason and reason.split(":")[0] in ("policy", "quality", "freshness") else "invalid"
