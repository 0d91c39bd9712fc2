"""Quality and freshness checks, their log, and what they block."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import named
from ..model import FreshnessRule, QualityRule

# Seconds after which a run no longer counts.
STALE_CHEAP, STALE_EXPENSIVE, STALE_FRESHNESS = 600, 3600, 300
EXPENSIVE = ("custom_sql", "anomaly", "unique")


@dataclass(frozen=True)
class Outcome:
    rule_id: str
    kind: str
    passed: bool
    observed: Any = None
    detail: str | None = None


@dataclass(frozen=True)
class Failure:
    rule_id: str
    kind: str
    reason: str
    detail: str | None = None


def staleness(rule: QualityRule | FreshnessRule) -> int:
    if rule.staleness_seconds is not None:
        return rule.staleness_seconds
    if isinstance(rule, FreshnessRule):
        return STALE_FRESHNESS
    cost = rule.cost_class or ("expensive" if rule.type in EXPENSIVE else "cheap")
    return STALE_EXPENSIVE if cost == "expensive" else STALE_CHEAP


def measures(rules: Iterable[QualityRule | FreshnessRule]) -> dict[str, F.Column]:
    """One aggregate for each rule that is one: bad rows, duplicates, or the newest time. All fit into one scan."""
    out = {}
    for r in rules:
        if isinstance(r, FreshnessRule):
            out[r.id] = F.max(named(r.watermark_column).cast("timestamp_ntz"))
        elif r.type == "not_null":
            out[r.id] = F.count_if(named(r.config["column"]).isNull())
        elif r.type == "unique":
            out[r.id] = F.count(F.lit(1)) - F.countDistinct(named(r.config["column"]))
        elif r.type == "range":
            c, bad = named(r.config["column"]), F.lit(False)
            if r.config.get("min") is not None:
                bad = bad | (c < F.lit(r.config["min"]))
            if r.config.get("max") is not None:
                bad = bad | (c > F.lit(r.config["max"]))
            out[r.id] = F.count_if(bad)
    return out


def judge_anomaly(value: float | None, history: list[float], n_sigma: float) -> tuple[bool, float | None]:
    """(passed, z) of an observation against earlier ones. Fewer than two pass; no value fails; without spread, only an equal one passes."""
    if value is None:
        return False, None
    if len(history) < 2:
        return True, None
    mean = sum(history) / len(history)
    spread = math.sqrt(sum((x - mean) ** 2 for x in history) / (len(history) - 1))
    if spread == 0:
        return value == mean, None
    z = abs(value - mean) / spread
    return z <= n_sigma, z


def judge_freshness(newest: datetime | None, now: datetime, max_age_seconds: int) -> tuple[bool, float | None]:
    if newest is None:
        return False, None
    age = (now - newest).total_seconds()
    return age <= max_age_seconds, age


def run_checks(df: DataFrame, rules: Iterable[QualityRule | FreshnessRule], now: datetime, sql: Callable[[str], DataFrame], history: Callable[[str, int], list[float]]) -> list[Outcome]:
    """Outcomes of enabled rules on one source. Rules that are aggregates share one job; SQL rules run one each."""
    rules = [r for r in rules if getattr(r, "enabled", True)]
    found = measures(rules)
    values = df.agg(*[c.alias(k) for k, c in found.items()]).first().asDict() if found else {}
    out = []
    for r in rules:
        kind = "freshness" if isinstance(r, FreshnessRule) else "quality"
        if isinstance(r, FreshnessRule):
            passed, age = judge_freshness(values[r.id], now, r.max_age_seconds)
            out.append(Outcome(r.id, kind, passed, {"value": age}, None if passed else f"age {age} s, allowed {r.max_age_seconds} s"))
        elif r.id in values:
            bad = values[r.id]
            out.append(Outcome(r.id, kind, bad == 0, {"value": bad}, None if bad == 0 else f"{r.type}: {bad} rows"))
        else:
            out.append(_sql_rule(r, sql, history))
    return out


def _sql_rule(r: QualityRule, sql, history) -> Outcome:
    rows = sql(r.config["sql"]).limit(2).collect()
    if len(rows) != 1 or len(rows[0]) != 1:
        return Outcome(r.id, "quality", False, {"value": None}, "the statement must give one row with one column")
    value = rows[0][0]
    if r.type == "custom_sql":
        return Outcome(r.id, "quality", bool(value), {"value": value}, None if value else f"custom_sql gave {value!r}")
    number = None if value is None else float(value)
    passed, z = judge_anomaly(number, history(r.id, int(r.config["trailing_periods"])), float(r.config["n_sigma"]))
    return Outcome(r.id, "quality", passed, {"value": number, "z": z}, None if passed else f"anomaly: {number}, z {z}")


def log_row(outcome: Outcome, now: datetime) -> dict:
    return {"run_id": uuid.uuid4().hex, "rule_id": outcome.rule_id, "rule_kind": outcome.kind, "passed": outcome.passed, "observed_value": json.dumps(outcome.observed, default=str), "ran_at": now}


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each rule."""
    order = Window.partitionBy("rule_id").orderBy(F.desc("ran_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def trailing(runs: DataFrame, rule_id: str, n: int) -> list[float]:
    """The last n observed numbers of a rule."""
    value = F.get_json_object("observed_value", "$.value").cast("double")
    rows = runs.where(F.col("rule_id") == rule_id).select(value.alias("v"), "ran_at", "run_id").where("v IS NOT NULL").orderBy(F.desc("ran_at"), F.desc("run_id")).limit(n)
    return [r["v"] for r in rows.collect()]


def blocking_failures(runs: DataFrame, rules: Iterable[QualityRule | FreshnessRule], now: datetime, spark: SparkSession) -> list[Failure]:
    """Rules of severity block that keep a source closed: never run, failed, or run too long ago."""
    rules = [r for r in rules if r.severity == "block" and getattr(r, "enabled", True)]
    if not rules:
        return []
    declared = spark.createDataFrame([(r.id, k) for k, r in enumerate(rules)], "rule_id string, place int")
    rows = {r["rule_id"]: r for r in declared.join(latest_runs(runs.where(F.col("rule_id").isin([r.id for r in rules]))), "rule_id", "left").collect()}
    out = []
    for r in rules:
        kind, last = ("freshness" if isinstance(r, FreshnessRule) else "quality"), rows[r.id]
        if last["ran_at"] is None:
            out.append(Failure(r.id, kind, "never_run", f"{r.id} has never run"))
        elif not last["passed"]:
            out.append(Failure(r.id, kind, "rule_failed", f"{r.id} failed"))
        elif now - last["ran_at"] > timedelta(seconds=staleness(r)):
            out.append(Failure(r.id, kind, "stale_check", f"{r.id} was last run at {last['ran_at'].isoformat()}"))
    return out


def access_anomalies(log: DataFrame, today: datetime, trailing_days: int = 14, n_sigma: float = 3.0, min_days: int = 3) -> DataFrame:
    """user_id, role_id, today_count, mean, stddev, z_score: who asks far more today than on the days before.

    Days without a query are no history. With constant history any other count today is flagged, with an infinite z.
    """
    if trailing_days < 2 or n_sigma <= 0:
        raise ValueError("trailing_days must be at least 2 and n_sigma positive")
    day = F.date_trunc("day", F.col("created_at").cast("timestamp")).cast("date")
    now = F.lit(today.date())
    days = log.where((day >= F.date_sub(now, trailing_days)) & (day <= now)).groupBy("user_id", "role_id", day.alias("day")).agg(F.count("*").alias("n"))
    before = F.col("day") < now
    sums = days.groupBy("user_id", "role_id").agg(
        F.coalesce(F.sum(F.when(~before, F.col("n"))), F.lit(0)).alias("today_count"),
        F.avg(F.when(before, F.col("n"))).alias("mean"),
        F.coalesce(F.stddev_samp(F.when(before, F.col("n"))), F.lit(0.0)).alias("stddev"),
        F.count_if(before).alias("days"),
    )
    z = F.when(F.col("stddev") == 0, F.when(F.col("today_count") != F.col("mean"), F.lit(float("inf")))).otherwise((F.col("today_count") - F.col("mean")) / F.nullif("stddev", F.lit(0.0)))
    return sums.where(F.col("days") >= min_days).withColumn("z_score", z).where(F.col("z_score") > n_sigma).drop("days")
