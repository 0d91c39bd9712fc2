from datetime import date, datetime, timedelta

import pytest

from fixture_catalog import RIDES, SCHEMA, catalog
from marlstone.engine import Engine
from marlstone.model import DenyReason, Identity
from marlstone.plans.governance import RateLimiter, resolve_identity

NOW = datetime(2025, 7, 3)


@pytest.fixture
def engine(spark, tmp_path):
    spark.createDataFrame(RIDES, SCHEMA).createOrReplaceTempView("rides_fixture")
    return Engine(spark, catalog(), folder=str(tmp_path), clock=lambda: NOW)


def who(engine, role="admin", **attributes):
    return resolve_identity(engine.catalog, "u1", role, attributes)


def ask(engine, metrics=(), dims=(), role="admin", **more):
    return engine.query(who(engine, role), {"source": "rides", "metrics": list(metrics), "dimensions": list(dims), **more})


def test_aggregates_with_filter_isolation(engine):
    r = ask(engine, ["ride_count", "paid_fares", "fare_per_ride", "per_ride"], ["rides.zone"], order_by=[{"key": "rides.zone"}])
    assert r.status == "ok", r.reason
    assert r.rows == [("harbour", 1, None, None, None), ("north", 4, 32.5, 8.125, 8.125), ("south", 2, 40.0, 20.0, 20.0), (None, 1, None, None, None)]


def test_period_over_period(engine):
    r = ask(engine, ["fares_mom"], [{"id": "rides.started", "grain": "month"}], order_by=[{"key": "rides.started"}])
    assert [x[1] for x in r.rows] == [None, -22.5, -10.0]
    assert ask(engine, ["fares_mom"]).stage == "intent_invalid"


def test_shapes(engine):
    cohort = {(x[0], x[1]): x[2:] for x in ask(engine, ["rider_retention"]).rows}
    assert cohort[datetime(2025, 5, 1), 0] == (2, 2, 1.0)
    assert cohort[datetime(2025, 5, 1), 2] == (1, 2, 0.5)
    assert ask(engine, ["ride_funnel"]).rows == [("booked", 0, 3, None, 1.0), ("finished", 1, 2, 2 / 3, 2 / 3)]
    assert ask(engine, ["back_again"]).rows == [(1,)]
    assert ask(engine, ["top_riders"]).rows == [(2, 2)]
    assert ask(engine, ["top_half"]).rows == [(3, 5)]


def test_row_filter_holds_inside_shapes(engine):
    assert ask(engine, ["ride_funnel"], role="north").rows[0][2] == 2
    assert ask(engine, ["back_again"], role="north").rows == [(1,)]
    assert ask(engine, ["top_riders"], role="north").rows == [(2, 4)]


def test_rolling_window(engine):
    r = ask(engine, ["fares_5d"])
    assert sorted((x[0] for x in r.rows), key=lambda v: v or 0.0) == [None, 10.0, 10.0, 10.0, 12.5, 20.0, 20.0, 42.5]


def test_percentiles_of_large_inputs(spark, monkeypatch, tmp_path):
    """The selected percentile equals Spark's own, by group and overall, filtered, with nulls and groups without a value."""
    from marlstone.plans import compiler

    raw = catalog("percentile_rows")
    raw["metrics"].append({"id": "paid_p30", "source": "rides", "type": "percentile", "column": "fare", "p": 0.3, "filter": "state = 'done'"})
    rows = [(str(i), None if i % 9 == 0 else float(i * i % 101), NOW, "done" if i % 3 else "open", [None, "a", "b", "c"][i % 4], None) for i in range(200)] + [("x", None, NOW, "done", "empty", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "rows"))
    spark.read.parquet(str(tmp_path / "rows")).createOrReplaceTempView("percentile_rows")
    e = Engine(spark, raw, result_cache=False)
    asked = [(["p95_fare", "median_fare", "ride_count", "paid_p30"], ["rides.zone"]), (["median_fare"], ["rides.zone", "rides.state"]), (["p95_fare", "paid_p30"], [])]
    want = [sorted(map(repr, ask(e, m, d).rows)) for m, d in asked]
    calls = []
    monkeypatch.setattr(compiler, "PERCENTILE_BYTES", 0)
    monkeypatch.setattr(compiler, "at_ranks", lambda *a, f=compiler.at_ranks: calls.append(a) or f(*a))
    assert [sorted(map(repr, ask(e, m, d).rows)) for m, d in asked] == want
    assert len(calls) == 6


def test_having_order_limit(engine):
    r = ask(engine, ["ride_count"], ["rides.state"], having=[{"op": "gte", "metric": "ride_count", "value": 2}], order_by=[{"key": "ride_count", "direction": "desc"}], limit=1)
    assert r.rows == [("done", 4)]
    assert ask(engine, (), ["rides.state"], order_by=[{"key": "rides.state"}]).rows == [("done",), ("open",), ("void",)]


@pytest.mark.parametrize(
    "change",
    [
        {"metrics": ["nope"]},
        {"metrics": ["ride_count"], "dimensions": ["nope"]},
        {"metrics": ["ride_count"], "dimensions": [{"id": "rides.zone", "grain": "month"}]},
        {"metrics": ["ride_count"], "filters": [{"op": "like", "column": "zone", "value": "w%"}]},
        {"metrics": ["ride_count"], "filters": [{"op": "eq", "column": "zone", "value": {"$attr": "zone"}}]},
        {"metrics": ["ride_count"], "having": [{"op": "gt", "metric": "paid_fares", "value": 1}]},
        {"metrics": ["ride_count"], "order_by": [{"key": "paid_fares"}]},
        {"metrics": ["ride_funnel", "ride_count"]},
        {"metrics": ["fares_5d", "ride_count"]},
        {"metrics": ["fares_5d"], "dimensions": ["rides.zone"]},
        {"metrics": ["ride_count"], "limit": 0},
        {"metrics": ["ride_count"], "limit": 10001},
        {"metrics": ["ride_count"], "unknown": 1},
        {"metrics": []},
    ],
)
def test_bad_intents_are_errors(engine, change):
    r = engine.query(who(engine), {"source": "rides", **change})
    assert (r.status, r.stage) == ("error", "intent_invalid")


def test_deny_reasons(engine, spark):
    g = engine.governance
    assert g.evaluate(who(engine, "nobody"), {"rides"}).reason is DenyReason.NO_POLICY
    assert g.evaluate(who(engine, "partner"), {"rides"}, {"zone"}).deny_text == "policy:no_column_access:zone"
    assert g.evaluate(who(engine), {"rides"}, (), ("nope",)).reason is DenyReason.METRIC_DENIED
    assert g.evaluate(who(engine, "lost"), {"rides"}).reason is DenyReason.ATTRIBUTE_MISSING
    with pytest.raises(NotImplementedError):
        g.evaluate(who(engine), {"rides", "x"})
    with pytest.raises(ValueError):
        g.preview(who(engine), "nope")
    raw = catalog()
    raw["policies"][0]["valid_until"] = "2025-07-02T00:00:00+00:00"
    late = Engine(spark, raw, clock=lambda: NOW)
    assert late.governance.evaluate(who(late), {"rides"}).reason is DenyReason.POLICY_EXPIRED
    assert late.schema(who(late), "rides").columns == ()
    limited = Engine(spark, catalog(), limiter=RateLimiter(0, 1, clock=lambda: 0.0))
    assert limited.governance.evaluate(who(limited, "nobody"), {"rides"}).reason is DenyReason.NO_POLICY
    assert limited.governance.evaluate(who(limited, "nobody"), {"rides"}).reason is DenyReason.RATE_LIMITED


def test_column_denial_reaches_into_fragments(engine):
    r = engine.query(who(engine, "partner"), {"source": "rides", "metrics": ["paid_fares"]})
    assert (r.status, r.reason) == ("denied", "policy:no_column_access:state")
    r = ask(engine, ["max_fare"], role="partner")
    assert r.rows == [(64.0,)]
    assert [c.name for c in engine.schema(who(engine, "partner"), "rides").columns] == ["ride_id", "fare", "started"]
    assert [d.id for d in engine.schema(who(engine, "partner"), "rides").dimensions] == ["rides.started"]


def test_quality_blocks_and_webhook(engine, spark):
    sent = []
    raw = catalog()
    raw["quality_rules"][0]["alert_webhook"] = "http://alerts.invalid/x"
    e = Engine(spark, raw, enforce_quality=True, clock=lambda: NOW, webhook=lambda url, body: sent.append((url, body)) or True)
    r = ask(e, ["ride_count"])
    assert r.status == "denied" and r.reason.startswith("quality:rule_failed:fare_not_null has never run")
    outcomes = {o.rule_id: o.passed for o in e.check("rides")}
    assert outcomes == {"fare_not_null": False, "fare_range": True, "fare_anomaly": True, "fresh": True}
    assert sent[0][1]["rule_id"] == "fare_not_null"
    assert ask(e, ["ride_count"]).status == "denied"


def test_stale_checks_block(engine, spark):
    raw = catalog()
    raw["quality_rules"] = [{"id": "range", "source": "rides", "type": "range", "config": {"column": "fare", "min": 0}, "severity": "block"}]
    raw["metrics"] = [m for m in raw["metrics"] if m["type"] != "anomaly_query"]
    now = [NOW]
    e = Engine(spark, raw, enforce_quality=True, clock=lambda: now[0])
    e.check("rides")
    assert ask(e, ["ride_count"]).status == "ok"
    now[0] += timedelta(seconds=601)
    assert "was last run" in ask(e, ["ride_count"]).reason


def test_anomaly_query(engine):
    for day, passed in ((1, True), (2, False), (3, False)):
        engine.runs.append(run_id=f"r{day}", rule_id="fare_anomaly", rule_kind="quality", passed=passed, observed_value=f'{{"value": {day}.5}}', ran_at=datetime(2025, 6, day))
    assert ask(engine, ["fare_anomalies"]).rows == [("r3", 3.5, datetime(2025, 6, 3), True), ("r2", 2.5, datetime(2025, 6, 2), True)]


def test_audit_is_redacted_and_complete(engine):
    ask(engine, ["ride_count"], filters=[{"op": "eq", "column": "rider", "value": "kim@m.example"}])
    engine.sql(who(engine, "glass"), "SELECT count(ride_id) AS n FROM rides WHERE lower(rider) = 'lee@m.example' AND state = 'done'")
    ask(engine, ["ride_count"], role="nobody")
    engine.sql(who(engine), "DROP TABLE rides")
    rows = sorted(engine.audit.df().collect(), key=lambda r: r["status"])
    assert [r["status"] for r in rows] == ["denied", "error", "ok", "ok"]
    text = " ".join(r["generated_sql"] for r in rows)
    assert "kim@m.example" not in text and "lee@m.example" not in text and "'done'" in text
    assert [r["is_break_glass"] for r in rows if r["status"] == "ok"].count(True) == 1
    assert rows[0]["deny_reason"] == "policy:no_policy_for_role:role=nobody source=rides"


def test_result_cache_and_touch(engine):
    assert not ask(engine, ["ride_count"]).cached
    assert ask(engine, ["ride_count"]).cached
    assert not ask(engine, ["ride_count"], role="north").cached
    engine.registry.touch("rides")
    assert not ask(engine, ["ride_count"]).cached


def test_state_is_shared_between_engines(spark, tmp_path):
    """Touches, quality history and the audit log of one engine are seen by the next on the same folder."""
    first = Engine(spark, catalog(), folder=str(tmp_path), enforce_quality=True, clock=lambda: NOW)
    before = first.registry.version("rides")
    first.registry.touch("rides")
    first.check("rides")
    ask(first, ["ride_count"])
    second = Engine(spark, catalog(), folder=str(tmp_path), enforce_quality=True, clock=lambda: NOW)
    assert second.registry.version("rides") == first.registry.version("rides") != before
    assert ask(second, ["ride_count"]).reason.startswith("quality:rule_failed:fare_not_null failed")
    assert [r["status"] for r in second.audit.rows()] == ["denied", "denied"]
    assert second.runs.df().count() == 4


def test_registered_phrases(engine):
    from marlstone.plans import nl

    kept = list(nl._COMPILED)
    try:

        @nl.register("metric_please", "please {metric}")
        def please(schema, said):
            return {"metrics": [schema.metric(said["metric"])]}

        match, r = engine.ask(who(engine), "please ride count", "rides")
        assert match.pattern == "metric_please" and r.rows == [(8,)]
        assert engine.ask(who(engine), "please nonsense", "rides") == (None, None)
    finally:
        nl._COMPILED[:] = kept


def test_questions(engine):
    engine.sample_examples("rides")
    match, r = engine.ask(who(engine), "top 1 zone by paid fares?", "rides")
    assert match.pattern == "top_n_by_metric" and r.rows == [("south", 40.0)]
    assert engine.ask(who(engine), "tell me a joke about ducks", "rides") == (None, None)
    match, r = engine.ask(who(engine), "paid fares in june 2025", "rides")
    assert r.rows == [(20.0,)]
    match, _ = engine.ask(who(engine), "ride count this month", "rides", today=date(2025, 7, 9))
    assert match.intent["filters"][0]["args"][0]["value"] == "2025-07-01"


def test_explain_runs_nothing(engine):
    out = engine.explain(who(engine, "north"), {"source": "rides", "metrics": ["ride_count"]})
    assert out["allowed"] and "zone" in out["plan"]
    assert engine.audit.rows() == []
    assert not engine.explain(who(engine, "nobody"), {"source": "rides", "metrics": ["ride_count"]})["allowed"]


def test_unknown_identity_attributes_override(engine):
    assert who(engine, "north", zone="south").attributes == {"zone": "south"}
    assert ask(engine, ["ride_count"], role="north").rows == [(4,)]
    r = engine.query(Identity("u", "north", {"zone": "south"}), {"source": "rides", "metrics": ["ride_count"]})
    assert r.rows == [(2,)]
