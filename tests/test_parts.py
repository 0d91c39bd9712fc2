import json
import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixture_catalog import RIDES, SCHEMA, catalog
from marlstone import cli, config
from marlstone.config import load
from marlstone.functions.dates import boundary_diff, interval, interval_sql
from marlstone.functions.predicates import check, intent_column
from marlstone.model import ConfigError, FilterError, Source
from marlstone.operators import materialize
from marlstone.operators.quality import judge_anomaly
from marlstone.operators.selection import at_ranks
from marlstone.operators.windows import rolling
from marlstone.plans import redaction, sqlgate
from marlstone.plans.audit import AUDIT, RUNS, AppendLog
from marlstone.plans.governance import ApprovalQueue, identity_from_env, identity_from_jwt
from marlstone.sources.registry import Drift, SourceRegistry, drift, example_values
from marlstone.sources.sinks import to_csv, to_json, to_tsv


@pytest.fixture(scope="module")
def rides(spark):
    df = spark.createDataFrame(RIDES, SCHEMA)
    df.createOrReplaceTempView("rides_fixture")
    return df


def sql3(tree, row):
    """A filter by three-valued logic in plain Python."""
    op = tree["op"]
    if op in ("and", "or"):
        values = [sql3(a, row) for a in tree["args"]]
        stop = op == "or"
        return stop if stop in values else None if None in values else not stop
    if op == "not":
        v = sql3(tree["args"][0], row)
        return None if v is None else not v
    x = row[tree["column"]]
    if op in ("is_null", "is_not_null"):
        return (x is None) == (op == "is_null")
    v = tree["value"]
    if x is None:
        return None
    plain = {"eq": lambda: x == v, "neq": lambda: x != v, "lt": lambda: x < v, "lte": lambda: x <= v, "gt": lambda: x > v, "gte": lambda: x >= v, "in": lambda: x in v, "not_in": lambda: x not in v, "between": lambda: v[0] <= x <= v[1]}
    return plain[op]()


numbers = st.sampled_from([30, 50, 100, 200, 400])
leaves = st.one_of(
    st.builds(lambda op, v: {"op": op, "column": "fare", "value": v}, st.sampled_from(["eq", "neq", "lt", "lte", "gt", "gte"]), numbers),
    st.builds(lambda op, v: {"op": op, "column": "zone", "value": v}, st.sampled_from(["in", "not_in"]), st.lists(st.sampled_from(["north", "south", "harbour"]), min_size=1)),
    st.builds(lambda op, c: {"op": op, "column": c}, st.sampled_from(["is_null", "is_not_null"]), st.sampled_from(["fare", "zone"])),
    st.builds(lambda a, b: {"op": "between", "column": "fare", "value": [a, b]}, numbers, numbers),
)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(lambda op, a: {"op": op, "args": a}, st.sampled_from(["and", "or"]), st.lists(t, min_size=1, max_size=3)), st.builds(lambda a: {"op": "not", "args": [a]}, t)), max_leaves=6)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=trees)
def test_filters_agree_with_three_valued_logic(rides, tree):
    got = {r["ride_id"] for r in rides.where(intent_column(tree, frozenset(rides.columns))).collect()}
    names = rides.columns
    assert got == {r[0] for r in RIDES if sql3(tree, dict(zip(names, r, strict=True))) is True}


@pytest.mark.parametrize("tree", [None, {}, {"op": "and", "args": []}, {"op": "not", "args": [1, 2]}, {"op": "eq", "column": "x", "value": 1}, {"op": "in", "column": "a", "value": []}, {"op": "in", "column": "a", "value": 3}, {"op": "between", "column": "a", "value": [1]}, {"op": "is_null", "column": "a", "value": 1}, {"op": "eq", "column": "a"}, {"op": "eq", "column": "a", "value": 1, "more": 2}, {"op": "eq", "column": "a", "value": [1]}])
def test_bad_filters(tree):
    with pytest.raises(FilterError):
        check(tree, {"a"}, attributes=True)


def test_boundary_differences(spark):
    cases = [("month", "2024-01-31", "2024-02-01", 1), ("day", "2024-01-01 23:00", "2024-01-02 01:00", 1), ("year", "2023-12-31", "2024-01-01", 1), ("quarter", "2024-03-31", "2024-04-01", 1), ("week", "2024-02-04", "2024-02-05", 0), ("week", "2024-02-04", "2024-02-12", 1), ("week", "2024-01-10", "2024-01-01", -1)]
    for unit, a, b, n in cases:
        df = spark.sql(f"SELECT TIMESTAMP_NTZ'{a}:00' a, TIMESTAMP_NTZ'{b}:00' b" if ":" in a else f"SELECT TIMESTAMP_NTZ'{a}' a, TIMESTAMP_NTZ'{b}' b")
        assert df.select(boundary_diff(unit, F.col("a"), F.col("b"))).first()[0] == n
    assert interval("28 days") == (28, "day") and interval_sql("2 quarters") == "INTERVAL 6 MONTH"
    with pytest.raises(ConfigError):
        interval("soon")


def test_widgets(spark):
    """Aggregates with known values on five rows."""
    from marlstone.functions.aggregates import metric_sql
    from marlstone.model import Metric

    spark.createDataFrame([("a", 10.0, 1.0, "red"), ("b", 20.0, 2.0, "red"), ("c", 30.0, 3.0, "blue"), ("d", 30.0, 3.0, "blue"), ("e", 30.0, 3.0, "blue")], "id string, value double, weight double, label string").createOrReplaceTempView("widgets")
    ms = {m.id: m for m in (Metric("v", "w", "variance", expression="value"), Metric("m", "w", "median", column="value"), Metric("o", "w", "mode", column="label"), Metric("d", "w", "count_distinct", column="label"), Metric("w", "w", "weighted_avg", expression="value", weight_column="weight"), Metric("f", "w", "first_value", column="value", order_column="id"), Metric("l", "w", "last_value", column="value", order_column="id"))}
    row = spark.table("widgets").agg(*[F.expr(metric_sql(k, ms)).alias(k) for k in ms]).first()
    assert (round(row["v"], 9), row["m"], row["o"], row["d"], round(row["w"], 6), row["f"], row["l"]) == (80.0, 30.0, "blue", 2, round(320 / 12, 6), 10.0, 30.0)


@pytest.mark.parametrize("window, by", [("3 days", ()), ("90 minutes", ("g",)), ("1 month", ()), ("1 quarter", ("g",)), ("1 second", ())])
def test_rolling_equals_one_window(spark, window, by):
    """Every aggregate against Spark's own window: ties, a time that a third of the rows have, nulls, month ends, a hot group."""
    start = datetime(2024, 1, 29, 23, 30)
    rows = [(i, start + timedelta(minutes=i * i % 997 * 60, microseconds=i % 3), None if i % 11 == 0 else float(i % 7) - 3, None if i % 5 == 0 else "h" if i % 4 else "c") for i in range(300)]
    rows += [(1000 + i, datetime(2024, 2, 29, 12), float(i), "h") for i in range(150)] + [(2000 + i, datetime(2023, 10 + i % 3, 31 - i % 3), 1.5, "h") for i in range(20)]
    rows += [(900, None, 1.0, "h"), (901, None, 2.0, "h"), (902, None, None, None)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, v double, g string")
    df.createOrReplaceTempView("rolling_rows")
    frame = f"({'PARTITION BY g ' if by else ''}ORDER BY t RANGE BETWEEN {interval_sql(window)} PRECEDING AND CURRENT ROW)"
    for f in ("sum", "avg", "min", "max", "count"):
        m = config._metric({"id": "r", "source": "s", "type": "rolling_window", "column": "v", "aggregate": f, "window": window, "order_by_column": "t", "partition_by": list(by), "filter": "k % 13 <> 0"})
        got = {r["k"]: r["r"] for r in rolling(df, m, keep=("k",)).collect()}
        want = {r["k"]: r["r"] for r in spark.sql(f"SELECT k, {f}(CASE WHEN k % 13 <> 0 THEN v END) OVER {frame} AS r FROM rolling_rows").collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == want[k] or got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_selection_of_ranks(spark):
    """Order statistics by group against sorted lists."""
    rng = random.Random(3)
    rows = [(g, None if rng.random() < 0.1 else rng.choice([rng.gauss(0, 1), 7.0, rng.random() * 1e9])) for g in ("a", "b", None) for _ in range(400)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {r["g"]: r["at"] for r in at_ranks(df, ["g"], "v", share, lambda n, p=share: [F.floor((n - 1) * p)]).collect()}
        for g in ("a", "b", "c", None):
            values = sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v or 0.0))
            assert got[g] == values[math.floor((len(values) - 1) * share)]
    assert at_ranks(df.where("false"), [], "v", 0.5, lambda n: [F.floor(n / 2)]).count() == 0


def test_logs_survive_their_process(spark, tmp_path):
    """Rows are there for a second log on the same path, written singly, gathered, or in both places."""
    path = str(tmp_path / "log")
    at = datetime(2026, 3, 4, 5, 6, 7, 123456)
    first = AppendLog(spark, RUNS, path, batch=3)
    assert first.df().count() == 0
    for i in range(4):
        first.append(run_id=f"r{i}", rule_id="x", passed=i % 2 == 0, ran_at=at)
        assert AppendLog(spark, RUNS, path).df().count() == i + 1
    assert len(list((tmp_path / "log" / "new").glob("*.json"))) == 1
    second = AppendLog(spark, RUNS, path)
    second.append(run_id="r9", rule_id="it's \"odd\"\n", passed=None, ran_at=None)
    second.append(run_id="r0", rule_id="x", passed=True, ran_at=at)  # as if a process had ended while it gathered
    rows = {r["run_id"]: r for r in second.rows()}
    assert sorted(rows) == ["r0", "r1", "r2", "r3", "r9"] and len(second.rows()) == 5
    assert rows["r1"]["ran_at"] == at and rows["r1"]["passed"] is False and rows["r9"]["rule_id"] == "it's \"odd\"\n"
    second.gather()
    assert AppendLog(spark, RUNS, path).df().count() == 5


@pytest.mark.parametrize(
    "change",
    [
        {"metrics": [{"id": "m", "source": "rides", "type": "ratio", "numerator": "m", "denominator": "m"}]},
        {"metrics": [{"id": "a", "source": "rides", "type": "expression", "expression": "{b}"}, {"id": "b", "source": "rides", "type": "expression", "expression": "{a}"}]},
        {"metrics": [{"id": "m", "source": "rides", "type": "sum"}]},
        {"metrics": [{"id": "m", "source": "rides", "type": "count", "expression": "fare"}]},
        {"metrics": [{"id": "m", "source": "nope", "type": "count"}]},
        {"metrics": [{"id": "m", "source": "rides", "type": "percentile", "column": "fare", "p": 1.0}]},
        {"metrics": [{"id": "m", "source": "rides", "type": "median", "column": "nope"}]},
        {"metrics": [{"id": "m", "source": "rides", "type": "count", "typo": 1}]},
        {"metrics": [{"id": "m", "source": "rides", "type": "count", "materialized": ["rides.zone"], "materialized_strategy": "incremental"}]},
        {"metrics": [{"id": "m", "source": "rides", "type": "ratio", "numerator": "x", "denominator": "y"}]},
        {"metrics": [{"id": "m", "source": "rides", "type": "funnel", "funnel_entity_column": "rider", "funnel_event_order_column": "started", "funnel_steps": [{"name": "a", "condition": "true"}]}]},
        {"quality_rules": [{"id": "r", "source": "rides", "type": "range", "config": {"column": "fare"}, "severity": "warn"}]},
        {"policies": [{"id": "p", "role": "admin", "source": "rides", "row_filter": {"op": "eq", "column": "nope", "value": 1}}]},
        {"policies": [{"id": "p", "role": "nobody", "source": "rides"}]},
        {"unknown": []},
    ],
)
def test_bad_catalogs(change):
    raw = catalog() | {"metrics": [], "quality_rules": [], "freshness_rules": []} | change
    with pytest.raises((ConfigError, FilterError)):
        load(raw)


def test_versions_and_additive_sync():
    first = load(catalog(), now=datetime(2026, 1, 1))
    changed = {"metrics": [{"id": "ride_count", "source": "rides", "type": "count", "filter": "state = 'done'", "display_name": "x"}]}
    second = load({**changed, "quality_rules": catalog()["quality_rules"]}, first, datetime(2026, 2, 1))
    assert [v.version for v in second.versions["ride_count"]] == [1, 2]
    assert second.versions["ride_count"][0].effective_to == datetime(2026, 2, 1)
    assert len(second.versions["max_fare"]) == 1 and second.freshness_rules == {} and "max_fare" in second.metrics


@pytest.mark.parametrize(
    "text, error",
    [
        ("SELECT * FROM rides", "\\*"),
        ("SELECT o.* FROM rides o", "\\*"),
        ("SELECT ride_id FROM (SELECT ride_id FROM rides) t", "subquer"),
        ("SELECT ride_id FROM rides WHERE fare IN (SELECT fare FROM rides)", "subquer"),
        ("SELECT ride_id FROM rides WHERE EXISTS (SELECT 1 FROM rides)", "subquer"),
        ("SELECT ride_id FROM rides UNION SELECT ride_id FROM rides", "UNION"),
        ("SELECT 1", "FROM"),
        ("SELECT a.ride_id FROM rides a JOIN customers b ON a.ride_id = b.id", "one source"),
        ("WITH a AS (SELECT * FROM rides) SELECT ride_id FROM a", "\\*"),
        ("SELECT x FROM parquet.`/etc/passwd`", "not a source"),
        ("DROP TABLE rides", "SELECT"),
        ("INSERT INTO rides SELECT ride_id FROM rides", "SELECT"),
        ("SELEC ride_id", "parse"),
        ("SELECT ride_id FROM rides; SELECT 1 FROM rides", "parse"),
    ],
)
def test_sql_gate_rejects(spark, text, error):
    with pytest.raises(sqlgate.SqlError, match=error):
        sqlgate.parse(spark, text)


def test_sql_gate_columns(spark, rides):
    text = "WITH a AS (SELECT ride_id AS k, fare AS x FROM rides), b AS (SELECT k, x * 2 AS y FROM a WHERE x > 1) SELECT count(*) AS n, max(y) AS m FROM b"
    assert sqlgate.parse(spark, text) == "rides"
    assert sqlgate.columns_used(spark, text, "rides", rides.schema) == {"ride_id", "fare"}
    assert sqlgate.columns_used(spark, 'SELECT count(*) AS n FROM rides WHERE "zone" = \'west\'', "rides", rides.schema) == {"zone"}
    with pytest.raises(sqlgate.SqlError):
        sqlgate.columns_used(spark, "SELECT nope FROM rides", "rides", rides.schema)


def test_redaction():
    red = redaction.redact_sql
    cols = frozenset({"email"})
    assert red("SELECT a FROM t WHERE email = 'x' AND b = 'y'", cols) == "SELECT a FROM t WHERE email = '<redacted>' AND b = 'y'"
    assert red("SELECT a FROM t WHERE 'x' = email OR b BETWEEN 1 AND 2", cols) == "SELECT a FROM t WHERE '<redacted>' = email OR b BETWEEN 1 AND 2"
    assert red("SELECT a FROM t WHERE email IN ('x', 'y') AND lower(email) LIKE 'z%'", cols).count("<redacted>") == 3
    assert red("SELECT a FROM t WHERE email BETWEEN 'a' AND 'b' AND c = 1", cols).endswith("BETWEEN '<redacted>' AND '<redacted>' AND c = 1")
    assert red("SELECT a FROM t WHERE email = 'unterminated", cols) == "<redacted>"
    assert red("SELECT a FROM t WHERE b = 'x'", cols) == "SELECT a FROM t WHERE b = 'x'"
    intent = json.dumps({"filters": [{"op": "or", "args": [{"op": "in", "column": "email", "value": ["x"]}, {"op": "eq", "column": "b", "value": "y"}]}]})
    out = redaction.redact_intent(intent, cols)
    assert '"x"' not in out and '"y"' in out
    assert redaction.redact_intent("not json", cols) == "<redacted>"
    assert redaction.redact_prompt("revenue where email = 7 and b", '{"filters": [{"op": "eq", "column": "email", "value": 7}]}', cols) == "revenue where email = <redacted> and b"
    assert redaction.redact_prompt("revenue", "{}", cols) == "revenue"


def test_anomaly_judgement():
    assert judge_anomaly(5, [], 2)[0] and judge_anomaly(5, [1], 2)[0]
    assert not judge_anomaly(None, [1, 2], 2)[0]
    assert judge_anomaly(3, [3, 3, 3], 2)[0] and not judge_anomaly(4, [3, 3, 3], 2)[0]
    assert not judge_anomaly(100, [1, 2, 3], 2)[0]


def test_sources_drift_examples(spark, tmp_path, rides):
    path = str(tmp_path / "o.parquet")
    rides.write.parquet(path)
    raw = catalog()["sources"][0] | {"type": "parquet", "uri": path}
    raw["columns"] = [*raw["columns"][:-1], {"name": "gone", "type": "string"}]
    raw["columns"][1] = {"name": "fare", "type": "bigint"}
    registry = SourceRegistry(spark, load({"sources": [raw | {"dimensions": []}]}).sources)
    kinds = {(d.kind, d.column) for d in drift(registry, "rides")}
    assert kinds == {("missing_in_source", "gone"), ("missing_in_config", "rider"), ("type_mismatch", "fare")}
    assert example_values(registry, "rides")["state"] == ("done", "open", "void")
    assert registry.version("rides") not in ("missing", "0")
    assert SourceRegistry(spark, {"x": Source("x", "parquet", str(tmp_path / "no"))}).version("x") == "missing"
    assert drift(SourceRegistry(spark, {"x": Source("x", "parquet", str(tmp_path / "no"))}), "x")[0].kind == "unreachable"
    assert isinstance(drift(registry, "rides")[0], Drift)


def test_incremental_equals_rebuild(spark, tmp_path, rides):
    raw = catalog()
    raw["metrics"] = [{"id": "stored", "source": "rides", "type": "sum", "expression": "fare", "materialized": ["rides.zone"], "materialized_strategy": "incremental", "watermark_column": "started", "late_arrival_grace_seconds": 86400}]
    raw["quality_rules"], raw["freshness_rules"] = [], []
    c = load(raw)
    m, s = c.metrics["stored"], c.sources["rides"]
    store = materialize.MaterializedStore(spark, str(tmp_path))
    store.refresh(m, s, rides.where("started < '2025-07-02'"), datetime(2025, 7, 2))
    assert store.watermark("stored") == datetime(2025, 7, 1)
    out = store.refresh(m, s, rides, datetime(2025, 7, 3))
    key = lambda r: str(r)
    assert sorted(out.collect(), key=key) == sorted(materialize.grouped(rides, m, s).collect(), key=key)
    again = materialize.MaterializedStore(spark, str(tmp_path))
    assert again.watermark("stored") == datetime(2025, 7, 2) and again.read("stored").count() == 4


def test_stream_refresh(spark, tmp_path, rides):
    from marlstone.streaming.refresh import refresh_on_arrival

    path = str(tmp_path / "in")
    rides.write.parquet(path)
    raw = catalog()
    raw["metrics"] = [{"id": "stored", "source": "rides", "type": "count", "materialized": ["rides.state"]}]
    raw["quality_rules"], raw["freshness_rules"] = [], []
    c = load(raw)
    store = materialize.MaterializedStore(spark, str(tmp_path / "store"))
    q = refresh_on_arrival(spark.readStream.schema(rides.schema).parquet(path), c.metrics["stored"], c.sources["rides"], store, lambda: spark.read.parquet(path), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert {tuple(r) for r in store.read("stored").collect()} == {("done", 4), ("open", 3), ("void", 1)}


def test_identities():
    import base64
    import hashlib
    import hmac

    c = load(catalog())
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    body = f"{part({'alg': 'HS256'})}.{part({'sub': 'u', 'role': 'north', 'exp': 100})}"
    token = body + "." + base64.urlsafe_b64encode(hmac.new(b"k", body.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
    assert identity_from_jwt(c, token, b"k", now=50).attributes == {"zone": "north"}
    for bad in (lambda: identity_from_jwt(c, token, b"other", now=50), lambda: identity_from_jwt(c, token, b"k", now=200), lambda: identity_from_jwt(c, "x", b"k")):
        with pytest.raises(Exception, match="token"):
            bad()
    env = {"MARLSTONE_USER": "u", "MARLSTONE_ROLE": "north", "MARLSTONE_ATTR_ZONE": "south"}
    assert identity_from_env(c, env=env).attributes == {"zone": "south"}


def test_approvals(tmp_path, capsys):
    q = ApprovalQueue(str(tmp_path / "approvals.json"))
    key = q.submit({"add": 1}, "a")
    assert [e["id"] for e in ApprovalQueue(q.path).pending()] == [key]
    assert q.approve(key, "b") == {"add": 1} and q.pending() == []
    with pytest.raises(Exception, match="already"):
        ApprovalQueue(q.path).approve(key, "c")
    (tmp_path / "change.yaml").write_text("metrics: []")
    run = lambda *a: cli.main(["--folder", str(tmp_path), "--user", "d", *a])
    assert run("submit", str(tmp_path / "change.yaml")) == 0
    key = capsys.readouterr().out.strip()
    assert run("approvals") == 0 and run("approve", key) == 0 and run("approve", key) == 3


def test_file_sources(spark, tmp_path, rides):
    for kind in ("json", "orc"):
        path = str(tmp_path / kind)
        rides.select("ride_id", "fare").write.format(kind).save(path)
        c = load({"sources": [{"id": "s", "type": kind, "uri": path}, {"id": "t", "type": "duckdb_table", "uri": "rides_fixture"}]})
        registry = SourceRegistry(spark, c.sources)
        assert registry.load("s").count() == len(RIDES) and registry.load("t").count() == len(RIDES)


def test_outputs():
    assert to_tsv(["a", "b"], [(1, None)]) == "a\tb\n1\t"
    assert to_csv(["a"], [(None,), ("x,y",)]).splitlines() == ["a", '""', '"x,y"']
    assert json.loads(to_json(["d"], [(datetime(2026, 1, 1),)])) == [{"d": "2026-01-01 00:00:00"}]


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init"]) == 0
    text = (tmp_path / "catalog.yaml").read_text().replace("uri: orders.csv", f"uri: {tmp_path}/orders.csv")
    (tmp_path / "catalog.yaml").write_text(text)
    run = lambda *a: cli.main(["--config", str(tmp_path / "catalog.yaml"), "--role", "analyst", *a], spark)
    assert run("query", '{"source": "orders", "metrics": ["revenue"], "dimensions": ["orders.region"], "order_by": [{"key": "orders.region"}]}') == 0
    assert capsys.readouterr().out == "orders.region\trevenue\ncentral\t8.0\neast\t20.0\nwest\t15.75\n"
    assert run("query", "SELECT region, count(*) AS n FROM orders GROUP BY region", "--format", "json") == 0
    assert run("ask", "orders", "revenue by region") == 0
    assert run("ask", "orders", "why") == 4
    assert run("query", '{"source": "orders", "metrics": ["nope"]}') == 3
    assert cli.main(["--config", str(tmp_path / "catalog.yaml"), "--role", "nobody", "query", '{"source": "orders", "metrics": ["revenue"]}'], spark) == 2
    # Every attempt is on disk, exports and denials too, and other processes read it.
    folder = str(tmp_path / "state")
    kept = lambda *a, role="analyst": cli.main(["--config", str(tmp_path / "catalog.yaml"), "--folder", folder, "--role", role, *a], spark)
    text = '{"source": "orders", "metrics": ["revenue"]}'
    assert [kept("query", text), kept("query", text, "--format", "parquet", "--out", str(tmp_path / "x")), kept("query", text, "--out", str(tmp_path / "y"), role="nobody")] == [0, 0, 2]
    assert spark.read.parquet(str(tmp_path / "x")).collect()[0][0] == 43.75 and not (tmp_path / "y").exists()
    log = AppendLog(spark, AUDIT, f"{folder}/audit").rows()
    assert sorted((r["status"], r["row_count"]) for r in log if r["status"] == "ok") == [("ok", 1), ("ok", 1)] and len(log) == 3
    assert kept("query", "SELECT nope FROM orders") == 3 and kept("check", "nowhere") == 2
    assert kept("detect-access-anomalies") == 0
    assert run("sync") == 0 and run("catalog") == 0 and run("describe", "revenue") == 0 and run("check", "orders") == 0
