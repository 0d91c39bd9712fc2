"""The registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_demo import catalog
from .engine import Engine
from .functions.predicates import named
from .operators import materialize, quality
from .operators.windows import rolling
from .plans.governance import resolve_identity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ALL = 10000


_ENGINES: WeakKeyDictionary = WeakKeyDictionary()


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over a folder of test tables, one for each session."""
    own = _ENGINES.setdefault(spark, {})
    if sf_dir not in own:
        own[sf_dir] = Engine(spark, catalog(sf_dir))
    return own[sf_dir]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, since sums over partitions differ in their last bits."""
    return df.select(*[F.round(named(c), digits).alias(c) if t == "double" else named(c) for c, t in df.dtypes])


def put(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def intent(name: str, source: str, sql: str | None, metrics=(), dims=(), role: str = "admin", **more) -> None:
    """A query that answers an intent as a role."""
    raw = {"source": source, "metrics": list(metrics), "dimensions": list(dims), "limit": ALL, **more}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        return rounded(e.plan(resolve_identity(e.catalog, "u", role), raw).df)

    put(name, run, sql)


ORDERS = {"order_count": "count(*)", "gross_revenue": "round(sum(o_totalprice), 4)"}

# Scans and projections
intent("scan_parquet", "orders", "SELECT count(*) AS order_count, round(sum(o_totalprice), 4) AS gross_revenue FROM orders", ["order_count", "gross_revenue"])
intent("dims_only_distinct", "orders", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders", dims=["status", "priority"])
for _grain in ("year", "quarter", "month", "week", "day", "hour"):
    intent(f"grain_{_grain}", "events", f"SELECT date_trunc('{_grain}', ts)::TIMESTAMP AS \"events.time\", count(*) AS event_count FROM events GROUP BY 1", ["event_count"], [{"id": "events.time", "grain": _grain}])


def _scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV source in the engine, over a copy of `nation`."""
    import uuid

    from .sources.folders import shared_path

    path = f"{shared_path(spark)}/nation-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    raw = {
        "sources": [{"id": "nations", "type": "csv", "uri": path, "columns": [{"name": "n_nationkey", "type": "bigint"}, {"name": "n_name", "type": "varchar"}, {"name": "n_regionkey", "type": "bigint"}], "dimensions": [{"id": "region", "column": "n_regionkey"}]}],
        "metrics": [{"id": "nations", "source": "nations", "type": "count"}],
        "roles": [{"id": "admin"}],
        "policies": [{"id": "p", "role": "admin", "source": "nations", "default_column_mode": "allow"}],
    }
    e = Engine(spark, raw)
    return e.plan(resolve_identity(e.catalog, "u", "admin"), {"source": "nations", "metrics": ["nations"], "dimensions": ["region"]}).df


put("scan_csv", _scan_csv, "SELECT n_regionkey::BIGINT AS region, count(*) AS nations FROM nation GROUP BY 1")


def _scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view source in the engine; its name differs from the source's id."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer_live_view")
    raw = {
        "sources": [{"id": "customers", "type": "sql_view", "uri": "customer_live_view", "columns": [{"name": "c_mktsegment", "type": "string"}, {"name": "c_acctbal", "type": "double"}], "dimensions": [{"id": "segment", "column": "c_mktsegment"}]}],
        "metrics": [{"id": "balance", "source": "customers", "type": "sum", "expression": "c_acctbal"}],
        "roles": [{"id": "admin"}],
        "policies": [{"id": "p", "role": "admin", "source": "customers", "default_column_mode": "allow"}],
    }
    e = Engine(spark, raw)
    return rounded(e.plan(resolve_identity(e.catalog, "u", "admin"), {"source": "customers", "metrics": ["balance"], "dimensions": ["segment"]}).df)


put("scan_view", _scan_table, "SELECT c_mktsegment AS segment, round(sum(c_acctbal), 4) AS balance FROM customer GROUP BY 1")

# Filters
_FILTERS = {
    "eq": ({"op": "eq", "column": "o_orderstatus", "value": "F"}, "o_orderstatus = 'F'"),
    "neq": ({"op": "neq", "column": "o_orderstatus", "value": "F"}, "o_orderstatus <> 'F'"),
    "lt": ({"op": "lt", "column": "o_totalprice", "value": 50000}, "o_totalprice < 50000"),
    "lte": ({"op": "lte", "column": "o_orderkey", "value": 900}, "o_orderkey <= 900"),
    "gt": ({"op": "gt", "column": "o_totalprice", "value": 250000.5}, "o_totalprice > 250000.5"),
    "gte": ({"op": "gte", "column": "o_orderdate", "value": "1998-01-01"}, "o_orderdate >= TIMESTAMP '1998-01-01'"),
    "in": ({"op": "in", "column": "o_orderpriority", "value": ["1-URGENT", "5-LOW"]}, "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "not_in": ({"op": "not_in", "column": "o_orderpriority", "value": ["1-URGENT", "5-LOW"]}, "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    "is_null": ({"op": "is_null", "column": "o_orderstatus"}, "o_orderstatus IS NULL"),
    "is_not_null": ({"op": "is_not_null", "column": "o_orderstatus"}, "o_orderstatus IS NOT NULL"),
    "between": ({"op": "between", "column": "o_totalprice", "value": [100000, 150000]}, "o_totalprice BETWEEN 100000 AND 150000"),
    "and": ({"op": "and", "args": [{"op": "eq", "column": "o_orderstatus", "value": "O"}, {"op": "lt", "column": "o_totalprice", "value": 90000}]}, "o_orderstatus = 'O' AND o_totalprice < 90000"),
    "or": ({"op": "or", "args": [{"op": "eq", "column": "o_orderstatus", "value": "P"}, {"op": "lt", "column": "o_totalprice", "value": 20000}]}, "o_orderstatus = 'P' OR o_totalprice < 20000"),
    "not": ({"op": "not", "args": [{"op": "in", "column": "o_orderstatus", "value": ["F", "P"]}]}, "NOT (o_orderstatus IN ('F', 'P'))"),
}
for _op, (_tree, _where) in _FILTERS.items():
    intent(f"filter_{_op}", "orders", f"SELECT o_orderpriority AS priority, count(*) AS order_count FROM orders WHERE {_where} GROUP BY 1", ["order_count"], ["priority"], filters=[_tree])

# Aggregates
_AGGS = {
    "count": ("order_count", "count(*)"),
    "sum": ("gross_revenue", "round(sum(o_totalprice), 4)"),
    "avg": ("avg_amount", "round(avg(o_totalprice), 4)"),
    "min": ("min_amount", "round(min(o_totalprice), 4)"),
    "max": ("max_amount", "round(max(o_totalprice), 4)"),
    "percentile": ("p95_amount", "round(quantile_cont(o_totalprice, 0.95), 4)"),
    "median": ("median_amount", "round(median(o_totalprice), 4)"),
    "stddev_samp": ("stddev_amount", "round(stddev_samp(o_totalprice), 4)"),
    "stddev_pop": ("stddev_pop_amount", "round(stddev_pop(o_totalprice), 4)"),
    "variance": ("variance_amount", "round(var_samp(o_totalprice / 1000), 4)"),
    "count_distinct": ("unique_customers", "count(DISTINCT o_custkey)"),
    "first_value": ("first_amount", "round(arg_min(o_totalprice, o_orderkey), 4)"),
    "last_value": ("last_amount", "round(arg_max(o_totalprice, o_orderkey), 4)"),
    "ratio": ("avg_order_value", "round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 4)"),
    "expression": ("revenue_per_customer", "round(sum(o_totalprice) / nullif(count(DISTINCT o_custkey), 0) + sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 4)"),
}
for _kind, (_id, _sql) in _AGGS.items():
    intent(f"agg_{_kind}", "orders", f"SELECT o_orderpriority AS priority, {_sql} AS {_id} FROM orders GROUP BY 1", [_id], ["priority"])
intent("agg_mode", "orders", "SELECT status, usual_customer FROM (SELECT o_orderstatus AS status, o_custkey AS usual_customer, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_custkey) AS n FROM orders GROUP BY 1, 2) WHERE n = 1", ["usual_customer"], ["status"])
intent("agg_weighted_avg", "lineitem", "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) AS weighted_price FROM lineitem GROUP BY 1, 2", ["weighted_price"], ["returnflag", "linestatus"])


def _approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate distinct counts are within three standard errors (15 %) of exact ones."""
    e = engine(spark, sf_dir)
    found = e.plan(resolve_identity(e.catalog, "u", "admin"), {"source": "orders", "metrics": ["approx_customers", "unique_customers"], "dimensions": ["status"]}).df
    return found.select("status", (F.abs(F.col("approx_customers") - F.col("unique_customers")) <= 0.15 * F.col("unique_customers")).alias("is_close"))


put("agg_count_distinct_approx", _approx, "SELECT DISTINCT o_orderstatus AS status, true AS is_close FROM orders")
intent("agg_global", "orders", "SELECT count(*) AS order_count, round(median(o_totalprice), 4) AS median_amount, count(DISTINCT o_custkey) AS unique_customers FROM orders", ["order_count", "median_amount", "unique_customers"])
intent("agg_filter_isolation", "orders", "SELECT o_orderpriority AS priority, count(*) AS order_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS paid_count, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS paid_revenue, round(sum(o_totalprice), 4) AS gross_revenue FROM orders GROUP BY 1", ["order_count", "paid_count", "paid_revenue", "gross_revenue"], ["priority"])
intent("agg_net_revenue_by_month", "lineitem", "SELECT l_returnflag AS returnflag, date_trunc('month', l_shipdate)::TIMESTAMP AS shipdate, count(*) AS line_count, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net_revenue FROM lineitem GROUP BY 1, 2", ["line_count", "net_revenue"], ["returnflag", {"id": "shipdate", "grain": "month"}])

# Post-filters, order and limit
_HAVINGS = {"eq": (10, "= 10"), "neq": (10, "<> 10"), "lt": (9, "< 9"), "lte": (9, "<= 9"), "gt": (14, "> 14"), "gte": (14, ">= 14"), "in": ([7, 11], "IN (7, 11)"), "not_in": ([7, 11, 12], "NOT IN (7, 11, 12)")}
for _op, (_value, _sql) in _HAVINGS.items():
    intent(f"having_{_op}", "orders", f"SELECT o_custkey AS customer, count(*) AS order_count FROM orders GROUP BY 1 HAVING count(*) {_sql} ORDER BY 1 LIMIT {ALL}", ["order_count"], ["customer"], having=[{"op": _op, "metric": "order_count", "value": _value}], order_by=[{"key": "customer"}])
intent("order_top_k", "orders", "SELECT o_custkey AS customer, round(sum(o_totalprice), 4) AS gross_revenue FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC NULLS LAST, 1 LIMIT 20", ["gross_revenue"], ["customer"], order_by=[{"key": "gross_revenue", "direction": "desc"}], limit=20)
intent("order_bottom_k", "orders", "SELECT o_custkey AS customer, count(*) AS order_count FROM orders GROUP BY 1 ORDER BY 2 ASC NULLS LAST, 1 LIMIT 15", ["order_count"], ["customer"], order_by=[{"key": "order_count"}], limit=15)

# Windows
_ROLL = "SELECT event_id, {agg} OVER ({by}ORDER BY ts RANGE BETWEEN INTERVAL {w} PRECEDING AND CURRENT ROW) AS {id} FROM events"


def _rolling(name: str, metric: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        return rounded(rolling(e.registry.load("events"), e.catalog.metrics[metric], keep=("event_id",)), 3)

    put(name, run, sql)


for _a in ("sum", "min", "max", "count"):
    _sql = _ROLL.format(agg=f"{_a}(value)", by="", w="7 DAYS", id=f"value_7d_{_a}")
    _rolling(f"rolling_{_a}_7d", f"value_7d_{_a}", f"SELECT event_id, {f'round(value_7d_{_a}, 3)' if _a != 'count' else f'value_7d_{_a}'} AS value_7d_{_a} FROM ({_sql})")


def _rolling_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of cents as decimals, which are exact in both engines; as doubles, ties would be rounded either way."""
    e = engine(spark, sf_dir)
    events = e.registry.load("events").withColumn("value", F.col("value").cast("decimal(12,2)"))
    out = rolling(events, e.catalog.metrics["value_7d_avg"], keep=("event_id",))
    return out.withColumn("value_7d_avg", F.col("value_7d_avg").cast("double"))


_CENTS = _ROLL.format(agg="sum(round(value * 100)::BIGINT)", by="", w="7 DAYS", id="s").replace(" FROM", ", count(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS n FROM")
put("rolling_avg_7d", _rolling_avg, f"SELECT event_id, ((((2 * abs(s) * 10000 + n) // (2 * n)) * sign(s))::DECIMAL(24,0) / 1000000)::DOUBLE AS value_7d_avg FROM ({_CENTS})")
_rolling("rolling_partitioned", "value_1h_by_type", f"SELECT event_id, round(value_1h_by_type, 3) AS value_1h_by_type FROM ({_ROLL.format(agg='max(value)', by='PARTITION BY event_type ', w='1 HOUR', id='value_1h_by_type')})")
_rolling("rolling_filtered", "clicks_7d", _ROLL.format(agg="count(CASE WHEN event_type = 'click' THEN value END)", by="PARTITION BY user_id ", w="7 DAYS", id="clicks_7d"))


def _pop(value: str, grain: str, comparison: str, where: str = "") -> str:
    form = {"delta": "b - p", "ratio": "b / nullif(p, 0)", "pct_change": "(b - p) / nullif(p, 0)"}[comparison]
    return f"SELECT d AS \"orders.date\", round({form}, 4) AS {{id}} FROM (SELECT d, b, lag(b) OVER (ORDER BY d) AS p FROM (SELECT date_trunc('{grain}', o_orderdate)::TIMESTAMP AS d, sum(o_totalprice){where} AS b FROM orders GROUP BY 1))"


for _c in ("delta", "ratio", "pct_change"):
    intent(f"pop_{_c}_month", "orders", _pop("gross", "month", _c).format(id=f"revenue_mom_{_c}"), [f"revenue_mom_{_c}"], [{"id": "orders.date", "grain": "month"}])
intent("pop_pct_change_quarter", "orders", _pop("paid", "quarter", "pct_change", " FILTER (WHERE o_orderstatus = 'F')").format(id="revenue_qoq"), ["revenue_qoq"], [{"id": "orders.date", "grain": "quarter"}])
intent("pop_delta_year", "orders", _pop("gross", "year", "delta").format(id="revenue_yoy"), ["revenue_yoy"], [{"id": "orders.date", "grain": "year"}])
intent("pop_by_dimension", "orders", "SELECT s AS status, d AS \"orders.date\", round(b - p, 4) AS revenue_mom_delta FROM (SELECT s, d, b, lag(b) OVER (PARTITION BY s ORDER BY d) AS p FROM (SELECT o_orderstatus AS s, date_trunc('month', o_orderdate)::TIMESTAMP AS d, sum(o_totalprice) AS b FROM orders GROUP BY 1, 2))", ["revenue_mom_delta"], ["status", {"id": "orders.date", "grain": "month"}])


# Shapes. {src} is the source as the role sees it.
def _cohort(src: str, entity: str, event: str, cohort: str, grain: str, most: int | None = None) -> str:
    between = f"WHERE periods_since_cohort BETWEEN 0 AND {most}" if most is not None else ""
    diff = f"date_diff('{grain}', c, date_trunc('{grain}', t))" if grain != "week" else "trunc(date_diff('day', c, date_trunc('week', t)) / 7)::BIGINT"
    return f"""WITH s AS (SELECT {entity} AS e, {event} AS t FROM {src}), f AS (SELECT e, date_trunc('{cohort}', min(t))::TIMESTAMP AS c FROM s GROUP BY e),
r AS (SELECT c AS cohort_start, {diff} AS periods_since_cohort, s.e FROM s JOIN f ON s.e = f.e),
n AS (SELECT c, count(DISTINCT e) AS cohort_size FROM f GROUP BY c),
k AS (SELECT cohort_start, periods_since_cohort, count(DISTINCT e) AS retained_count FROM r {between} GROUP BY 1, 2)
SELECT cohort_start, periods_since_cohort, retained_count, cohort_size, round(retained_count / nullif(cohort_size, 0), 4) AS retention_rate FROM k JOIN n ON k.cohort_start = n.c ORDER BY 1, 2 LIMIT {ALL}"""


def _funnel(src: str, entity: str, t: str, steps: list[tuple[str, str]]) -> str:
    ctes, counts = [], []
    for i, (name, where) in enumerate(steps):
        if i == 0:
            ctes.append(f"f0 AS (SELECT {entity} AS e, min({t}) AS t FROM {src} WHERE {where} GROUP BY 1)")
        else:
            ctes.append(f"f{i} AS (SELECT p.e, min(s.{t}) AS t FROM f{i - 1} p JOIN {src} s ON s.{entity} = p.e WHERE {where} AND s.{t} >= p.t GROUP BY 1)")
        counts.append(f"SELECT '{name}' AS step_name, {i} AS step_index, count(DISTINCT e) AS entity_count FROM f{i}")
    over = "OVER (ORDER BY step_index)"
    return f"WITH {', '.join(ctes)}, c AS ({' UNION ALL '.join(counts)}) SELECT step_name, step_index, entity_count, round(entity_count / nullif(lag(entity_count) {over}, 0), 4) AS conversion_from_previous, round(entity_count / nullif(first_value(entity_count) {over}, 0), 4) AS conversion_from_first FROM c"


_PAID = [("ordered", "o_orderstatus IN ('O', 'F')"), ("finished", "o_orderstatus = 'F'")]


def _best(src: str) -> str:
    return f"SELECT count(DISTINCT o_custkey) AS entity_count, count(*) AS result_value FROM {src} WHERE o_custkey IN (SELECT o_custkey FROM {src} GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 25)"


def _returned(src: str) -> str:
    return f"SELECT count(*) AS returners FROM (SELECT DISTINCT o_custkey FROM {src} WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' INTERSECT SELECT DISTINCT o_custkey FROM {src} WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01' AND o_orderstatus = 'F')"


intent("cohort_retention", "orders", _cohort("orders", "o_custkey", "o_orderdate", "month", "month"), ["retention"])
intent("cohort_retention_capped", "orders", _cohort("orders", "o_custkey", "o_orderdate", "quarter", "quarter", 6), ["retention_capped"])
intent("cohort_retention_week", "events", _cohort("events", "user_id", "ts", "week", "week"), ["weekly_retention"])
intent("funnel_2step", "orders", _funnel("orders", "o_custkey", "o_orderdate", _PAID), ["paid_funnel"])
intent("funnel_3step", "events", _funnel("events", "user_id", "ts", [(s, f"event_type = '{s}'") for s in ("view", "click", "purchase")]), ["purchase_funnel"])
intent("msf_top_n", "orders", _best("orders"), ["best_customers"])
intent("msf_top_percentile", "orders", "SELECT count(DISTINCT o_custkey) AS entity_count, round(avg(o_totalprice), 4) AS result_value FROM orders WHERE o_custkey IN (SELECT e FROM (SELECT o_custkey AS e, percent_rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY 1) WHERE r <= 0.1)", ["top_decile"])
intent("cohort_filter", "orders", _returned("orders"), ["returners"])

# Governance: policies hold inside every operator
_F, _U = "(SELECT * FROM orders WHERE o_orderstatus = 'F')", "(SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')"
intent("row_filter_on_metric", "orders", f"SELECT o_orderpriority AS priority, count(*) AS order_count FROM {_F} GROUP BY 1", ["order_count"], ["priority"], role="finance")
intent("row_filter_on_cohort", "orders", _cohort(_F, "o_custkey", "o_orderdate", "month", "month"), ["retention"], role="finance")
intent("row_filter_on_funnel", "orders", _funnel(_U, "o_custkey", "o_orderdate", _PAID), ["paid_funnel"], role="urgent")
intent("row_filter_on_top_n", "orders", _best(_U), ["best_customers"], role="urgent")
intent("row_filter_on_cohort_filter", "orders", _returned(_U), ["returners"], role="urgent")
intent("column_allowlist", "orders", "SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS \"orders.date\", round(sum(o_totalprice), 4) AS gross_revenue FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 100000 GROUP BY 1", ["gross_revenue"], [{"id": "orders.date", "grain": "year"}], role="partner")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What roles get for a few requests."""
    e = engine(spark, sf_dir)
    asked = [("admin", ["o_custkey"], []), ("partner", ["o_totalprice"], []), ("partner", ["o_custkey"], []), ("nobody", ["o_orderkey"], []), ("finance", ["o_orderkey"], ["no_such_metric"])]
    rows = []
    for role, columns, metrics in asked:
        d = e.governance.evaluate(resolve_identity(e.catalog, "u", role), {"orders"}, frozenset(columns), tuple(metrics))
        rows.append((role, ",".join(columns + metrics), d.allowed, d.deny_text))
    return spark.createDataFrame(rows, "role string, asked string, allowed boolean, reason string")


put("policy_decisions", _decisions, """SELECT * FROM (VALUES ('admin', 'o_custkey', true, NULL), ('partner', 'o_totalprice', true, NULL), ('partner', 'o_custkey', false, 'policy:no_column_access:o_custkey'),
('nobody', 'o_orderkey', false, 'policy:no_policy_for_role:role=nobody source=orders'), ('finance', 'o_orderkey,no_such_metric', false, 'policy:no_metric_access:no_such_metric')) t(role, asked, allowed, reason)""")


# Raw SQL
def _sql(name: str, role: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        return rounded(e.plan_sql(resolve_identity(e.catalog, "u", role), text).df)

    put(name, run, oracle)


_sql("sql_governed", "finance", "SELECT o_orderpriority AS p, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority HAVING count(*) > 1", f"SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM {_F} WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 1")
_CTE = "WITH a AS (SELECT o_custkey AS c, count(*) AS n FROM {0} t GROUP BY o_custkey), b AS (SELECT o_custkey AS c, max(o_totalprice) AS m FROM {0} t GROUP BY o_custkey) SELECT a.n AS n, count(*) AS customers, round(avg(b.m), 4) AS m FROM a JOIN b ON a.c = b.c GROUP BY a.n"
_sql("sql_cte_governed", "urgent", _CTE.format("orders"), _CTE.format(_U))


# Stored metrics
def _stored_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    m = e.catalog.metrics["stored_revenue"]
    return rounded(materialize.grouped(e.registry.load("orders"), m, e.catalog.sources["orders"]))


put("materialized_full", _stored_full, "SELECT o_orderstatus AS status, o_orderpriority AS priority, round(sum(o_totalprice), 4) AS stored_revenue FROM orders GROUP BY 1, 2")


def _stored_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store made before 20 January, then merged with what came after."""
    e = engine(spark, sf_dir)
    m, source, df = e.catalog.metrics["stored_events"], e.catalog.sources["events"], e.registry.load("events")
    since = datetime(2024, 1, 20)
    old = materialize.grouped(df.where(F.col("ts") <= F.lit(since)), m, source)
    return materialize.merged(old, df, m, source, since)


put("materialized_incremental", _stored_incremental, "SELECT event_type, user_id AS user, count(*) AS stored_events FROM events GROUP BY 1, 2")


def _stored_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intent that a stored metric answers, through the store."""
    import uuid

    from .sources.folders import shared_path

    e = Engine(spark, catalog(sf_dir), folder=f"{shared_path(spark)}/store-{uuid.uuid4().hex}")
    e.refresh("stored_revenue")
    return rounded(e.plan(resolve_identity(e.catalog, "u", "admin"), {"source": "orders", "metrics": ["stored_revenue"], "dimensions": ["status", "priority"]}).df)


put("materialized_route", _stored_route, ORACLE["materialized_full"])


# Quality
def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad rows, duplicates and the newest time of all rules on orders, in one scan."""
    e = engine(spark, sf_dir)
    rules = [r for r in (*e.catalog.quality_rules.values(), *e.catalog.freshness_rules.values()) if r.source == "orders"]
    return e.registry.load("orders").agg(*[c.alias(k) for k, c in quality.measures(rules).items()])


put("quality_measures", _rules, "SELECT count(*) FILTER (WHERE o_totalprice IS NULL) AS orders_price_not_null, count(*) - count(DISTINCT o_orderkey) AS orders_key_unique, count(*) - count(DISTINCT o_custkey) AS orders_customer_unique, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) AS orders_price_range, max(o_orderdate) AS orders_fresh FROM orders")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a check of orders, by a fixed clock."""
    e = Engine(spark, catalog(sf_dir), clock=lambda: datetime(2001, 8, 2))
    return spark.createDataFrame([(o.rule_id, o.passed) for o in e.check("orders")], "rule_id string, passed boolean")


put("quality_check", _checked, """SELECT 'orders_price_not_null' AS rule_id, count(*) FILTER (WHERE o_totalprice IS NULL) = 0 AS passed FROM orders UNION ALL SELECT 'orders_key_unique', count(*) = count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'orders_customer_unique', count(*) = count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'orders_price_range', count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) = 0 FROM orders
UNION ALL SELECT 'orders_some_paid', count(*) FILTER (WHERE o_orderstatus = 'F') > 0 FROM orders UNION ALL SELECT 'orders_revenue_anomaly', true
UNION ALL SELECT 'orders_fresh', epoch(TIMESTAMP '2001-08-02') - epoch(max(o_orderdate)) <= 86400 FROM orders""")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality log made of the events table: one run a day, failed if the day is a Monday."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    days = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(day.cast("timestamp_ntz").alias("ran_at")).agg(F.count("*").alias("n"))
    return days.select(
        F.date_format("ran_at", "yyyyMMdd").alias("run_id"),
        F.lit("orders_revenue_anomaly").alias("rule_id"),
        F.lit("quality").alias("rule_kind"),
        (F.weekday("ran_at") != 0).alias("passed"),
        F.to_json(F.struct(F.col("n").alias("value"))).alias("observed_value"),
        "ran_at",
    )


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.shapes import anomaly_query

    return anomaly_query(_runs(spark, sf_dir), engine(spark, sf_dir).catalog.metrics["revenue_anomalies"], ALL)


put("anomaly_query", _anomalies, "SELECT strftime(d, '%Y%m%d') AS run_id, n::DOUBLE AS observed_value, d AS ran_at, true AS detected_anomaly FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS d, count(*) AS n FROM events GROUP BY 1) WHERE dayofweek(d) = 1")
put("latest_runs", lambda spark, sf_dir: quality.latest_runs(_runs(spark, sf_dir)).select("rule_id", "run_id", "ran_at"), "SELECT 'orders_revenue_anomaly' AS rule_id, strftime(max(d), '%Y%m%d') AS run_id, max(d) AS ran_at FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS d FROM events)")


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access anomalies with the events table as the log: users by event type, today being 20 January."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("user_id"), (F.col("user_id") % 10).cast("string").alias("role_id"), F.col("ts").alias("created_at"))
    return rounded(quality.access_anomalies(log, datetime(2024, 1, 20), n_sigma=0.5))


put("access_anomaly", _access, """WITH d AS (SELECT event_type AS user_id, (user_id % 10)::VARCHAR AS role_id, ts::DATE AS day, count(*) AS n FROM events WHERE ts::DATE BETWEEN DATE '2024-01-20' - 14 AND DATE '2024-01-20' GROUP BY 1, 2, 3),
s AS (SELECT user_id, role_id, coalesce(sum(n) FILTER (WHERE day = DATE '2024-01-20'), 0)::BIGINT AS today_count, avg(n) FILTER (WHERE day < DATE '2024-01-20') AS mean, coalesce(stddev_samp(n) FILTER (WHERE day < DATE '2024-01-20'), 0) AS stddev, count(*) FILTER (WHERE day < DATE '2024-01-20') AS days FROM d GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN stddev = 0 THEN CASE WHEN today_count <> mean THEN 'Infinity'::DOUBLE END ELSE (today_count - mean) / stddev END AS z_score FROM s WHERE days >= 3)
SELECT user_id, role_id, today_count, round(mean, 4) AS mean, round(stddev, 4) AS stddev, round(z_score, 4) AS z_score FROM z WHERE z_score > 0.5""")


# Plain English
def _ask(name: str, question: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans.nl import understand

        e = engine(spark, sf_dir)
        who = resolve_identity(e.catalog, "u", "admin")
        e.examples["orders"] = {"o_orderstatus": ("F", "O", "P"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
        match = understand(question, e.schema(who, "orders"), date(1998, 5, 20))
        return rounded(e.plan(who, match.intent).df)

    put(name, run, sql)


_SUM, _BY = "round(sum(o_totalprice), 4) AS gross_revenue", "FROM orders GROUP BY 1"
_MONTHS = f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS \"orders.date\", {_SUM} {_BY}"
for _name, _question, _text in [
    ("top_n_having", "top 2 priority by gross revenue where order count > 10", "SELECT o_orderpriority AS priority, round(sum(o_totalprice), 4) AS gross_revenue, count(*) AS order_count FROM orders GROUP BY 1 HAVING count(*) > 10 ORDER BY sum(o_totalprice) DESC LIMIT 2"),
    ("top_n", "biggest 3 priority by gross revenue", f"SELECT o_orderpriority AS priority, {_SUM} {_BY} ORDER BY sum(o_totalprice) DESC LIMIT 3"),
    ("bottom_n", "lowest 2 priority by order count", f"SELECT o_orderpriority AS priority, count(*) AS order_count {_BY} ORDER BY 2 LIMIT 2"),
    ("type_keyword", "what is the median amount?", "SELECT round(median(o_totalprice), 4) AS median_amount FROM orders"),
    ("by_grain", "show me gross revenue by month", _MONTHS),
    ("over_time", "gross revenue over time", _MONTHS),
    ("dim_and_grain", "gross revenue by status by year", f"SELECT o_orderstatus AS status, date_trunc('year', o_orderdate)::TIMESTAMP AS \"orders.date\", {_SUM} FROM orders GROUP BY 1, 2"),
    ("two_dims", "order count by status, priority", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS order_count FROM orders GROUP BY 1, 2"),
    ("multi_metric", "gross revenue and order count by status", f"SELECT o_orderstatus AS status, {_SUM}, count(*) AS order_count {_BY}"),
    ("by_dim", "gross revenue by priority", f"SELECT o_orderpriority AS priority, {_SUM} {_BY}"),
    ("in_period", "order count in march 1997", "SELECT count(*) AS order_count FROM orders WHERE o_orderdate >= '1997-03-01' AND o_orderdate < '1997-04-01'"),
    ("in_range", "order count from 1996-01-15 to 1996-02-15", "SELECT count(*) AS order_count FROM orders WHERE o_orderdate >= '1996-01-15' AND o_orderdate < '1996-02-15'"),
    ("this_period", "gross revenue this quarter", f"SELECT {_SUM} FROM orders WHERE o_orderdate >= '1998-04-01' AND o_orderdate < '1998-07-01'"),
    ("last_n", "order count last 2 months", "SELECT count(*) AS order_count FROM orders WHERE o_orderdate >= '1998-03-21' AND o_orderdate < '1998-05-21'"),
    ("count_condition", "count of F orders", "SELECT count(*) AS order_count FROM orders WHERE o_orderstatus = 'F'"),
    ("count_thing", "how many orders", "SELECT count(*) AS order_count FROM orders"),
    ("excluding", "gross revenue excluding F orders", f"SELECT {_SUM} FROM orders WHERE o_orderstatus <> 'F'"),
    ("percent_of", "paid revenue as percent of order count", "SELECT round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 4) AS avg_order_value FROM orders"),
    ("where_between", "order count where o_totalprice between 1000 and 50000", "SELECT count(*) AS order_count FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 50000"),
    ("where", "order count where o_totalprice >= 100000", "SELECT count(*) AS order_count FROM orders WHERE o_totalprice >= 100000"),
    ("filtered_by_value", "gross revenue for 1-URGENT", f"SELECT {_SUM} FROM orders WHERE o_orderpriority = '1-URGENT'"),
    ("period_over_period", "revenue year over year", _pop("gross", "year", "delta").format(id="revenue_yoy")),
    ("distribution", "p95 amount distribution", "SELECT round(quantile_cont(o_totalprice, 0.95), 4) AS p95_amount FROM orders"),
    ("single_metric", "what's the gross revenue", f"SELECT {_SUM} FROM orders"),
]:
    _ask(f"nl_{_name}", _question, _text)


def _nl_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values of two dimensions in one question."""
    from .plans.nl import understand

    e = engine(spark, sf_dir)
    who = resolve_identity(e.catalog, "u", "admin")
    e.examples["lineitem"] = {"l_returnflag": ("A", "N", "R"), "l_linestatus": ("F", "O")}
    return e.plan(who, understand("line count for R and F", e.schema(who, "lineitem"), date(1998, 5, 20)).intent).df


put("nl_filter_compound", _nl_compound, "SELECT count(*) AS line_count FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")


# State, drift, outputs and what is refused
def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from .sources.folders import shared_path

    return f"{shared_path(spark)}/{name}-{uuid.uuid4().hex}"


def _nl_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about anomalies, from a quality log that another process left in the engine's folder."""
    from .plans.nl import understand

    folder = _folder(spark, "runs")
    _runs(spark, sf_dir).write.parquet(f"{folder}/quality_runs/rows")
    e = Engine(spark, catalog(sf_dir), folder)
    who = resolve_identity(e.catalog, "u", "admin")
    return e.plan(who, understand("anomalies in revenue", e.schema(who, "orders")).intent).df


put("nl_anomalies", _nl_anomalies, ORACLE["anomaly_query"])


def _audit_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, an export, a denial and errors of one engine, as a second one reads them from the log."""
    folder = _folder(spark, "audit")
    first = Engine(spark, catalog(sf_dir), folder)
    who = lambda role: resolve_identity(first.catalog, "u", role)
    first.query(who("admin"), {"source": "orders", "metrics": ["order_count"], "dimensions": ["status"]})
    first.sql(who("admin"), "SELECT count(*) AS n FROM orders WHERE o_custkey = 12345")
    first.export(who("admin"), '{"source": "orders", "dimensions": ["priority"]}', f"{folder}/out")
    first.export(who("nobody"), '{"source": "orders", "dimensions": ["priority"]}', f"{folder}/none")
    first.sql(who("admin"), "SELECT * FROM orders")
    log = Engine(spark, catalog(sf_dir), folder).audit.df()
    return log.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_out"), F.count_if(F.col("generated_sql").contains("12345")).alias("leaks"))


put("audit_reread", _audit_reread, "SELECT 'ok' AS status, 3::BIGINT AS n, (1 + count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority))::BIGINT AS rows_out, 0::BIGINT AS leaks FROM orders UNION ALL SELECT 'denied', 1, 0, 0 UNION ALL SELECT 'error', 1, 0, 0")


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer exported in each format and read again."""
    folder = _folder(spark, "outputs")
    e = engine(spark, sf_dir)
    who, out = resolve_identity(e.catalog, "u", "admin"), None
    for kind in ("tsv", "csv", "json", "parquet"):
        e.export(who, '{"source": "orders", "metrics": ["order_count"], "dimensions": ["priority"]}', f"{folder}/{kind}", kind)
        read = spark.read.schema("priority string, order_count long")
        df = read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(f"{folder}/{kind}") if kind in ("tsv", "csv") else read.format(kind).load(f"{folder}/{kind}")
        df = df.select(F.lit(kind).alias("kind"), "priority", "order_count")
        out = df if out is None else out.unionByName(df)
    return out


put("outputs", _outputs, "SELECT kind, o_orderpriority AS priority, count(*) AS order_count FROM orders, (VALUES ('tsv'), ('csv'), ('json'), ('parquet')) k(kind) GROUP BY 1, 2")


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration that lacks a column, has one too many and has one type wrong, and a source that is not there."""
    raw = {
        "sources": [
            {"id": "regions", "type": "parquet", "uri": f"{sf_dir}/region.parquet", "columns": [{"name": "r_regionkey", "type": "varchar"}, {"name": "r_gone", "type": "bigint"}]},
            {"id": "nowhere", "type": "parquet", "uri": f"{sf_dir}/nowhere.parquet", "columns": [{"name": "x", "type": "bigint"}]},
        ]
    }
    e = Engine(spark, raw)
    found = [(d.source, d.kind, d.column) for s in ("regions", "nowhere") for d in e.drift(s) if d.column in (None, "r_regionkey", "r_gone", "r_name")]
    return spark.createDataFrame(found, "source string, kind string, name string")


put("drift", _drift, "SELECT * FROM (VALUES ('regions', 'missing_in_source', 'r_gone'), ('regions', 'missing_in_config', 'r_name'), ('regions', 'type_mismatch', 'r_regionkey'), ('nowhere', 'unreachable', NULL)) t(source, kind, name)")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example values of public columns with few values."""
    found = Engine(spark, catalog(sf_dir)).sample_examples("orders")
    return spark.createDataFrame([(c, v) for c, values in found.items() for v in values], "name string, example string")


put("example_values", _examples, "SELECT DISTINCT 'o_orderstatus' AS name, o_orderstatus AS example FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions as the audit log keeps them."""
    from .plans import redaction

    hidden = redaction.sensitive_columns(engine(spark, sf_dir).catalog, "orders")
    texts = ["o_custkey = 17 AND o_orderstatus = 'F'", "o_custkey BETWEEN 17 AND 19", "o_custkey IN (1, 2)", "o_totalprice > 5"]
    kept = [redaction.redact_sql(f"SELECT count(*) AS n FROM orders WHERE {t}", hidden).split("WHERE ")[1].replace(f"'{redaction.REDACTED}'", "?") for t in texts]
    return spark.createDataFrame(list(enumerate(kept)), "k int, kept string")


put("redaction", _redacted, "SELECT * FROM (VALUES (0, 'o_custkey = ? AND o_orderstatus = ' || chr(39) || 'F' || chr(39)), (1, 'o_custkey BETWEEN ? AND ?'), (2, 'o_custkey IN (?, ?)'), (3, 'o_totalprice > 5')) t(k, kept)")

_REFUSED = [
    "SELECT * FROM orders",
    "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders) t",
    "SELECT o_orderkey FROM orders WHERE o_totalprice IN (SELECT o_totalprice FROM orders)",
    "SELECT o_orderkey FROM orders UNION SELECT o_orderkey FROM orders",
    "SELECT 1",
    "SELECT a.o_orderkey FROM orders a JOIN customer b ON a.o_custkey = b.c_custkey",
    "WITH a AS (SELECT * FROM orders) SELECT o_orderkey FROM a",
    "DROP TABLE orders",
    "SELECT o_orderkey FROM",
]


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that the gate refuses, and one that it lets through."""
    e = Engine(spark, catalog(sf_dir))
    who = resolve_identity(e.catalog, "u", "admin")
    found = [e.sql(who, t) for t in [*_REFUSED, "SELECT count(o_orderkey) AS n FROM orders"]]
    return spark.createDataFrame([(k, r.status, r.stage) for k, r in enumerate(found)], "k int, status string, stage string")


put("sql_refused", _refused, f"SELECT k::INTEGER AS k, CASE WHEN k < {len(_REFUSED)} THEN 'error' ELSE 'ok' END AS status, CASE WHEN k < {len(_REFUSED)} THEN 'sql_invalid' END AS stage FROM range({len(_REFUSED) + 1}) t(k)")


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a source closed: a rule that never ran, one that failed, one that ran too long ago."""
    from dataclasses import replace

    rule = engine(spark, sf_dir).catalog.quality_rules["orders_price_not_null"]
    rules = [replace(rule, id=k) for k in ("never", "failed", "stale", "fine")]
    runs = [("1", "failed", True, 9), ("2", "failed", False, 10), ("3", "stale", True, 8), ("4", "fine", False, 9), ("5", "fine", True, 11)]
    log = spark.createDataFrame([(a, b, "quality", c, "{}", datetime(2024, 1, 1, h, 55)) for a, b, c, h in runs], "run_id string, rule_id string, rule_kind string, passed boolean, observed_value string, ran_at timestamp_ntz")
    found = quality.blocking_failures(log, rules, datetime(2024, 1, 1, 12), spark)
    return spark.createDataFrame([(f.rule_id, f.reason) for f in found], "rule_id string, reason string")


put("blocking_failures", _blocked, "SELECT * FROM (VALUES ('never', 'never_run'), ('failed', 'rule_failed'), ('stale', 'stale_check')) t(rule_id, reason)")


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The freshness rule on orders an hour and two days after the newest one, and on an empty source."""
    e = engine(spark, sf_dir)
    rule, df = e.catalog.freshness_rules["orders_fresh"], e.registry.load("orders")
    newest = df.agg(F.max(F.col("o_orderdate").cast("timestamp_ntz"))).first()[0]
    cases = [(df, timedelta(hours=1)), (df, timedelta(days=2)), (df.where("false"), timedelta(0))]
    found = [quality.run_checks(d, [rule], newest + age, lambda sql: None, lambda r, n: [])[0] for d, age in cases]
    return spark.createDataFrame([(k, o.passed, o.observed["value"]) for k, o in enumerate(found)], "k int, passed boolean, age double")


put("freshness", _fresh, "SELECT * FROM (VALUES (0, true, 3600.0::DOUBLE), (1, false, 172800.0::DOUBLE), (2, false, NULL)) t(k, passed, age)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governed monthly revenue with a ratio, a filtered metric, a post-filter and an order."""
    e = engine(spark, sf_dir)
    raw = {
        "source": "orders",
        "metrics": ["order_count", "paid_revenue", "avg_order_value"],
        "dimensions": [{"id": "orders.date", "grain": "month"}],
        "having": [{"op": "gt", "metric": "order_count", "value": 1}],
        "order_by": [{"key": "orders.date"}],
        "limit": ALL,
    }
    return rounded(e.plan(resolve_identity(e.catalog, "analyst", "finance"), raw).df)


put("flagship", flagship, f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS \"orders.date\", count(*) AS order_count, round(sum(o_totalprice), 4) AS paid_revenue, round(sum(o_totalprice) / count(*), 4) AS avg_order_value FROM {_F} GROUP BY 1 HAVING count(*) > 1")
