"""A catalogue over the star-schema test tables: what the registered queries and the bench run on."""

from __future__ import annotations


def _column(name, kind, sensitivity="public"):
    return {"name": name, "type": kind, "sensitivity": sensitivity}


def _dim(key, column, kind="categorical", name=None):
    return {"id": key, "column": column, "type": kind, "display_name": name or key}


def _metric(key, source, kind, **fields):
    return {"id": key, "source": source, "type": kind, "display_name": key.replace("_", " ").title(), **fields}


def catalog(sf_dir: str) -> dict:
    """The catalogue as a dict, with Parquet sources under sf_dir."""
    sources = [
        {
            "id": "orders", "type": "parquet", "uri": f"{sf_dir}/orders.parquet", "primary_grain": "o_orderkey",
            "columns": [_column("o_orderkey", "bigint"), _column("o_custkey", "bigint", "pii"), _column("o_orderstatus", "string"), _column("o_totalprice", "double"), _column("o_orderdate", "timestamp"), _column("o_orderpriority", "string")],
            "dimensions": [_dim("status", "o_orderstatus", name="Status"), _dim("priority", "o_orderpriority", name="Priority"), _dim("orders.date", "o_orderdate", "temporal", "Order Date"), _dim("customer", "o_custkey", "numeric_bin", "Customer")],
        },
        {
            "id": "events", "type": "parquet", "uri": f"{sf_dir}/events.parquet", "primary_grain": "event_id",
            "columns": [_column("event_id", "bigint"), _column("ts", "timestamp"), _column("user_id", "bigint", "pii"), _column("event_type", "string"), _column("value", "double"), _column("props", "string", "internal")],
            "dimensions": [_dim("event_type", "event_type"), _dim("user", "user_id", "numeric_bin"), _dim("events.time", "ts", "temporal")],
        },
        {
            "id": "lineitem", "type": "parquet", "uri": f"{sf_dir}/lineitem.parquet",
            "columns": [_column(c, t) for c, t in (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp"))],
            "dimensions": [_dim("returnflag", "l_returnflag"), _dim("linestatus", "l_linestatus"), _dim("shipdate", "l_shipdate", "temporal"), _dim("supplier", "l_suppkey", "numeric_bin")],
        },
    ]
    paid = "o_orderstatus = 'F'"
    metrics = [
        _metric("order_count", "orders", "count"),
        _metric("paid_count", "orders", "count", filter=paid),
        _metric("gross_revenue", "orders", "sum", expression="o_totalprice"),
        _metric("paid_revenue", "orders", "sum", expression="o_totalprice", filter=paid),
        _metric("avg_amount", "orders", "avg", expression="o_totalprice"),
        _metric("min_amount", "orders", "min", expression="o_totalprice"),
        _metric("max_amount", "orders", "max", expression="o_totalprice"),
        _metric("p95_amount", "orders", "percentile", column="o_totalprice", p=0.95),
        _metric("median_amount", "orders", "median", column="o_totalprice"),
        _metric("stddev_amount", "orders", "stddev_samp", expression="o_totalprice"),
        _metric("stddev_pop_amount", "orders", "stddev_pop", expression="o_totalprice"),
        _metric("variance_amount", "orders", "variance", expression="o_totalprice / 1000"),
        _metric("unique_customers", "orders", "count_distinct", column="o_custkey"),
        _metric("approx_customers", "orders", "count_distinct_approx", column="o_custkey"),
        _metric("usual_customer", "orders", "mode", column="o_custkey"),
        _metric("first_amount", "orders", "first_value", column="o_totalprice", order_column="o_orderkey"),
        _metric("last_amount", "orders", "last_value", column="o_totalprice", order_column="o_orderkey"),
        _metric("avg_order_value", "orders", "ratio", numerator="paid_revenue", denominator="order_count"),
        _metric("revenue_per_customer", "orders", "expression", expression="{gross_revenue} / NULLIF({unique_customers}, 0) + {avg_order_value}"),
        _metric("weighted_price", "lineitem", "weighted_avg", expression="l_extendedprice", weight_column="l_quantity"),
        _metric("line_count", "lineitem", "count"),
        _metric("net_revenue", "lineitem", "sum", expression="l_extendedprice * (1 - l_discount)"),
        _metric("event_count", "events", "count"),
        *[_metric(f"revenue_mom_{c}", "orders", "period_over_period", base_metric="gross_revenue", period_dim="orders.date", period_unit="month", comparison=c) for c in ("delta", "ratio", "pct_change")],
        _metric("revenue_qoq", "orders", "period_over_period", base_metric="paid_revenue", period_dim="orders.date", period_unit="quarter", comparison="pct_change"),
        _metric("revenue_yoy", "orders", "period_over_period", base_metric="gross_revenue", period_dim="orders.date", period_unit="year", comparison="delta"),
        *[_metric(f"value_7d_{a}", "events", "rolling_window", column="value", aggregate=a, window="7 days", order_by_column="ts") for a in ("sum", "avg", "min", "max", "count")],
        _metric("value_1h_by_type", "events", "rolling_window", column="value", aggregate="max", window="1 hour", order_by_column="ts", partition_by=["event_type"]),
        _metric("clicks_7d", "events", "rolling_window", column="value", aggregate="count", window="7 days", order_by_column="ts", partition_by=["user_id"], filter="event_type = 'click'"),
        _metric("retention", "orders", "cohort_retention", entity_column="o_custkey", event_column="o_orderdate", cohort_grain="month", retention_grain="month"),
        _metric("retention_capped", "orders", "cohort_retention", entity_column="o_custkey", event_column="o_orderdate", cohort_grain="quarter", retention_grain="quarter", max_periods=6),
        _metric("weekly_retention", "events", "cohort_retention", entity_column="user_id", event_column="ts", cohort_grain="week", retention_grain="week"),
        _metric("paid_funnel", "orders", "funnel", funnel_entity_column="o_custkey", funnel_event_order_column="o_orderdate", funnel_steps=[{"name": "ordered", "condition": "o_orderstatus IN ('O', 'F')"}, {"name": "finished", "condition": "o_orderstatus = 'F'"}]),
        _metric("purchase_funnel", "events", "funnel", funnel_entity_column="user_id", funnel_event_order_column="ts", funnel_steps=[{"name": s, "condition": f"event_type = '{s}'"} for s in ("view", "click", "purchase")]),
        _metric("best_customers", "orders", "multi_stage_filter", msf_entity_column="o_custkey", msf_ranking_expression="SUM(o_totalprice)", msf_result_expression="COUNT(*)", top_n=25),
        _metric("top_decile", "orders", "multi_stage_filter", msf_entity_column="o_custkey", msf_ranking_expression="COUNT(*)", msf_result_expression="AVG(o_totalprice)", top_percentile=0.1),
        _metric("returners", "orders", "cohort_filter", entity_column="o_custkey", cohort_condition="o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'", result_condition="o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01' AND o_orderstatus = 'F'"),
        _metric("revenue_anomalies", "orders", "anomaly_query", rule_id="orders_revenue_anomaly"),
        _metric("stored_revenue", "orders", "sum", expression="o_totalprice", materialized=["status", "priority"]),
        _metric("stored_events", "events", "count", materialized=["event_type", "user"], materialized_strategy="incremental", watermark_column="ts", late_arrival_grace_seconds=3600),
    ]
    roles = [
        {"id": "admin"},
        {"id": "finance", "attributes": {"status": "F"}},
        {"id": "partner"},
        {"id": "urgent", "attributes": {"priority": "1-URGENT"}},
        {"id": "oncall", "is_break_glass": True},
    ]
    policies = [
        *[{"id": f"{r}_{s}", "role": r, "source": s, "default_column_mode": "allow"} for r in ("admin", "oncall") for s in ("orders", "events", "lineitem")],
        {"id": "finance_orders", "role": "finance", "source": "orders", "default_column_mode": "allow", "row_filter": {"op": "eq", "column": "o_orderstatus", "value": {"$attr": "status"}}},
        {"id": "partner_orders", "role": "partner", "source": "orders", "column_overrides": {"o_orderkey": "allow", "o_totalprice": "allow", "o_orderdate": "allow"}, "row_filter": {"op": "or", "args": [{"op": "eq", "column": "o_orderpriority", "value": "1-URGENT"}, {"op": "gt", "column": "o_totalprice", "value": 100000}]}},
        {"id": "urgent_orders", "role": "urgent", "source": "orders", "default_column_mode": "allow", "row_filter": {"op": "eq", "column": "o_orderpriority", "value": {"$attr": "priority"}}},
    ]
    quality = [
        {"id": "orders_price_not_null", "source": "orders", "type": "not_null", "config": {"column": "o_totalprice"}, "severity": "block"},
        {"id": "orders_key_unique", "source": "orders", "type": "unique", "config": {"column": "o_orderkey"}, "severity": "block"},
        {"id": "orders_customer_unique", "source": "orders", "type": "unique", "config": {"column": "o_custkey"}, "severity": "warn"},
        {"id": "orders_price_range", "source": "orders", "type": "range", "config": {"column": "o_totalprice", "min": 1000, "max": 400000}, "severity": "warn"},
        {"id": "orders_some_paid", "source": "orders", "type": "custom_sql", "config": {"sql": "SELECT count(*) > 0 FROM orders WHERE o_orderstatus = 'F'"}, "severity": "warn"},
        {"id": "orders_revenue_anomaly", "source": "orders", "type": "anomaly", "config": {"sql": "SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F'", "n_sigma": 2.0, "trailing_periods": 7}, "severity": "warn"},
    ]
    freshness = [{"id": "orders_fresh", "source": "orders", "watermark_column": "o_orderdate", "max_age_seconds": 86400, "severity": "warn"}]
    return {"sources": sources, "metrics": metrics, "roles": roles, "policies": policies, "quality_rules": quality, "freshness_rules": freshness}
