"""A small catalogue of taxi rides and its rows."""

from datetime import datetime

RIDES = [
    ("a1", 12.5, datetime(2025, 5, 2), "done", "north", "kim@m.example"),
    ("a2", 30.0, datetime(2025, 5, 6), "done", "south", "lee@m.example"),
    ("a3", 8.0, datetime(2025, 5, 20), "open", "north", "kim@m.example"),
    ("a4", 20.0, datetime(2025, 6, 4), "done", "north", "kim@m.example"),
    ("a5", 45.5, datetime(2025, 6, 8), "void", "harbour", "mia@m.example"),
    ("a6", 10.0, datetime(2025, 7, 1), "done", "south", "lee@m.example"),
    ("a7", 64.0, datetime(2025, 7, 2), "open", "north", "ned@m.example"),
    ("a8", None, datetime(2025, 7, 2), "open", None, None),
]
SCHEMA = "ride_id string, fare double, started timestamp_ntz, state string, zone string, rider string"
COLUMNS = [("ride_id", "string", "public"), ("fare", "double", "public"), ("started", "timestamp", "public"), ("state", "string", "public"), ("zone", "string", "public"), ("rider", "string", "pii")]


def metric(key, kind, **fields):
    return {"id": key, "source": "rides", "type": kind, "display_name": key.replace("_", " ").title(), **fields}


def catalog(uri="rides_fixture"):
    return {
        "sources": [
            {
                "id": "rides",
                "type": "sql_view",
                "uri": uri,
                "columns": [{"name": n, "type": t, "sensitivity": s} for n, t, s in COLUMNS],
                "dimensions": [
                    {"id": "rides.zone", "column": "zone", "type": "categorical", "display_name": "Zone"},
                    {"id": "rides.state", "column": "state", "type": "categorical", "display_name": "State"},
                    {"id": "rides.started", "column": "started", "type": "temporal", "display_name": "Started"},
                    {"id": "rides.rider", "column": "rider", "type": "categorical", "display_name": "Rider"},
                ],
            }
        ],
        "metrics": [
            metric("ride_count", "count"),
            metric("paid_fares", "sum", expression="fare", filter="state = 'done'"),
            metric("fare_per_ride", "ratio", numerator="paid_fares", denominator="ride_count"),
            metric("per_ride", "expression", expression="{paid_fares} / NULLIF({ride_count}, 0)"),
            metric("p95_fare", "percentile", column="fare", p=0.95),
            metric("median_fare", "median", column="fare"),
            metric("max_fare", "max", expression="fare"),
            metric("avg_fare", "avg", expression="fare"),
            metric("riders", "count_distinct", column="rider"),
            metric("fares_5d", "rolling_window", column="fare", aggregate="sum", window="5 days", order_by_column="started", filter="state = 'done'"),
            metric("fares_mom", "period_over_period", base_metric="paid_fares", period_dim="rides.started", period_unit="month", comparison="delta"),
            metric("rider_retention", "cohort_retention", entity_column="rider", event_column="started", cohort_grain="month", retention_grain="month", max_periods=12),
            metric("ride_funnel", "funnel", funnel_entity_column="rider", funnel_event_order_column="started", funnel_steps=[{"name": "booked", "condition": "state IN ('open', 'done')"}, {"name": "finished", "condition": "state = 'done'"}]),
            metric("top_riders", "multi_stage_filter", msf_entity_column="rider", msf_ranking_expression="SUM(fare)", msf_result_expression="COUNT(*)", top_n=2),
            metric("top_half", "multi_stage_filter", msf_entity_column="rider", msf_ranking_expression="SUM(fare)", msf_result_expression="COUNT(*)", top_percentile=0.5),
            metric("back_again", "cohort_filter", entity_column="rider", cohort_condition="started < '2025-06-01' AND state = 'done'", result_condition="started >= '2025-06-01' AND started < '2025-07-01' AND state = 'done'"),
            metric("fare_anomalies", "anomaly_query", rule_id="fare_anomaly"),
        ],
        "roles": [{"id": "admin"}, {"id": "north", "attributes": {"zone": "north"}}, {"id": "partner"}, {"id": "lost"}, {"id": "glass", "is_break_glass": True}],
        "policies": [
            {"id": "p_admin", "role": "admin", "source": "rides", "default_column_mode": "allow"},
            {"id": "p_glass", "role": "glass", "source": "rides", "default_column_mode": "allow"},
            {"id": "p_north", "role": "north", "source": "rides", "default_column_mode": "allow", "row_filter": {"op": "eq", "column": "zone", "value": {"$attr": "zone"}}},
            {"id": "p_lost", "role": "lost", "source": "rides", "default_column_mode": "allow", "row_filter": {"op": "eq", "column": "zone", "value": {"$attr": "nowhere"}}},
            {"id": "p_partner", "role": "partner", "source": "rides", "column_overrides": {"ride_id": "allow", "fare": "allow", "started": "allow"}, "row_filter": {"op": "eq", "column": "zone", "value": "north"}},
        ],
        "quality_rules": [
            {"id": "fare_not_null", "source": "rides", "type": "not_null", "config": {"column": "fare"}, "severity": "block"},
            {"id": "fare_range", "source": "rides", "type": "range", "config": {"column": "fare", "min": 0, "max": 1000}, "severity": "warn"},
            {"id": "fare_anomaly", "source": "rides", "type": "anomaly", "config": {"sql": "SELECT sum(fare) FROM rides WHERE state = 'done'", "n_sigma": 2.0, "trailing_periods": 7}, "severity": "warn"},
        ],
        "freshness_rules": [{"id": "fresh", "source": "rides", "watermark_column": "started", "max_age_seconds": 86400, "severity": "warn"}],
    }
