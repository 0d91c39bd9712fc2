"""Every phrase of plain English, over a view of parcels made by hand; no Spark."""

from datetime import date

import pytest

from marlstone.plans.governance import AllowedSchema, ColumnView, DimensionView, MetricView
from marlstone.plans.nl import understand

KINDS = {
    "parcels": "count", "mass_sent": "sum", "weight_share": "ratio", "unique_senders": "count_distinct", "max_postage": "max", "median_postage": "median",
    "weight_yoy": "period_over_period", "weight_mom": "period_over_period", "weight_anomalies": "anomaly_query",
}
NAMES = {"weight_yoy": "Weight Year-over-Year", "weight_mom": "Weight Month-over-Month", "weight_share": "Weight per Parcel", "max_postage": "Max Stamp Postage", "median_postage": "Median Stamp Postage"}
HUB, STAGE, SENT = "post.hub", "post.stage", "post.sent"
VIEW = AllowedSchema(
    "post",
    "Post",
    (
        ColumnView("grams", "double", "public", None),
        ColumnView("sent_at", "timestamp", "public", None),
        ColumnView("stage", "string", "public", None, ("delivered", "lost", "sorted")),
        ColumnView("hub", "string", "public", None, ("oslo", "porto", "riga")),
    ),
    (DimensionView(HUB, "hub", "Hub", "categorical"), DimensionView(STAGE, "stage", "Stage", "categorical"), DimensionView(SENT, "sent_at", "Sent", "temporal")),
    tuple(MetricView(k, NAMES.get(k, k.replace("_", " ").title()), t, None, None, (), *(("mass_sent", "parcels") if t == "ratio" else ())) for k, t in KINDS.items()),
)
TODAY = date(2023, 8, 16)


def ask(text):
    return understand(text, VIEW, TODAY)


def between(a, b):
    return [{"op": "and", "args": [{"op": "gte", "column": "sent_at", "value": a}, {"op": "lt", "column": "sent_at", "value": b}]}]


def is_(column, value, op="eq"):
    return {"op": op, "column": column, "value": value}


RANKED = {
    "top 4 hub by mass sent where parcels >= 12": ("top_n_with_having", "mass_sent", "desc", HUB, 4, [{"op": "gte", "metric": "parcels", "value": 12}]),
    "largest 2 stage by parcels": ("top_n_by_metric", "parcels", "desc", STAGE, 2, None),
    "Lowest 9 Hub by mass sent": ("bottom_n_by_metric", "mass_sent", "asc", HUB, 9, None),
}


@pytest.mark.parametrize("text", RANKED)
def test_rankings(text):
    name, metric, direction, dim, n, having = RANKED[text]
    m = ask(text)
    want = {"source": "post", "dimensions": [{"id": dim}], "order_by": [{"key": metric, "direction": direction}], "limit": n}
    metrics = [metric] if having is None else m.intent["metrics"]
    assert m.pattern == name and metrics[0] == metric
    assert m.intent == want | {"metrics": metrics} | ({"having": having} if having else {})


BY = {
    "what is the maximum stamp postage?": ("metric_by_type_keyword", ["max_postage"], []),
    "unique senders": ("metric_by_type_keyword", ["unique_senders"], []),
    "show me parcels by yearly": ("metric_by_grain", ["parcels"], [(SENT, "year")]),
    "parcels over time": ("metric_over_time", ["parcels"], [(SENT, "month")]),
    "mass sent by stage by day": ("metric_by_dim_and_grain", ["mass_sent"], [(STAGE, None), (SENT, "day")]),
    "parcels by stage, hub": ("metric_by_two_dims", ["parcels"], [(STAGE, None), (HUB, None)]),
    "parcels by hub by stage": ("metric_by_two_dims", ["parcels"], [(HUB, None), (STAGE, None)]),
    "parcels and mass sent by hub": ("multi_metric", ["parcels", "mass_sent"], [(HUB, None)]),
    "mass sent and parcels": ("multi_metric", ["mass_sent", "parcels"], []),
    "mass sent by hub": ("metric_by_dim", ["mass_sent"], [(HUB, None)]),
    "how many boxes": ("count_of_thing", ["parcels"], []),
    "mass sent as % of parcels": ("metric_as_percent_of", ["weight_share"], []),
    "anomalies in weight": ("metric_anomalies", ["weight_anomalies"], []),
    "weight vs last month": ("metric_period_over_period", ["weight_mom"], [(SENT, "month")]),
    "weight yoy": ("metric_period_over_period", ["weight_yoy"], [(SENT, "year")]),
    "median_postage distribution": ("metric_distribution", ["median_postage"], []),
    "what's the mass sent": ("single_metric", ["mass_sent"], []),
}


@pytest.mark.parametrize("text", BY)
def test_metrics_and_dimensions(text):
    name, metrics, dims = BY[text]
    m = ask(text)
    assert m.pattern == name and m.intent["metrics"] == metrics
    assert m.intent.get("dimensions", []) == [{"id": d} | ({"grain": g} if g else {}) for d, g in dims]
    assert not m.intent.keys() - {"source", "metrics", "dimensions"}


FILTERED = {
    "parcels in feb 2024": ("metric_in_period", "parcels", between("2024-02-01", "2024-03-01")),
    "parcels in 2019": ("metric_in_period", "parcels", between("2019-01-01", "2020-01-01")),
    "mass sent from 2022-11-30 to 2023-01-02": ("metric_in_date_range", "mass_sent", between("2022-11-30", "2023-01-02")),
    "parcels this week": ("metric_this_period", "parcels", between("2023-08-14", "2023-08-21")),
    "parcels this quarter": ("metric_this_period", "parcels", between("2023-07-01", "2023-10-01")),
    "mass sent last 3 weeks": ("metric_last_n_period", "mass_sent", between("2023-07-26", "2023-08-17")),
    "count of lost boxes": ("count_with_condition", "parcels", [is_("stage", "lost")]),
    "mass sent excluding sorted boxes": ("metric_excluding_value", "mass_sent", [is_("stage", "sorted", "neq")]),
    "mass sent for riga and lost": ("metric_filter_compound", "mass_sent", [is_("hub", "riga"), is_("stage", "lost")]),
    "parcels where grams between 250 and 999.5": ("metric_where_between", "parcels", [{"op": "and", "args": [is_("grams", 250, "gte"), is_("grams", 999.5, "lte")]}]),
    "parcels where grams < 20": ("metric_where", "parcels", [is_("grams", 20, "lt")]),
    "parcels for Porto": ("metric_filtered_by_value", "parcels", [is_("hub", "porto")]),
}


@pytest.mark.parametrize("text", FILTERED)
def test_filters(text):
    name, metric, filters = FILTERED[text]
    m = ask(text)
    assert (m.pattern, m.intent) == (name, {"source": "post", "metrics": [metric], "filters": filters})


@pytest.mark.parametrize("text", ["", "largest 2 stages by parcels", "median weight distribution", "parcels in thermidor 2019", "parcels for atlantis", "parcels where secret > 3", "parcels as percent of mass sent", "sing me a song"])
def test_not_understood(text):
    assert ask(text) is None


def test_nothing_without_a_view():
    assert understand("mass sent", AllowedSchema("post", "Post"), TODAY) is None
