"""Plain-English questions by fixed phrases; nothing is invented.

A phrase is a template of words and slots, such as "{metric} by {dim} by {grain}". Templates are tried in order; the first whose words
fit and whose slots all resolve against what the role may see gives the intent. Slots resolve by kind, so a template is one
line with a function that puts the resolved parts together.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

from .governance import AllowedSchema

# The vocabulary.
WORDS = {
    "top": ("top", "biggest", "largest", "highest"),
    "bottom": ("bottom", "smallest", "lowest", "fewest", "least"),
    "trend": ("trend", "over time", "across time"),
    "count": ("count of", "count", "how many", "total"),
    "show": ("show me", "show", "what's the", "what is the", "what's", "what is"),
    "span": ("last", "past"),
}
GRAINS = {"year": ("year", "yearly", "annual", "annually"), "quarter": ("quarter", "quarterly"), "month": ("month", "monthly"), "week": ("week", "weekly"), "day": ("day", "daily")}
KINDS = {
    ("unique", "distinct"): ("count_distinct", "count_distinct_approx"),
    ("max", "maximum"): ("max",),
    ("min", "minimum"): ("min",),
    ("first",): ("first_value",),
    ("last",): ("last_value",),
    ("average", "avg", "mean"): ("avg",),
    ("median",): ("median",),
}
PERIODS = {"year": ("year over year", "vs last year", "yoy"), "quarter": ("quarter over quarter", "vs last quarter", "qoq"), "month": ("month over month", "vs last month", "mom")}
MONTHS = "january february march april may june july august september october november december".split()
COMPARISONS = {">": "gt", "<": "lt", ">=": "gte", "<=": "lte", "=": "eq", "!=": "neq"}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


class NoMatch(Exception):
    """A slot does not resolve."""


@dataclass(frozen=True)
class Match:
    intent: dict
    pattern: str
    text: str


def _alt(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def _flat(table) -> list[str]:
    return [w for ws in table.values() for w in ws]


# What a slot may look like; its kind is its name without a trailing digit.
_SLOTS = {
    "metric": ".+?", "dim": ".+?", "noun": ".+?", "value": ".+?", "word": r"\w+", "column": r"\w+", "rest": ".+?",
    "n": r"\d+", "number": r"-?\d+(?:\.\d+)?", "cmp": ">=|<=|!=|>|<|=", "date": r"\d{4}-\d{2}-\d{2}", "yyyy": r"\d{4}", "month": r"[A-Za-z]+",
    "grain": _alt(_flat(GRAINS)), "kind": _alt([w for k in KINDS for w in k]), "period": _alt(_flat(PERIODS)),
    "where": "where|with", "unit": "(?:day|week|month|year)s?", "now": "week|month|quarter|year",
    **{k: _alt(v) for k, v in WORDS.items()},
}


def _pattern(template: str) -> re.Pattern:
    """A template as a regular expression: spaces are white space, (..) is optional, {slot} is a named group."""
    out = []
    for part in re.split(r"(\{\w+\}|[()]|\s+)", template):
        if m := re.fullmatch(r"\{(\w+)\}", part):
            out.append(f"(?P<{m[1]}>{_SLOTS[m[1].rstrip('0123456789')]})")
        elif part in ("(", ")"):
            out.append("(?:" if part == "(" else ")?")
        else:
            out.append(r"\s+" if part.isspace() else re.escape(part))
    return re.compile("".join(out), re.IGNORECASE)


class Schema:
    """Slot resolution over what a role may see."""

    def __init__(self, view: AllowedSchema, today: date):
        self.view, self.today = view, today

    @staticmethod
    def _best(phrase: str, entries: list[tuple[str, list[str]]], exact: bool = True) -> str | None:
        """The entry with a name equal to the phrase, else the one whose containing name is shortest."""
        phrase = phrase.lower().strip()
        if not phrase:
            return None
        if exact:
            for key, names in entries:
                if phrase in names:
                    return key
        found = [(len(next(n for n in names if phrase in n)), key) for key, names in entries if any(phrase in n for n in names)]
        return min(found)[1] if found else None

    def _need(self, value):
        if value is None:
            raise NoMatch
        return value

    def metric(self, text: str, types: tuple[str, ...] | None = None, exact: bool = True) -> str:
        rows = [(m.id, [m.id.lower(), m.display_name.lower()]) for m in self.view.metrics if types is None or m.type in types]
        return self._need(self._best(text, rows, exact))

    def dim(self, text: str) -> str:
        return self._need(self._best(text, [(d.id, [d.id.lower(), d.display_name.lower(), d.column.lower()]) for d in self.view.dimensions]))

    def column(self, text: str) -> str:
        return self._need(next((c.name for c in self.view.columns if c.name.lower() == text.lower()), None))

    def temporal(self):
        return self._need(next((d for d in self.view.dimensions if d.type == "temporal"), None))

    def example(self, text: str) -> tuple[str, str]:
        """(column, value) of the first column that has the value among its examples."""
        text = text.lower().strip()
        return self._need(next(((c.name, v) for c in self.view.columns for v in c.example_values or () if v.lower() == text), None))

    def named_metric(self, phrase: str, metric_type: str, also=lambda name: True) -> str:
        """The metric of a type whose id and display name together contain the phrase; the shortest display name wins."""
        phrase = phrase.lower().strip()
        found = [(len(m.display_name), m.id) for m in self.view.metrics if m.type == metric_type and phrase in (name := f"{m.id} {m.display_name}".lower()) and also(name)]
        return self._need(min(found)[1] if found else None)

    def count_metric(self) -> str:
        return self._need(next((m.id for m in self.view.metrics if m.type == "count"), None))

    def between(self, start: str, end: str) -> dict:
        """A half-open filter on the first temporal column."""
        c = self.temporal().column
        return {"op": "and", "args": [{"op": "gte", "column": c, "value": start}, {"op": "lt", "column": c, "value": end}]}


def _number(text: str) -> int | float:
    x = float(text)
    return int(x) if x.is_integer() else x


def _canonical(table, word: str) -> Any:
    return next(k for k, ws in table.items() if word.lower() in ws)


def _month_after(year: int, month: int, n: int = 1) -> date:
    at = year * 12 + month - 1 + n
    return date(at // 12, at % 12 + 1, 1)


def _ranked(direction):
    def build(s: Schema, g: dict) -> dict:
        m = s.metric(g["metric"])
        return {"metrics": [m], "dimensions": [{"id": s.dim(g["dim"])}], "order_by": [{"key": m, "direction": direction}], "limit": int(g["n"])}

    return build


def _ranked_having(s, g):
    out = _ranked("desc")(s, g)
    other = s.metric(g["metric2"])
    if g["cmp"] == "!=":
        raise NoMatch
    out["metrics"] = list(dict.fromkeys([*out["metrics"], other]))
    return out | {"having": [{"op": COMPARISONS[g["cmp"]], "metric": other, "value": _number(g["number"])}]}


def _by_kind(s, g):
    return {"metrics": [s.metric(g["noun"], _canonical({v: k for k, v in KINDS.items()}, g["kind"]), exact=False)]}


def _by_grain(s, g):
    return {"metrics": [s.metric(g["metric"])], "dimensions": [{"id": s.temporal().id, "grain": _canonical(GRAINS, g["grain"])}]}


def _trend(s, g):
    return {"metrics": [s.metric(g["metric"])], "dimensions": [{"id": s.temporal().id, "grain": "month"}]}


def _dim_and_grain(s, g):
    d, t = s.dim(g["dim"]), s.temporal().id
    if d == t:
        raise NoMatch
    return {"metrics": [s.metric(g["metric"])], "dimensions": [{"id": d}, {"id": t, "grain": _canonical(GRAINS, g["grain"])}]}


def _two_dims(s, g):
    ds = [s.dim(g["dim1"]), s.dim(g["dim2"])]
    if ds[0] == ds[1]:
        raise NoMatch
    return {"metrics": [s.metric(g["metric"])], "dimensions": [{"id": d} for d in ds]}


def _two_metrics(s, g):
    ms = [s.metric(g["metric1"]), s.metric(g["metric2"])]
    if ms[0] == ms[1]:
        raise NoMatch
    return {"metrics": ms} | ({"dimensions": [{"id": s.dim(g["dim"])}]} if g.get("dim") else {})


def _one_dim(s, g):
    return {"metrics": [s.metric(g["metric"])], "dimensions": [{"id": s.dim(g["dim"])}]}


def _in_period(s, g):
    year, word = int(g["yyyy"]), g.get("month")
    if word:
        w = word.lower()
        found = [i for i, m in enumerate(MONTHS, 1) if w == m or w == m[:3] or (w == "sept" and m == "september")]
        if not found:
            raise NoMatch
        start, end = date(year, found[0], 1), _month_after(year, found[0])
    else:
        start, end = date(year, 1, 1), date(year + 1, 1, 1)
    return {"metrics": [s.metric(g["metric"])], "filters": [s.between(start.isoformat(), end.isoformat())]}


def _in_range(s, g):
    return {"metrics": [s.metric(g["metric"])], "filters": [s.between(g["date1"], g["date2"])]}


def _this(s, g):
    t, unit = s.today, g["now"].lower()
    if unit == "week":
        start = t - timedelta(days=t.weekday())
        end = start + timedelta(days=7)
    else:
        months = {"month": 1, "quarter": 3, "year": 12}[unit]
        start = date(t.year, (t.month - 1) // months * months + 1, 1)
        end = _month_after(start.year, start.month, months)
    return {"metrics": [s.metric(g["metric"])], "filters": [s.between(start.isoformat(), end.isoformat())]}


def _last(s, g):
    days = int(g["n"]) * UNIT_DAYS[g["unit"].lower().rstrip("s")]
    return {"metrics": [s.metric(g["metric"])], "filters": [s.between((s.today - timedelta(days=days)).isoformat(), (s.today + timedelta(days=1)).isoformat())]}


def _equal(s, text, op="eq"):
    column, value = s.example(text)
    return {"op": op, "column": column, "value": value}


def _percent(s, g):
    names = {m.id: f"{m.id} {m.display_name}".lower() for m in s.view.metrics}
    a, b = g["metric1"].lower().strip(), g["metric2"].lower().strip()
    found = [(len(m.display_name), m.id) for m in s.view.metrics if m.type == "ratio" and a in names.get(m.numerator, "") and b in names.get(m.denominator, "")]
    return {"metrics": [s._need(min(found)[1] if found else None)]}


def _compared(s, g):
    return {"metrics": [s.metric(g["metric"])], "filters": [{"op": COMPARISONS[g["cmp"]], "column": s.column(g["column"]), "value": _number(g["number"])}]}


def _compared_between(s, g):
    c = s.column(g["column"])
    bounds = [{"op": op, "column": c, "value": _number(g[k])} for op, k in (("gte", "number1"), ("lte", "number2"))]
    return {"metrics": [s.metric(g["metric"])], "filters": [{"op": "and", "args": bounds}]}


def _against_period(s, g):
    unit = _canonical(PERIODS, g["period"])
    short = PERIODS[unit][-1]
    m = s.named_metric(g["metric"], "period_over_period", lambda name: unit in name or short in name)
    return {"metrics": [m], "dimensions": [{"id": s.temporal().id, "grain": unit}]}


def _distribution(s, g):
    m = s.metric(g["metric"])
    if not any(v.id == m and v.type in ("median", "percentile") for v in s.view.metrics):
        raise NoMatch
    return {"metrics": [m]}


Build = Callable[[Schema, dict], dict]
#: In order of priority. Templates of the second group may start with "show me" and the like.
PLAIN: list[tuple[str, str, Build]] = [
    ("top_n_with_having", "{top} {n} {dim} by {metric} {where} {metric2} {cmp} {number}", _ranked_having),
    ("top_n_by_metric", "{top} {n} {dim} by {metric}", _ranked("desc")),
    ("bottom_n_by_metric", "{bottom} {n} {dim} by {metric}", _ranked("asc")),
]
SHOWN: list[tuple[str, str, Build]] = [
    ("metric_by_type_keyword", "{kind} {noun}", _by_kind),
    ("metric_by_grain", "{metric} by {grain}", _by_grain),
    ("metric_over_time", "{metric} {trend}", _trend),
    ("metric_by_dim_and_grain", "{metric} by {dim} by {grain}", _dim_and_grain),
    ("metric_by_two_dims", "{metric} by {dim1} by {dim2}", _two_dims),
    ("metric_by_two_dims", "{metric} by {dim1}, {dim2}", _two_dims),
    ("multi_metric", "{metric1} and {metric2}( by {dim})", _two_metrics),
    ("metric_by_dim", "{metric} by {dim}", _one_dim),
    ("metric_in_period", "{metric} in ({month} ){yyyy}", _in_period),
    ("metric_in_date_range", "{metric} from {date1} to {date2}", _in_range),
    ("metric_this_period", "{metric} this {now}", _this),
    ("metric_last_n_period", "{metric} {span} {n} {unit}", _last),
    ("count_with_condition", "{count} {word} {word2}", lambda s, g: {"filters": [_equal(s, g["word"])], "metrics": [s.count_metric()]}),
    ("count_of_thing", "{count} {rest}", lambda s, g: {"metrics": [s.count_metric()]}),
    ("metric_excluding_value", "{metric} excluding {word}( {word2})", lambda s, g: {"metrics": [s.metric(g["metric"])], "filters": [_equal(s, g["word"], "neq")]}),
    ("metric_as_percent_of", "{metric1} as percent of {metric2}", _percent),
    ("metric_as_percent_of", "{metric1} as % of {metric2}", _percent),
    ("metric_filter_compound", "{metric} for {word1} and {word2}", lambda s, g: {"metrics": [s.metric(g["metric"])], "filters": [_equal(s, g["word1"]), _equal(s, g["word2"])]}),
    ("metric_where_between", "{metric} where {column} between {number1} and {number2}", _compared_between),
    ("metric_where", "{metric} where {column} {cmp} {number}", _compared),
    ("metric_filtered_by_value", "{metric} for {value}", lambda s, g: {"metrics": [s.metric(g["metric"])], "filters": [_equal(s, g["value"])]}),
    ("metric_anomalies", "anomalies in {noun}", lambda s, g: {"metrics": [s.named_metric(g["noun"], "anomaly_query")]}),
    ("metric_anomalies", "anomaly in {noun}", lambda s, g: {"metrics": [s.named_metric(g["noun"], "anomaly_query")]}),
    ("metric_period_over_period", "{metric} {period}", _against_period),
    ("metric_distribution", "{metric} distribution", _distribution),
    ("single_metric", "{metric}", lambda s, g: {"metrics": [s.metric(g["metric"])]}),
]

_COMPILED: list[tuple] = [(name, _pattern(t), b) for name, t, b in PLAIN] + [(name, _pattern("({show} )" + t), b) for name, t, b in SHOWN]


def register(name: str, template: str, first: bool = False) -> Callable[[Build], Build]:
    """Adds a phrase: decorates the function from (schema, what the template's fields matched) to an intent's fields.

    The function raises NoMatch where the phrase does not resolve. Phrases are tried in order; `first` puts this one before all others.
    """

    def put(build: Build) -> Build:
        entry = (name, _pattern("({show} )" + template), build)
        _COMPILED.insert(0 if first else len(_COMPILED), entry)
        return build

    return put


def understand(text: str, view: AllowedSchema, today: date | None = None) -> Match | None:
    """The intent of a question, or None where no phrase fits and resolves."""
    said = text.strip().rstrip(".?!").strip()
    schema = Schema(view, today or date.today())
    for name, pattern, build in _COMPILED:
        m = pattern.fullmatch(said)
        if not m:
            continue
        try:
            return Match({"source": view.source, **build(schema, m.groupdict())}, name, said)
        except NoMatch:
            continue
    return None
