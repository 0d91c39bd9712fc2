"""Sensitive literals taken out of what the audit log keeps.

SQL is cut into tokens and the tokens into predicates; a predicate that names a sensitive column loses all its literals, also where
the column stands inside a function. Text that cannot be cut into tokens loses everything. Intents lose the values of
filters on sensitive columns.
"""

from __future__ import annotations

import json
import re

from ..config import Catalog
from ..model import SENSITIVE

REDACTED = "<redacted>"
_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>[rR]?'(?:[^'\\]|''|\\.)*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|[^\W\d]\w*)"""
    r"""|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[A-Za-z]*|\.\d+)|(?P<other><=>|<>|!=|<=|>=|\|\||::|->>|->|.)""",
    re.DOTALL,
)
_EDGES = {"and", "or", "where", "having", "on", "select", "from", "group", "order", "limit", "case", "when", "then", "else", "end", "qualify", "with"}


def sensitive_columns(catalog: Catalog, source_id: str | None) -> frozenset[str]:
    """Names of pii and restricted columns of a source; of all sources if it is not known."""
    sources = [catalog.sources[source_id]] if source_id in catalog.sources else catalog.sources.values()
    return frozenset(c.name for s in sources for c in s.columns if c.sensitivity in SENSITIVE)


def _bare(token: str) -> str:
    return (token[1:-1] if token[:1] in "\"`" else token).lower()


def redact_sql(sql: str, columns: frozenset[str]) -> str:
    if not sql or not columns:
        return sql
    names = {c.lower() for c in columns}
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql)]
    if "".join(t for _, t in tokens) != sql or any(k == "other" and t == "'" for k, t in tokens):
        return REDACTED
    out, held, depth, between = [], [], 0, False

    def close():
        hit = any(k == "name" and _bare(t) in names for k, t in held)
        out.extend(f"'{REDACTED}'" if hit and k in ("text", "number") else t for k, t in held)
        held.clear()

    for kind, token in tokens:
        word = token.lower() if kind == "name" else token
        if word == "between":
            between = True
        depth += (token == "(") - (token == ")")
        if word == "and" and between:
            between = False
        elif (kind == "name" and word in _EDGES) or (token == "," and depth <= 0):
            close()
        held.append((kind, token))
    close()
    return "".join(out)


def redact_intent(text: str, columns: frozenset[str]) -> str:
    if not text or not columns:
        return text
    try:
        intent = json.loads(text)
    except ValueError:
        return REDACTED
    if not isinstance(intent, dict):
        return REDACTED

    def clean(node):
        if not isinstance(node, dict):
            return REDACTED
        node = dict(node)
        if isinstance(node.get("args"), list):
            node["args"] = [clean(a) for a in node["args"]]
        if node.get("column") in columns and "value" in node:
            v = node["value"]
            node["value"] = [REDACTED] * len(v) if isinstance(v, list) else REDACTED
        return node

    if isinstance(intent.get("filters"), list):
        intent["filters"] = [clean(f) for f in intent["filters"]]
    return json.dumps(intent, sort_keys=True)


def redact_prompt(prompt: str | None, intent_text: str, columns: frozenset[str]) -> str | None:
    """A question without the values that its intent compares with sensitive columns."""
    if not prompt or not columns:
        return prompt
    try:
        work = list(json.loads(intent_text).get("filters") or [])
    except (ValueError, AttributeError):
        return REDACTED
    while work:
        node = work.pop()
        work += node.get("args") or []
        if node.get("column") in columns and node.get("value") is not None:
            values = node["value"] if isinstance(node["value"], list) else [node["value"]]
            for v in values:
                prompt = re.sub(re.escape(str(v)), REDACTED, prompt, flags=re.IGNORECASE)
    return prompt
