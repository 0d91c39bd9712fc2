"""Raw SQL under governance.

The text is parsed by Spark, and its shape is checked on the plan: one SELECT (WITH allowed), one real relation, no subquery, no
star. Columns are found by analysing it in a session of its own where only the source's name exists, first over the whole
schema without rows, then over the governed DataFrame. The row filter and the allowed columns are in that DataFrame, so they
hold in every CTE and self-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..model import MarlstoneError


class SqlError(MarlstoneError):
    """The statement is not one that may run."""


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(plan):
    """(plan node, None) and (plan node, expression) for all of a parsed plan, CTE definitions included."""
    work = [plan]
    while work:
        node = work.pop()
        yield node, None
        for e in _seq(node.expressions()):
            deeper = [e]
            while deeper:
                x = deeper.pop()
                yield node, x
                deeper += _seq(x.children())
        work += _seq(node.children())
        if _kind(node) == "UnresolvedWith":
            work += [pair._2() for pair in _seq(node.cteRelations())]


# Plan nodes that a SELECT may be made of.
_ALLOWED = {
    "Project", "Aggregate", "Filter", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedWith", "WithWindowDefinition", "UnresolvedSubqueryColumnAliases", "UnresolvedOrdinal",
}
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "UnresolvedScalarSubquery", "UnresolvedExists", "UnresolvedInSubquery"}


def parse(spark: SparkSession, sql: str) -> str:
    """The one source that a statement reads; SqlError for any other statement."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        text = str(getattr(e, "java_exception", e)).splitlines()
        raise SqlError(f"cannot parse: {text[0] if text else e}") from e
    ctes: set[str] = set()
    tables: set[str] = set()
    bodies = []
    for node, _ in ((n, e) for n, e in _walk(plan) if e is None):
        if _kind(node) == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                ctes.add(pair._1().lower())
                bodies.append(pair._2().hashCode())
    for node, e in _walk(plan):
        if e is None:
            kind = _kind(node)
            if kind in ("Union", "Intersect", "Except"):
                raise SqlError("only a SELECT may run, without UNION, INTERSECT or EXCEPT")
            if kind == "OneRowRelation":
                raise SqlError("a FROM clause is needed")
            if kind not in _ALLOWED:
                raise SqlError(f"only a SELECT may run; found {kind}")
            if kind == "SubqueryAlias" and node.hashCode() not in bodies and _kind(node.child()) not in ("UnresolvedRelation",):
                raise SqlError("subqueries are not allowed")
            if kind == "UnresolvedRelation":
                parts = _seq(node.multipartIdentifier())
                if len(parts) > 1:
                    raise SqlError(f"relation {'.'.join(parts)!r} is not a source")
                if parts[0].lower() not in ctes:
                    tables.add(parts[0])
        else:
            kind = _kind(e)
            if kind in _SUBQUERIES:
                raise SqlError("subqueries are not allowed")
            if "Star" in kind:
                raise SqlError("* is not allowed; name the columns")
    if not tables:
        raise SqlError("a FROM clause with a source is needed")
    if len({t.lower() for t in tables}) > 1:
        raise SqlError(f"one source at a time; found {', '.join(sorted(tables))}")
    return tables.pop()


def _session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    return own


def columns_used(spark: SparkSession, sql: str, source_id: str, schema: T.StructType) -> frozenset[str]:
    """The source's columns that the statement refers to anywhere, through CTEs too. No rows are read."""
    own = _session(spark)
    own.createDataFrame([], schema).createOrReplaceTempView(source_id)
    try:
        plan = own.sql(sql)._jdf.queryExecution().analyzed()
    except Exception as e:
        raise SqlError(f"cannot analyse: {str(e).splitlines()[0]}") from e
    ids: dict[int, str] = {}
    used: set[str] = set()
    work = [plan]
    while work:
        node = work.pop()
        children = [] if _kind(node) == "View" else _seq(node.children())
        # CTE references have no children either, but their columns are those of the definition.
        if not children and _kind(node) != "CTERelationRef":
            ids |= {a.exprId().id(): a.name() for a in _seq(node.output())}
        work += children
    work = [plan]
    while work:
        node = work.pop()
        if _kind(node) == "View":
            continue
        if _kind(node) != "SubqueryAlias":
            for e in _seq(node.expressions()):
                deeper = [e]
                while deeper:
                    x = deeper.pop()
                    if _kind(x) == "AttributeReference" and x.exprId().id() in ids:
                        used.add(ids[x.exprId().id()])
                    deeper += _seq(x.children())
        work += _seq(node.children())
    lower = {f.name.lower(): f.name for f in schema.fields}
    return frozenset(lower[c.lower()] for c in used if c.lower() in lower)


def run(spark: SparkSession, sql: str, source_id: str, governed: DataFrame) -> DataFrame:
    """The statement over the governed source, in a session that knows nothing else by that name."""
    own = _session(spark)
    moved = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, governed._jdf.logicalPlan()), own)
    moved.createOrReplaceTempView(source_id)
    return own.sql(sql)
