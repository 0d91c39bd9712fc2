"""Command line: python -m marlstone.cli --config catalog.yaml COMMAND ...

Exit codes: 0 done, 1 a check failed, 2 denied (or a check could not run), 3 error, 4 question not understood.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .model import MarlstoneError
from .plans.governance import ApprovalQueue, identity_from_env, resolve_identity
from .sources.sinks import to_csv, to_json, to_tsv

SAMPLE = """sources:
  - id: orders
    type: csv
    uri: orders.csv
    columns:
      - {name: order_id, type: string, sensitivity: public}
      - {name: amount, type: double, sensitivity: public}
      - {name: region, type: string, sensitivity: public}
    dimensions:
      - {id: orders.region, column: region, type: categorical, display_name: Region}
metrics:
  - {id: order_count, source: orders, type: count, display_name: Order Count}
  - {id: revenue, source: orders, type: sum, expression: amount, display_name: Revenue}
roles:
  - {id: analyst}
policies:
  - {id: analyst_orders, role: analyst, source: orders, default_column_mode: allow}
"""
SAMPLE_ROWS = "order_id,amount,region\no1,10.5,west\no2,20.0,east\no3,5.25,west\no4,8.0,central\n"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone")
    p.add_argument("--config", default="catalog.yaml")
    p.add_argument("--folder", help="where logs and stored metrics are kept")
    p.add_argument("--user", default="cli")
    p.add_argument("--role")
    p.add_argument("--attr", action="append", default=[], help="name=value")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("init", help="write a sample catalogue and data").add_argument("--dir", default=".")
    c.add_parser("sync", help="validate the catalogue, report drift, refresh stored metrics")
    c.add_parser("catalog")
    for name in ("describe", "materialize", "touch"):
        c.add_parser(name).add_argument("id")
    q = c.add_parser("query", help="a JSON intent or a SELECT")
    q.add_argument("text")
    q.add_argument("--format", choices=("tsv", "csv", "json", "parquet"), default="tsv")
    q.add_argument("--out")
    c.add_parser("explain").add_argument("text")
    a = c.add_parser("ask")
    a.add_argument("source")
    a.add_argument("text")
    k = c.add_parser("check")
    k.add_argument("source")
    k.add_argument("--watch", type=float, help="seconds between checks")
    c.add_parser("detect-access-anomalies")
    c.add_parser("submit", help="put a YAML change up for approval").add_argument("file")
    c.add_parser("approvals", help="list changes that wait")
    c.add_parser("approve", help="approve a change; prints it").add_argument("id")
    return p


def show(result, kind: str = "tsv") -> int:
    if result.status != "ok":
        print(f"{result.status}: {result.reason}", file=sys.stderr)
        return 2 if result.status == "denied" else 3
    print({"tsv": to_tsv, "csv": to_csv, "json": to_json}[kind](result.columns, result.rows))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init":
        folder = Path(args.dir)
        for name, text in (("catalog.yaml", SAMPLE), ("orders.csv", SAMPLE_ROWS)):
            if not (folder / name).exists():
                (folder / name).write_text(text)
        return 0
    if args.command in ("submit", "approvals", "approve"):
        return _approvals(args)
    spark = spark or SparkSession.builder.appName("marlstone").getOrCreate()
    try:
        engine = Engine(spark, Path(args.config).read_text(), args.folder)
        return _run(args, engine)
    except Exception as e:  # whatever Spark raises ends the command, not the shell's patience
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2 if args.command == "check" else 3


def _approvals(args) -> int:
    import yaml

    queue = ApprovalQueue(str(Path(args.folder or ".") / "approvals.json"))
    try:
        if args.command == "submit":
            print(queue.submit(yaml.safe_load(Path(args.file).read_text()), args.user))
        elif args.command == "approvals":
            print(json.dumps(queue.pending(), indent=1))
        else:
            print(json.dumps(queue.approve(args.id, args.user), indent=1, default=str))
    except (MarlstoneError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    return 0


def _run(args, engine: Engine) -> int:
    c = engine.catalog
    if args.command == "sync":
        for s in c.sources:
            for d in engine.drift(s):
                print(f"drift: {asdict(d)}")
        if engine.store:
            for m in c.metrics.values():
                if m.materialized is not None:
                    engine.refresh(m.id)
        print(f"{len(c.sources)} sources, {len(c.metrics)} metrics, {len(c.policies)} policies")
        return 0
    if args.command == "catalog":
        print(json.dumps({k: sorted(getattr(c, k)) for k in ("sources", "metrics", "roles", "policies", "quality_rules", "freshness_rules")}, indent=1))
        return 0
    if args.command == "describe":
        found = c.metrics.get(args.id) or c.sources.get(args.id)
        if found is None:
            print(f"error: unknown id {args.id!r}", file=sys.stderr)
            return 3
        print(json.dumps({k: v for k, v in asdict(found).items() if v not in (None, (), "")}, indent=1, default=str))
        return 0
    if args.command == "materialize":
        print(engine.refresh(args.id).count())
        return 0
    if args.command == "touch":
        print(engine.registry.touch(args.id))
        return 0
    if args.command == "check":
        while True:
            outcomes = engine.check(args.source)
            for o in outcomes:
                print(f"{'pass' if o.passed else 'FAIL'} {o.rule_id} {o.detail or ''}".rstrip())
            if not args.watch:
                return 0 if all(o.passed for o in outcomes) else 1
            time.sleep(args.watch)
    if args.command == "detect-access-anomalies":
        from .operators.quality import access_anomalies

        rows = access_anomalies(engine.audit.df(), engine.clock()).collect()
        for r in rows:
            print(json.dumps(r.asDict(), default=str))
        return 0
    own = dict(x.split("=", 1) for x in args.attr)
    identity = resolve_identity(c, args.user, args.role, own) if args.role else identity_from_env(c)
    if args.command == "ask":
        match, result = engine.ask(identity, args.text, args.source)
        if match is None:
            print("not understood", file=sys.stderr)
            return 4
        return show(result)
    is_intent = args.text.lstrip().startswith("{")
    if args.command == "explain":
        print(json.dumps(engine.explain(identity, args.text), indent=1, default=str))
        return 0
    if args.format == "parquet" or args.out:
        result = engine.export(identity, args.text, args.out or "out.parquet", args.format)
        return show(result) if result.status != "ok" else 0
    return show(engine.query(identity, args.text) if is_intent else engine.sql(identity, args.text), args.format)


if __name__ == "__main__":
    sys.exit(main())
