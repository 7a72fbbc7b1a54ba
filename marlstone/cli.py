"""Command line: catalog, scan, aggregate, query, query-file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from .engine import Engine
from .operators.scan import ScanRequest
from .operators.sinks import print_rows


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone")
    p.add_argument("--catalog", default=".marlstone/catalog.json")
    p.add_argument("--header", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("catalog").add_subparsers(dest="action", required=True)
    for name in ("register", "refresh", "list", "show"):
        a = c.add_parser(name)
        if name != "list":
            a.add_argument("name")
        if name == "register":
            a.add_argument("location")
    s = sub.add_parser("scan")
    s.add_argument("path")
    s.add_argument("--columns", default="")
    s.add_argument("--filter")
    s.add_argument("--order-by", default="")
    s.add_argument("--limit", type=int)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--distinct", action="store_true")
    s.add_argument("--metrics", action="store_true")
    a = sub.add_parser("aggregate")
    a.add_argument("path")
    a.add_argument("--aggregate", action="append", required=True)
    a.add_argument("--group-by", default="")
    a.add_argument("--filter")
    for name, arg in (("query", "sql"), ("query-file", "file")):
        sub.add_parser(name).add_argument(arg)
    return p


def names(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def main(argv: list[str] | None = None, engine: Engine | None = None, out=None) -> int:
    args, out = parser().parse_args(argv), out or sys.stdout
    engine = engine or Engine(catalog_path=args.catalog)

    def show(result: DataFrame | str | int) -> None:
        if isinstance(result, DataFrame):
            print_rows(result, out, args.header)
        else:
            print(result, file=out)

    if args.command == "catalog":
        if args.action == "list":
            for t in engine.catalog.list():
                print(t.name, t.location, t.rows, file=out)
        else:
            t = engine.catalog.register(args.name, args.location) if args.action == "register" else getattr(engine.catalog, {"refresh": "refresh", "show": "get"}[args.action])(args.name)
            print(t, file=out)
    elif args.command == "scan":
        r = ScanRequest(args.path, names(args.columns), args.filter, names(args.order_by), args.limit, args.offset, args.distinct)
        show(str(engine.scan_metrics(r)) if args.metrics else engine.scan(r))
    elif args.command == "aggregate":
        show(engine.aggregate(args.path, args.aggregate, list(names(args.group_by)), args.filter))
    elif args.command == "query":
        show(engine.sql(args.sql))
    else:
        with open(args.file) as f:
            for result in engine.script(f.read()):
                show(result)
    return 0


if __name__ == "__main__":
    sys.exit(main())
