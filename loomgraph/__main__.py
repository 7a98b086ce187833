"""Command line: python -m loomgraph COMMAND. Exit codes: 0 fine, 1 findings, 2 bad call or policy, 3 no workspace."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .operators.assembly import WorkspaceError
from .operators.packages import FILTERS, SORTS, listed, node_table
from .operators.rules import exit_code
from .plans import model, policy, render, sinks
from .sources import workspace


def _print(table: DataFrame, form: str) -> None:
    for row in table.toLocalIterator():
        print(json.dumps(row.asDict(True), ensure_ascii=False, default=str) if form == "json" else "  ".join(str(x) for x in row))


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="loomgraph")
    top.add_argument("-C", "--workspace", help="the workspace, where the command names none")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "packages", "nodes", "graph", "viz", "audit", "validate"):
        c = commands.add_parser(name)
        c.add_argument("path", nargs="?")
        c.add_argument("-f", "--format", default="mermaid" if name == "graph" else "table", choices=("mermaid", "dot", "json") if name == "graph" else ("table", "json"))
        c.add_argument("-o", "--output", help="a file on this machine instead of the standard output")
        c.add_argument("--cache", help="a shared folder where parsed records are kept; one below the shared folder by default")
        c.add_argument("--no-cache", action="store_true", help="parse every file")
        if name == "packages":
            c.add_argument("-t", "--filter", choices=sorted(FILTERS))
            c.add_argument("-s", "--sort", default="name", choices=sorted(SORTS))
            c.add_argument("--show-deps", action="store_true")
        if name in ("nodes", "graph"):
            c.add_argument("-p", "--package")
        if name == "nodes":
            c.add_argument("--show-connections", action="store_true")
        if name == "graph":
            c.add_argument("--view", default="deps", choices=("deps", "comms", "full"))
            c.add_argument("--folder", help="a shared folder for a diagram of any size, written in parts")
        if name == "viz":
            c.add_argument("--container", help="the id of a package or node, where a view is too large for one page")
            c.add_argument("--page", type=int, default=0, help="which page of what the top or a container shows")
            c.add_argument("--folder", help="a shared folder for the pages of all containers, as JSON lines")
        if name in ("audit", "validate"):
            c.add_argument("--fail-on", default="error", choices=("error", "warning", "info"))
        if name == "audit":
            c.add_argument("--strict", action="store_true")
            c.add_argument("--exclude", default="")
        if name == "validate":
            c.add_argument("--policy", required=True)
    args = top.parse_args(argv)
    args.path = args.path or args.workspace or "."
    return args


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if args.output:
            with open(args.output, "w", encoding="utf-8") as out, contextlib.redirect_stdout(out):
                return _run(spark, args)
        return _run(spark, args)
    except policy.PolicyError as e:
        print(e, file=sys.stderr)
        return 2
    except (WorkspaceError, OSError) as e:
        print(e, file=sys.stderr)
        return 3


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    asked = policy.load(args.policy) if args.command == "validate" else []
    kept = None if args.no_cache else args.cache or sinks.default_cache(spark, workspace.workspace_root(args.path))
    m = model.read(spark, args.path, kept)
    if args.command == "scan":
        _print(m.packages.select("name", "version", "package_type", "path").orderBy("name"), args.format)
    elif args.command == "packages":
        rows = listed(m.packages.join(m.scores.withColumnRenamed("score", "health_score"), "name", "left"), args.filter, args.sort)
        if args.filter and rows.isEmpty():
            print(f"no packages match the filter {args.filter}", file=sys.stderr)
        else:
            _print(rows if args.show_deps else rows.drop("deps"), args.format)
    elif args.command == "nodes":
        rows = m.components.filter(F.col("package") == args.package) if args.package else m.components
        if args.show_connections:
            met = graph.connection_rows(m.endpoints, rows.select("package", F.col("name").alias("component")))
            _print(met.orderBy("package", "seq", "peer_rel", "peer_seq").drop("seq", "peer_seq"), args.format)
        elif args.format == "table":
            _print(node_table(rows, m.endpoints), args.format)
        else:
            _print(rows.orderBy("package", "seq").drop("seq"), args.format)
    elif args.command == "graph" and args.folder and args.format != "json":
        render.write(m, args.folder, args.format, args.view, args.package)
    elif args.command == "graph":
        made = {"dot": render.dot, "json": render.graph_json}.get(args.format, render.mermaid)
        for line in made(m, args.view, args.package):
            print(line)
    elif args.command == "viz" and args.folder:
        render.write_levels(m, args.folder)
    elif args.command == "viz":
        for line in render.page(m, args.path, args.container, args.page):
            print(line)
    else:
        rules = asked or [r | ({"exclude": [x for x in args.exclude.split(",") if x]} if r["type"] == "topic_connectivity" else {}) for r in policy.AUDIT]
        found = policy.evaluate(m, rules)
        if args.format == "json":
            print(render.report_json(found, m))
        else:
            _print(policy.ordered(found, by_rule=args.command == "audit").drop("rule_seq"), args.format)
        return exit_code(found, "warning" if getattr(args, "strict", False) else args.fail_on)
    return 0


if __name__ == "__main__":
    sys.exit(main())
