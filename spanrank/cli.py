"""Command line: exit code 0 with chunks, 1 without, 2 for a bad query."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.search import focused_read

VERSION = "0.1.0"


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanrank", description="Ranked, token-budgeted slices of files that match a query.")
    p.add_argument("path", help="a file, or a folder that is searched as a whole")
    p.add_argument("pattern", help="regular expressions, joined by |")
    p.add_argument("before", nargs="?", type=int, default=40, help="lines of context before a match")
    p.add_argument("after", nargs="?", type=int, default=40, help="lines of context after a match")
    p.add_argument("--budget", type=int, default=0, metavar="N", help="tokens that the result may have")
    p.add_argument("--boundary", choices=("auto", "fn", "none"), default="auto", help="fn: whole enclosing functions or classes")
    p.add_argument("--recursive", "-r", action="store_true", help="search the folder of the file")
    p.add_argument("--objective", choices=("auto", "single", "def+caller", "def+test"), default="auto", help="kinds of chunks that get room first")
    p.add_argument("--no-dedupe", action="store_true", help="keep near duplicates")
    p.add_argument("--no-semantic", action="store_true", help="no recall beyond the patterns")
    p.add_argument("--json", action="store_true", help="JSON, not the report")
    p.add_argument("--version", action="version", version=f"spanrank {VERSION}")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spanrank").getOrCreate()
    try:
        result = focused_read(spark, args.path, args.pattern, before=args.before, after=args.after, budget=args.budget, boundary=args.boundary, recursive=args.recursive, dedupe=not args.no_dedupe, objective=args.objective, semantic=not args.no_semantic)
    except ValueError as e:
        print(f"spanrank: {e}", file=sys.stderr)
        return 2
    print(result.to_json(indent=2) if args.json else result.render())
    return 0 if result.chunks else 1


def focused_read_tool(path: str, pattern: str, before: int = 40, after: int = 40, budget: int = 800, boundary: str = "auto", recursive: bool = False, objective: str = "auto", spark: SparkSession | None = None) -> str:
    """The report as a tool for agents: like the command line, with a budget of 800 by default."""
    try:
        return focused_read(spark or SparkSession.builder.getOrCreate(), path, pattern, before=before, after=after, budget=budget, boundary=boundary, recursive=recursive, objective=objective).render()
    except ValueError as e:
        return f"error: {e}"


def serve() -> None:
    """The tool over the Model Context Protocol's standard streams, where the ``mcp`` package is installed."""
    try:
        from mcp.server.fastmcp import FastMCP
    except ImportError as e:
        raise SystemExit("the mcp package is not installed") from e
    server = FastMCP("spanrank")
    server.tool()(focused_read_tool)
    server.run()
