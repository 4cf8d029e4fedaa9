"""python -m millrace --root DIR [--query SQL | --query-file FILE]: run statements, or read them line by line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from millrace.outcomes import Outcome
from millrace.session import Engine, Session


def show(outcome: Outcome, rows: int) -> None:
    if outcome.rows is not None:
        outcome.rows.show(rows, truncate=False)
    print(outcome.envelope(), flush=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("--root", required=True)
    parser.add_argument("--mode", default="ansi", choices=("ansi", "strict", "compat"))
    parser.add_argument("--user", default="admin")
    parser.add_argument("--role", default="ADMIN")
    parser.add_argument("--rows", type=int, default=50)
    parser.add_argument("--query")
    parser.add_argument("--query-file")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    engine = Engine(spark, args.root, args.mode, Session(args.user, args.role.upper()))
    if args.query or args.query_file:
        script = args.query or open(args.query_file).read()  # noqa: SIM115
        outcome = engine.run(script)
        show(outcome, args.rows)
        return 0 if outcome.ok else 1
    held = ""
    for line in sys.stdin:
        if line.strip().lower() in ("exit", "quit"):
            break
        held += line
        if ";" in line:
            show(engine.run(held), args.rows)
            held = ""
    return 0


if __name__ == "__main__":
    sys.exit(main())
