"""Command for spark-submit: load delimited text, or analyse it first.

    spark-submit tableload/__main__.py load   --csv PATH --table NAME [options]
    spark-submit tableload/__main__.py analyze --csv PATH [options]
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tableload import (  # noqa: E402
    Dialect,
    advise,
    apply_schema,
    load_csv,
    parse_transform,
    present,
    profile,
    structure_report,
)
from tableload.operators.schema import schema_rows  # noqa: E402
from tableload.plans.load import prepare  # noqa: E402


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tableload", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("load", "analyze"):
        sub = commands.add_parser(name)
        sub.add_argument("--csv", required=True, nargs="+", help="files, folders or globs")
        sub.add_argument("--delimiter", default=",")
        sub.add_argument("--quote", default='"')
        sub.add_argument("--no-header", action="store_true")
        sub.add_argument("--multiline", action="store_true")
        sub.add_argument("--include", help="comma-separated columns to keep")
        sub.add_argument("--exclude", help="comma-separated columns to leave out")
        sub.add_argument("--schema", help="file with a JSON schema")
        sub.add_argument("--sample-rows", type=int, help="infer from a random sample of about this many rows")
    load = commands.choices["load"]
    load.add_argument("--table", required=True)
    load.add_argument("--mode", choices=("append", "overwrite"), default="append")
    load.add_argument("--keep-schema", action="store_true", help="overwrite rows only")
    load.add_argument("--partition", action="append", default=[], help="e.g. month(ts)")
    load.add_argument("--history", help="table that records loads")
    load.add_argument("--dry-run", action="store_true")
    return parser


def _input_options(args: argparse.Namespace) -> dict:
    return {
        "dialect": Dialect(args.delimiter, args.quote, not args.no_header, args.multiline),
        "schema": Path(args.schema).read_text(encoding="utf-8") if args.schema else None,
        "sample_rows": args.sample_rows,
        "include": args.include,
        "exclude": args.exclude,
    }


def run(spark: SparkSession, argv: list[str]) -> int:
    """Run one command; 0 on success."""
    args = _parser().parse_args(argv)
    options = _input_options(args)
    if args.command == "load":
        result = load_csv(
            spark,
            args.csv,
            args.table,
            mode=args.mode,
            replace_schema=not args.keep_schema,
            transforms=[parse_transform(t) for t in args.partition],
            dry_run=args.dry_run,
            history_table=args.history,
            **options,
        )
        shown = {k: v for k, v in vars(result).items() if k != "log"}
        print(json.dumps(shown, indent=2, default=str))
        return 0 if result.success else 1
    structure_report(spark, args.csv, args.delimiter, args.quote).show(vertical=True)
    text, schema, _ = prepare(spark, args.csv, **options)
    schema_rows(spark, schema).show(len(schema), truncate=False)
    present(advise(profile(apply_schema(text, schema)))).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("tableload").getOrCreate(), sys.argv[1:]))
