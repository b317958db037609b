"""python -m vellum.cli version|init|generate|check|doctor|backfill|rebuild|merge|drop --root DIR --definition FILE [--source TABLE.parquet] [--acknowledge | --dry-run]

A definition file holds the arguments of define_index as JSON. Commands that change an index need --acknowledge; --dry-run says what they would do.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import __version__
from .definition import IndexDefinition, define_index, table
from .engine import SearchEngine
from .errors import SearchError

_CHANGES = ("backfill", "rebuild", "merge", "drop")
TEMPLATE = {"name": "products", "source": {"name": "products", "key": "id"}, "searchable": {"title": 5}, "filterable": {"status": "text"}}


def load(path: str) -> IndexDefinition:
    with open(path) as f:
        given = json.load(f)
    if given.get("source"):
        given["source"] = table(**given["source"])
    return define_index(given.pop("name"), **given)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellum", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("version", "init", "generate", "check", "doctor", *_CHANGES))
    for name in ("root", "definition", "source"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--acknowledge", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    got = parser.parse_args(args)
    if got.command == "version":
        print(__version__)
        return 0
    if got.command == "init":
        print(json.dumps(TEMPLATE, indent=2))
        return 0
    if not got.root or not got.definition:
        parser.error("--root and --definition are needed")
    if got.command in _CHANGES and not (got.acknowledge or got.dry_run):
        print(f"{got.command} changes the index: add --acknowledge, or --dry-run to look first", file=sys.stderr)
        return 2
    try:
        spark = spark or SparkSession.builder.getOrCreate()
        handle = SearchEngine(spark, got.root).index(load(got.definition))
        if got.command == "generate" or got.dry_run:
            print("\n".join([f"drop {handle.stored.id}"] if got.command == "drop" else handle.plan()))
            return 0
        source = spark.read.parquet(got.source) if got.source else None
        if got.command in ("check", "doctor"):
            findings = handle.doctor()
            print(json.dumps(findings, indent=2) if got.command == "doctor" else "ok" if not findings else "not ok")
            return int(any(f["severity"] == "error" for f in findings))
        if got.command == "backfill":
            print(handle.create(source))
        elif got.command == "rebuild":
            handle.rebuild(source)
        elif got.command == "merge":
            print(json.dumps(handle.compact()))
        else:
            handle.drop()
        return 0
    except SearchError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
