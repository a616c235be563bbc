"""Loads a saved catalogue:

python -m stemma.plans.cli dictionary --dump FILE --catalog FOLDER [--dry-run]
python -m stemma.plans.cli knowledge --catalog FOLDER [--mode search|scroll|window|type-window] [--type Q] [--resume] [--names-only | --edges-only] ...
python -m stemma.plans.cli enrich --catalog FOLDER --key KEY [--limit N] [--min-degree N]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from stemma.plans.load import DAILY, KnowledgeLoad, Options, enrich
from stemma.sources import lexical, remote
from stemma.sources.progress import choose_input
from stemma.sources.shared import materialize
from stemma.streaming.ingest import merge_batch


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parts = args.add_subparsers(dest="command", required=True)
    of = parts.add_parser("dictionary")
    for name in ("--dump", "--fixture", "--catalog"):
        of.add_argument(name)
    of.add_argument("--dry-run", action="store_true")
    of = parts.add_parser("knowledge")
    of.add_argument("--catalog", required=True)
    of.add_argument("--progress", help="beside the catalogue by default")
    of.add_argument("--mode", choices=("search", "scroll", "window", "type-window"), default="search")
    of.add_argument("--type")
    for name, default in (("--page-size", 400), ("--max-pages", None), ("--first", 1), ("--last", 100_000_000), ("--window", 50_000)):
        of.add_argument(name, type=int, default=default)
    for name in ("--resume", "--names-only", "--edges-only", "--skip-closure"):
        of.add_argument(name, action="store_true")
    of = parts.add_parser("enrich")
    of.add_argument("--catalog", required=True)
    of.add_argument("--key", default=os.environ.get("USAGE_KEY"))
    of.add_argument("--limit", type=int, default=DAILY)
    of.add_argument("--min-degree", type=int, default=0)
    return args


def dictionary(spark: SparkSession, got: argparse.Namespace) -> dict[str, int]:
    path = choose_input(got.dump, os.environ.get("LEXICAL_DUMP"), got.fixture)
    lines = lexical.placed(spark.read.text(path))
    if path.endswith(".gz"):  # one split: its lines are dealt out before they are parsed, and unpacked once
        lines = materialize(lines.repartition(spark.sparkContext.defaultParallelism), "dictionary_lines")
    made = lexical.counts(lines).first().asDict()
    if got.dry_run or not got.catalog:
        t = lexical.transform(lexical.parse(lines))
        return made | {"names": lexical.names(t).count(), "edges": lexical.edges(t).count()}
    merge_batch(spark, got.catalog, lines)
    return made


def main(argv: list[str] | None = None, source: remote.Remote | None = None) -> dict[str, int]:
    got = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if got.command == "dictionary":
        return dictionary(spark, got)
    if got.command == "enrich":
        if not got.key:
            raise SystemExit("the usage service wants a key")
        return {"asked": enrich(spark, got.catalog, got.key, got.limit, got.min_degree, source)}
    load = KnowledgeLoad(spark, got.catalog, got.progress, Options(got.mode, got.page_size, got.max_pages, got.first, got.last, got.window, got.type, got.resume, got.skip_closure), source)
    return ({} if got.edges_only else {"name_pages": load.names()}) | ({} if got.names_only else {"edge_pages": load.edges()})


if __name__ == "__main__":
    print(main())
