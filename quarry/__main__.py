"""``python -m quarry``: the engine on the command line (section 2.11)."""

from __future__ import annotations

import argparse
import sys

from quarry.functions.render import render
from quarry.operators.catalog import KINDS
from quarry.plans.engine import Engine, IndexOptions, SearchOptions, summary_line


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description="Index folders and search them by meaning.")
    top.add_argument("--index", required=True, help="folder of the index, shared by all executors")
    commands = top.add_subparsers(dest="command", required=True)
    for name, asks in (("search", "query"), ("similar", "file")):
        own = commands.add_parser(name)
        own.add_argument(asks)
        own.add_argument("path", nargs="?", help="only below this folder")
        own.add_argument("-n", "--limit", type=int, default=10)
        own.add_argument("-k", "--kind", choices=KINDS)
        own.add_argument("-a", "--all", action="store_true", help="several results of a file, and also unlikely ones")
        form = own.add_mutually_exclusive_group()
        form.add_argument("-l", "--paths", dest="form", action="store_const", const="paths", help="paths only")
        form.add_argument("--json", dest="form", action="store_const", const="json")
        own.set_defaults(form="text")
    own = commands.add_parser("index")
    own.add_argument("path")
    own.add_argument("--rebuild", action="store_true")
    for kind in ("images", "audio", "video"):
        own.add_argument(f"--no-{kind}", dest=f"include_{kind}", action="store_false")
    own = commands.add_parser("status")
    own.add_argument("path", nargs="?")
    commands.add_parser("forget").add_argument("path")
    return top


def main(arguments: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    given = parser().parse_args(arguments)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quarry").getOrCreate()
    engine = Engine(spark, given.index)
    if given.command in ("search", "similar"):
        options = SearchOptions(limit=given.limit, kind=given.kind, one_result_per_file=not given.all, relevance_cutoff=not given.all)
        found = engine.search(given.query, given.path, options) if given.command == "search" else engine.similar(given.file, given.path, options)
        shown = render(found, given.form, given.path, colours=out.isatty(), links=out.isatty())
        print(shown, end="", file=out)
        return 0 if shown else 1
    if given.command == "index":
        options = IndexOptions(include_images=given.include_images, include_audio=given.include_audio, include_video=given.include_video)
        print(summary_line(engine.index(given.path, options, given.rebuild)), file=out)
    elif given.command == "status":
        print(engine.status(given.path), end="", file=out)
    else:
        print(f"{engine.forget(given.path)} files forgotten", file=out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
