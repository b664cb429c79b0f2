"""Command line: ``python -m helixframe.cli index|align [options] files``, ``compare``, ``sam``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import DEFAULT_K, Settings
from .plans import jobs

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("assemble", "index", "align"):
        c = sub.add_parser(name)
        c.add_argument("-k", type=int, default=DEFAULT_K)
        c.add_argument("-p", dest="work_path", default=".")
        c.add_argument("-d", "--depth", dest="search_depth", type=int, default=5000)
        c.add_argument("--visits", dest="max_visits", type=int, default=1000)
        c.add_argument("-c", dest="abundance_min", type=int)
        c.add_argument("-nBB", dest="branch_and_bound", action="store_false")
        c.add_argument("-nMM", dest="markov_filter", action="store_false")
        c.add_argument("-nMEM", dest="mem_seeds", action="store_false")
        c.add_argument("-o", dest="outputs", action="append", default=[], help="output of the file at the same place")
        c.add_argument("files", nargs="+")
    c = sub.add_parser("compare")
    c.add_argument("files", nargs=3)
    c = sub.add_parser("sam")
    c.add_argument("files", nargs=3, help="sam genome reads")
    c.add_argument("--ops", default="MIDS")
    c.add_argument("-A", dest="alternatives", action="store_true")
    return p


def settings_of(args: argparse.Namespace) -> Settings:
    names = ("command", "k", "work_path", "search_depth", "max_visits", "abundance_min", "branch_and_bound", "markov_filter", "mem_seeds")
    outputs = [*args.outputs, *[None] * len(args.files)]
    return Settings(inputs=list(zip(args.files, outputs)), **{n: getattr(args, n) for n in names})


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    if args.command == "compare":
        jobs.compare(spark, *args.files).show(truncate=False)
    elif args.command == "sam":
        jobs.sam_to_alignment(spark, *args.files, args.ops, args.alternatives).show()
    else:
        settings = settings_of(args)
        if args.command in ("assemble", "index"):
            jobs.index(spark, settings)
        if args.command in ("assemble", "align"):
            jobs.align(spark, settings)


if __name__ == "__main__":
    main()
