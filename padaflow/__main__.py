"""Command line: extract, build-index, lookup, serve."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from padaflow.operators import export
from padaflow.plans.engine import Engine
from padaflow.server import serve
from padaflow.service import Service
from padaflow.sources.text import read_lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="padaflow")
    sub = parser.add_subparsers(dest="command", required=True)
    ex = sub.add_parser("extract", help="annotate a text file, one document per line; - reads standard input")
    ex.add_argument("input")
    ex.add_argument("-o", "--output", help="folder to write; standard output without it")
    ex.add_argument("-f", "--format", default="jsonl", choices=sorted(export.FORMATS))
    ex.add_argument("--fuzzy", action="store_true")
    build = sub.add_parser("build-index", help="compile the lexicon")
    build.add_argument("--collisions", action="store_true")
    look = sub.add_parser("lookup", help="find lexicon entries by name")
    look.add_argument("query")
    web = sub.add_parser("serve", help="answer HTTP requests")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    for p in (ex, build, look, web):
        p.add_argument("-l", "--lexicons", nargs="*", default=None)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("padaflow").getOrCreate()
    engine = Engine.load(spark, args.lexicons, fuzzy=getattr(args, "fuzzy", False))
    if args.command == "build-index":
        print(f"{len(engine.local.lexicon.entries)} entries, version {engine.version}")
        for key, ids in engine.local.lexicon.collisions() if args.collisions else []:
            print(f"{key}: {', '.join(ids)}")
    elif args.command == "serve":
        serve(Service.from_env(engine), args.host, args.port).serve_forever()
    elif args.command == "lookup":
        for e in engine.lookup(args.query):
            print(e.id, e.label, e.canonical, sep="\t")
    else:
        docs = spark.createDataFrame([(line.rstrip("\n"),) for line in sys.stdin], "text string") if args.input == "-" else read_lines(spark, args.input).select("text")
        found = engine.annotate(docs)
        if args.output:
            export.write(found, args.output, args.format)
        else:
            shape = {"jsonl": export.json_lines, "conll": export.conll, "tasks": export.tasks}[export.FORMATS[args.format]]
            for row in shape(found).toLocalIterator():
                print(row.value)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
