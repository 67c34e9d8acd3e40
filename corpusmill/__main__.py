"""python -m corpusmill scrape|dump|serve PAGES ...: over a Parquet table of pages (url, html)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from corpusmill.operators import dom
from corpusmill.plans import spider as S, tools
from corpusmill.sources import sinks


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusmill")
    commands = p.add_subparsers(dest="command", required=True)
    scrape = commands.add_parser("scrape", help="write what a selector matches on each page")
    scrape.add_argument("pages"), scrape.add_argument("selector"), scrape.add_argument("out")
    scrape.add_argument("--attr"), scrape.add_argument("--format", choices=("jsonl", "json"), default="jsonl")
    dump = commands.add_parser("dump", help="print the stored html of a url, or its Markdown")
    dump.add_argument("pages"), dump.add_argument("url"), dump.add_argument("--markdown", action="store_true")
    serve = commands.add_parser("serve", help="answer JSON-RPC messages, a line each")
    serve.add_argument("pages")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("corpusmill").getOrCreate()
    pages = spark.read.parquet(a.pages).select("url", "html")
    if a.command == "scrape":
        found = pages.select("url", F.explode(S.scrape(F.col("html"), a.selector, a.attr)).alias("text"))
        items = S.as_items(found.select(F.to_json(F.struct("text")).alias("value"), F.col("url").alias("source_url")), "scrape")
        sinks.ItemOutput(a.out, a.format).open().write(items)
    elif a.command == "dump":
        row = pages.filter(F.col("url") == a.url).select((dom.html_to_markdown(F.col("html")) if a.markdown else F.col("html")).alias("x")).first()
        if row is None:
            print(f"no page of {a.url}", file=sys.stderr)
            return 1
        print(row.x)
    else:
        for line in sys.stdin:
            answer = tools.handle(pages, line)
            if answer is not None:
                print(answer, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
