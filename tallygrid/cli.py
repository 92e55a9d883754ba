"""python -m tallygrid.cli search|index|analyze|serve|codecs|scan: searches, indexes, the service and figures from the shell."""

from __future__ import annotations

import argparse
import csv
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from . import metrics
from .config import Config, OnlineConfig
from .plans.engine import build_index, build_queries, search
from .sources.generate import geometric, uniform
from .sources.index import load_index, save_index
from .sources.rows import read_rows
from .streaming.online import serve_configured


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tallygrid")
    todo = parser.add_subparsers(dest="do", required=True)
    one = todo.add_parser("search", help="print qid, id, count and rank")
    one.add_argument("-t", "--table", required=True)
    one.add_argument("-q", "--queries", required=True)
    one.add_argument("-k", type=int)
    one.add_argument("-n", "--num-of-queries", type=int)
    one.add_argument("-r", "--query-range", type=int)
    one.add_argument("-c", "--config", help="JSON or key = value; the options above go before it")
    one.add_argument("-m", "--metrics", help="a CSV file for the search's figures")
    two = todo.add_parser("index", help="make an index of a text table")
    two.add_argument("-i", "--input", required=True)
    two.add_argument("-o", "--output", required=True)
    two.add_argument("-c", "--codec", help="print the sizes of its lists under this codec")
    three = todo.add_parser("analyze", help="print the posting lists of an index")
    three.add_argument("-i", "--input", required=True)
    three.add_argument("-c", "--codec")
    four = todo.add_parser("serve", help="answer query documents that appear in a folder")
    four.add_argument("-c", "--config", required=True, help="the service's settings, JSON")
    four.add_argument("-s", "--source", required=True)
    four.add_argument("-o", "--output", required=True)
    four.add_argument("--checkpoint", required=True)
    four.add_argument("--once", action="store_true", help="end when all that is there is answered")
    five = todo.add_parser("codecs", help="print each codec's size and speed on made lists")
    five.add_argument("-n", type=int, default=10_000)
    five.add_argument("--uniform", action="store_true")
    todo.add_parser("scan", help="print the speed of prefix sums")
    return parser


def _print(rows: list[dict], columns: list[str]) -> None:
    out = csv.DictWriter(sys.stdout, columns)
    out.writeheader()
    out.writerows(rows)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.do == "scan":
        _print(metrics.scan_figures(), metrics.SCAN_COLUMNS)
        return 0
    spark = spark or SparkSession.builder.appName("tallygrid").getOrCreate()
    if args.do == "search":
        config = Config.from_file(args.config) if args.config else Config()
        given = {k: v for k in ("k", "num_of_queries", "query_range") if (v := getattr(args, k)) is not None}
        config = replace(config, **given).validate()
        for r in search(spark, args.table, args.queries, config).orderBy("qid", "rnk").toLocalIterator():
            print(r["qid"], r["id"], r["cnt"], r["rnk"], sep=",")
        if args.metrics:
            points, preds = build_index(read_rows(spark, args.table)), build_queries(read_rows(spark, args.queries, config.num_of_queries), config)
            metrics.write_csv([metrics.search_figures(points, preds, config)], metrics.SEARCH_COLUMNS, args.metrics)
    elif args.do == "index":
        save_index(build_index(read_rows(spark, args.input)), args.output)
        if args.codec:
            for r in metrics.codec_sizes(load_index(spark, args.output), [args.codec]).collect():  # a row for the codec
                print(*r, sep=",")
    elif args.do == "analyze":
        for r in metrics.analyze(load_index(spark, args.input), args.codec).orderBy("dim", "value").toLocalIterator():
            print(*r, sep=",")
    elif args.do == "serve":
        serve_configured(spark, OnlineConfig.from_file(args.config), args.source, args.output, args.checkpoint, once=args.once).awaitTermination()
    else:
        made = (uniform if args.uniform else geometric)(spark, args.n)
        values = sorted(r["value"] for r in made.select("value").collect())  # as many as were asked for
        _print(metrics.codec_figures(values), metrics.CODEC_COLUMNS)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
