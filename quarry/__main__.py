"""Command line: crawl, index a folder of pages, search the index, show its facts and its pages by authority, evaluate a ranking."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quarry.operators import crawl, evaluate, ranking
from quarry.plans.engine import Engine
from quarry.plans.session import cut
from quarry.sources import corpus


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in {"index": ["folder", "path"], "search": ["path", "query"], "stats": ["path"], "compare": ["path", "query"], "evaluate": ["path", "judgments"], "pagerank": ["path"], "crawl": ["path", "seed"]}.items():
        command = commands.add_parser(name)
        for w in words:
            command.add_argument(w)
    commands.choices["search"].add_argument("--limit", type=int, default=10)
    commands.choices["search"].add_argument("--method", choices=ranking.METHODS, default="bm25")
    commands.choices["evaluate"].add_argument("--sweep", action="store_true")
    commands.choices["pagerank"].add_argument("--limit", type=int, default=50)
    commands.choices["crawl"].add_argument("--pages", type=int, default=25)
    commands.choices["crawl"].add_argument("--other-hosts", action="store_true")
    commands.choices["crawl"].add_argument("--fresh", action="store_true", help="drop what earlier crawls stored")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    if args.command == "index":
        corpus.save_index(corpus.read_corpus(spark, args.folder), args.path)
        return
    if args.command == "crawl":
        stored = None if args.fresh else corpus.stored_pages(spark, f"{args.path}/pages")
        found = cut(crawl.crawled(spark, corpus.fetched(), [args.seed], args.pages, not args.other_hosts, stored=stored))
        corpus.append_pages(found.select("url", "filename", "digest", "seq", "html"), f"{args.path}/pages", args.fresh)
        corpus.append_manifest(found, args.path, args.fresh)
        found.select("seq", "url", "filename").orderBy("seq").show(args.pages, truncate=False)
        return
    index = corpus.load_index(spark, args.path)
    if args.command == "compare":
        ranking.compare(index, ranking.query_terms(spark, {"q": args.query})).show(truncate=False)
        return
    engine = Engine(index)
    if args.command == "search":
        print(engine.search_json(args.query, args.limit, args.method).first().response)
    elif args.command == "pagerank":
        engine.pages().select("authority", "id", "url").show(args.limit, truncate=False)
    elif args.command == "stats":
        print(engine.stats_json().first().response)
        for table in (engine.stats(), engine.suggestions(), engine.pages()):
            table.show(truncate=False)
    else:
        judged, skipped = evaluate.matched(corpus.judgments(spark, args.judgments), index.documents)
        terms = ranking.terms_of(judged.selectExpr("query_id", "query_id as query").distinct())
        if args.sweep:
            evaluate.sweep(index, terms, engine.authority, judged).show(42, truncate=False)
        else:
            evaluate.evaluate(ranking.blend(ranking.relevance(engine.index, terms), engine.authority), judged).show()
        skipped.show(truncate=False)


if __name__ == "__main__":
    main()
