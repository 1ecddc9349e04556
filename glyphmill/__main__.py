"""Command line: build an index from a corpus, and search it.

    python -m glyphmill build corpus.json -o index [--config file] [--stopwords file] [--no-initials] [-q]
    python -m glyphmill search index "words" [-n 20]

A corpus is a JSON array (.json), JSON lines (.jsonl) or Parquet (anything else, with a doc_id column or not).
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from glyphmill.config import IndexConfig
from glyphmill.operators.index import SearchIndex, build_index
from glyphmill.sources import corpus, stopwords


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command")
    build = commands.add_parser("build", help="build an index")
    build.add_argument("corpus")
    build.add_argument("-o", "--output", default="index")
    build.add_argument("--config", help="JSON configuration")
    build.add_argument("--stopwords", help="file of stopwords, one a line; an empty file for none")
    build.add_argument("--no-initials", action="store_true", help="no search by initial consonants, whatever the configuration says")
    build.add_argument("-q", "--quiet", action="store_true")
    search = commands.add_parser("search", help="search an index")
    search.add_argument("index")
    search.add_argument("query")
    search.add_argument("-n", "--max-results", type=int, default=0)
    return p


def read_corpus(spark: SparkSession, path: str, config: IndexConfig):
    texts = list(dict.fromkeys(("title", config.url_field, *config.indexed_fields)))
    if path.endswith((".jsonl", ".ndjson")):
        return corpus.from_json_lines(spark, path, texts, list(config.metadata_fields))
    if path.endswith(".json"):
        return corpus.from_json_array(spark, path, texts, list(config.metadata_fields))
    table = spark.read.parquet(path)
    return table if "doc_id" in table.columns else corpus.with_doc_id(table)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(args)
    if not options.command:
        parser().print_help()
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if options.command == "search":
        for row in SearchIndex.load(spark, options.index).search(options.query, options.max_results).toLocalIterator():
            print(f"{row['rank']}\t{row['hits']}\t{row['title']}\t{row['url']}")
        return 0
    config = IndexConfig.from_json(Path(options.config).read_text()) if options.config else IndexConfig()
    words = stopwords.read_file(spark, options.stopwords) if options.stopwords else stopwords.DEFAULT_STOPWORDS
    config = replace(config, stopwords=words or None, **({"initials_max_len": 0} if options.no_initials else {})).checked()
    index = build_index(read_corpus(spark, options.corpus, config), config)
    index.save(options.output)
    if not options.quiet:
        print(f"{options.output}: {index.document_count} documents, {SearchIndex.load(spark, options.output).postings.count()} postings")
    return 0


if __name__ == "__main__":
    sys.exit(main())
