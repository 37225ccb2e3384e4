"""``python -m vexmark.cli ingest|query|search ...``; run it with spark-submit on a cluster."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .files import Files
from .ingest import ingest, search_text
from .plans.collection import Collection
from .sources.lines import lookup, read_lines, write_text
from .sources.rawvec import read_query
from .types import EMBEDDING_DIMENSION


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vexmark", description="Similarity search on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="a raw embedding file and a text file into a collection")
    i.add_argument("-e", "--embeddings", required=True)
    i.add_argument("-t", "--texts", required=True)
    i.add_argument("-i", "--ids", help="taken for compatibility; ids are line numbers")
    i.add_argument("-o", "--out", default="collection_output")
    i.add_argument("-d", "--dimensions", type=int, default=EMBEDDING_DIMENSION)
    q = sub.add_parser("query", help="the lines nearest to a vector in a file")
    q.add_argument("-f", "--file", required=True)
    q.add_argument("-c", "--collection", default="wiki_collection")
    q.add_argument("-t", "--texts", default="wikitext.txt")
    q.add_argument("-k", type=int, default=10)
    q.add_argument("-o", "--out", default="output.txt")
    s = sub.add_parser("search", help="the lines nearest to a text")
    s.add_argument("text", nargs="+")
    s.add_argument("-c", "--collection", default="owt_collection")
    s.add_argument("-t", "--texts", default="openwebtext.txt")
    s.add_argument("-m", "--model", help="an ONNX sentence model; words are hashed without one")
    s.add_argument("--tokenizer", help="the model's tokenizer file")
    s.add_argument("-k", type=int, default=10)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, also if the command ran into an error and said so; 1 for a wrong call."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.appName("vexmark").getOrCreate()
    try:
        if args.command == "ingest":
            report = ingest(spark, args.embeddings, args.texts, args.out, args.dimensions)
            print(f"{report.timing.rows} vectors, {report.timing.per_second} a second", report.message)
            return 0
        collection = Collection.load(spark, args.collection)
        lines = read_lines(spark, args.texts) if Files(spark).exists(args.texts) else None
        if args.command == "query":
            hits = lookup(collection.search(read_query(spark, args.file, collection.dimension), args.k), lines)
            write_text(hits, args.out, "rank")
        else:
            embedder = None
            if args.model:
                from .embed import OnnxEmbedder

                embedder = OnnxEmbedder(args.model, args.tokenizer)
            hits = search_text(spark, collection, " ".join(args.text), lines, args.k, embedder)
        for r in hits.orderBy("rank").collect():
            print(f"{r['rank']}. [{r['score']:.4f}] {r['text']}")
    except EngineError as e:
        print(e)
    return 0


if __name__ == "__main__":
    sys.exit(main())
