"""Command line: `python -m tabbyline ingest|index|search|stats ...`."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from tabbyline.operators import chunk, embed, search, store
from tabbyline.plans.pipeline import index_corpus, ingest_corpus
from tabbyline.session import build_session
from tabbyline.sources.corpus import read_corpus


def main() -> None:
    parser = argparse.ArgumentParser(prog="tabbyline")
    parser.add_argument("--master", default="local[*]")
    tasks = parser.add_subparsers(dest="task", required=True)
    ingest = tasks.add_parser("ingest", help="fetched pages (Parquet) to a corpus with its report")
    ingest.add_argument("pages")
    ingest.add_argument("output")
    ingest.add_argument("--source", required=True)
    ingest.add_argument("--prefix", required=True)
    ingest.add_argument("--test", action="store_true", help="five pages only")
    index = tasks.add_parser("index", help="a corpus to a collection of points")
    index.add_argument("corpus")
    index.add_argument("collection")
    index.add_argument("--dim", type=int, default=384)
    ask = tasks.add_parser("search", help="the chunks most similar to a question")
    ask.add_argument("collection")
    ask.add_argument("question")
    ask.add_argument("--dim", type=int, default=384)
    ask.add_argument("-k", type=int, default=5)
    stats = tasks.add_parser("stats", help="chunk statistics of a corpus")
    stats.add_argument("corpus")
    given = parser.parse_args()

    spark = build_session(given.master)
    if given.task == "ingest":
        pages = spark.read.parquet(given.pages)
        print(json.dumps(ingest_corpus({given.source: (pages, given.prefix)}, given.output, test=given.test)))
    elif given.task == "index":
        began = time.time()
        counts = index_corpus(read_corpus(spark, given.corpus), given.collection, dim=given.dim)
        print(json.dumps({**counts, "seconds": round(time.time() - began, 1)}))
    elif given.task == "search":
        vector = embed.hash_model(given.dim)()([given.question])[0]
        found = search.search(store.Collection(spark, given.collection).points(), vector.tolist(), given.k)
        search.hits(found).show(truncate=100)
    else:
        documents = read_corpus(spark, given.corpus)
        chunk.chunk_stats(chunk.chunk_documents(documents), documents).select(*(F.round(c, 2).alias(c) for c in ("chunks", "documents", "token_min", "token_max", "token_mean", "chunks_per_document"))).show()


if __name__ == "__main__":
    main()
