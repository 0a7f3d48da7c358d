"""Command line: build an index, rank the link graph, search.

    python -m inkwell.cli build CORPUS INDEX_FOLDER
    python -m inkwell.cli rank CORPUS RANK_FOLDER
    python -m inkwell.cli search INDEX_FOLDER            (queries from standard input)

On a cluster, by ``spark-submit``: master, memory, shuffle partitions and
``spark.checkpoint.dir`` (the folder that all executors share) are the submit's.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from inkwell.operators import index, links, rank, search, snippets
from inkwell.session import session
from inkwell.sources import trec
from inkwell.storage import materialize


def build(spark, corpus: str, folder: str) -> None:
    index.save(materialize(trec.read_corpus(spark, corpus), "corpus"), folder)


def rank_corpus(spark, corpus: str, folder: str, normalized: bool = False) -> int:
    """Write the rank of every document, a line each; returns the number of iterations."""
    docs = materialize(trec.read_corpus(spark, corpus), "corpus")
    n = docs.where("url <> ''").select("url").distinct().count()
    found = rank.fixpoint(docs.select("doc_id"), links.edges(docs.select("doc_id", F.col("body").alias("text")), docs.where("url <> ''")), max(1, n), normalized=normalized)
    trec.write_ranks(found.ranks, folder)
    return found.iterations


def answer(spark, opened: index.Index, query: str, mode: str) -> str:
    """The printed result of one query."""
    words = search.check(query, mode)
    asked = spark.createDataFrame([(0, query, mode)], "query_id int, query string, mode string")
    narrow = replace(opened, lexicon=opened.lexicon.where(F.col("term").isin(words) if words else F.lit(False)))
    state = search.states(narrow, asked).first().state
    if state == search.NOTHING:
        return "No result"
    if state == search.INCOMPLETE:
        return "Not every word is in the index; ask again with d"
    best = snippets.with_snippets(search.search(opened, query, mode), opened.docs, words).collect()
    if not best:
        return "No result"
    return "\n\n".join(f"URL: {r.url}\nBM25 Score: {r.score}\nSnippet:\n{r.snippet or ''}" for r in best)


def loop(spark, folder: str, lines=sys.stdin, out=print) -> None:
    """A query line, then a mode line: c for all words, d for any; asked again until it is one of them."""
    opened = index.load(spark, folder)
    lines = iter(lines)
    for query in lines:
        mode = next(lines, "d").strip().lower()
        while mode not in search.MODES:
            out("c (all words) or d (any word)?")
            mode = next(lines, "d").strip().lower()
        try:
            out(answer(spark, opened, query.strip(), mode))
        except ValueError as problem:
            out(str(problem))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("build", "rank"):
        s = sub.add_parser(name)
        s.add_argument("corpus")
        s.add_argument("folder")
    sub.add_parser("search").add_argument("folder")
    given = p.parse_args(argv)
    spark = session(f"inkwell {given.what}")
    spark.sparkContext.setLogLevel("ERROR")
    if given.what == "build":
        build(spark, given.corpus, given.folder)
    elif given.what == "rank":
        print(f"{rank_corpus(spark, given.corpus, given.folder)} iterations")
    else:
        loop(spark, given.folder)


if __name__ == "__main__":
    main()
