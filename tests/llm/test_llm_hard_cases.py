"""Every operator with nulls in every column, empty tables, repeated rows, very long texts and columns of clashing names."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkwell.llm import encoding, mixing, packing, site_lines, spam, splitting, term_stats, term_weight, tokens
from inkwell.sources.tables import entries, page_rows

CLASH = ["n", "x", "rank", "site", "k1", "part", "lines", "name", "gain", "lost", "share", "block", "degree", "marks", "salt", "capacity", "q", "u", "bucket",
         "whole", "tokens", "text2", "row", "n_pages", "score", "twin", "skeleton", "doc_no", "spam", "lang2"]

LINES = "doc_id bigint, line_no int, line string"
PAGES = "doc_id bigint, url string, word_number int, fetched_at timestamp"
HEAP = "run_no int, word string, doc_id bigint, positions string, spilled_at timestamp"
LISTS = "word string, doc_id bigint, occurrence int, loaded_at timestamp"
DOCS = "doc_id bigint, text string, source string"
MIX = "source string, target_share double, max_repeats int"

SENTENCE = "The bridge was moved to the river in the night, and nobody had seen it."


def frames(spark):
    lines = [(d, n, x) for d in range(6) for n, x in enumerate(["Menu of the site", SENTENCE, "für Gäste"], 1)] + [(0, 4, "fÃ¼r GÃ¤ste"), (1, 5, None), (2, 6, ""), (None, 1, "x"), (3, None, "x")]
    pages = [(d, f"http://a.example/{d}", 10, None) for d in range(6)] + [(None, None, None, None), (9, None, None, None)]
    heap = [(1, "a", 0, "0,2", None), (1, "b", 0, "1", None), (1, None, 0, "3", None), (1, "c", None, "3", None), (1, "d", 0, None, None)]
    lists = [("a", 0, 2, None), ("b", 0, 1, None), (None, 0, 1, None), ("c", None, 1, None), ("d", 0, None, None), ("a", 1, 1, None)]
    docs = [(0, SENTENCE * 3, "s"), (1, None, "s"), (2, "", None), (3, SENTENCE, None), (None, SENTENCE, "s")]
    mix = [("s", 1.0, 2), (None, None, None), ("t", None, 1), ("u", 0.5, None)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {"lines": make(lines, LINES), "pages": make(pages, PAGES), "heap": make(heap, HEAP), "lists": make(lists, LISTS), "docs": make(docs, DOCS), "mix": make(mix, MIX)}


def sized(t):
    return t["docs"].withColumn("n_tokens", F.length("text").cast("bigint"))


OPERATORS = {
    "garbled": lambda t: encoding.garbled_lines(t["lines"]).select("doc_id", "line_no", "restored"),
    "repeated": lambda t: site_lines.repeated_lines(t["lines"], page_rows(t["pages"])),
    "scores": lambda t: term_weight.term_scores(entries(t["lists"]), term_weight.run_positions(t["heap"]), page_rows(t["pages"])),
    "marked": lambda t: term_stats.marked_terms(entries(t["lists"])),
    "spam": lambda t: spam.spam_pages(t["lines"]),
    "furniture": lambda t: spam.furniture(t["lines"]),
    "main": lambda t: spam.main_texts(t["lines"]),
    "packed": lambda t: packing.pack(sized(t), [("a", 7), ("b", 100)]),
    "fill": lambda t: packing.fill(packing.pack(sized(t), [("a", 7), ("b", 100)]), [("a", 7), ("b", 100)]),
    "mixture": lambda t: mixing.mixture(sized(t), t["mix"]),
    "shares": lambda t: mixing.shares(mixing.mixture(sized(t), t["mix"]), sized(t), t["mix"]),
    "pieces": lambda t: splitting.split_documents(t["docs"], [("a", 12, 2)]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_tables(spark, rows, name):
    if name == "pieces" and not Path(tokens.RANKS).exists():
        pytest.skip("no vocabulary files here")
    t, run = frames(spark), OPERATORS[name]
    plain = rows(run(t))
    clashing = {k: df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns}) for k, df in t.items()}
    assert rows(run(clashing)) == plain
    empty = rows(run({k: df.limit(0) for k, df in t.items()}))
    assert empty == []
    nulls = {k: df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]) for k, df in t.items()}
    run(nulls).collect()
    twice = rows(run({k: df.unionByName(df) if k in ("lines", "pages", "heap", "lists") else df for k, df in t.items()}))
    assert twice == plain or name == "garbled"


def test_very_long_texts(spark):
    long = " ".join(f"The bridge b{i} was moved to the river r{i} in the night, and nobody n{i} had seen it{i}." for i in range(20_000))
    lines = spark.createDataFrame([(1, 1, long), (1, 2, "All rights reserved."), (2, 1, "kettle buy " * 100_000)], LINES)
    assert [tuple(r) for r in spam.furniture(lines).collect()] == [(1, 2)]
    assert [r.doc_id for r in spam.spam_pages(lines).collect()] == [2]
    if Path(tokens.RANKS).exists():
        docs = spark.createDataFrame([(1, long, "s"), (2, "x" * 300_000, "s")], DOCS)
        got = splitting.split_documents(docs, [("a", 500, 50)]).groupBy("doc_id").agg(F.max("n_tokens").alias("most"), F.min("n_tokens").alias("least")).collect()
        assert {r.doc_id for r in got} == {1, 2} and max(r.most for r in got) <= 500
        assert {r.doc_id: r.n_tokens for r in tokens.sizes(docs).collect()}[1] > 100_000
