"""Many queries at once: the same rows as by joining queries with postings, without an index and without those rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.operators import batch, index, search
from inkwell.plans import reference

WORDS = ["the", "of", "und", "die", "haus", "żółw", "дом", "rare", "x"]
ODD = ["İstanbul İ “The” the's", "ΟΔΟΣ ΑΣ'Β ὈΔΌΣ", "ŻÓŁW żółw Żółw—the", "a" * 30 + " " + "a" * 31 + " the", None, "", "  ?! ", "the\r\nThe\tthe THE", "Kelvin kelvin", "Ż" * 30 + " the", "İ" * 16 + " of",
       "ДОМ дом,дом", "die‘die’die–die_die", "x", "x", "x"]
ASKED = ["the", "the of", "the the of", "of the the", "die die die", "żółw the", "ŻÓŁW", "дом die", "i̇stanbul the", "İSTANBUL", "οδος", "ας β", "kelvin x", "a" * 30, "a" * 31 + " the", "ż" * 30, "i̇" * 16, "nowhere", "nowhere the", "",
         "the of und die haus rare x", "x", "rare haus"]


def docs_of(spark, bodies, parts=3):
    return spark.createDataFrame([(i * 7, b) for i, b in enumerate(bodies)], "doc_id bigint, body string").repartition(parts)


def queries_of(spark, asked=ASKED):
    rows = [(2 * i + j, q, m) for i, q in enumerate(asked) for j, m in enumerate(("c", " D "))]
    return spark.createDataFrame(rows, "query_id int, query string, mode string")


def made(seed, n):
    at = random.Random(seed)
    return [" ".join(at.choices(WORDS, [60, 40, 20, 20, 6, 3, 3, 1, 1], k=at.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("bodies,k", [(ODD, 10), (ODD + made(1, 300), 10), (made(2, 400), 3), (made(3, 20) * 30, 10), ([], 10), ([None, ""], 10)])
def test_best_equals_joined_postings(spark, rows, bodies, k):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        docs, queries = docs_of(spark, bodies), queries_of(spark)
        got, want = batch.best(docs, queries, k), search.top(search.scores(index.build(docs), queries), k)
        assert got.dtypes == want.dtypes
        assert rows(got) == rows(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents_without_id_count_but_are_not_found(spark, rows):
    docs = docs_of(spark, made(4, 60)).withColumn("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")))
    queries = queries_of(spark)
    assert rows(batch.best(docs, queries)) == rows(search.top(search.scores(index.build(docs), queries)))


def test_queries_that_are_errors(spark):
    docs = docs_of(spark, ["the"])
    for bad in (("a b c d e f g h i j k", "d"), ("the", "x"), ("the", None)):
        with pytest.raises(Exception, match="a query has at most|unknown mode"):
            batch.best(docs, spark.createDataFrame([(1, *bad)], "query_id int, query string, mode string")).collect()


def test_batch_query_stores_no_index(spark, tmp_path, monkeypatch):
    """At 1 GB the index, made for this query alone, took longer than the query may and more than four times the input's disk."""
    docs = docs_of(spark, made(5, 300)).select(F.col("doc_id"), F.col("body").alias("text"), F.lit("u").alias("url"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(index, "save", lambda *a: pytest.fail("an index is stored"))
    monkeypatch.setattr(search, "scores", lambda *a: pytest.fail("a row is made per query, word and document"))
    assert reference.batch_search_top10(spark, str(tmp_path)).count()


def pairs(bodies, words, monkeypatch, segment):
    monkeypatch.setattr(batch, "SEGMENT", segment)
    table = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(bodies)), pa.int64()), "body": pa.array(bodies, pa.string())})
    return [s.to_pylist()[0] for s in batch._segments(iter([table.slice(0, 33), table.slice(33)]), words)]


def test_segments_are_bounded_and_hold_everything(monkeypatch):
    bodies, words = made(6, 200), sorted(WORDS)
    monkeypatch.setattr(batch, "BYTES", 500)
    got = pairs(bodies, words, monkeypatch, 40)
    assert max(s["n_docs"] for s in got) <= 40 and sum(s["n_docs"] for s in got) == 200
    assert sum(s["total_len"] for s in got) == sum(len(b.split()) for b in bodies)
    tf = {}
    for s in got:
        ids, docs, tfs = np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["docs"], "<i4"), np.frombuffer(s["tfs"], "<i4")
        for d, t, n in zip(ids[docs], np.repeat(s["terms"], s["counts"]), tfs):
            tf[int(d), words[t]] = int(n)
    assert tf == {(d, w): b.split().count(w) for d, b in enumerate(bodies) for w in set(b.split())}


def test_hot_words_are_not_looked_at_in_all_documents(monkeypatch):
    """Three words that nearly all documents have: fewer documents are looked at than half of the rows that joining makes."""
    at = random.Random(7)
    words = ["a", "b", "c"]
    bodies = [" ".join(at.choices([*words, "y", "z"], k=at.randint(1, 300))) for _ in range(5000)] + ["y"] * 6000
    row, = pairs(bodies, words, monkeypatch, 1 << 16)
    dfs = np.array([sum(w in b.split() for b in bodies) for w in words], float)
    p = batch._Postings(row, dfs, len(bodies), sum(len(b.split()) for b in bodies) / len(bodies))
    looked = []
    score = batch._score
    monkeypatch.setattr(batch, "_score", lambda p, terms, whole, docs: looked.append(len(docs)) or score(p, terms, whole, docs))
    terms = [(*p.of[i], 1) for i in range(3)]
    for whole in (True, False):
        looked.clear()
        scores, ids = batch._answer(p, terms, whole, 10, None)
        docs, every = score(p, terms, whole, np.arange(len(bodies)))
        order = np.lexsort((docs, -batch._rounded(every)))[:10]
        assert ids.tolist() == docs[order].tolist() and scores.tolist() == batch._rounded(every)[order].tolist()
        assert sum(looked) < 0.5 * dfs.sum()
