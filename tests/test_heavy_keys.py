from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.operators import heavy_keys
from inkwell.sources.tables import entries, page_rows, site_of

WORDS = ["the"] * 400 + ["of"] * 12 + [None] * 60 + [f"w{i}" for i in range(130)] + ["The"] * 3


def heap(spark, words, parts=7):
    return spark.createDataFrame([(w, i % 50, str(i)) for i, w in enumerate(words)], "word string, doc_id bigint, n_rows string").repartition(parts)


@pytest.mark.parametrize("chunks,fan_in", [(1, 2), (7, 2), (40, 3), (200, 16)])
def test_tree_equals_plain_counts(spark, rows, chunks, fan_in):
    got = heavy_keys.word_rows(heap(spark, WORDS), chunks, fan_in)
    assert rows(got) == sorted(Counter(WORDS).items(), key=repr)


def test_heavy_words_count_nulls_and_repeats_in_the_total(spark, rows):
    total = len(WORDS)
    want = sorted((w, n) for w, n in Counter(w for w in WORDS if w).items() if n * 50 >= total)
    assert rows(heavy_keys.heavy_words(heap(spark, WORDS), 7)) == want
    exact = ["a"] * 1 + ["b"] * 49
    assert rows(heavy_keys.heavy_words(heap(spark, exact), 3), "word") == [("a",), ("b",)]


def test_empty_and_checks(spark, rows):
    none = heap(spark, WORDS).limit(0)
    assert rows(heavy_keys.heavy_words(none, 4)) == []
    assert rows(heavy_keys.word_statistics(none, spark.createDataFrame([], "word string, doc_id bigint, occurrence int"), 4)) == []
    with pytest.raises(ValueError):
        heavy_keys.heavy_words(none, 4, share=0)
    with pytest.raises(ValueError):
        heavy_keys.word_rows(none, 4, fan_in=1)


def test_statistics(spark, rows):
    e = spark.createDataFrame([("the", 1, 5), ("the", 2, 7), ("other", 1, 1)], "word string, doc_id bigint, occurrence int")
    got = {r.word: (r.n_rows, r.n_pages, r.occurrences) for r in heavy_keys.word_statistics(heap(spark, WORDS), e, 5).collect()}
    pages = {}
    for i, w in enumerate(WORDS):
        pages.setdefault(w, set()).add(i % 50)
    assert got["the"] == (400, len(pages["the"]), 12)
    assert got["of"] == (12, len(pages["of"]), None)
    assert None not in got and "other" not in got


def test_clashing_columns(spark):
    df = heap(spark, ["a", "b", "a"]).withColumn("__node", F.lit(3))
    got = heavy_keys.tree_aggregate(df, ["word"], {"n": F.count(F.lit(1))}, {"n": "sum"}, 9, 2)
    assert {r.word: r.n for r in got.collect()} == {"a": 2, "b": 1}


def test_entries_keep_the_latest_valid_load(spark, rows):
    d = spark.createDataFrame(
        [(" The", 1, 3, 5), ("the", 1, 4, 9), ("the", 1, 0, 99), ("the", 1, None, 98), ("the", 1, 4, 9), (None, 1, 1, 1), ("  ", 1, 1, 1), ("a", 2, 1, None),
         ("a", 2, 6, 1), ("b", None, 1, 1)], "word string, doc_id bigint, occurrence int, loaded_at int")
    assert rows(entries(d)) == [("a", 2, 6), ("the", 1, 4)]


def test_sites(spark):
    urls = {" HTTP://WWW.A.example:80/x?y ": "a.example", "www.b.test/z": "b.test", "c.test#f": "c.test", "": None, None: None, "https://": None, "http://www.d.example?q=1": "d.example"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", site_of(F.col("u")).alias("s")).collect()
    assert {r.u: r.s for r in got} == urls


def test_page_rows_take_the_latest(spark, rows):
    p = spark.createDataFrame([(1, "http://a.test", 3, 1), (1, "http://b.test", None, 2), (2, None, 5, None), (None, "http://c.test", 1, 1)],
                              "doc_id bigint, url string, word_number int, fetched_at int")
    assert rows(page_rows(p), "doc_id", "site", "word_number") == [(1, "b.test", None), (2, None, 5)]
