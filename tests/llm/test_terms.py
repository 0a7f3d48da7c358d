import math
from collections import defaultdict

import pytest

from inkwell.llm import term_stats, term_weight


def entries(spark, data):
    return spark.createDataFrame(data, "word string, doc_id bigint, occurrence int")


def test_marks(spark, rows):
    data = [("all", d, 2) for d in range(8)] + [("half", d, 1) for d in range(3)] + [("one", 1, 5), ("two", 1, 1), ("two", 2, 1)]
    got = {r.word: (r.n_pages, r.occurrences, r.marks) for r in term_stats.marked_terms(entries(spark, data)).collect()}
    assert got == {"all": (8, 16, ["common"]), "half": (3, 3, ["common"]), "one": (1, 5, ["rare"]), "two": (2, 2, ["rare"])}
    both = term_stats.marked_terms(entries(spark, [("x", 1, 1)])).first()
    assert both.marks == ["rare", "common"]
    exact = term_stats.marked_terms(entries(spark, [("q", 0, 1)] + [(f"w{d}", d, 1) for d in range(4)])).where("word = 'q'").first()
    assert exact.marks == ["rare"]  # a quarter of the pages is not more than a quarter
    assert rows(term_stats.marked_terms(entries(spark, []))) == []


def brute_degrees(tokens, window):
    near = defaultdict(set)
    for d, w, p in tokens:
        for e, v, q in tokens:
            if d == e and p != q and abs(p - q) < window and v != w:
                near[d, w].add(v)
    return {k: len(v) for k, v in near.items()}


@pytest.mark.parametrize("block", [4, 7, 1024])
@pytest.mark.parametrize("window", [2, 4])
def test_degrees_for_any_block(spark, block, window):
    text = ("a b c a d e f a b g h a i j k l b c d a a b z" + " q") .split()
    tokens = [(d, w, p * (1 + d)) for d in (0, 1, 2) for p, w in enumerate(text[d:])]
    df = spark.createDataFrame(tokens + tokens[:3], "doc_id bigint, word string, pos int")
    got = {(r.doc_id, r.word): r.degree for r in term_weight.degrees(df, window, block).collect()}
    assert got == brute_degrees(tokens, window)


def test_degrees_where_spills_disagree(spark):
    tokens = [(1, f"{w}{p}", p) for p in range(9) for w in "abcde"[: 1 + p % 5]] + [(2, f"w{i}", 3) for i in range(20)] + [(2, "end", 6), (2, "far", 7)]
    df = spark.createDataFrame(tokens, "doc_id bigint, word string, pos int")
    for block in (4, 1024):
        got = {(r.doc_id, r.word): r.degree for r in term_weight.degrees(df, 4, block).collect()}
        assert got == brute_degrees(tokens, 4)


def test_run_positions(spark, rows):
    df = spark.createDataFrame([(" A ", 1, "0,3"), ("a", 1, "0,3"), (None, 1, "1"), ("", 1, "1"), ("b", None, "1"), ("c", 2, None), ("d", 2, "x,4,")],
                               "word string, doc_id bigint, positions string")
    assert rows(term_weight.run_positions(df)) == [(1, "a", 0), (1, "a", 0), (1, "a", 3), (1, "a", 3), (2, "d", 4)]


def test_scores(spark):
    e = entries(spark, [("a", 1, 2), ("b", 1, 1), ("a", 2, 1), ("solo", 3, 1)])
    pos = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2), (2, "a", 0)], "doc_id bigint, word string, pos int")
    pages = spark.createDataFrame([(1, 3), (2, None), (3, 0)], "doc_id bigint, word_number int")
    got = {(r.doc_id, r.word): r for r in term_weight.term_scores(e, pos, pages).collect()}
    assert got[1, "a"].score == pytest.approx(math.log(4 / 2), abs=1e-6)
    assert got[1, "b"].score == pytest.approx(math.log(4 / 1), abs=1e-6)
    assert got[2, "a"].degree == 0 and got[2, "a"].score == 0 and got[2, "a"].share is None
    assert got[3, "solo"].share is None


def test_found_is_exact_at_the_border(spark, rows):
    s = spark.createDataFrame([(1, "in", 3, 30, 2, 0.0), (1, "out", 2, 30, 2, 0.0), (1, "few", 3, 30, 1, 0.0), (1, "many", 3, 30, 7, 0.0), (1, "null", 3, None, 2, 0.0)],
                              "doc_id bigint, word string, occurrence int, word_number int, n_pages bigint, score double")
    assert rows(term_weight.characteristic(s)) == [(1, "in")]
