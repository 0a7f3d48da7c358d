import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text, varbyte


def docs(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, body string")


def test_tokens_split_on_separators_only(spark):
    got = docs(spark, 'a-b_c/d "e" (f)?g', "x@y a=b\tc", "l1\r\nl2\rl3", "", None, " ..,, ").select(text.document_tokens(F.col("body")).alias("t")).collect()
    assert [r.t for r in got] == [list("abcdefg"), ["x@y", "a=b\tc"], ["l1", "l2", "l3"], [], [], []]


def test_long_tokens_keep_their_position(spark):
    from inkwell.operators import index

    body = "one " + "x" * 30 + " " + "Y" * 31 + " Two"
    d = docs(spark, body)
    assert sorted((r.term, r.pos) for r in index.kept_tokens(d).collect()) == [("one", 0), ("two", 3), ("x" * 30, 1)]
    assert index.doc_lengths(d).first().doc_len == 4


def test_query_words(spark):
    q = docs(spark, "  Foo, bar  foo, ", "", None).select(text.query_words(F.col("body")).alias("w")).collect()
    assert [r.w for r in q] == [["foo,", "bar", "foo,"], [], []]


def test_plain_decimals(spark):
    x = [0.0, 1e-7, 1.5, 100.0, 1e21, float("inf"), float("-inf")]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(text.plain_decimal("v").alias("s")).collect()
    assert [r.s for r in got] == ["0", "0.0000001", "1.5", "100", "1" + "0" * 21, "Infinity", "-Infinity"]


EDGES = [(0, 1), (1, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2097151, 3), (2097152, 4), (268435455, 4), (2**31 - 1, 5)]


def test_varbyte_sizes(spark):
    got = spark.createDataFrame([(n,) for n, _ in EDGES], "n bigint").select("n", varbyte.size(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == dict(EDGES)
    for n, size in EDGES:
        assert len(varbyte.encode([n])) == size
    with pytest.raises(Exception, match="negative"):
        spark.sql("SELECT -1 AS n").select(varbyte.size(F.col("n"))).collect()
    with pytest.raises(ValueError):
        varbyte.encode([-1])
    with pytest.raises(ValueError):
        varbyte.decode(b"\x80")


@given(st.lists(st.integers(0, 2**40)))
@settings(deadline=None)
def test_varbyte_round_trip(values):
    assert varbyte.decode(varbyte.encode(values)).tolist() == values


def test_gaps_round_trip_in_spark(spark):
    a = [[3, 7, 7, 200], [5], [], None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(a)], "i int, a array<bigint>").orderBy("i")
    got = d.select(varbyte.gaps(F.col("a")).alias("g"), varbyte.restore(varbyte.decode_array(varbyte.encode_array(varbyte.gaps(F.col("a"))))).alias("r")).collect()
    assert got[0].g == [3, 4, 0, 193]
    assert [r.r for r in got[:3]] == a[:3]
    shifted = d.limit(1).select(varbyte.restore(varbyte.gaps(F.col("a"), F.lit(2)), F.lit(2)).alias("r")).first()
    assert shifted.r == a[0]
    assert spark.sql("SELECT X'8101' AS b").select(varbyte.byte_string(F.col("b")).alias("s")).first().s == "10000001 00000001"
