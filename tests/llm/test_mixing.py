import pytest

from inkwell.llm import mixing

T = "source string, target_share double, max_repeats int"


def sized(spark, **sources):
    rows, i = [], 0
    for s, lengths in sources.items():
        for n in lengths:
            rows.append((i, {"none": None, "b": " B "}.get(s, s), n))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_shares_are_met_and_repeats_are_capped(spark):
    docs = sized(spark, a=[7 + i % 50 for i in range(900)], b=[20 + i % 9 for i in range(60)], none=[5] * 30, other=[9] * 10)
    goals = spark.createDataFrame([("A ", 0.7, 1), ("b", 0.3, 8), ("missing", 0.0, 2)], T)
    mixed = mixing.mixture(docs, goals)
    got = {r.source: r for r in mixing.shares(mixed, docs, goals).collect()}
    assert got["a"].share == pytest.approx(0.7, abs=0.005) and got["b"].share == pytest.approx(0.3, abs=0.005)
    assert got["missing"].tokens == 0 and "other" not in got
    assert got["a"].most_copies == 1 and got["b"].most_copies <= 8
    assert mixed.count() == mixed.select("doc_id").distinct().count()


def test_a_given_total_leaves_scarce_sources_short(spark):
    docs = sized(spark, a=[10] * 1000, b=[10] * 3)
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], T)
    got = {r.source: r for r in mixing.shares(mixing.mixture(docs, goals, 10_000), docs, goals).collect()}
    assert got["a"].tokens == 5000 and got["b"].tokens == 120 and got["b"].most_copies == 4


def test_the_size_reached_is_told(spark):
    docs = sized(spark, a=[10] * 100, b=[10], none=[10] * 99)
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], T)
    got = mixing.shares(mixing.mixture(docs, goals), docs, goals).collect()
    assert {(r.source, r.tokens, r.share, r.size) for r in got} == {("a", 40, 0.5, 0.04), ("b", 40, 0.5, 0.04)}


def test_the_same_sample_again_and_other_seeds(spark, rows):
    docs = sized(spark, a=[10 + i % 3 for i in range(500)])
    goals = spark.createDataFrame([("a", 1.0, 1)], T)
    one = rows(mixing.mixture(docs, goals, 2000))
    assert one == rows(mixing.mixture(docs.repartition(7), goals, 2000))
    assert one != rows(mixing.mixture(docs, goals, 2000, seed=1))


def test_buckets_make_no_gap(spark, monkeypatch):
    docs = sized(spark, a=[1 + i % 13 for i in range(3000)])
    goals = spark.createDataFrame([("a", 1.0, 3)], T)
    for size in (20, 500, 10**6):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", size)
        total = mixing.mixture(docs, goals, 9000).selectExpr("sum(n_tokens * copies) AS t").first().t
        assert total == pytest.approx(9000, abs=13)


def seen(spark, docs, goals, total, seeds, **how):
    """How often each document was in samples of several seeds, and the sizes of these."""
    n, sizes = {}, set()
    for seed in range(seeds):
        got = mixing.mixture(docs, goals, total, seed=seed, **how).collect()
        sizes.add(len(got))
        for r in got:
            n[r.doc_id] = n.get(r.doc_id, 0) + 1
    return n, sizes


def test_even_inclusion(spark):
    docs = sized(spark, a=[10] * 400)
    goals = spark.createDataFrame([("a", 1.0, 1)], T)
    n, sizes = seen(spark, docs, goals, 2000, 6, power=0)
    assert sizes == {200} and max(n.values()) <= 6 and len(n) > 380


def test_inclusion_follows_the_tokens(spark):
    lengths = [20] * 300 + [40] * 300 + [80] * 300
    docs = sized(spark, a=lengths)
    goals = spark.createDataFrame([("a", 1.0, 1)], T)
    n, sizes = seen(spark, docs, goals, 8400, 8)
    c, size = mixing.inclusion([(300, 6000, 6000, 120_000), (300, 12_000, 12_000, 480_000), (300, 24_000, 24_000, 1_920_000)], 8400)
    assert sizes == {size} and size == round(c * 42_000)
    for k, t in enumerate((20, 40, 80)):
        often = sum(n.get(i, 0) for i in range(300 * k, 300 * k + 300)) / (300 * 8)
        assert often == pytest.approx(c * t, abs=0.05)


def test_certain_documents_come_first(spark):
    docs = sized(spark, a=[1000] * 3 + [10] * 500)
    goals = spark.createDataFrame([("a", 1.0, 1)], T)
    n, sizes = seen(spark, docs, goals, 5000, 3)
    assert all(n[i] == 3 for i in range(3)) and sizes == {203}
    c, size = mixing.inclusion([(3, 3000, 3000, 3_000_000), (500, 5000, 5000, 50_000)], 5000)
    assert (c, size) == (pytest.approx(0.04), 203)


def test_rests_below_a_document(spark):
    docs = sized(spark, a=[900 + i for i in range(60)] + [35], b=[10] * 2000)
    goals = spark.createDataFrame([("a", 0.002, 1), ("b", 0.998, 1)], T)
    got = {r.source: r.tokens for r in mixing.shares(mixing.mixture(docs, goals, 18_000), docs, goals).collect()}
    assert got["a"] == 35 and got["b"] == pytest.approx(17_964, abs=10)


def test_edges(spark, rows):
    goals = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1)], T)
    assert rows(mixing.mixture(sized(spark, none=[1]), goals)) == []
    assert rows(mixing.mixture(sized(spark, a=[0, 0]), goals)) == []
    assert rows(mixing.mixture(sized(spark, a=[5]), goals.limit(0))) == []
    assert [r.share for r in mixing.shares(mixing.mixture(sized(spark, none=[1]), goals), sized(spark, none=[1]), goals).collect()] == [0.0]
