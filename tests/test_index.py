import math

import pytest

from inkwell.functions import varbyte
from inkwell.operators import index, links, rank, search, snippets
from inkwell.plans import reference
from inkwell.sources import trec


def corpus(spark, *bodies):
    return spark.createDataFrame([(i, f"N{i}", f"http://h.example/{i}", b) for i, b in enumerate(bodies)], "doc_id bigint, doc_no string, url string, body string")


def test_postings_and_lexicon(spark, rows):
    d = corpus(spark, "a b a", "b\nc", "", None)
    p = index.postings(d)
    assert rows(p) == [("a", 0, 2, [0, 2]), ("b", 0, 1, [1]), ("b", 1, 1, [0]), ("c", 1, 1, [1])]
    assert rows(index.lexicon(p)) == [("a", 1), ("b", 2), ("c", 1)]
    stats = index.corpus_stats(index.page_table(d)).first()
    assert (stats.n_docs, stats.total_len, stats.avg_len) == (4, 5, 1.25)
    empty = index.corpus_stats(index.page_table(d.limit(0))).first()
    assert (empty.n_docs, empty.total_len, empty.avg_len) == (0, 0, None)


@pytest.mark.parametrize("df", [127, 128, 129, 256, 257])
def test_blocks(spark, df):
    d = spark.createDataFrame([(i * 3, "hot " * (1 + i % 3)) for i in range(df)], "doc_id bigint, body string")
    b = index.blocks(index.postings(d)).orderBy("block_no").collect()
    assert [r.n for r in b] == [128] * (df // 128) + ([df % 128] if df % 128 else [])
    assert [i for r in b for i in r.doc_ids] == [i * 3 for i in range(df)]
    m = index.block_metadata(index.postings(d)).orderBy("block_no").collect()
    assert [(r.n, r.last_doc_id, r.docid_bytes, r.freq_bytes, r.pos_bytes) for r in m] == [
        (r.n, r.last_doc_id, len(r.docid_bytes), len(r.freq_bytes), len(r.position_bytes)) for r in b]


def test_segments_of_a_hot_term_agree_with_one(spark, rows):
    d = spark.createDataFrame([(i * 7, "hot cold") for i in range(60)], "doc_id bigint, body string")
    p = index.postings(d)
    cols = ("term", "doc_id", "nth", "gap")
    assert rows(index.ordered_postings(p, 10), *cols) == rows(index.ordered_postings(p), *cols)


def test_lexicon_offsets_are_contiguous(spark):
    d = corpus(spark, "a b c d", "b c d", "zz b")
    o = index.lexicon_offsets(index.block_metadata(index.postings(d))).orderBy("term").collect()
    assert o[0].start == 0 and o[0].pos_start == 0
    assert all(x.end == y.start and x.pos_end == y.pos_start for x, y in zip(o, o[1:]))


def test_next_geq(spark, rows):
    d = spark.createDataFrame([(i * 2, "t") for i in range(300)], "doc_id bigint, body string")
    want = spark.createDataFrame([("t", 0), ("t", 255), ("t", 598), ("t", 599), ("no", 1)], "term string, target bigint")
    assert rows(index.next_geq(index.blocks(index.postings(d)), want)) == [("no", 1, None), ("t", 0, 0), ("t", 255, 256), ("t", 598, 598), ("t", 599, None)]


@pytest.mark.parametrize("segment", [4, 100, 1 << 16])
def test_next_geq_in_segments(spark, segment):
    ids = [(i * i) % 997 for i in range(400)]
    d = spark.createDataFrame([(i, "t u" if i % 3 else "t") for i in sorted(set(ids))], "doc_id bigint, body string")
    b = index.blocks(index.postings(d), 8)
    want = spark.createDataFrame([(w, t) for w in ("t", "u", "v") for t in range(0, 1010, 7)], "term string, target bigint")
    have = {"t": set(ids), "u": {i for i in ids if i % 3}, "v": set()}
    for r in index.next_geq(b, want, segment).collect():
        assert r.doc_id == min((i for i in have[r.term] if i >= r.target), default=None)


def test_byte_layout(spark, monkeypatch):
    monkeypatch.setattr(index, "STRETCH", 2)
    d = spark.createDataFrame([(i * 3, "hot " * (1 + i % 3) + ("cold" if i % 50 == 0 else "")) for i in range(700)], "doc_id bigint, body string")
    stored = index.blocks(index.postings(d))
    lexicon = index.lexicon_offsets(index.stored_metadata(stored))
    file = index.list_file(stored)
    # the bytes in order, by the plain layout
    want = b""
    for term, ids in (("cold", [i * 3 for i in range(0, 700, 50)]), ("hot", [i * 3 for i in range(700)])):
        tf = {i * 3: 1 + i % 3 for i in range(700)} if term == "hot" else dict.fromkeys(ids, 1)
        parts = [ids[i : i + 128] for i in range(0, len(ids), 128)]
        gaps = [varbyte.encode([b - a for a, b in zip([([0] + ids)[128 * k], *x], x)]) for k, x in enumerate(parts)]
        freqs = [varbyte.encode([tf[i] for i in x]) for x in parts]
        for numbers in ([x[-1] for x in parts], map(len, gaps), map(len, freqs)):
            want += b"".join(n.to_bytes(4, "big") for n in numbers)
        want += b"".join(g + f for g, f in zip(gaps, freqs))
    extents = file.orderBy("at").collect()
    assert b"".join(bytes(r.bytes) for r in extents) == want
    assert [r.at for r in extents] == [sum(len(x.bytes) for x in extents[:k]) for k in range(len(extents))]
    opened = index.open_lists(file, lexicon)
    back = index.read_blocks(file, opened.where("last_doc_id >= 1000")).orderBy("term", "block_no").collect()
    assert [i for r in back if r.term == "hot" for i in r.doc_ids][-400:] == [i * 3 for i in range(300, 700)]
    assert min(r.block_no for r in back if r.term == "hot") == 2
    assert [t for r in back if r.term == "hot" for t in r.tfs][-3:] == [1 + i % 3 for i in (697, 698, 699)]
    assert "tfs" not in index.read_blocks(file, opened, frequencies=False).columns
    positions = b"".join(bytes(r.bytes) for r in index.position_file(stored).orderBy("at").collect())
    assert len(positions) == lexicon.agg({"pos_end": "max"}).first()[0]


def brute(bodies, words, mode):
    docs = [b.lower().split() for b in bodies]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for i, d in enumerate(docs):
        if (all if mode == "c" else any)(w in d for w in words):
            s = 0.0
            for w in words:
                df, tf = sum(w in x for x in docs), d.count(w)
                s += math.log((n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (1.2 * (0.25 + 0.75 * len(d) / avg) + tf) if tf else 0
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)][:10]


BODIES = ["the cat sat", "the dog", "the cat the cat ran far away", "a bird", "cat dog bird"]


@pytest.mark.parametrize("query,mode", [("cat", "c"), ("the cat", "c"), ("the cat", "d"), ("the the dog", "d"), ("the nothere", "d"),
                                        ("the nothere", "c"), ("nothere", "d"), ("", "d"), ("cat cat", "c")])
def test_search_against_brute_force(spark, query, mode):
    got = [(r.doc_id, r.score) for r in search.search(index.build(corpus(spark, *BODIES)), query, mode).collect()]
    want = brute(BODIES, query.split(), mode) if query else []
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_term_of_most_documents_counts_negatively(spark):
    assert all(r.score < 0 for r in search.search(index.build(corpus(spark, "a", "a b", "a c", "d")), "a", "d").collect())


def test_query_checks(spark):
    i = index.build(corpus(spark, "a"))
    search.search(i, " ".join("abcdefghij"), "D")
    with pytest.raises(ValueError):
        search.search(i, " ".join("abcdefghijk"), "d")
    with pytest.raises(ValueError):
        search.search(i, "a", "x")


def test_batch_equals_single(spark):
    i = index.build(corpus(spark, *BODIES))
    q = spark.createDataFrame([(1, "the cat", "c"), (2, "Bird dog", "d"), (3, "nothere", "c")], "query_id int, query string, mode string")
    got = search.top(search.scores(i, q)).orderBy("query_id", "rank").collect()
    for k, query, mode in ((1, "the cat", "c"), (2, "bird dog", "d")):
        assert [r.doc_id for r in got if r.query_id == k] == [d for d, _ in brute(BODIES, query.split(), mode)]
    assert not [r for r in got if r.query_id == 3]


def test_states(spark):
    i = index.build(corpus(spark, *BODIES))
    asked = [(1, "the cat", "c"), (2, "the nothere", "c"), (3, "the nothere", " D"), (4, "nothere", "d"), (5, "", "c"), (6, None, "d"), (7, "cat", "x"), (8, "cat", None),
             (9, " ".join("abcdefghijk"), "c"), (10, "cat cat", "c")]
    got = {r.query_id: r.state for r in search.states(i, spark.createDataFrame(asked, "query_id int, query string, mode string")).collect()}
    assert got == {1: search.ANSWERED, 2: search.INCOMPLETE, 3: search.ANSWERED, 4: search.NOTHING, 5: search.NOTHING, 6: search.NOTHING, 7: search.NO_MODE, 8: search.NO_MODE,
                   9: search.TOO_LONG, 10: search.ANSWERED}


def snip(spark, body, *words):
    d = spark.createDataFrame([(0, body)], "doc_id bigint, body string")
    return d.select(snippets.snippet(d.body, list(words)).alias("s")).first().s


def test_snippets(spark):
    body = "First line\nsecond Harbour line\nthird\nfourth ferry\nfifth harbour"
    assert snip(spark, body, "harbour") == "second Harbour line"
    assert snip(spark, body, "harbour", "ferry") == "second Harbour line\nthird\nfourth ferry"
    assert snip(spark, body, "ferry", "ferry") == "fourth ferry"
    assert snip(spark, body, "harbour", "absent") == "fifth harbour"
    assert snip(spark, body, "absent") is None
    assert snip(spark, None, "a") is None
    assert snip(spark, "a (b) c.d", "(b)") == "a (b) c.d"
    assert snip(spark, "axd", "a.d") is None


def test_links(spark, rows):
    d = corpus(spark, "x", "y", "z")
    twice = d.unionByName(spark.createDataFrame([(9, "N", "http://h.example/0", "w")], d.schema))
    m = spark.createDataFrame([(0, "see http://h.example/1, http://h.example/1 and http://h.example/0 http://no.example"), (1, None), (2, '"http://h.example/2"')], "doc_id bigint, text string")
    # an address ends at white space or a quotation mark, so the first one includes its comma and is no document's
    assert rows(links.edges(m, twice)) == [(0, 1), (0, 9), (2, 2)]
    assert rows(links.edges(m.where("doc_id > 0"), twice)) == [(2, 2)]
    plain = spark.createDataFrame([(0, "http://h.example/1 http://h.example/0 http://h.example/1")], "doc_id bigint, text string")
    assert rows(links.edges(plain, d)) == [(0, 0), (0, 1)]


def test_addresses_without_scheme(spark, rows):
    d = spark.createDataFrame([(0, "http://h.example/"), (1, "http://h.example/a?b"), (2, "https://Other.example"), (3, "http://h.example/c")], "doc_id bigint, url string")
    texts = ["see (H.example), h.example/a?b.", "HTTPS://x https://Other.example and version 1.2.3 of a.b", "h.example:80/c", "x" * 200_000 + ". " + "a-" * 100_000, "http://H.EXAMPLE/c"]
    m = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert rows(links.edges(m, d)) == [(0, 0), (0, 1), (1, 2), (4, 3)]


def iterate(n, edges):
    r, k = {i: 1 / n for i in range(n)}, 0
    while True:
        new = {i: 0.15 / n + 0.85 * sum(r[s] for s, d in edges if d == i) for i in range(n)}
        k += 1
        if max(abs(new[i] - r[i]) for i in r) <= 1e-4:
            return new, k
        r = new


@pytest.mark.parametrize("n,edges", [(4, [(0, 1), (1, 2)]), (2, [(0, 1), (1, 0)]), (3, [(0, 0), (1, 0)]), (3, [])])
def test_rank(spark, n, edges):
    got = rank.fixpoint(spark.range(n).withColumnRenamed("id", "doc_id"), spark.createDataFrame(edges, "src bigint, dst bigint"), n)
    want, k = iterate(n, edges)
    assert got.iterations == k
    assert {r.doc_id: r["rank"] for r in got.ranks.collect()} == pytest.approx(want)


def test_rank_diverges(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (1, 1)], "src bigint, dst bigint")
    with pytest.raises(rank.Diverged):
        rank.fixpoint(spark.range(2).withColumnRenamed("id", "doc_id"), e, 2, iterations=12)
    flat = rank.fixpoint(spark.range(2).withColumnRenamed("id", "doc_id"), e, 2, normalized=True)
    assert sum(r["rank"] for r in flat.ranks.collect()) == pytest.approx(1)


def test_full_ranks_are_not_cut(spark, tmp_path):
    n = 30_000  # 1 / n is below what four decimals hold, as are all of these ranks
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('http://h.example/', id) AS url", "'text' AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    of = {i: [i // 2] + [i // 3] * (i % 5 == 0 and i > 0) for i in range(n)}
    got = {}
    for _ in range(2):  # one update is enough for the threshold
        got, before = dict.fromkeys(range(n), 0.15 / n), got or dict.fromkeys(range(n), 1 / n)
        for i, targets in of.items():
            for j in set(targets):
                got[j] += 0.85 * before[i]
        if max(abs(got[i] - before[i]) for i in got) <= 1e-4:
            break
    found = {r.doc_id: r["rank"] for r in reference.full_ranks(spark, str(tmp_path)).collect()}
    assert found == pytest.approx(got, rel=1e-12) and min(found.values()) > 0
    lines = {r.doc_id: float(r.line) for r in reference.full_rank_lines(spark, str(tmp_path)).collect()}
    assert lines == pytest.approx(got, rel=1e-12)


TREC = """junk
<DOC>
<DOCNO>D1</DOCNO>
<TEXT>
http://one.example
first line
a </TEXT> inside
<DOC>
</TEXT>
</DOC>
<DOC>
<DOCNO>D2</DOCNO>
<TEXT>
http://two.example
</TEXT>
<TEXT>
http://twob.example
again
</TEXT>
</DOC>
<DOC>
<DOCNO>D3</DOCNO>
</DOC>
<TEXT>
cut off
"""


def test_sections(spark, tmp_path, rows, monkeypatch):
    (tmp_path / "c.txt").write_bytes(TREC.replace("\n", "\r\n").encode())
    want = [(0, "D1", "http://one.example", "first line\na </TEXT> inside\n<DOC>"), (1, "D2", "http://two.example", ""), (2, "D2", "http://twob.example", "again")]
    assert rows(trec.read_corpus(spark, str(tmp_path / "c.txt"))) == want
    monkeypatch.setattr(trec, "PIECE", 4)
    assert rows(trec.read_corpus(spark, str(tmp_path / "c.txt"))) == want


def test_saved_index_gives_the_same_results(spark, tmp_path):
    d = corpus(spark, *BODIES)
    index.save(d, str(tmp_path / "i"))
    got = search.search(index.load(spark, str(tmp_path / "i")), "the cat", "d").collect()
    assert got == search.search(index.build(d), "the cat", "d").collect()
    trec.write_page_table(index.page_table(d), str(tmp_path / "pages"))
    assert [r.value for r in spark.read.text(str(tmp_path / "pages")).collect()][-4:] == ["http://h.example/4 N4 3", "", "17", "5"]
    pages = trec.read_page_table(spark, str(tmp_path / "pages")).orderBy("doc_id").collect()
    assert [tuple(r) for r in pages] == [(i, f"http://h.example/{i}", f"N{i}", len(b.split())) for i, b in enumerate(BODIES)]
    assert [tuple(r) for r in trec.read_page_totals(spark, str(tmp_path / "pages")).collect()] == [(17, 5)]
    trec.write_corpus(d, str(tmp_path / "corpus"))
    back = trec.read_corpus(spark, str(tmp_path / "corpus")).orderBy("doc_id").collect()
    assert [r.body for r in back] == BODIES


def test_section_offsets(spark, tmp_path, monkeypatch):
    (tmp_path / "c.txt").write_text(TREC)
    want, at = [], 0
    for line in TREC.splitlines():
        at += len(line) + 1
        want += [at - 1] if line == "</TEXT>" else []
    for piece in (4, 100_000):
        monkeypatch.setattr(trec, "PIECE", piece)
        assert sorted(r.end_byte for r in trec.section_offsets(trec.lines(spark, str(tmp_path / "c.txt"))).collect()) == want


def test_run_lines_round_trip(spark, rows, tmp_path):
    d = corpus(spark, "b a b", "a")
    trec.write_run_lines(index.postings(d), str(tmp_path / "runs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "runs")).collect()] == ["a 0,1", "a 1,0", "b 0,0,2"]
    v = spark.createDataFrame([("cat 3,1,5",), ("dog 4",), ("bad",), (None,), ("x y,1",)], "value string")
    assert rows(trec.parse_run_lines(v)) == [("cat", 3, [1, 5]), ("dog", 4, [])]
    p = spark.createDataFrame([("w", 10, [1, 2]), ("w", 9, [0])], "term string, doc_id bigint, positions array<int>")
    assert rows(trec.merged_lines(p), "value") == [("w 9,0 10,1,2",)]
