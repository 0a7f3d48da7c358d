"""The search engine's operators with nulls, empty tables, repeats, long texts and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from inkwell import storage
from inkwell.operators import heavy_keys, index, links, search, snippets
from inkwell.sources import trec
from inkwell.sources.tables import entries

CLASH = ["term", "df", "tf", "pos", "token", "rank", "score", "n", "nth", "gap", "at", "segment", "query_id", "times", "found", "raw", "snippet", "src", "dst", "text", "word"]
DOCS = "doc_id bigint, doc_no string, url string, body string"
ROWS = [(0, "N0", "http://a.example/0", "The cat\nsees http://a.example/1"), (1, None, None, "the dog"), (2, "N2", "http://a.example/1", None), (3, None, None, "")]

OPERATORS = {
    "postings": index.postings,
    "page_table": index.page_table,
    "block_metadata": lambda d: index.block_metadata(index.postings(d)),
    "blocks": lambda d: index.blocks(index.postings(d)).drop("docid_bytes", "freq_bytes", "position_bytes"),
    "list_file": lambda d: index.list_file(index.blocks(index.postings(d))).drop("bytes"),
    "opened": lambda d: index.open_lists(index.list_file(b := index.blocks(index.postings(d))), index.lexicon_offsets(index.stored_metadata(b))),
    "next_geq": lambda d: index.next_geq(index.blocks(index.postings(d)), index.postings(d).select("term", (F.col("doc_id") + 1).alias("target"))),
    "states": lambda d: search.states(index.build(d), d.select(F.col("doc_id").alias("query_id"), F.col("body").alias("query"), F.lit("c").alias("mode"))),
    "offsets": lambda d: index.lexicon_offsets(index.block_metadata(index.postings(d))),
    "search": lambda d: search.search(index.build(d), "the cat", "d"),
    "snippets": lambda d: snippets.with_snippets(search.search(index.build(d), "the cat", "d"), d, ["the", "cat"]),
    "edges": lambda d: links.edges(d.select("doc_id", F.col("body").alias("text")), d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_tables(spark, rows, name):
    docs, run = spark.createDataFrame(ROWS, DOCS), OPERATORS[name]
    plain = rows(run(docs))
    assert rows(run(docs.withColumns({c: F.lit("clash") for c in CLASH}))) == plain
    assert plain and rows(run(docs.limit(0))) == []


def test_long_body(spark):
    docs = spark.createDataFrame([(0, "N", "u", "word other " * 150_000)], DOCS)
    assert index.postings(docs).agg(F.max("tf")).first()[0] == 150_000
    assert index.block_metadata(index.postings(docs)).count() == 2


def test_heavy_keys_with_nulls_everywhere(spark, rows):
    heap = spark.createDataFrame([(None, None, None), ("a", None, "x"), ("a", 1, None), ("a", 1, "y")], "word string, doc_id bigint, n string")
    lists = spark.createDataFrame([(None, None, None, None), ("a", 1, 3, None)], "word string, doc_id bigint, occurrence int, loaded_at int")
    assert rows(heavy_keys.word_statistics(heap, entries(lists), 3)) == [("a", 3, 1, 3)]
    assert rows(heavy_keys.heavy_words(heap, 3, share=1.0)) == []


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_tables_can_be_discarded(spark):
    kept = storage.materialize(spark.range(3))
    assert kept.count() == 3
    storage.discard(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._inkwell_path)


@pytest.mark.parametrize("files", [{}, {"a.txt": ""}, {"a.txt": "<TEXT>\nu\n"}, {"a.txt": "\n\n"}])
def test_corpora_without_sections(spark, tmp_path, files):
    (tmp_path / "b.txt").write_text("no marker")
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    assert trec.read_corpus(spark, str(tmp_path)).collect() == []
    assert trec.section_offsets(trec.lines(spark, str(tmp_path))).collect() == []


def test_sections_over_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"<DOC>\n<DOCNO>D{i}{k}</DOCNO>\n<TEXT>\nu{i}{k}\nbody {k}\n</TEXT>\n</DOC>\n" for k in range(4 - i)))
    got = [(r.doc_id, r.doc_no, r.url, r.body) for r in trec.read_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(n, f"D{i}{k}", f"u{i}{k}", f"body {k}") for n, (i, k) in enumerate((i, k) for i in range(3) for k in range(4 - i))]
