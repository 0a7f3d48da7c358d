import json

from inkwell import cli
from inkwell.operators import index
from inkwell.streaming import requests

CORPUS = "".join(
    f"<DOC>\n<DOCNO>D{i}</DOCNO>\n<TEXT>\nhttp://h.example/{i}\n{body}\n</TEXT>\n</DOC>\n"
    for i, body in enumerate(["the red cat\nsee http://h.example/1", "the blue dog", "a red dog\nhttp://h.example/1 http://h.example/0"]))


def test_programs(spark, tmp_path):
    (tmp_path / "c.txt").write_text(CORPUS)
    cli.build(spark, str(tmp_path / "c.txt"), str(tmp_path / "i"))
    said = []
    cli.loop(spark, str(tmp_path / "i"), ["red dog\n", "x\n", "C\n", "nothere\n", "d\n", "red nothere", "c", "a b c d e f g h i j k\n", "d\n"], said.append)
    assert "c (all words)" in said[0]
    assert said[1].startswith("URL: http://h.example/2\nBM25 Score: ") and said[1].endswith("Snippet:\na red dog")
    assert said[2] == "No result" and said[3].startswith("Not every word") and "at most 10" in said[4]
    cli.rank_corpus(spark, str(tmp_path / "c.txt"), str(tmp_path / "r"))
    ranks = [float(x.value) for x in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(ranks) == 3 and ranks[1] == max(ranks)


def test_requests_as_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([(0, "the red cat"), (1, "the dog")], "doc_id bigint, body string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"query_id": 5, "query": "red cat", "mode": "c"}) + "\n")
    stream = spark.readStream.schema(requests.REQUEST).json(str(tmp_path / "in"))
    requests.answer_stream(stream, index.build(docs), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in got] == [(5, 1, 0)]
