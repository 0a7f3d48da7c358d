"""Queries on a few keys that hold most records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.operators import heavy_keys
from inkwell.sources.tables import entries, load


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    heap = load(spark, folder, "heap_line")
    return heavy_keys.heavy_words(heap, heavy_keys.scan_chunks(heap)).select("word")


def p2_word_statistics(spark: SparkSession, folder: str) -> DataFrame:
    heap = load(spark, folder, "heap_line")
    return heavy_keys.word_statistics(heap, entries(load(spark, folder, "list_pointer")), heavy_keys.scan_chunks(heap))


ENTRIES_SQL = """
  SELECT lower(trim(word)) AS word, doc_id,
         max(struct_pack(l := loaded_at, o := occurrence)).o AS occurrence
  FROM list_pointer
  WHERE trim(word) <> '' AND doc_id IS NOT NULL AND occurrence > 0
  GROUP BY 1, 2"""

QUERIES = {"p2_found": p2_found, "p2_word_statistics": p2_word_statistics}

SQL = {
    "p2_found": """
SELECT word FROM heap_line WHERE word IS NOT NULL GROUP BY word
HAVING count(*) * 50 >= (SELECT count(*) FROM heap_line)""",
    "p2_word_statistics": f"""
WITH e AS ({ENTRIES_SQL}),
     s AS (SELECT word, CAST(sum(occurrence) AS BIGINT) AS occurrences FROM e GROUP BY word),
     h AS (SELECT word, count(*) AS n_rows, count(DISTINCT doc_id) AS n_pages
           FROM heap_line WHERE word IS NOT NULL GROUP BY word)
SELECT h.word, n_rows, n_pages, occurrences FROM h LEFT JOIN s ON h.word = s.word""",
}
