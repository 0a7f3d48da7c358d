"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import encoding, mixing, packing, site_lines, spam, splitting, term_stats, term_weight, tokens
from inkwell.plans.heavy import ENTRIES_SQL
from inkwell.sources.tables import entries, load, page_rows, spread
from inkwell.storage import materialize


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_restored(spark, folder).select("doc_id", "line_no")


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled_lines(spread(load(spark, folder, "trec_line")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_lines(load(spark, folder, "trec_line"), page_rows(load(spark, folder, "page_table")))


def p3_clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.clean_lines(load(spark, folder, "trec_line"), page_rows(load(spark, folder, "page_table")))


def _valid_entries(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(entries(load(spark, folder, "list_pointer")), "entries")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    return term_weight.term_scores(
        _valid_entries(spark, folder),
        term_weight.run_positions(load(spark, folder, "heap_line")),
        page_rows(load(spark, folder, "page_table")),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_weight.characteristic(p4_scores(spark, folder))


def p5_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    marked = term_stats.marked_terms(_valid_entries(spark, folder))
    return marked.selectExpr("word", "n_pages", "occurrences", "array_join(marks, ',') AS marks")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_stats.marked_terms(_valid_entries(spark, folder)).selectExpr("word", "explode(marks) AS mark")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(load(spark, folder, "trec_line"))


def p6_measures(spark: SparkSession, folder: str) -> DataFrame:
    return spam.verdicts(materialize(spam.looked_at(load(spark, folder, "trec_line"), with_lines=False).drop("hidden", "keys", "open"), "pages"))


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    return page_rows(load(spark, folder, "page_table")).select("doc_id", "site")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.furniture(load(spark, folder, "trec_line"), _sites(spark, folder))


def p7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return spam.main_texts(load(spark, folder, "trec_line"), _sites(spark, folder))


def _limits(spark: SparkSession, folder: str, prefix: str) -> list[tuple[str, int, int]]:
    """The caller's limits, a few rows: name, tokens, overlap."""
    rows = load(spark, folder, "token_limit").where(F.col("limit_name").startswith(prefix)).orderBy("limit_name").collect()
    return [(r["limit_name"], r["max_tokens"], r["overlap_tokens"] or 0) for r in rows]


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(tokens.sizes(spread(load(spark, folder, "documents").select("doc_id", "source", "text")), keep=("source",)), "sizes")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    limits = [(n, c) for n, c, _ in _limits(spark, folder, "pack_")]
    return packing.pack(_sizes(spark, folder), limits)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    limits = [(n, c) for n, c, _ in _limits(spark, folder, "pack_")]
    return packing.fill(packing.pack(_sizes(spark, folder), limits), limits)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_sizes(spark, folder), load(spark, folder, "mix_target"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets = _sizes(spark, folder), load(spark, folder, "mix_target")
    return mixing.shares(materialize(mixing.mixture(sized, targets), "mixture"), sized, targets)


def _corpus_size(sized: DataFrame) -> int:
    return sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]


def p9_mixture_corpus_size(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture of as many tokens as the corpus, where scarce sources stay short."""
    sized = _sizes(spark, folder)
    return mixing.mixture(sized, load(spark, folder, "mix_target"), _corpus_size(sized))


def p9_shares_corpus_size(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets = _sizes(spark, folder), load(spark, folder, "mix_target")
    return mixing.shares(materialize(mixing.mixture(sized, targets, _corpus_size(sized)), "mixture"), sized, targets)


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_documents(spread(load(spark, folder, "documents").select("doc_id", "text")), _limits(spark, folder, "piece_"))


QUERIES = {
    "p1_found": p1_found,
    "p1_restored": p1_restored,
    "p3_found": p3_found,
    "p3_clean_lines": p3_clean_lines,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p5_found": p5_found,
    "p5_lexicon": p5_lexicon,
    "p6_found": p6_found,
    "p6_measures": p6_measures,
    "p7_found": p7_found,
    "p7_main_text": p7_main_text,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_mixture": p9_mixture,
    "p9_mixture_corpus_size": p9_mixture_corpus_size,
    "p9_shares": p9_shares,
    "p9_shares_corpus_size": p9_shares_corpus_size,
    "p10_pieces": p10_pieces,
}

_PAGES = r"""
  SELECT doc_id, word_number,
         nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             lower(trim(url)), '^[a-z][a-z0-9+.\-]*://', ''), '[/?#].*$', ''), ':[0-9]*$', ''), '^www\.', '')), '') AS site
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fetched_at DESC NULLS LAST, word_number DESC NULLS LAST,
                                     url DESC NULLS LAST) AS nth FROM page_table WHERE doc_id IS NOT NULL)
  WHERE nth = 1"""

_REPEATED = f"""
  p AS ({_PAGES}),
  l AS (SELECT DISTINCT t.doc_id, t.line_no, p.site,
               lower(trim(regexp_replace(regexp_replace(line, '[ \\t\\r\\n\\x{{00A0}}]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS k
        FROM trec_line t JOIN p ON p.doc_id = t.doc_id WHERE line IS NOT NULL AND p.site IS NOT NULL),
  c AS (SELECT site, k FROM l WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT doc_id) >= 5),
  f AS (SELECT DISTINCT l.doc_id, l.line_no FROM l JOIN c ON l.site = c.site AND l.k = c.k)"""

_MARKED = f"""
  e AS ({ENTRIES_SQL}),
  n AS (SELECT count(DISTINCT doc_id) AS n FROM e),
  w AS (SELECT word, count(*) AS n_pages, CAST(sum(occurrence) AS BIGINT) AS occurrences FROM e GROUP BY word),
  m AS (SELECT w.*, n_pages <= 2 AS rare, n_pages > 0.25 * n AS common FROM w, n)"""

SQL = {
    "p3_found": f"WITH {_REPEATED} SELECT doc_id, line_no FROM f",
    "p3_clean_lines": f"""WITH {_REPEATED},
  a AS (SELECT doc_id, line_no, max(line) AS line FROM trec_line WHERE doc_id IS NOT NULL AND line_no IS NOT NULL GROUP BY 1, 2)
SELECT a.* FROM a ANTI JOIN f ON a.doc_id = f.doc_id AND a.line_no = f.line_no""",
    "p4_found": f"""WITH e AS ({ENTRIES_SQL}), p AS ({_PAGES}),
  d AS (SELECT word FROM e GROUP BY word HAVING count(*) BETWEEN 2 AND 6)
SELECT e.doc_id, e.word FROM e JOIN d ON d.word = e.word JOIN p ON p.doc_id = e.doc_id
WHERE e.occurrence * 10 >= p.word_number""",
    "p4_scores": f"""WITH e AS ({ENTRIES_SQL}), p AS ({_PAGES}),
  d AS (SELECT word, count(*) AS n_pages FROM e GROUP BY word),
  n AS (SELECT count(DISTINCT doc_id) AS n FROM e),
  t AS (SELECT DISTINCT doc_id, word, try_cast(x AS INT) AS pos
        FROM (SELECT doc_id, lower(trim(word)) AS word, unnest(string_split(positions, ',')) AS x FROM heap_line
              WHERE trim(word) <> '' AND doc_id IS NOT NULL AND positions IS NOT NULL)
        WHERE try_cast(x AS INT) IS NOT NULL),
  g AS (SELECT a.doc_id, a.word, count(DISTINCT b.word) AS degree FROM t a JOIN t b
        ON a.doc_id = b.doc_id AND a.word <> b.word AND b.pos - a.pos BETWEEN -3 AND 3 AND b.pos <> a.pos GROUP BY 1, 2)
SELECT e.doc_id, e.word, e.occurrence, p.word_number, d.n_pages, coalesce(degree, 0) AS degree,
       e.occurrence / nullif(p.word_number, 0)::DOUBLE AS share,
       round(coalesce(degree, 0) * ln((1.0::DOUBLE + n.n) / d.n_pages), 6) AS score
FROM e JOIN d ON d.word = e.word LEFT JOIN p ON p.doc_id = e.doc_id
LEFT JOIN g ON g.doc_id = e.doc_id AND g.word = e.word, n""",
    "p5_found": f"""WITH {_MARKED}
SELECT word, 'rare' AS mark FROM m WHERE rare UNION ALL SELECT word, 'common' FROM m WHERE common""",
    "p5_lexicon": f"""WITH {_MARKED}
SELECT word, n_pages, occurrences,
       CASE WHEN rare AND common THEN 'rare,common' WHEN rare THEN 'rare' WHEN common THEN 'common' ELSE '' END AS marks
FROM m""",
}
