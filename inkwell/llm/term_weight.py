"""How characteristic a term is of a page: graph-of-words weighting.

A page's words are the nodes of a graph; two words that stand within
``window`` tokens of each other share an edge.  The weight of a term is its
number of different neighbours instead of its frequency, times the rarity of
the term in the collection: ``degree * ln((N + 1) / df)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.term_stats import page_count, term_counts
from inkwell.storage import materialize

WINDOW = 4
BLOCK = 1024


def run_positions(heap_line: DataFrame) -> DataFrame:
    """``doc_id, word, pos`` of the parsed run lines, one row per token.

    A line spilled twice counts once; words are trimmed and in lower case;
    null or blank words, null pages and positions that are no numbers are dropped.
    """
    word = F.lower(F.trim("word"))
    pos = F.explode(F.transform(F.split("positions", ","), lambda x: x.try_cast("int")))
    return (
        heap_line.select("doc_id", word.alias("word"), "positions")
        .where("word <> '' AND doc_id IS NOT NULL AND positions IS NOT NULL")
        .select("doc_id", "word", pos.alias("pos"))
        .where("pos IS NOT NULL")
    )


def degrees(positions: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``doc_id, word, degree``: different other words within ``window - 1`` tokens.

    A page is cut into blocks of ``block`` positions, each with the
    ``window - 1`` positions before it, so no task ever holds more than one
    block of a page and a single huge page spreads over many tasks.  Every
    pair at distance 1 … window-1 falls into exactly one block, that of its
    later token.
    """
    if window < 2 or block < window:
        raise ValueError("window must be at least 2 and block at least window")
    reach = window - 1
    at = F.floor(F.col("pos") / block).cast("int")
    into = F.array_distinct(F.array(at, F.floor((F.col("pos") + reach) / block).cast("int")))
    placed = positions.select("doc_id", "word", "pos", F.explode(into).alias("block"))
    # pages of more than one block; known before the pairs are made, as only their pairs must meet again
    long = materialize(positions.where(F.col("pos") >= block - reach).select("doc_id").distinct(), "long-pages")
    short_pairs = _pairs(placed.join(long, "doc_id", "left_anti"), reach, block)
    # all pairs of a short page are in one group already: counted in place, without an exchange
    short = short_pairs.distinct().groupBy("doc_id", "block", "word").agg(F.count(F.lit(1)).alias("degree"))
    long_pairs = _pairs(placed.join(long, "doc_id", "left_semi"), reach, block).select("doc_id", "word", "other")
    both = long_pairs.distinct().groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("degree"))
    return short.select("doc_id", "word", "degree").unionByName(both)


def _pairs(placed: DataFrame, reach: int, block: int) -> DataFrame:
    """``doc_id, block, word, other``: words near each other, both ways, repeats within a block left out."""
    # a set, as a line spilled twice puts the same word into the same place again
    slots = placed.groupBy("doc_id", "block").agg(F.array_sort(F.collect_set(F.struct("pos", "word"))).alias("t"))
    # most words at one position: one, but for spills that disagree; bounds how many entries stand within reach
    most = F.expr(
        """CASE WHEN size(array_distinct(transform(t, x -> x.pos))) = size(t) THEN 1
           ELSE aggregate(t, named_struct('pos', cast(null AS int), 'n', 0, 'most', 0),
                          (a, x) -> named_struct('pos', x.pos, 'n', if(x.pos <=> a.pos, a.n + 1, 1),
                                                 'most', greatest(a.most, if(x.pos <=> a.pos, a.n + 1, 1))),
                          a -> a.most) END"""
    )
    slots = slots.withColumn("most", most)
    pairs = F.expr(
        f"""array_distinct(flatten(transform(t, (x, i) ->
              transform(filter(slice(t, i + 2, most * {reach + 1} - 1),
                               y -> y.pos - x.pos BETWEEN 1 AND {reach} AND floor(y.pos / {block}) = block
                                    AND y.word <> x.word),
                        y -> struct(x.word AS a, y.word AS b)))))"""
    )
    edges = slots.select("doc_id", "block", F.explode(pairs).alias("e"))
    ends = F.explode(F.array(F.struct(F.col("e.a").alias("word"), F.col("e.b").alias("other")),
                             F.struct(F.col("e.b").alias("word"), F.col("e.a").alias("other"))))
    return edges.select("doc_id", "block", ends.alias("x")).select("doc_id", "block", "x.word", "x.other")


def term_scores(entries: DataFrame, positions: DataFrame, pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """A score for every valid entry.

    Returns ``doc_id, word, occurrence, word_number, n_pages, degree, share,
    score``.  ``share`` is occurrence / word_number of the page's row (null if
    that is null or 0).  Entries of pages without a page row have null
    ``word_number``; run lines without an entry and empty tables give no rows.  A word alone on its page, or one whose run lines are
    missing, has degree 0 and score 0.
    """
    total = page_count(entries).scalar()
    df = term_counts(entries).select("word", "n_pages")
    rarity = F.log((F.lit(1.0) + total) / F.col("n_pages"))
    share = F.col("occurrence") / F.nullif(F.col("word_number"), F.lit(0))
    return (
        entries.join(degrees(positions, window), ["doc_id", "word"], "left")
        .join(pages.select("doc_id", "word_number"), "doc_id", "left")
        .join(df, "word")
        .select(
            "doc_id", "word", "occurrence", "word_number", "n_pages",
            F.coalesce("degree", F.lit(0)).alias("degree"), share.alias("share"),
            F.round(F.coalesce("degree", F.lit(0)) * rarity, 6).alias("score"),
        )
    )


def characteristic(scores: DataFrame, least_pages: int = 2, most_pages: int = 6, per: int = 10) -> DataFrame:
    """Entries of words on few pages that are at least one in ``per`` tokens of their page: ``doc_id, word``.

    Compared in integers; a null ``word_number`` gives no row.  Of the scored
    entries these are the ones that counts alone define; the degree, which
    orders a page's terms, decides none of them.
    """
    few = F.col("n_pages").between(least_pages, most_pages)
    enough = F.col("occurrence").cast("bigint") * per >= F.col("word_number")
    return scores.where(few & enough).select("doc_id", "word")
