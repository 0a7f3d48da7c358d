"""Per-key results when a few keys own most rows: aggregation by a tree.

Level 0 folds each scan chunk (a bounded slice of the input files) to one
state per key inside its task, before anything is exchanged.  Every exchange
merges the states of ``fan_in`` neighbours: first those of chunks, then those
of the merges before.  A key that stands in every chunk therefore
meets at most ``fan_in`` states per task and level, and no reducer gets all
partials of a hot key: the depth is the logarithm of the number of chunks.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 8


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    first: dict[str, Column],
    merge: dict[str, str],
    chunks: int,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Aggregate ``df`` by ``keys`` through levels of partial states.

    ``first`` gives each state column as an aggregate over input rows;
    ``merge`` names the function (``sum``, ``min`` or ``max``) that joins two
    states.  ``chunks`` is the number of leaves, at least 1.  The leaf of a row
    is the task that scans it, so the first fold needs no exchange of rows; the
    result does not depend on it.

    Nulls in a key form a key of their own; an empty input gives no rows.
    Columns of other names are not carried along.
    """
    if fan_in < 2 or chunks < 1:
        raise ValueError("fan_in must be at least 2 and chunks at least 1")
    node = "__node"
    while node in df.columns:
        node += "_"
    # spark_partition_id is not deterministic for the planner, so it stands in a projection of its own
    leaves = df.withColumn(node, F.pmod(F.spark_partition_id(), F.lit(chunks)))
    width, states = math.ceil(chunks / fan_in), leaves.withColumn(node, (F.col(node) / fan_in).cast("int"))
    how = [c.alias(n) for n, c in first.items()]
    while True:
        # the task's own fold of its rows is Spark's partial aggregate, and the exchange brings the neighbours' folds together
        states = states.groupBy(*keys, *([node] if width > 1 else [])).agg(*how)
        if width == 1:
            return states
        width = math.ceil(width / fan_in)
        states = states.withColumn(node, (F.col(node) / fan_in).cast("int"))
        how = [getattr(F, f)(n).alias(n) for n, f in merge.items()]


def scan_chunks(df: DataFrame) -> int:
    """Leaves of a tree over ``df``: its scan tasks, each a slice of bounded bytes."""
    return max(1, df.rdd.getNumPartitions())


def word_rows(heap_line: DataFrame, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Per word of the run lines, the number of rows as delivered: ``word, n_rows`` (a null word is a key)."""
    return tree_aggregate(heap_line.select("word"), ["word"], {"n_rows": F.count(F.lit(1))}, {"n_rows": "sum"}, chunks, fan_in)


def word_statistics(heap_line: DataFrame, entries: DataFrame, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """``word, n_rows, n_pages, occurrences`` of every non-null word.

    ``n_rows`` counts run lines as delivered and ``n_pages`` their different
    pages.  ``occurrences`` sums the valid inverted-list entries of the word
    (null where it has none).  Words are compared as they stand in the run
    lines; entries hold them trimmed and in lower case.

    Rows are folded to (word, page) first, which spreads a hot word over as
    many tasks as it has pages; those folds are then the leaves of the tree.
    """
    pairs = (
        heap_line.where("word IS NOT NULL").groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    )
    lines = tree_aggregate(
        pairs, ["word"],
        {"n_rows": F.sum("n"), "n_pages": F.count("doc_id")},
        {"n_rows": "sum", "n_pages": "sum"}, chunks, fan_in,
    )
    sums = tree_aggregate(entries, ["word"], {"occurrences": F.sum("occurrence")}, {"occurrences": "sum"}, chunks, fan_in)
    return lines.join(sums, "word", "left")


def heavy_words(heap_line: DataFrame, chunks: int, share: float = 0.02, fan_in: int = FAN_IN) -> DataFrame:
    """Words with at least ``share`` of all run lines, nulls and repeats counted in the total: ``word, n_rows``."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    rows = word_rows(heap_line, chunks, fan_in)
    total = heap_line.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.where(F.col("word").isNotNull() & (F.col("n_rows") >= F.lit(Decimal(str(share))) * total))
