"""Importance by links: the fixpoint of ``rank(j) = 0.15 / N + 0.85 * sum of rank(i) over links i → j``."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.storage import discard, materialize

DAMPING = 0.85
THRESHOLD = 1e-4
ITERATIONS = 200


class Diverged(ArithmeticError):
    """The update has no fixpoint on this graph, or none within the iterations."""


@dataclass
class Ranks:
    ranks: DataFrame
    iterations: int


def fixpoint(
    nodes: DataFrame, edges: DataFrame, n: int, damping: float = DAMPING, threshold: float = THRESHOLD,
    iterations: int = ITERATIONS, normalized: bool = False,
) -> Ranks:
    """``doc_id, rank`` after the first iteration that changes no rank by more than the threshold.

    ``n`` is the number of different urls.  A page hands its whole rank on to
    every target (with ``normalized``, it is shared among them); the rank of
    pages without links is not handed round.  The update can diverge, which
    raises ``Diverged``.  Contributions are summed per target before the
    exchange, so a page that everything links to costs one row per task; each
    iteration is a table in the shared folder, of which the two last are kept,
    and only the largest change comes to the driver.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    start, base = 1.0 / n, (1 - damping) / n
    if normalized:
        edges = edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src").select("src", "dst", (1.0 / F.col("out")).alias("part"))
    else:
        edges = edges.select("src", "dst", F.lit(1.0).alias("part"))
    edges = materialize(edges, "edges")
    before = current = materialize(nodes.select("doc_id").distinct().select("doc_id", F.lit(start).alias("rank")), "ranks")
    for i in range(1, iterations + 1):
        given = current.join(edges, F.col("doc_id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        changed = current.join(given, F.col("doc_id") == F.col("dst"), "left").select(
            "doc_id", (F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("was"))
        changed = materialize(changed, "ranks")
        discard(before)
        most = changed.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0]
        before, current = changed, changed.select("doc_id", "rank")
        if most is None or most <= threshold:
            discard(edges)
            return Ranks(current, i)
        if not math.isfinite(most):
            raise Diverged(f"ranks are no longer finite after {i} iterations")
    raise Diverged(f"ranks still change after {iterations} iterations")
