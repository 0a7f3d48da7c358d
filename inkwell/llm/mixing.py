"""Mixing sources to target shares of all tokens, by Pareto order sampling.

A source's tokens in the mixture are its share of the total.  As many whole
copies of all of its documents as fit are certain.  For the rest, documents
have inclusion probabilities in proportion to their tokens, those that reach 1
are certain too, and the others are ranked by their random odds divided by
their inclusion odds (Rosén 1997): the first ``n`` in that order are the
sample, ``n`` being the sum of the probabilities.  A sample of a fixed number
of documents misses the tokens by chance; where it ends, documents next to
each other in the order are exchanged until it comes nearest (in sources of a
few very unlike lengths, one is left out for several shorter ones).

The random numbers are hashes of seed and ``doc_id``, so a lost task gives the
same sample again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 2048  # documents that are looked at one by one where a source's sample ends
NEAR = 0.001  # of a source's rest: what exchanges may leave open
REFILLS = 8  # documents that are tried without in turn
FINE = 16  # length classes per doubling, in which probabilities are solved for


def _sources(targets: DataFrame) -> list[dict]:
    """Targets by source, trimmed and in lower case; shares of a source given twice are added, the lower cap holds."""
    rows = (
        targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
        .where("source <> ''").groupBy("source")
        .agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("share"), F.min("max_repeats").alias("most"))
    )
    return [r.asDict() for r in rows.collect()]  # the caller's table of targets, a row per source


def sized_sources(sized: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` with the source trimmed and in lower case; documents without source or tokens are left out."""
    source = F.lower(F.trim("source"))
    return sized.select("doc_id", source.alias("source"), "n_tokens").where("source <> '' AND n_tokens > 0")


def allocate(targets: list[dict], have: dict[str, tuple[int, int]], total: int | None) -> list[dict]:
    """Tokens, whole copies and what is left of each source.

    ``have`` gives documents and tokens per source.  Without ``total`` the
    mixture is as large as it can be with every source that has documents
    reaching its share within its repeats.  With a ``total`` a source that
    can't fill its share gives all its copies and stays short.
    """
    able = [(t, *have[t["source"]]) for t in targets if t["source"] in have and t["share"] > 0 and (t["most"] or 0) > 0]
    if total is None:
        total = math.floor(min((t["most"] * tokens / t["share"] for t, _, tokens in able), default=0))
    out = []
    for t, docs, tokens in able:
        wanted = min(t["share"] * total, float(t["most"] * tokens))
        whole = min(int(wanted / tokens + 1e-12), t["most"])
        rest = max(0.0, wanted - whole * tokens) if whole < t["most"] else 0.0
        out.append({"source": t["source"], "whole": whole, "rest": rest, "buckets": max(1, math.ceil(docs / BUCKET_ROWS))})
    return out


def inclusion(classes: list[tuple[int, float, float, float]], rest: float) -> tuple[float, int]:
    """``(c, n)``: a document's inclusion probability is ``min(1, c * measure)``, and the sample has ``n`` documents.

    ``classes`` are length classes as (documents, tokens, sum of measures, sum
    of measure times tokens).  ``c`` is such that the expected tokens are
    ``rest``; classes that would pass 1 are certain, and the others share
    what these leave.
    """
    order = sorted(classes, key=lambda x: -x[2] / x[0])
    certain = 0
    while certain < len(order):
        c = max(0.0, rest - sum(x[1] for x in order[:certain])) / sum(x[3] for x in order[certain:])
        if c * order[certain][2] / order[certain][0] < 1:
            break
        certain += 1
    else:
        c = math.inf
    n = sum(x[0] for x in order[:certain]) + (c * sum(x[2] for x in order[certain:]) if certain < len(order) else 0)
    return c, max(int(rest > 0), round(n))


def _exchanged(rows):
    """The end of a source's sample: its first ``left`` documents in order, exchanged with those after them until ``room`` is met best.

    Where lengths are such that exchanges still miss it by more than ``NEAR``
    of the source's rest, a document too many is left out, and in its place
    those that fit are taken in order; exchanges go on from there.
    """
    rows = rows.sort_values(["q", "doc_id"], ignore_index=True)
    n, room, near = int(rows["left"].iloc[0]), float(rows["room"].iloc[0]), NEAR * float(rows["rest"].iloc[0])
    size, fixed = rows["n_tokens"].to_numpy(), rows["q"].to_numpy() <= 0
    taken = _exchange(np.arange(len(rows)) < n, size, fixed, room)
    best = taken.copy()
    miss = lambda t: abs(room - float(size[t].sum()))
    for i in np.flatnonzero(taken & ~fixed)[::-1][:REFILLS].tolist() + [-1]:
        if miss(best) <= max(near, 0.5):
            break
        tried = taken.copy()
        if i >= 0:
            tried[i] = False
        left = room - float(size[tried].sum())
        for j in np.flatnonzero(~tried):
            if j != i and size[j] <= left:
                tried[j] = True
                left -= float(size[j])
        tried = _exchange(tried, size, fixed, room)
        if miss(tried) < miss(best):
            best = tried
    return rows.assign(copies=best.astype("int32"))[["doc_id", "source", "n_tokens", "copies"]]


def _exchange(taken: np.ndarray, size: np.ndarray, fixed: np.ndarray, room: float) -> np.ndarray:
    """One document for one other, as long as that brings the tokens of those taken nearer to ``room``."""
    taken = taken.copy()
    gap = room - float(size[taken].sum())
    for _ in range(2 * len(size)):
        inside, outside = np.flatnonzero(taken & ~fixed), np.flatnonzero(~taken)
        if abs(gap) < 0.5 or not len(inside) or not len(outside):
            break
        # for each document inside, the one outside whose tokens come nearest to closing the gap
        outside = outside[np.argsort(size[outside], kind="stable")]
        at = np.searchsorted(size[outside], size[inside] + gap)
        both = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(outside) - 1)])
        misses = np.abs(gap - (size[outside[both]] - size[inside]))
        k = int(np.argmin(misses))
        if misses.flat[k] >= abs(gap):
            break
        i, j = inside[k % len(inside)], outside[both.flat[k]]
        taken[i], taken[j] = False, True
        gap -= float(size[j] - size[i])
    return taken


def mixture(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, power: float = 1.0) -> DataFrame:
    """Documents of the mixture and how often each is used: ``doc_id, source, n_tokens, copies``.

    ``sized`` has ``doc_id, source, n_tokens``.  Every target source's tokens
    come as near to its share of ``total_tokens`` as whole documents allow,
    at most ``max_repeats`` copies each.  Inclusion is in proportion to
    ``n_tokens ** power``; 0 makes it even.  Sources without target, targets
    without documents, null sources and empty texts give no rows; a document
    that stands twice is sampled twice.
    """
    spark = sized.sparkSession
    docs = sized_sources(sized)
    wanted = _sources(targets)
    names = [w["source"] for w in wanted]
    size = F.col("n_tokens").cast("double")
    measure = F.pow(size, F.lit(float(power)))
    by_length = docs.where(F.col("source").isin(names)).groupBy("source", F.floor(F.log2(size) * FINE).alias("class")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum(measure).alias("m"), F.sum(measure * size).alias("mt"))
    classes: dict[str, list[tuple]] = {}
    for r in by_length.collect():  # a row per target and length class, of which there are at most FINE * 64
        classes.setdefault(r["source"], []).append((r["docs"], r["tokens"], r["m"], r["mt"]))
    have = {k: (sum(x[0] for x in v), sum(x[1] for x in v)) for k, v in classes.items()}
    parts = allocate(wanted, have, total_tokens)
    rows = [(p["source"], p["whole"], p["rest"], p["buckets"], *(inclusion(classes[p["source"]], p["rest"]) if p["rest"] > 0 else (0.0, 0))) for p in parts]
    plan = spark.createDataFrame(rows, "source string, whole int, rest double, buckets int, c double, n bigint")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("bigint"), "doc_id"), 11) + 0.5) / float(1 << 53)
    each = docs.join(plan, "source").withColumn("u", u)
    certain = each.where("whole > 0").select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))
    pi = F.col("c") * measure
    # certain documents come first; q / (1 + q) keeps the order and lies between 0 and 1
    q = F.when(pi >= 1, F.lit(0.0)).otherwise(F.col("u") / (1 - F.col("u")) * (1 - pi) / pi)
    drawn = each.where("n > 0").withColumn("q", q)
    drawn = drawn.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * F.col("buckets")).cast("int"))
    drawn = drawn.select("doc_id", "source", "n_tokens", "q", "bucket", "n", "rest")
    filled = drawn.groupBy("source", "bucket", "n", "rest").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    upto = Window.partitionBy("source").orderBy("bucket")  # a row per bucket
    filled = filled.withColumn("docs_upto", F.sum("docs").over(upto)).withColumn("tokens_upto", F.sum("tokens").over(upto))
    filled = filled.withColumn("begun", F.col("docs_upto") - F.col("docs"))
    # the bucket in which the sample ends, and its neighbours
    filled = filled.withColumn("nth", F.row_number().over(upto))
    ends = filled.groupBy("source").agg(F.max(F.when(F.col("begun") < F.col("n"), F.col("nth"))).alias("end"))
    filled = filled.join(ends, "source").where(F.col("nth") <= F.col("end") + 1)
    filled = filled.withColumn("state", F.when(F.col("nth") < F.col("end") - 1, "in").otherwise("end"))
    first = F.col("nth") == F.greatest(F.col("end") - 1, F.lit(1))
    of_source = Window.partitionBy("source")
    before = lambda x, own: F.max(F.when(first, F.col(x) - F.col(own))).over(of_source)
    filled = filled.withColumn("left", F.col("n") - before("docs_upto", "docs")).withColumn("room", F.col("rest") - before("tokens_upto", "tokens"))
    filled = filled.select("source", "bucket", "state", "left", "room", "rest")
    placed = drawn.select("doc_id", "source", "n_tokens", "q", "bucket").join(filled, ["source", "bucket"])
    sure = placed.where("state = 'in'").select("doc_id", "source", "n_tokens", F.lit(1).alias("copies"))
    # three buckets per source, of a few BUCKET_ROWS documents
    ending = placed.where("state = 'end'").groupBy("source").applyInPandas(_exchanged, "doc_id bigint, source string, n_tokens bigint, copies int")
    all_ = certain.unionByName(sure).unionByName(ending.where("copies > 0"))
    return all_.groupBy("doc_id", "source", "n_tokens").agg(F.sum("copies").cast("int").alias("copies"))


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What came out, a row per target: ``source, target_share, max_repeats, available_tokens, tokens, share, most_copies, size``.

    ``size`` is the whole mixture's tokens, repeats counted, by those of all texts in ``sized``; it is the same in every row.
    """
    goals = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("source <> ''")
    goals = goals.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    have = sized_sources(sized).groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    zero = F.lit(0).cast("bigint")
    joined = goals.join(have, "source", "left").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("available_tokens", zero).alias("available_tokens"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    corpus = sized.agg(F.sum("n_tokens").alias("corpus_tokens"))  # one row
    size = F.round(F.coalesce(F.try_divide(total, F.col("corpus_tokens")), F.lit(0.0)), 6)
    joined = joined.crossJoin(corpus).withColumn("size", size).drop("corpus_tokens")
    return joined.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6))
