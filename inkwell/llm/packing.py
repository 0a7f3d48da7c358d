"""Filling containers of fixed capacity with items of varying length.

The plan is made on the histogram of lengths, which has at most ``capacity``
rows whatever the number of items:

1. Items above the capacity are cut into pieces of the capacity and a rest.
2. Shallow combinations (up to three items) of length classes that fill the
   container up to a window are enumerated, and non-negative least squares
   gives how often each is repeated to use up the histogram.
3. The counts are rounded down and turned into containers; what is left of
   the histogram is packed greedily, longest first, into the smallest gap
   that takes it.

Containers are then given to items by an item's rank among those of its
length, so no task or driver ever holds the items.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.storage import materialize

CLASSES = 32  # length classes of the combinations
WINDOW = 16  # a combination leaves at most 1/WINDOW of the capacity
SALTS = 64  # least number of parts that the items of one length are ranked in
SALT_ROWS = 1_000_000  # items per part, should all have one length


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set (Lawson and Hanson 1974)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient)) if n else 0
        if not n or gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            own = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[own] = s
                break
            # go towards s as far as nothing becomes negative, and leave out what reaches zero
            low = s <= 0
            step = float(np.min(x[own][low] / np.maximum(x[own][low] - s[low], 1e-300)))
            x[own] += step * (s - x[own])
            x[own[x[own] <= 1e-12]] = 0
            active &= x > 0
            if not active.any():
                break
    return x


@dataclass
class Plan:
    """Where the items of each length go.

    ``rules`` has, per length, (first rank, items, first container, items per
    container): item ``r`` of a length goes to container
    ``first + (r - rank) // per``.
    """

    capacity: int
    containers: int = 0
    rules: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))


def _combinations(reps: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Class numbers, ascending, of up to three items that fill the capacity up to the window."""
    least, out, n = capacity - capacity // WINDOW, [], len(reps)
    for i in range(n):
        if least <= reps[i] <= capacity:
            out.append((i,))
        for j in range(i, n):
            two = reps[i] + reps[j]
            if two > capacity:
                break
            if two >= least:
                out.append((i, j))
            for k in range(j, n):
                three = two + reps[k]
                if three > capacity:
                    break
                if three >= least:
                    out.append((i, j, k))
    return out


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack ``histogram`` (length from 1 to ``capacity`` → items) into containers."""
    if capacity < 1 or any(not 1 <= n <= capacity for n in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    made = Plan(capacity)
    left = {n: c for n, c in histogram.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # free space → [first container, containers]

    def put(length: int, first: int, containers: int, per: int) -> None:
        n = containers * per
        made.rules[length].append((used[length], n, first, per))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    _pack_combinations(made, left, put, gaps)
    sizes = sorted(g for g, x in gaps.items() if g and x)
    for length in sorted(left, reverse=True):
        while c := left.get(length, 0):
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, n = capacity, made.containers, max(1, c // (capacity // length))
                made.containers += n
            per = min(gap // length, c)
            full = min(n, c // per)
            put(length, first, full, per)
            for free, start, many in ((gap - per * length, first, full), (gap, first + full, n - full)):
                if free and many:
                    if free not in gaps or not gaps[free]:
                        bisect.insort(sizes, free)
                    gaps[free].append([start, many])
    return made


def _pack_combinations(made: Plan, left: dict[int, int], put, gaps) -> None:
    """The part of the histogram that rounded combinations use up."""
    capacity = made.capacity
    lengths = sorted(n for n in left if n * 2 * WINDOW > capacity)
    if not lengths:
        return
    # classes of about equal token mass; a class is as long as its longest item
    mass = np.cumsum([n * left[n] for n in lengths])
    of = np.minimum((mass * CLASSES / (mass[-1] + 1)).astype(int), CLASSES - 1)
    members: dict[int, list[int]] = defaultdict(list)
    for n, k in zip(lengths, of, strict=True):
        members[int(k)].append(n)
    classes = [members[k] for k in sorted(members)]
    reps = [x[-1] for x in classes]
    patterns = _combinations(reps, capacity)
    if not patterns:
        return
    a = np.zeros((len(classes), len(patterns)))
    for p, pattern in enumerate(patterns):
        for k in pattern:
            a[k, p] += 1
    have = np.array([sum(left[n] for n in x) for x in classes], dtype=float)
    repeats = non_negative_least_squares(a, have)
    order = sorted(left)
    for p in np.argsort(-repeats, kind="stable"):
        times = int(repeats[p] + 1e-9)
        if times < 1:
            break
        pattern = sorted(patterns[p], reverse=True)
        while times > 0:
            # the longest items left of each class but the last, whose place takes the longest item of any class that fits
            taken: dict[int, int] = defaultdict(int)
            gap = capacity
            for nth, k in enumerate(pattern):
                if nth and nth == len(pattern) - 1:
                    at = bisect.bisect_right(order, gap) - 1
                    while at >= 0 and left.get(order[at], 0) <= taken.get(order[at], 0):
                        at -= 1
                    length = order[at] if at >= 0 else None
                else:
                    length = next((n for n in reversed(classes[k]) if n <= gap and left.get(n, 0) > taken.get(n, 0)), None)
                if length is None:
                    taken.clear()
                    break
                taken[length] += 1
                gap -= length
            if not taken:
                break
            n = min([times, *(left[x] // m for x, m in taken.items())])
            first = made.containers
            made.containers += n
            times -= n
            for length, per in taken.items():
                put(length, first, n, per)
                if length not in left:
                    del order[bisect.bisect_left(order, length)]
            gaps[gap].append([first, n])


def items(sized: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """``limit_name, capacity, doc_id, piece_no, start_token, n_tokens``: what is put into containers.

    An item above the capacity becomes pieces of the capacity and a rest, numbered from 1.
    """
    given = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in limits])
    each = sized.select("doc_id", "n_tokens", F.explode(given).alias("l")).select("doc_id", F.col("n_tokens").alias("size"), "l.*")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))
    each = each.withColumn("piece_no", F.explode(F.sequence(F.lit(1), pieces.cast("int"))))
    start = (F.col("piece_no") - 1) * F.col("capacity")
    return each.select("limit_name", "capacity", "doc_id", "piece_no", start.alias("start_token"),
                       F.least("capacity", F.col("size") - start).alias("n_tokens"))


RANKS = 1 << 40  # above the items of one length


def _looked_up(plan: Plan) -> tuple[np.ndarray, ...]:
    """A plan's rules in the order of (length, first rank): these as one key, first rank, first container, items per container."""
    rows = sorted((n, r[0], r[2], r[3]) for n, rules in plan.rules.items() for r in rules)
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return table[:, 0] * RANKS + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def _assign(plans: dict[str, tuple[np.ndarray, ...]], totals: dict[str, int]):
    """Containers of whole batches: each item's rule is the last that begins at or before its (length, rank).

    The rules come with the function; they are bounded by the capacities, whatever the number of items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column("n_tokens").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            out = np.zeros(len(sizes), dtype=np.int64)
            names = batch.column("limit_name").dictionary_encode()
            which = names.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(names.dictionary.to_pylist()):
                empty = (which == i) & (sizes == 0)  # takes no space: spread over all containers
                out[empty] = ranks[empty] % totals[name]
                mine = np.flatnonzero((which == i) & (sizes > 0))
                if len(mine):
                    keys, begin, first, per = plans[name]
                    at = np.searchsorted(keys, sizes[mine] * RANKS + ranks[mine], side="right") - 1
                    out[mine] = first[at] + (ranks[mine] - begin[at]) // per[at]
            kept = [batch.column(c) for c in ("limit_name", "doc_id", "piece_no", "start_token", "n_tokens")]
            yield pa.record_batch([*kept, pa.array(out, pa.int64())],
                                  names=["limit_name", "doc_id", "piece_no", "start_token", "n_tokens", "container_id"])

    return run


def pack(sized: DataFrame, limits: list[tuple[str, int]], salts: int | None = None) -> DataFrame:
    """Every item's container: ``limit_name, doc_id, piece_no, start_token, n_tokens, container_id``.

    ``sized`` has ``doc_id, n_tokens``; repeated rows are items of their own.
    Items of no tokens get any container of the limit, and container 0 if it
    has no others.  Null sizes count as 0.  No items or no limits give no rows.
    """
    if any(c is None or c < 1 for _, c in limits):
        raise ValueError("capacities must be at least 1")
    spark = sized.sparkSession
    empty = "limit_name string, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint, container_id bigint"
    if not limits:
        return spark.createDataFrame([], empty)
    salts = salts or max(SALTS, sized.count() // SALT_ROWS)
    clean = sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    all_items = items(clean, limits).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    key = ["limit_name", "n_tokens", "salt"]
    counts = materialize(all_items.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    # at most one row per limit and length, so bounded by the capacities
    rows = counts.groupBy("limit_name", "n_tokens").agg(F.sum("n").alias("n")).where("n_tokens > 0").toArrow().to_pylist()
    by: dict[str, dict[int, int]] = {name: {} for name, _ in limits}
    for r in rows:
        by[r["limit_name"]][r["n_tokens"]] = r["n"]
    plans = {name: plan(by[name], capacity) for name, capacity in limits}
    rules = {name: _looked_up(p) for name, p in plans.items()}
    totals = {name: max(1, p.containers) for name, p in plans.items()}
    # rank of an item among those of its length: inside its salt, after the salts before
    before = Window.partitionBy("limit_name", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*key).orderBy("doc_id", "piece_no")
    # the items are partitioned by the key already; the offsets, a row per length and salt, come to them
    ranked = all_items.withColumn("nth", F.row_number().over(inside) - 1).join(offsets.hint("merge"), key)
    ranked = ranked.select("limit_name", "doc_id", "piece_no", "start_token", "n_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_assign(rules, totals), empty)


def fill(packed: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """Per limit: items, containers, tokens and the share of the space that is used."""
    names = F.create_map(*[x for n, c in limits for x in (F.lit(n), F.lit(c))])
    per = packed.groupBy("limit_name", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return per.groupBy("limit_name").agg(
        F.sum("items").alias("items"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
    ).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * names[F.col("limit_name")]), 6))
