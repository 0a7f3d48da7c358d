"""Pages of very many lines, looked at in parts with the result of the whole.

What a line is depends on lines before it only through the small state of
``layout.walk``.  Each part of a page tells, for every state that it can be
entered with, the one that it is left with; composed along the page's parts,
that gives each part its own.  Word, pair and line counts of the parts are
added up by key.  So no task holds more than a part of a page, or a page's
list of parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import layout
from inkwell.storage import materialize

INHERITED = -1  # stands for the line that a part was entered with
_NONE = -2
TOGETHER = 64  # lines after which states that have become one are walked as one

#: Every state that a part can be entered with, by its number; lines are inherited.
ENTRIES = [
    (a2, a1, box, settled, run, INHERITED, None)
    for a2, a1, box, (settled, run) in product((False, True), (False, True), range(4), ((False, 0), (False, 1), (False, 2), (True, 0)))
]
_NUMBER = {e[:5]: i for i, e in enumerate(ENTRIES)}


def _number(state: tuple) -> int:
    """The entry that a state is, but for the lines it names."""
    return _NUMBER[(*state[:4], 0 if state[3] else state[4])]


def _lines(numbers: list[int], lines: list[str | None]) -> tuple[list[int], list[str | None], list[str]]:
    """Numbers, roles and flat texts of a part's lines that aren't blank."""
    known = [(n, *layout.role(x)) for n, x in sorted(zip(numbers, lines, strict=True))]
    real = [x for x in known if x[1] != "blank"]
    return [x[0] for x in real], [x[1] for x in real], [x[2] for x in real]


def _each(batches: Iterator[pa.RecordBatch], schema: pa.Schema, of_row) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True) for r in of_row(*values)]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


_EDGES = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("navs", pa.list_(pa.bool_())), ("crumb", pa.string())])


def _edges(batches):
    """Of each part, which of its first two lines are menu entries, and its first breadcrumb."""

    def one(doc_id, part, numbers, lines):
        _, kinds, texts = _lines(numbers, lines)
        yield doc_id, part, [k == "nav" for k in kinds[:2]], layout.breadcrumb(kinds, texts) or None

    return _each(batches, _EDGES, one)


_AROUND = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("ahead", pa.list_(pa.bool_())), ("crumb", pa.string())])


def _around(batches):
    """Of a page's parts in order: what each has to know of the others."""

    def one(doc_id, parts):
        crumb = next((p["crumb"] for p in parts if p["crumb"]), "")
        ahead: list[bool] = []
        found = []
        for p in reversed(parts):
            found.append((doc_id, p["part"], [*ahead, False, False][:2], crumb))
            ahead = [*p["navs"], *ahead][:2]
        yield from found

    return _each(batches, _AROUND, one)


_LEFT = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("state", pa.list_(pa.int32())), ("last", pa.list_(pa.int64())), ("shown", pa.list_(pa.int64()))])


def _through(batches):
    """The state each part is left with, by the number of the one it is entered with."""

    def one(doc_id, part, numbers, lines, ahead, crumb):
        keys, kinds, texts = _lines(numbers, lines)
        now = {i: ENTRIES[i] for i in range(len(ENTRIES))}
        for at in range(0, len(kinds), TOGETHER):
            end = min(at + TOGETHER, len(kinds))
            navs = [k == "nav" for k in kinds[end : end + 2]] + list(ahead)
            after = {s: layout.walk(kinds[at:end], texts[at:end], keys[at:end], s, tuple(navs[:2]), crumb)[1] for s in set(now.values())}
            now = {i: after[s] for i, s in now.items()}
        line = lambda x: _NONE if x is None else x
        yield doc_id, part, [_number(now[i]) for i in now], [line(now[i][5]) for i in now], [line(now[i][6]) for i in now]

    return _each(batches, _LEFT, one)


_ENTERED = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("entry", pa.int32()), ("shown", pa.int64())])


def _entered(batches):
    """The state each part is entered with, composed along the page; and the page's headline, if a box's last title is it."""

    def one(doc_id, parts):
        number, last, shown, entries = _NUMBER[layout.START[:5]], None, None, []
        for p in parts:
            entries.append((p["part"], number))
            own = lambda x, was: was if x == INHERITED else None if x == _NONE else x
            said = own(p["shown"][number], last)
            shown = shown if said is None else said
            last, number = own(p["last"][number], last), p["state"][number]
        end = layout.last_shown((*ENTRIES[number][:5], last, shown))
        for part, entry in entries:
            yield doc_id, part, entry, end

    return _each(batches, _ENTERED, one)


_COUNTED = pa.schema([("doc_id", pa.int64()), ("hidden", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())),
                      ("open", pa.list_(pa.struct([("line_no", pa.int32()), ("key", pa.int64())]))),
                      ("counts", pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string()), ("n", pa.int64())])))])


def _counted(batches):
    """Hidden lines of each part, and the counts of the others."""
    from inkwell.llm import spam  # which imports this module

    def one(doc_id, part, numbers, lines, ahead, crumb, entry, shown):
        keys, kinds, texts = _lines(numbers, lines)
        walked, _ = layout.walk(kinds, texts, keys, ENTRIES[entry], tuple(ahead), crumb)
        roles = [None if n == shown else k for n, k in zip(keys, walked, strict=True)]
        hidden = [n for n, k in zip(keys, roles, strict=True) if k is not None]
        own = [t for t, k in zip(texts, roles, strict=True) if k is None]
        sums, words, pairs = spam.count(own)
        counts = [("sum", k, n) for k, n in sums.items()] + [("lang", k, n) for k, n in spam.languages(words).items()]
        counts += [("word", w, n) for w, n in words.items() if spam.is_content(w)] + [("pair", " ".join(p), n) for p, n in pairs.items() if spam.is_telling(p)]
        counts += [("line", t, n) for t, n in Counter(own).items()]
        known, open_ = spam.keys_and_open(list(zip(keys, texts, strict=True)), hidden)
        yield doc_id, hidden, known, [dict(zip(("line_no", "key"), x)) for x in open_], [dict(zip(("kind", "key", "n"), c)) for c in counts]

    return _each(batches, _COUNTED, one)


def looked_at(rows: DataFrame, part: int) -> DataFrame:
    """Rows as those of ``spam.looked_at``, without text, for pages of any number of lines (``doc_id, line_no, line``)."""
    from inkwell.llm import spam

    once = rows.groupBy("doc_id", "line_no").agg(F.max("line").alias("line"))
    nth = F.floor((F.col("line_no") - 1) / part).alias("part")
    parts = once.select("doc_id", nth, F.struct("line_no", "line").alias("x")).groupBy("doc_id", "part").agg(F.collect_list("x").alias("x"))
    parts = materialize(parts.select("doc_id", "part", F.col("x.line_no").alias("numbers"), F.col("x.line").alias("lines")), "parts")
    key = ["doc_id", "part"]
    of_page = lambda df, *c: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", *c))).alias("parts"))
    edges = parts.mapInArrow(_edges, "doc_id bigint, part bigint, navs array<boolean>, crumb string")
    around = materialize(of_page(edges, "navs", "crumb").mapInArrow(_around, "doc_id bigint, part bigint, ahead array<boolean>, crumb string"), "around")
    left = parts.join(around, key).mapInArrow(_through, "doc_id bigint, part bigint, state array<int>, last array<bigint>, shown array<bigint>")
    entered = of_page(left, "state", "last", "shown").mapInArrow(_entered, "doc_id bigint, part bigint, entry int, shown bigint")
    counted = parts.join(around, key).join(entered, key).mapInArrow(
        _counted, f"doc_id bigint, {spam.LINES_DDL}, counts array<struct<kind:string,key:string,n:bigint>>")
    counted = materialize(counted, "counted")
    each = counted.select("doc_id", F.explode("counts").alias("c")).groupBy("doc_id", F.col("c.kind").alias("kind"), F.col("c.key").alias("key")).agg(F.sum("c.n").alias("n"))
    each = materialize(each, "counts")
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"))
    top = each.where("kind = 'word' AND n > 2").withColumn("r", F.row_number().over(best)).where("r <= 3").groupBy("doc_id").agg(F.sum("n").alias("top"))
    sums = each.groupBy("doc_id").agg(
        *[F.sum(F.when((F.col("kind") == "sum") & (F.col("key") == m), F.col("n"))).alias(m) for m in spam.SUMS],
        F.coalesce(F.max(F.when(F.col("kind") == "lang", F.struct("n", "key"))), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("").alias("key"))).alias("best"),
        F.coalesce(F.sum(F.when(F.col("kind") == "pair", F.col("n") - 1)), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.when(F.col("kind") == "line", F.col("n") - 1)), F.lit(0)).alias("lines"))
    measured = sums.join(top, "doc_id", "left").select(
        "doc_id", F.col("best.key").alias("lang"), *spam.SUMS, F.col("best.n").alias("function"), F.coalesce("top", F.lit(0)).cast("bigint").alias("top"), "pairs", "lines")
    none = F.lit(None)
    hidden = counted.select("doc_id", none.cast("string").alias("lang"), *[none.cast("bigint").alias(m) for m in spam.MEASURES], "hidden", "keys", "open")
    without = [none.cast(hidden.schema[c].dataType).alias(c) for c in ("hidden", "keys", "open")]
    return measured.select("doc_id", "lang", *spam.MEASURES, *without).unionByName(hidden)
