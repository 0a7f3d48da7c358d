"""Building the positional inverted index: postings, lexicon, page table and 128-posting blocks, stored and read again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text, varbyte
from inkwell.storage import materialize

BLOCK = 128
SEGMENT = 1 << 16  # doc ids that are numbered together when a term's postings are ordered


def tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, token`` of every token, over-long ones included; ``docs`` has ``doc_id, body``."""
    return docs.select("doc_id", F.posexplode(text.document_tokens(F.col("body"))).alias("pos", "token"))


def kept_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, term``: indexed tokens in lower case; a dropped token leaves its position empty."""
    return tokens(docs).where(text.indexed(F.col("token"))).select("doc_id", "pos", F.lower("token").alias("term"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_len``: all tokens of the body; no exchange."""
    return docs.select("doc_id", F.size(text.document_tokens(F.col("body"))).alias("doc_len"))


def corpus_stats(page_table: DataFrame) -> DataFrame:
    """One row ``n_docs, total_len, avg_len`` (null average of an empty collection)."""
    return page_table.agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"),
        (F.sum("doc_len") / F.count(F.lit(1))).alias("avg_len"),
    )


def postings(docs: DataFrame) -> DataFrame:
    """``term, doc_id, tf, positions``, the positions in order.

    A document's tokens are counted by one group per (term, document), so a
    hot term spreads over its documents.
    """
    return (
        kept_tokens(docs).groupBy("term", "doc_id")
        .agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        .select("term", "doc_id", F.size("positions").alias("tf"), "positions")
    )


def term_frequencies(docs: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` without positions."""
    return kept_tokens(docs).groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def lexicon(posted: DataFrame) -> DataFrame:
    """``term, df``."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def page_table(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_no, url, doc_len``; missing ``doc_no`` or ``url`` columns are null."""
    have = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("doc_no", "url")]
    return docs.select("doc_id", *have, F.size(text.document_tokens(F.col("body"))).alias("doc_len"))


def ordered_postings(posted: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Postings with ``nth`` (0-based rank by doc id in the term) and ``gap`` (difference to the doc id before).

    A term of most documents would be one sort task; so each term is cut into
    segments of doc ids.  Ranks and gaps are taken inside a segment, and the
    few (term, segment) totals carry them across.
    """
    cut = posted.withColumn("segment", F.floor(F.col("doc_id") / segment))
    totals = cut.groupBy("term", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    before = Window.partitionBy("term").orderBy("segment")
    carried = totals.select(
        "term", "segment",
        F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"),
        F.coalesce(F.lag("last").over(before), F.lit(0)).alias("last_before"),
    )
    inside = Window.partitionBy("term", "segment").orderBy("doc_id")
    return (
        cut.withColumn("at", F.row_number().over(inside) - 1)
        .withColumn("previous", F.lag("doc_id").over(inside))
        .join(carried, ["term", "segment"])
        .withColumn("nth", F.col("n_before") + F.col("at"))
        .withColumn("gap", F.col("doc_id") - F.coalesce("previous", "last_before"))
        .drop("segment", "at", "previous", "n_before", "last_before")
    )


def _position_bytes() -> F.Column:
    total = F.aggregate(varbyte.gaps(F.col("positions")), F.lit(0), lambda a, x: a + varbyte.size(x))
    return total.cast("bigint")


def block_metadata(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per block of postings: ``term, block_no, n, first_doc_id, last_doc_id, docid_bytes, freq_bytes, pos_bytes``."""
    return (
        ordered_postings(posted).withColumn("block_no", F.floor(F.col("nth") / block).cast("int"))
        .groupBy("term", "block_no")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"),
            F.sum(varbyte.size(F.col("gap"))).alias("docid_bytes"), F.sum(varbyte.size(F.col("tf"))).alias("freq_bytes"),
            F.sum(_position_bytes()).alias("pos_bytes"),
        )
    )


def blocks(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """The stored index: a row per block with its doc ids, frequencies and their gap-coded bytes.

    At most ``block`` postings meet in a row, however hot the term.
    """
    entry = F.struct("doc_id", "tf", "gap", varbyte.gaps(F.col("positions")).alias("position_gaps"))
    packed = (
        ordered_postings(posted).withColumn("block_no", F.floor(F.col("nth") / block).cast("int"))
        .groupBy("term", "block_no").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    )
    arrays = packed.select(
        "term", "block_no", F.size("e").alias("n"),
        F.element_at("e.doc_id", 1).alias("first_doc_id"), F.element_at("e.doc_id", -1).alias("last_doc_id"),
        F.col("e.doc_id").alias("doc_ids"), F.col("e.tf").alias("tfs"),
        F.col("e.gap").cast("array<bigint>").alias("gaps"), F.col("e.tf").cast("array<bigint>").alias("freqs"),
        F.flatten("e.position_gaps").cast("array<bigint>").alias("positions"),
    )
    return arrays.select(
        "term", "block_no", "n", "first_doc_id", "last_doc_id", "doc_ids", "tfs",
        varbyte.encode_array("gaps").alias("docid_bytes"), varbyte.encode_array("freqs").alias("freq_bytes"),
        varbyte.encode_array("positions").alias("position_bytes"),
    )


def stored_metadata(stored: DataFrame) -> DataFrame:
    """The metadata of ``blocks``, from the sizes of their bytes."""
    size = lambda c: F.octet_length(c).cast("bigint").alias(c.replace("position", "pos").replace("_bytes", "") + "_bytes")
    return stored.select("term", "block_no", F.col("n").cast("bigint").alias("n"), "first_doc_id", "last_doc_id",
                         size("docid_bytes"), size("freq_bytes"), size("position_bytes"))


def running(rows: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` with running sums, each up to and with the row, in the order of ``order``: ``{new column: column}``.

    The rows are cut into ranges, summed per range, carried over the ranges
    and summed inside each: no task has more than a range.  The ranges are as
    many as the session's shuffle partitions.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    carried = totals.select("__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(carried, "__range")
    return placed.select(*rows.columns, *[(F.col(f"__b_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])


def lexicon_offsets(metadata: DataFrame) -> DataFrame:
    """``term, df, n_blocks, start, end, pos_start, pos_end``: where each term's bytes lie in the two files.

    A term takes 12 bytes of metadata per block and its doc id and frequency
    bytes; in the position file 4 bytes per block and its positions.
    """
    terms = metadata.groupBy("term").agg(
        F.sum("n").alias("df"), F.count(F.lit(1)).alias("n_blocks"),
        (12 * F.count(F.lit(1)) + F.sum("docid_bytes") + F.sum("freq_bytes")).alias("bytes"),
        (4 * F.count(F.lit(1)) + F.sum("pos_bytes")).alias("pos_bytes"),
    )
    placed = running(terms, ["term"], {"end": "bytes", "pos_end": "pos_bytes"}, "lexicon")
    return placed.select("term", "df", "n_blocks", (F.col("end") - F.col("bytes")).alias("start"), "end",
                         (F.col("pos_end") - F.col("pos_bytes")).alias("pos_start"), "pos_end")


def next_geq(index: DataFrame, targets: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For each ``term, target``, the first posting at or after the target: ``term, target, doc_id`` (null when exhausted).

    Blocks and targets of a term meet in segments of doc ids, in order: each
    target looks at the next block that doesn't end before it, and only there
    at doc ids.  A segment's last targets look at the first block of the
    segments after it.  The work grows with blocks plus targets, and a hot
    term spreads over its segments.
    """
    cut = lambda c: F.floor(F.col(c) / segment).alias("segment")
    none = F.lit(None)
    blocks_ = index.select("term", cut("last_doc_id"), F.col("last_doc_id").alias("at"), F.lit(0).alias("kind"), none.cast("bigint").alias("target"), F.col("doc_ids").alias("ids"))
    wanted = targets.select("term", cut("target"), F.col("target").alias("at"), F.lit(1).alias("kind"), "target", none.cast("array<bigint>").alias("ids"))
    both = blocks_.unionByName(wanted)
    # the first block of each segment, for the segments before it; segments of targets alone have none
    firsts = both.groupBy("term", "segment").agg(F.min_by("ids", F.when(F.col("kind") == 0, F.col("at"))).alias("first"))
    later = Window.partitionBy("term").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select("term", "segment", F.first("first", True).over(later).alias("carried"))
    # from behind, blocks before targets of the same doc id
    behind = Window.partitionBy("term", "segment").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("own", F.last("ids", True).over(behind)).where("kind = 1").select("term", "segment", "target", "own")
    met = met.join(carried, ["term", "segment"], "left")
    found = F.array_min(F.filter(F.coalesce("own", "carried"), lambda x: x >= F.col("target")))
    return met.select("term", "target", found.alias("doc_id"))


@dataclass
class Index:
    """The tables that a search reads."""

    postings: DataFrame
    lexicon: DataFrame
    page_table: DataFrame
    stats: DataFrame
    docs: DataFrame | None = None
    blocks: DataFrame | None = None  # of a stored index


def build(docs: DataFrame) -> Index:
    """An index as lazy tables over ``docs`` (``doc_id, body`` and maybe ``doc_no, url``)."""
    posted, pages = term_frequencies(docs), page_table(docs)
    return Index(posted, lexicon(posted), pages, corpus_stats(pages), docs)


def save(docs: DataFrame, folder: str) -> None:
    """Write the index: postings, blocks and lexicon range-partitioned and sorted by term, so a search reads few row groups.

    The corpus is tokenised once for the postings and once for the lengths;
    offsets come from the stored blocks.
    """
    spark = docs.sparkSession
    by_term = lambda df: df.repartitionByRange(*(o := [c for c in ("term", "block_no", "doc_id") if c in df.columns])).sortWithinPartitions(*o)
    by_term(postings(docs)).write.mode("overwrite").parquet(f"{folder}/postings")
    by_term(blocks(spark.read.parquet(f"{folder}/postings"))).write.mode("overwrite").parquet(f"{folder}/index_blocks")
    by_term(lexicon_offsets(stored_metadata(spark.read.parquet(f"{folder}/index_blocks")))).write.mode("overwrite").parquet(f"{folder}/lexicon")
    page_table(docs).write.mode("overwrite").parquet(f"{folder}/page_table")
    docs.write.mode("overwrite").parquet(f"{folder}/docs")
    corpus_stats(spark.read.parquet(f"{folder}/page_table")).write.mode("overwrite").parquet(f"{folder}/corpus_stats")


def load(spark: SparkSession, folder: str) -> Index:
    """A saved index."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Index(read("postings"), read("lexicon"), read("page_table"), read("corpus_stats"), read("docs"), read("index_blocks"))


# -- the byte layout ---------------------------------------------------------------------------------------------

STRETCH = 4096  # numbers of a metadata array that stand in one extent
#: The sections of a term's bytes: three metadata arrays, one number per block, then the blocks.
LAST, DOC_SIZES, FREQ_SIZES, BLOCKS = 0, 1, 2, 3


def _arrays(stored: DataFrame, arrays: list[tuple[int, Column]]) -> DataFrame:
    """``term, section, nth, bytes``: a number per block as four bytes each, in stretches of blocks."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("section"), c.cast("bigint").alias("value")) for i, c in arrays]))
    rows = stored.select("term", "block_no", each.alias("x")).select("term", "block_no", "x.*")
    stretch = F.floor(F.col("block_no") / STRETCH).alias("nth")
    packed = rows.groupBy("term", "section", stretch).agg(F.array_sort(F.collect_list(F.struct("block_no", "value"))).alias("x"))
    return packed.select("term", "section", "nth", varbyte.int32_bytes(F.col("x.value")).alias("bytes"))


def list_file(stored: DataFrame) -> DataFrame:
    """The file of inverted lists as extents ``at, term, section, nth, bytes``: at which byte of the file which bytes stand.

    In order of ``at`` they are, term by term, the last doc ids of its blocks,
    the sizes of their coded doc ids and of their frequencies (each number in
    four bytes, high byte first), and then each block's gap-coded doc ids and
    frequencies.  No extent is longer than a block or ``STRETCH`` numbers.
    """
    arrays = _arrays(stored, [(LAST, F.col("last_doc_id")), (DOC_SIZES, F.octet_length("docid_bytes")), (FREQ_SIZES, F.octet_length("freq_bytes"))])
    data = stored.select("term", F.lit(BLOCKS).alias("section"), F.col("block_no").cast("bigint").alias("nth"), F.concat("docid_bytes", "freq_bytes").alias("bytes"))
    return _extents(arrays.unionByName(data), "list-file")


def position_file(stored: DataFrame) -> DataFrame:
    """The file of positions, alike: the sizes of a term's blocks, then their gap-coded positions."""
    data = stored.select("term", F.lit(BLOCKS).alias("section"), F.col("block_no").cast("bigint").alias("nth"), F.col("position_bytes").alias("bytes"))
    return _extents(_arrays(stored, [(DOC_SIZES, F.octet_length("position_bytes"))]).unionByName(data), "position-file")


def _extents(rows: DataFrame, name: str) -> DataFrame:
    sized = rows.withColumn("size", F.octet_length("bytes").cast("bigint"))
    placed = running(sized, ["term", "section", "nth"], {"upto": "size"}, name)
    return placed.select((F.col("upto") - F.col("size")).alias("at"), "term", "section", "nth", "bytes")


def open_lists(file: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``term, block_no, last_doc_id, before, at, doc_size, freq_size``: where each block of the lexicon's terms lies.

    Read from the metadata arrays alone, which stand at the start of a term's
    bytes; ``before`` is the last doc id of the block before.  Nothing of the
    blocks is read, and a cursor skips those that end before its target.
    """
    heads = file.where(F.col("section") < BLOCKS).join(lexicon.select("term", "start", "n_blocks"), "term")
    numbers = heads.select("term", "section", "nth", "start", "n_blocks", varbyte.int32_array("bytes").alias("x"))
    each = numbers.select("term", "section", "start", "n_blocks", "nth", F.posexplode("x").alias("i", "value"))
    at = lambda s: F.max(F.when(F.col("section") == s, F.col("value")))
    rows = each.groupBy("term", (F.col("nth") * STRETCH + F.col("i")).alias("block_no")).agg(
        F.first("start").alias("start"), F.first("n_blocks").alias("n_blocks"),
        at(LAST).alias("last_doc_id"), at(DOC_SIZES).alias("doc_size"), at(FREQ_SIZES).alias("freq_size"))
    # sizes are summed within a stretch and carried over the stretches, of which a term has one per 524,288 postings
    rows = rows.withColumn("stretch", F.floor(F.col("block_no") / STRETCH)).withColumn("size", F.col("doc_size") + F.col("freq_size"))
    totals = rows.groupBy("term", "stretch").agg(F.sum("size").alias("t"), F.max("last_doc_id").alias("last"))
    over = Window.partitionBy("term").orderBy("stretch")
    carried = totals.select("term", "stretch", F.coalesce(F.sum("t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("t0"),
                            F.coalesce(F.lag("last").over(over), F.lit(0)).alias("l0"))
    inside = Window.partitionBy("term", "stretch").orderBy("block_no")
    placed = rows.withColumn("w", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("l", F.lag("last_doc_id").over(inside))
    placed = placed.join(carried, ["term", "stretch"])
    return placed.select("term", F.col("block_no").cast("int").alias("block_no"), "last_doc_id", F.coalesce("l", "l0").alias("before"),
                         (F.col("start") + 12 * F.col("n_blocks") + F.col("t0") + F.col("w") - F.col("size")).alias("at"), "doc_size", "freq_size")


def read_blocks(file: DataFrame, opened: DataFrame, frequencies: bool = True) -> DataFrame:
    """The blocks of ``opened``, decoded: ``term, block_no, at, doc_ids`` and ``tfs``; only their bytes are read.

    Without ``frequencies`` those bytes are never decoded.
    """
    data = file.where(F.col("section") == BLOCKS).select("at", "bytes").join(opened, "at")
    cut = lambda start, size: F.substring(F.col("bytes"), start, size)
    ids = varbyte.decode_gaps(cut(F.lit(1), F.col("doc_size").cast("int")), F.col("before")).alias("doc_ids")
    tfs = [varbyte.decode_array(cut(F.col("doc_size").cast("int") + 1, F.col("freq_size").cast("int"))).alias("tfs")] if frequencies else []
    return data.select("term", "block_no", "at", ids, *tfs)
