"""Reading and writing corpora of marked-up text sections, and the text form of the page table and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.text import plain_decimal
from inkwell.storage import materialize

PIECE = 100_000  # lines of a file that are ordered together
FAR = 4096  # pieces whose totals are carried together


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``at, line``: the lines of the files in order of path and place, numbered without gaps.

    LF, CRLF and CR end a line.  The files are read once, into a table in
    which every line has its split and a number that grows within it; the
    numbers of the splits' lines are then carried over the splits, of which
    there are few.  No line goes through Python.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    kept = materialize(read, "lines")
    splits = kept.groupBy("file", "block").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    files = splits.groupBy("file").agg(F.sum("n").alias("n"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    files = files.select("file", F.coalesce(F.sum("n").over(order), zero).alias("of_file"))
    begins = splits.withColumn("of_split", F.coalesce(F.sum("n").over(inside), zero)).join(files, "file")
    begins = begins.select("file", "block", (F.col("of_file") + F.col("of_split") - F.col("first")).alias("shift"))
    return kept.join(begins, ["file", "block"]).select((F.col("nth") + F.col("shift")).alias("at"), "line")


def _carried(totals: DataFrame, value: str, last: bool = False) -> DataFrame:
    """``piece, carried``: the sum of ``value`` over the pieces before each piece, or the last one that isn't null.

    Summed within ``FAR`` pieces and over their totals, so that the longest
    window has a row per ``FAR`` pieces.
    """
    far = totals.withColumn("far", F.floor(F.col("piece") / FAR))
    seen = F.col(value).isNotNull()
    of_far = far.groupBy("far").agg((F.max_by(value, F.when(seen, F.col("piece"))) if last else F.sum(value)).alias("x"))
    over = (lambda c, w: F.last(c, True).over(w)) if last else (lambda c, w: F.sum(c).over(w))
    before = of_far.select("far", over("x", Window.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)).alias("x"))
    inside = Window.partitionBy("far").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    both = far.withColumn("y", over(value, inside)).join(before, "far")
    carried = F.coalesce("y", "x") if last else F.coalesce("y", F.lit(0)) + F.coalesce("x", F.lit(0))
    return both.select("piece", carried.alias("carried"))


def _piece() -> F.Column:
    return F.floor(F.col("at") / PIECE).alias("piece")


def sections(numbered: DataFrame) -> DataFrame:
    """``doc_id, doc_no, url, body`` of ``at, line``.

    A line equal to ``<DOC>`` outside a section is followed by the number
    line; one equal to ``<TEXT>`` begins a section whose first line is the
    url; one equal to ``</TEXT>`` ends it.  Markers count only as whole lines,
    and inside a section only the end counts.  Sections are numbered from 0 in
    order; a section without number line has that of the document before.  A
    section that the file's end cuts off is dropped.

    Which lines open and end sections is found on the lines with angle
    brackets alone; all lines are exchanged twice, to follow their section's
    opening and to meet in it.
    """
    tagged = materialize(numbered.where("contains(line, '<') OR contains(line, '>')"), "tags")
    signs = _ends_before(tagged.where(F.col("line").isin("<TEXT>", "</TEXT>", "<DOC>")))
    opens = signs.where("line = '<TEXT>'").groupBy("n").agg(F.min("at").alias("open"))
    ends = signs.where("line = '</TEXT>'").select("n", F.col("at").alias("close"))
    spans = opens.join(ends, "n").where("open < close")
    docs = signs.where("line = '<DOC>'").join(opens, "n", "left").where("open IS NULL OR at < open")
    number = tagged.select((F.col("at") - 1).alias("at"), F.regexp_extract("line", "^[<>]*[^<>]+[<>]+([^<>]+)", 1).alias("doc_no"))
    numbers = docs.select("at").join(number, "at", "left").select("at", F.coalesce("doc_no", F.lit("")).alias("doc_no"))
    headers = materialize(_headed(spans, numbers), "sections")
    # every line with the section that was opened last before it
    rows = numbered.select("at", "line", F.lit(None).cast("struct<doc_id:bigint,doc_no:string,open:bigint,close:bigint>").alias("s")).unionByName(
        headers.select(F.col("open").alias("at"), F.lit(None).cast("string").alias("line"), F.struct("doc_id", "doc_no", "open", "close").alias("s")))
    rows = rows.select("at", "line", "s", _piece())
    # pieces in which no section opens have a total too, so that each line finds its carried one
    totals = rows.groupBy("piece").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("at"))).alias("s"))
    upto = Window.partitionBy("piece").orderBy("at", F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("own", F.last("s", True).over(upto)).join(_carried(totals, "s", last=True), "piece")
    placed = placed.select("at", "line", F.coalesce("own", "carried").alias("d"), F.col("s").isNotNull().alias("head"))
    inside = placed.where("d IS NOT NULL AND (head OR line IS NOT NULL AND at > d.open AND at < d.close)")
    each = F.when(~F.col("head"), F.struct("at", "line"))
    texts = inside.groupBy(F.col("d.doc_id").alias("doc_id"), F.col("d.doc_no").alias("doc_no")).agg(F.array_sort(F.collect_list(each)).alias("x"))
    return texts.select("doc_id", "doc_no", F.get("x.line", F.lit(0)).alias("url"),
                        F.array_join(F.slice("x.line", 2, F.greatest(F.size("x") - 1, F.lit(0))), "\n").alias("body"))


def _ends_before(signs: DataFrame) -> DataFrame:
    """The marker lines with ``n``: section ends before each."""
    rows = signs.select("at", "line", _piece(), F.when(F.col("line") == "</TEXT>", 1).otherwise(0).alias("e"))
    before = Window.partitionBy("piece").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(rows.groupBy("piece").agg(F.sum("e").alias("e")), "e")
    counted = rows.withColumn("w", F.coalesce(F.sum("e").over(before), F.lit(0))).join(carried, "piece")
    return counted.select("at", "line", (F.col("w") + F.col("carried")).alias("n"))


def _headed(spans: DataFrame, numbers: DataFrame) -> DataFrame:
    """``doc_id, doc_no, open, close``: the sections numbered in order, each with the latest number line before it."""
    none = lambda kind: F.lit(None).cast(kind)
    both = spans.select(F.col("open").alias("at"), "close", none("string").alias("doc_no")).unionByName(
        numbers.select("at", none("bigint").alias("close"), "doc_no")).select("at", "close", "doc_no", _piece())
    is_open = F.when(F.col("close").isNotNull(), 1).otherwise(0)
    totals = both.groupBy("piece").agg(F.sum(is_open).alias("n"), F.max_by("doc_no", F.when(F.col("doc_no").isNotNull(), F.col("at"))).alias("d"))
    ids = _carried(totals, "n").withColumnRenamed("carried", "n0")
    last = _carried(totals, "d", last=True).withColumnRenamed("carried", "d0")
    upto = Window.partitionBy("piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("own", F.last("doc_no", True).over(upto)).withColumn("w", F.sum(is_open).over(upto)).where("close IS NOT NULL")
    return placed.join(ids, "piece").join(last, "piece").select(
        (F.col("n0") + F.col("w") - 1).alias("doc_id"), F.coalesce("own", "d0").alias("doc_no"), F.col("at").alias("open"), "close")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, doc_no, url, body`` of corpus files."""
    return sections(lines(spark, path))


def to_corpus_text(docs: DataFrame) -> DataFrame:
    """``value``: each document of ``doc_id, doc_no, url, body`` as the lines of its section, ordered by doc id."""
    parts = [F.lit("<DOC>"), F.concat(F.lit("<DOCNO>"), F.coalesce("doc_no", F.lit("")), F.lit("</DOCNO>")), F.lit("<TEXT>"),
             F.coalesce("url", F.lit("")), F.when(F.col("body") != "", F.col("body")), F.lit("</TEXT>"), F.lit("</DOC>")]
    return docs.sort("doc_id").select(F.concat_ws("\n", *parts).alias("value"))


def write_corpus(docs: DataFrame, path: str) -> None:
    to_corpus_text(docs).write.mode("overwrite").text(path)


def write_page_table(page_table: DataFrame, path: str) -> None:
    """A line ``url doc_no doc_len`` per document in order of doc ids; then a blank line, the total length and the number of documents.

    One text, in the order of its part files.
    """
    line = F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("doc_no", F.lit("")), F.col("doc_len").cast("string"))
    totals = page_table.agg(F.coalesce(F.sum("doc_len"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n"))
    trailer = totals.select(F.posexplode(F.array(F.lit(""), F.col("t").cast("string"), F.col("n").cast("string"))).alias("i", "value"))
    pages = page_table.select(F.lit(0).alias("k"), F.col("doc_id").alias("i"), line.alias("value"))
    text = pages.unionByName(trailer.select(F.lit(1).alias("k"), F.col("i").cast("bigint").alias("i"), "value"))
    text.sort("k", "i").select("value").write.mode("overwrite").text(path)


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, url, doc_no, doc_len`` of such a text; doc ids are the places of the lines, which leave out none."""
    m = lambda i: F.regexp_extract("line", r"^(.*) (\S*) (\d+)$", i)
    return lines(spark, path).where(m(3) != "").select(F.col("at").alias("doc_id"), m(1).alias("url"), m(2).alias("doc_no"), m(3).cast("int").alias("doc_len"))


def read_page_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row ``total_len, n_docs`` from the end of such a text; it is checked by ``n_docs`` lines before."""
    rest = lines(spark, path).where(F.col("line").rlike(r"^\d*$"))
    two = rest.agg(F.max("at").alias("last"), F.max_by("line", "at").alias("n"), F.max_by("line", F.when(F.col("line") != "", -F.col("at"))).alias("t"))
    return two.where((F.col("last") - 2) == F.col("n").try_cast("bigint")).select(F.col("t").cast("bigint").alias("total_len"), F.col("n").cast("bigint").alias("n_docs"))


def run_lines(postings: DataFrame) -> DataFrame:
    """``value``: the text form of single postings, ``word doc,pos,pos…``; null words have no line."""
    positions = F.array_join(F.col("positions").cast("array<string>"), ",")
    return postings.where("term IS NOT NULL").select(
        F.concat(F.col("term"), F.lit(" "), F.concat_ws(",", F.col("doc_id").cast("string"), F.when(positions != "", positions))).alias("value"))


def write_run_lines(postings: DataFrame, path: str) -> None:
    """Sorted by word and doc id, a file per range of words."""
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").transform(run_lines).write.mode("overwrite").text(path)


def section_offsets(numbered: DataFrame) -> DataFrame:
    """``at, end_byte``: where the line end of each ``</TEXT>`` line lies, for UTF-8 text with one byte per line end.

    Only sizes are exchanged: bytes are summed per piece of lines and carried over the piece totals.
    """
    sized = numbered.select("at", (F.col("line") == "</TEXT>").alias("ends"), (F.octet_length("line") + 1).alias("bytes"), _piece())
    carried = _carried(sized.groupBy("piece").agg(F.sum("bytes").alias("b")), "b")
    inside = Window.partitionBy("piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = sized.withColumn("w", F.sum("bytes").over(inside)).where("ends").join(carried, "piece")
    return ends.select("at", (F.col("carried") + F.col("w") - 1).alias("end_byte"))


def merged_lines(postings: DataFrame) -> DataFrame:
    """``term, value``: the inverted list of each word as a line of text, ``word doc,pos,… doc,pos,…``.

    A line is as long as its word's list, but is put together from runs of
    65,536 doc ids, so that no task sorts the whole list of a hot word.
    """
    one = F.concat_ws(",", F.col("doc_id").cast("string"), F.array_join(F.col("positions").cast("array<string>"), ","))
    runs = postings.groupBy("term", F.floor(F.col("doc_id") / (1 << 16)).alias("run")).agg(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("s")))).alias("x"))
    runs = runs.select("term", "run", F.array_join("x.s", " ").alias("s"))
    whole = runs.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("run", "s"))).alias("x"))
    return whole.select("term", F.concat_ws(" ", F.col("term"), F.array_join("x.s", " ")).alias("value"))


def write_merged_lines(postings: DataFrame, path: str) -> None:
    """The lists in order of words."""
    merged_lines(postings).sort("term").select("value").write.mode("overwrite").text(path)


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """A line ``word df start end pos_start pos_end`` per word, in order of words."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("term", "df", "start", "end", "pos_start", "pos_end")])
    lexicon.sort("term").select(line.alias("value")).write.mode("overwrite").text(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``term, df, start, end, pos_start, pos_end`` of such a text."""
    part = F.split("value", " ")
    names = ("df", "start", "end", "pos_start", "pos_end")
    # a word can hold no space, as spaces part the words of a text
    return spark.read.text(path).select(part[0].alias("term"), *[part[i].cast("bigint").alias(c) for i, c in enumerate(names, 1)])


def write_ranks(ranks: DataFrame, path: str) -> None:
    """One plain decimal per line in order of doc ids."""
    ranks.sort("doc_id").select(plain_decimal("rank").alias("value")).write.mode("overwrite").text(path)


def parse_run_lines(run_lines: DataFrame) -> DataFrame:
    """``word, doc_id, positions`` of ``value`` lines ``word doc,pos,pos…``; other lines are dropped."""
    m = lambda i: F.regexp_extract("value", r"^(\S+) (\d+)((?:,\d+)*)$", i)
    rest = F.filter(F.split(m(3), ","), lambda x: x != "").cast("array<int>")
    return run_lines.select(m(1).alias("word"), m(2).alias("d"), rest.alias("positions")).where("word <> ''").select("word", F.col("d").cast("bigint").alias("doc_id"), "positions")
