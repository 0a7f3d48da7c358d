"""Lines repeated across the pages of one site, kept as incremental counts.

A kept table has, per site and normalised line (as a 128-bit digest of both),
on how many pages it stands.  A new partition of pages is counted alone
(``delta``) and merged into the counts of the sites it has pages of; the keys
whose count passed the threshold by the merge (``newly``) select the earlier
pages to rebuild.  All other pages and sites are neither read nor written.

On disk, ``SiteLines`` is a folder: ``lines``, ``texts``, ``removed`` and
``clean`` grow by a version per partition, ``counts`` has new versions of the
buckets of sites that changed, and a manifest per version names the files that
hold, so a run that dies half-way leaves the version before as it was.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import digest, lines_of
from inkwell.storage import materialize, new_path

MIN_PAGES = 5
BUCKETS = 8  # of sites; a larger corpus has more
KEY = ["bucket", "k1", "k2"]
WHERE = ["doc_id", "line_no"]


def normalized(line: Column) -> Column:
    """Runs of spaces, tabs, CRs, LFs and no-break spaces as one space, digit runs as one sign, trimmed, lower case."""
    flat = F.regexp_replace(line, "[ \\t\\r\\n\\u00a0]+", " ")
    return F.lower(F.trim(F.regexp_replace(flat, "[0-9]+", "0")))


def bucketed(pages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, bucket, site, fetched_at``: pages with the bucket of their site; those without a site have a bucket of their own."""
    bucket = F.when(F.col("site").isNull(), buckets).otherwise(F.pmod(F.xxhash64("site"), F.lit(buckets))).cast("int")
    return pages.select("doc_id", bucket.alias("bucket"), "site", "fetched_at")


def keyed_lines(trec_line: DataFrame, placed: DataFrame) -> DataFrame:
    """``doc_id, line_no, bucket, k1, k2, first, fetched_at`` of every line that can count; ``placed`` are ``bucketed`` pages.

    ``first`` is 1 for the first line of its key on a page and 0 for others,
    so that pages are counted by a sum.  Null lines, lines empty after
    normalising and pages without a site don't count; a row delivered twice is
    one line.  Only digests travel, not texts, and all of it is one exchange
    by page.
    """
    text = trec_line.select("doc_id", "line_no", normalized(F.col("line")).alias("line")).where("line <> ''")
    keys = text.select("doc_id", "line_no", *digest(F.col("line"), names=("l1", "l2")))
    keyed = keys.join(placed.where("site IS NOT NULL"), "doc_id").select(
        "doc_id", "line_no", "bucket", F.xxhash64("site", "l1").alias("k1"), F.xxhash64("l2", "site", F.lit(977)).alias("k2"), "fetched_at").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id", "k1", "k2").orderBy("line_no")) == 1
    return keyed.withColumn("first", first.cast("int"))


def delta(keyed: DataFrame) -> DataFrame:
    """Page counts of one partition of pages: ``bucket, k1, k2, n_pages``."""
    return keyed.groupBy(*KEY).agg(F.sum("first").alias("n_pages"))


def merge(state: DataFrame | None, added: DataFrame) -> DataFrame:
    """``bucket, k1, k2, was, n_pages``: a partition's counts added to the state.

    The pages of a partition must not have been counted before: a page that
    is delivered again belongs to its first partition.
    """
    zero = F.lit(0).cast("bigint")
    new = added.select(*KEY, zero.alias("was"), F.col("n_pages").alias("plus"))
    if state is not None:
        new = new.unionByName(state.select(*KEY, F.col("n_pages").alias("was"), zero.alias("plus")))
    both = new.groupBy(*KEY).agg(F.sum("was").alias("was"), F.sum("plus").alias("plus"))
    return both.select(*KEY, "was", (F.col("was") + F.col("plus")).alias("n_pages"))


@dataclass
class Update:
    """What a partition did: its version, the buckets it has pages of, and those where keys newly crossed the threshold."""

    version: int
    touched: list[int]
    crossing: list[int]


class SiteLines:
    """The kept tables in a folder, opened at their last version or begun anew."""

    def __init__(self, spark: SparkSession, path: str, min_pages: int = MIN_PAGES):
        self.spark, self.path, self.min_pages = spark, path.rstrip("/"), min_pages
        self.version, self._counts, self._buckets = 0, {}, {}  # counts: bucket → version; buckets: version → table → buckets
        self._unkept: list[DataFrame] = []  # partitions whose lines stay with the caller
        if self._exists(f"{self.path}/manifest"):
            said = [json.loads(r.value) for r in spark.read.text(f"{self.path}/manifest/*").collect()]  # a row per version
            last = max(said, key=lambda x: x["version"])
            self.version = last["version"]
            self._counts = {int(b): v for b, v in last["counts"].items()}
            self._buckets = {int(v): b for v, b in last["buckets"].items()}

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _read(self, table: str, versions: list[int], buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of some versions of a table, of the given buckets only: no other file is opened."""
        paths = [f"{self.path}/{table}/version={v}" for v in versions]
        paths = [f"{p}/bucket={b}" for v, p in zip(versions, paths, strict=True) for b in self._of(table, v) if buckets is None or b in buckets]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*paths).drop("version")

    def _of(self, table: str, version: int) -> list[int]:
        return self._buckets.get(version, {}).get(table, [])

    def _write(self, df: DataFrame, table: str, version: int) -> None:
        """One version of a table, partitioned by bucket; which buckets it has, at most as many as there are, is remembered."""
        where = f"{self.path}/{table}/version={version}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(where)
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        listed = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs_path)
        names = [x.getPath().getName() for x in listed]
        self._buckets.setdefault(version, {})[table] = sorted(int(n[7:]) for n in names if n.startswith("bucket="))

    def stage(self, keyed: DataFrame, part: Column) -> list[DataFrame]:
        """Partitions of pages written in one go, before they are added one after the other; ``part`` is 0 or 1."""
        where, parted = f"{self.path}/staged", keyed.withColumn("part", part)
        parted.write.mode("overwrite").option("compression", "zstd").partitionBy("part", "bucket").parquet(where)
        rows = self.spark.read.schema(parted.schema).parquet(where)
        return [rows.where(F.col("part") == i).drop("part") for i in (0, 1)]

    def add(self, keyed: DataFrame, texts: DataFrame | None = None, keep: bool = True) -> Update:
        """Count a new partition of pages (``keyed_lines``), and find what must go from it and from earlier pages.

        With ``texts`` (``doc_id, bucket, line_no, line``) the clean lines of
        the new pages and of the earlier ones with newly crossed lines are
        written, and of no others.  ``keep=False`` is for rows that are stored
        where ``keyed`` reads them and stay there.
        """
        new = self.version + 1
        if keep:
            self._write(keyed.select(*WHERE, *KEY, "first"), "lines", new)
            keyed = self._read("lines", [new])
        else:
            self._unkept.append(keyed)
        # at most as many rows as there are buckets
        touched = sorted(r["bucket"] for r in keyed.select("bucket").distinct().collect()) if keyed is not None else []
        newly_in: list[int] = []
        if touched:
            plus = delta(keyed)
            known = {b: self._counts[b] for b in touched if b in self._counts}
            old = [self._read("counts", [v], [b]) for b, v in known.items()]
            self._write(merge(reduce(DataFrame.unionByName, old) if old else None, plus), "counts", new)
            self._counts |= dict.fromkeys(touched, new)
            counts = self._read("counts", [new])
            over = counts.where(F.col("n_pages") >= self.min_pages)
            newly = over.where(F.col("was").between(1, self.min_pages - 1))  # keys that no earlier page has select none
            newly_in = sorted(r["bucket"] for r in newly.select("bucket").distinct().collect())
            gone = keyed.join(over.select(*KEY), KEY, "left_semi").select(*WHERE, "bucket")
            earlier = self._lines_before(new, newly_in)
            if earlier is not None:
                gone = gone.unionByName(earlier.join(newly.select(*KEY), KEY, "left_semi").select(*WHERE, "bucket"))
            self._write(gone, "removed", new)
        if texts is not None:
            self._write(texts.select(*WHERE, "line", "bucket"), "texts", new)
            self._rebuild(new, newly_in)
        self.version = new
        said = json.dumps({"version": new, "counts": self._counts, "buckets": self._buckets})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/version={new}")
        return Update(new, touched, newly_in)

    def _lines_before(self, version: int, buckets: list[int]) -> DataFrame | None:
        kept = self._read("lines", list(range(1, version)), buckets)
        unkept = [x.where(F.col("bucket").isin(buckets)) for x in self._unkept[:-1]] if buckets else []
        all_ = [x.select(*WHERE, *KEY) for x in ([kept] if kept is not None else []) + unkept]
        return reduce(DataFrame.unionByName, all_) if all_ else None

    def _rebuild(self, version: int, crossing: list[int]) -> None:
        """The clean lines of a version's own pages, and of the earlier pages that lose lines by it."""
        rows = self._read("texts", [version])
        gone = self._read("removed", [version])
        own = rows if gone is None or rows is None else rows.join(gone.select(*WHERE), WHERE, "left_anti")
        changed = None
        if gone is not None and crossing:
            earlier = self._read("texts", list(range(1, version)), crossing)
            if earlier is not None:
                # pages of this version are in no earlier one, so these are the earlier pages that lose lines now
                changed = gone.where(F.col("bucket").isin(crossing)).select("doc_id", "bucket").distinct().join(
                    earlier.select("doc_id").distinct(), "doc_id", "left_semi")
                gone_before = self._read("removed", list(range(1, version + 1)), crossing)
                rebuilt = earlier.join(changed.select("doc_id"), "doc_id", "left_semi").join(gone_before.select(*WHERE), WHERE, "left_anti")
                own = rebuilt if own is None else own.unionByName(rebuilt)
        if own is not None:
            self._write(own.select(*WHERE, "line", "bucket"), "clean", version)
        if changed is not None:
            self._write(changed, "rebuilt", version)

    def repeated(self) -> DataFrame | None:
        """``doc_id, line_no`` of all lines that have to go so far."""
        found = self._read("removed", list(range(1, self.version + 1)))
        return found.select(*WHERE) if found is not None else None

    def clean(self) -> DataFrame | None:
        """``doc_id, line_no, line`` of every page as it was last written."""
        layers = []
        for v in range(1, self.version + 1):
            rows, again = self._read("clean", [v]), self._read("rebuilt", list(range(v + 1, self.version + 1)))
            if rows is not None:
                rows = rows if again is None else rows.join(again.select("doc_id").distinct(), "doc_id", "left_anti")
                layers.append(rows.select(*WHERE, "line"))
        return reduce(DataFrame.unionByName, layers) if layers else None


def _later(pages: DataFrame) -> Column:
    """1 for pages fetched after the median time or at no known one, else 0."""
    middle = pages.agg(F.percentile_approx("fetched_at", 0.5)).first()[0]
    return F.when(F.col("fetched_at") <= F.lit(middle), 0).otherwise(1) if middle is not None else F.lit(1)


def _none(spark: SparkSession, columns: str) -> DataFrame:
    return spark.createDataFrame([], columns)


def repeated_lines(trec_line: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``doc_id, line_no`` of lines that stand on at least ``min_pages`` pages of their site.

    The pages come in two partitions, those fetched up to the median time and
    the later ones, so that each call goes the whole way of a merge: earlier
    pages are looked at again only for keys that the second partition made
    cross.  The result is the same for any partitioning.  Null and blank
    lines, rows without a page and pages without a site or page row are in no
    result; rows delivered twice are one line; pages without a fetch time come
    with the later ones; empty tables give no rows.
    """
    spark = trec_line.sparkSession
    store = SiteLines(spark, new_path(spark, "site-lines"), min_pages)
    placed = materialize(bucketed(pages), "pages")  # used twice
    for part in store.stage(keyed_lines(trec_line, placed), _later(placed)):
        store.add(part, keep=False)
    found = store.repeated()
    return found if found is not None else _none(spark, "doc_id bigint, line_no int")


def clean_lines(trec_line: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``doc_id, line_no, line`` of every page without its repeated lines, in the same two partitions.

    The second partition rewrites only those pages of the first that lose
    lines by it.  Null and blank lines and pages without a site or page row
    stay as they are; of two deliveries of a line the larger text counts.
    """
    spark = trec_line.sparkSession
    store = SiteLines(spark, new_path(spark, "site-lines"), min_pages)
    placed = materialize(bucketed(pages), "pages")
    later = _later(placed)
    texts = lines_of(trec_line).join(placed.select("doc_id", "bucket", "fetched_at"), "doc_id", "left")
    texts = store_texts(spark, texts.withColumn("bucket", F.coalesce("bucket", F.lit(BUCKETS))).withColumn("part", later))
    for i, part in enumerate(store.stage(keyed_lines(trec_line, placed), later)):
        store.add(part, texts.where(F.col("part") == i), keep=False)
    got = store.clean()
    return got if got is not None else _none(spark, "doc_id bigint, line_no int, line string")


def store_texts(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Texts of both partitions, written once, each to a folder of its own."""
    path = new_path(spark, "site-texts")
    texts.write.option("compression", "zstd").partitionBy("part").parquet(path)
    return spark.read.schema(texts.schema).parquet(path)
