"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a folder of its own;
    on a cluster that folder would be another one on every machine, so it is
    an error there.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="inkwell-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, cleared when the driver ends."""
    path = f"{shared_dir(spark)}/inkwell/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The files survive the loss of an executor and are far smaller than a
    checkpointed RDD; they are deleted when the driver ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._inkwell_path = path
    return table


def discard(table: DataFrame | None) -> None:
    """Delete a table that ``materialize`` returned and that no plan reads any more."""
    path = getattr(table, "_inkwell_path", None) if table is not None else None
    if path:
        _delete(table.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_tables() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and its folder's owner clears it
            pass
    _made.clear()
