"""Tables in the folder that driver and executors share, and joins whose broadcast side is measured first.

Intermediate results are written as Parquet under ``spark.checkpoint.dir`` and read again, so a lost
executor costs its running tasks only and no plan is computed twice. The files go when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.operators.dense import input_bytes, spread  # noqa: F401

#: Most rows of a side that may be broadcast, and most bytes of a column of varying width; larger sides take the
#: shuffled join instead.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32_000_000

#: Rows of a batch that goes to Python; whole texts are large, and a batch lies in memory on both sides.
BATCH_ROWS = 1_000

#: Bytes that a Python task holds of a bucket at once, about.
BUCKET_BYTES = 32_000_000

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one where none is set (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="corpus_")
    return _LOCAL["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores added as it takes to be no name among ``columns``, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, size: int, most: int = BUCKET_BYTES) -> int:
    """How many buckets hold ``size`` bytes at ``most`` each: as many as there are partitions, or a multiple of them."""
    parts = partitions(spark)
    return parts * max(1, -(-size // (parts * most)))


def dealt(df: DataFrame, buckets: int, column: str = "bucket", *order: str) -> DataFrame:
    """Rows dealt out by ``column``, which counts from 0 to ``buckets`` - 1: each partition holds a run of as many
    buckets as the others, in order, so a task may take its buckets one by one and hold one at a time."""
    parts = min(buckets, partitions(df.sparkSession))
    return df.repartitionById(parts, (F.col(column).cast("long") * parts / buckets).cast("int")).sortWithinPartitions(column, *order)


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session set to send Python at most ``BATCH_ROWS`` rows at once (fewer if it is set so)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def keep_rows(docs: DataFrame, key: Column, dropped: DataFrame, repeats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id and ``key`` are a row of ``dropped``, and with one row of each in ``repeats``.

    Both tables are (id, key), nulls equal to nulls; ``docs`` may have columns of any names.
    """
    own, its_id, its_key = free_names(docs.columns, "__key", "__id", "__key2")
    same = [named(id_col).eqNullSafe(F.col(its_id)), F.col(own) == F.col(its_key)]
    dropped, repeats = (materialize(x.toDF(its_id, its_key), "rows") for x in (dropped, repeats))
    left = sized_join(docs.withColumn(own, key), dropped, same, "left_anti")
    if repeats.limit(1).count():
        once = sized_join(left, repeats, same, "left_semi").dropDuplicates([id_col, own])
        left = sized_join(left, repeats, same, "left_anti").unionByName(once)
    return left.drop(own)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def sized_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_ROWS, wide: str | None = None) -> DataFrame:
    """Join with ``right`` broadcast if it has at most ``limit`` rows, else shuffled (sort-merge, split when skewed).

    ``right`` should come from ``materialize``, so that counting it reads file footers only. ``wide``: its column of
    varying width, whose bytes are limited too.
    """
    rows, size = right.agg(F.count(F.lit(1)), F.sum(F.length(wide)) if wide else F.lit(0)).first()
    if rows <= limit and (size or 0) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    else:
        right = right.hint("merge")
    return left.join(right, on, how)
