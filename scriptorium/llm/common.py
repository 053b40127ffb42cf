"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a local session, where all run on one machine, a new one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables that this process wrote and has not removed yet.
_made: list[tuple[SparkSession, str]] = []


#: Rows that go to Python at a time where a row may be a long text.
FEW_ROWS = 1000


def written(df: DataFrame, label: str, rows_at_a_time: int | None = None) -> DataFrame:
    """Cuts the lineage: df written as Parquet to the shared folder and read back.

    rows_at_a_time bounds the batches that Python functions of df get while it is written.

    Survives the loss of any executor, and gives later plans true file sizes to plan with.
    Results are lazy and may read the table for as long as the session lasts, so it goes when
    the driver's process ends, or earlier by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if rows_at_a_time is not None:
            spark.conf.set(key, rows_at_a_time)
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    for entry in [x for x in _made if x[1] == path]:
        _remove(*entry)
        _made.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _clean() -> None:
    for entry in _made:
        try:
            _remove(*entry)
        except Exception:  # noqa: BLE001  the session may have ended before the process does
            break
    _made.clear()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front where df has such a column (in any case) already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    """Tasks worth having at least: the cluster's cores, as Spark reports them."""
    return max(2, spark.sparkContext.defaultParallelism)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text as a long; null counts 0. Needs no array of words."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{BLANKS}]+", "\x01")
    return F.length(F.regexp_replace(gaps, rf"[{BLANKS}]+", "")).cast("long")


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` inside each `group`, in the order (bucket, order).

    Two levels, so that a group with a third of all rows is no single task: rows are
    summed per (group, bucket), the bucket totals (one row a bucket) are summed along
    the buckets, and each bucket is summed on its own. `bucket` must sort as `order` does.
    """
    from pyspark.sql import Window as W

    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_t"))
    along = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = df.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = F.col(bucket) == F.col("_bucket")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return own.join(starts, match).withColumn(out, F.col("_start") + F.col("_own")).drop("_start", "_own", "_bucket", *[f"_{g}" for g in group])
