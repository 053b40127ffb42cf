"""Reading corpora (SC1-SC4, P1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import normalized_rows, relative_source, strip


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by a hash of keys where the source comes in fewer splits than twice the cores, as one file of one row group does; else as they are.

    Larger sources have splits enough and are never shuffled.
    """
    wanted = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted, F.xxhash64(*keys)) if rows.rdd.getNumPartitions() < wanted else rows


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """SC1, SC2, SC4: (source, text) of the `*.txt` files right below a directory; text is null where it is no UTF-8. A missing directory is empty."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "source string, text string")
    # many small files are packed into splits by size; a split a file would be a task a file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").load(path)
    return files.select(relative_source(F.col("path"), path).alias("source"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def scan_documents(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(source, text) of a Parquet table, one row a document."""
    return spread(spark.read.parquet(path).select(F.col(key).cast("string").alias("source"), F.col(text).alias("text")), "source")


def usable(files: DataFrame) -> DataFrame:
    """SC2, SC3, P1: (source, text) of decoded, non-blank files, normalised. A blank text is empty once normalised, so each is looked at once."""
    return files.where("text IS NOT NULL").select("source", "text").mapInArrow(normalized_rows, "source string, text string").where("text <> ''")


def skipped(files: DataFrame) -> DataFrame:
    """SC2, SC3, A13, S6: (source, reason) of the files that are left out."""
    reason = F.when(F.col("text").isNull(), "not UTF-8").when(strip(F.col("text")) == "", "empty")
    return files.select("source", reason.alias("reason")).where("reason IS NOT NULL")
