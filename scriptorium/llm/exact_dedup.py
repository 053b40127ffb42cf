"""Exact deduplication by distributed most-significant-digit radix partitioning.

A digit is a block of successive bytes of the normalised text. The first one (FIRST bytes)
splits all documents: digits are counted where they are read, and only digits and counts are
shuffled. Then documents meet the counts, either because Spark broadcasts the digits that come
more than once, or, where these are too many, by moving each text once. A document whose digit
no other has is done. The others keep what is left of their bytes and are split again, inside
their group, by the next digit, which is GROWTH times as wide as the one before, until a group
has one document or all its texts have ended. The documents of a group whose texts ended with the same digit have had
equal bytes all along: equality is the comparison of all bytes, and no digest takes part in it.

Digits widen so that a text of n bytes takes log(n) rounds. A group of copies of any size is no
single task's: its digits are counted per task first, and the counts come back by a join that
Spark broadcasts or splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, free_names, written

#: Bytes of the first digit, and by how much each further one is wider. One in five texts of the test corpora shares its first 128 bytes with another.
FIRST, GROWTH = 128, 8
#: Wide enough for any text's rest.
_REST = 2**31 - 1


def normal_form(text: Column) -> Column:
    """The text with each run of ASCII white space as one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{BLANKS}]+", " ")


def _digit(rest: str, width: int) -> list[Column]:
    return [F.substring(F.col(rest), 1, width).alias("digit"), (F.octet_length(F.col(rest)) <= width).alias("ended")]


def mark_copies(docs: DataFrame, keep: tuple[str, ...] = (), first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """Every row's class of equal texts: doc_id, keep_id, group_size, kept, text_sha256, and the columns `keep` of docs.

    Of equal texts the row with the smallest doc_id stays; of several with that id one does,
    whichever was read first. A null id is greater than all others, and keep_id is null where
    all ids of a group are. Null and empty texts are equal to each other; a text of blanks
    alone is the text of one blank. An empty table gives no rows; further columns, of any
    name, take no part (`keep` returns them, under a free name where it clashes).
    """
    taken = {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}
    spark = docs.sparkSession
    of = docs.select(F.col("doc_id"), normal_form(F.col("text")).cast("binary").alias("bytes"), F.struct(*[docs[f"`{c}`"] for c in keep] or [F.lit(0)]).alias("own"))
    digits = of.select("doc_id", "own", "bytes", *_digit("bytes", first))
    groups = digits.groupBy("digit", "ended").agg(F.count("*").alias("n")).where("n > 1").select("digit", "ended", F.monotonically_increasing_id().alias("class"))
    groups = written(groups, "radix-groups")
    met = digits.join(groups, ["digit", "ended"], "left")
    rest = F.when(F.col("class").isNotNull(), F.expr(f"substring(bytes, {first + 1}, {_REST})"))
    start = met.select(F.monotonically_increasing_id().alias("row"), "doc_id", "own", F.sha2("bytes", 256).alias("sha"), "class", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("least_id"), F.lit(True).alias("kept"), rest.alias("rest"))
    tables, width = [written(start, "radix-1")], first
    while not (left := tables[-1].where("rest IS NOT NULL")).isEmpty():
        tables.append(_split(left, width := min(width * growth, _REST // growth), len(tables) + 1))
    done = tables[0].where("rest IS NULL")
    for t in tables[1:]:
        done = done.unionByName(t.where("rest IS NULL"))
    names = dict(zip(keep, free_names(spark.createDataFrame([], ", ".join(f"`{c}` int" for c in sorted(taken))), *keep), strict=True))
    own = [F.col("own")[c].alias(names[c]) for c in keep]
    return done.select("doc_id", F.col("least_id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"), *own)


def _split(left: DataFrame, width: int, number: int) -> DataFrame:
    """One more digit: groups are split by it, and rows of single or ended groups are done (their rest is null)."""
    cut = left.select("row", "doc_id", "own", "sha", "class", "rest", *_digit("rest", width))
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    groups = cut.groupBy("class", "digit", "ended").agg(F.count("*").alias("n"), first_of.alias("least")).where("n > 1")
    groups = written(groups, f"radix-groups-{number}")
    met = cut.join(groups, ["class", "digit", "ended"], "left")
    single = F.col("n").isNull()
    rest = F.when(~single & ~F.col("ended"), F.expr(f"substring(rest, {width + 1}, {_REST})"))
    out = met.select(
        "row", "doc_id", "own", "sha", F.coalesce("least.row", "row").alias("class"), F.coalesce("n", F.lit(1).cast("long")).alias("n"),
        F.when(single, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("least_id"), (single | (F.col("least.row") == F.col("row"))).alias("kept"), rest.alias("rest"),
    )
    return written(out, f"radix-{number}")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns; rows and columns as `mark_copies` says."""
    (row,) = free_names(docs, "whole_row")
    whole = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(row))
    return mark_copies(whole, keep=(row,), **options).where("kept").select(f"{row}.*")
