"""What filters remove in every order of application, and how they overlap, from one pass of failure marks.

Duplicates are found by sorting: rows are range-partitioned by (text fingerprint, doc_id), so
that a group of copies of any size is cut into ranges of ids, and sorted inside a partition by
fingerprint, full text and doc_id. Each row is held against its predecessor. Only a
partition's first fingerprint can go on from the partition before; for the groups at both
edges of every partition (two a partition, but for fingerprints that collide) the least id and
the text are written apart and compared by full text. Range bounds come from a sample of
fingerprints and ids; texts never go to the driver.

The other filters are told in the same pass. A row's five failures are a mask of five bits, and
rows are summed to (part, mask) counters, at most 32 a part. All 120 orders and their steps
are sums over those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, written

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: The filters' limits.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NO_CAPITALS = bytes(b for b in range(256) if b not in _CAPITALS)
#: Bytes that go on a character in UTF-8.
_INSIDE = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Filters A to D on a text in UTF-8: too few words, too few distinct ones, too many capitals, odd signs."""
    words = text.split()
    capitals, points = len(text.translate(None, _NO_CAPITALS)), len(text.translate(None, _INSIDE))
    return (
        BIT["A"] * (len(words) < LEAST_WORDS)
        | BIT["B"] * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
        | BIT["C"] * (100 * capitals > CAPITALS_PERCENT * points)
        | BIT["D"] * (len(text.translate(None, SIGNS)) < len(text))
    )


def _marker(id_type: pa.DataType):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (fp, text, doc_id, part) to marks; rows without `mask` are the groups at the partition's edges."""
        here = TaskContext.get().partitionId()
        schema = pa.schema([("doc_id", id_type), ("part", pa.string()), ("mask", pa.int32()), ("place", pa.int32()), ("number", pa.int64()), ("fp", pa.int64()), ("text", pa.binary())])
        first_fp = fp = text = least = mask = None
        number, begun, edges = -1, False, []  # edges: [number, fp, text, least id] of the first fingerprint's groups, then of the current one's
        kept_edges = []
        for batch in batches:
            out = []
            for f, t, i, part in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not begun or f != fp or t != text:
                    if begun and f != fp:
                        if fp == first_fp:
                            kept_edges = edges
                        edges = []
                    first_fp = first_fp if begun else f
                    fp, text, least, mask, begun, number = f, t, None, text_mask(t), True, number + 1
                    edges.append([number, f, t, None])
                if least is None and i is not None:
                    least = edges[-1][3] = i
                copy = i is not None and i > least
                # the least id's rows of the first fingerprint may have a smaller one in an earlier partition
                open_ = f == first_fp and i is not None and not copy
                out.append((i, part, mask | BIT["E"] * copy, here if open_ else None, number if open_ else None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        for e in [*kept_edges, *edges]:
            if e[3] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((e[3], None, None, here, e[0], e[1], e[2]), schema.types, strict=True)], schema=schema)

    return mark


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of docs: part is its lang (null: empty), mask the sum of the BITs of the filters that it fails.

    Null texts count as empty ones, which fail A alone and are copies of each other. A row fails
    E where a smaller doc_id has the same text; rows that repeat an id do not fail by each other,
    and null ids are neither smaller nor greater than any. An empty table gives no rows;
    further columns, of any name, take no part.
    """
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(body).alias("fp"), body.cast("binary").alias("text"), "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.monotonically_increasing_id().alias("tie"))
    placed = rows.repartitionByRange("fp", "doc_id", "tie").sortWithinPartitions("fp", "text", "doc_id").select("fp", "text", "doc_id", "part")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, part string, mask int, place int, number long, fp long, text binary"
    found = written(placed.mapInArrow(_marker(to_arrow_type(kind)), schema), "audit-marks", rows_at_a_time=FEW_ROWS)
    edges, marks = found.where("mask IS NULL"), found.where("mask IS NOT NULL")
    least = edges.groupBy("fp", "text").agg(F.min("doc_id").alias("first_id"))
    settled = edges.join(least, ["fp", "text"]).select("place", "number", "first_id")
    late = marks.where("place IS NOT NULL").join(settled, ["place", "number"])
    copy = F.when(F.col("doc_id") > F.col("first_id"), F.lit(BIT["E"])).otherwise(0)
    sure = marks.where("place IS NULL").select("doc_id", "part", "mask")
    return sure.unionByName(late.select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask")))


def counters(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of a part with a mask, and those that labels call good (quality 1) and toxic (toxic 1).

    An id with several rows in labels is good, or toxic, if one of them says so; null ids have
    no labels. Rows are summed by id, part and mask before they meet the labels.
    """
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    each = marks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(told, "doc_id", "left")
    some = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))


def every_order(cells: DataFrame) -> DataFrame:
    """The report of `audit` from the counters."""
    steps = [(order, k + 1, BIT[f], sum(BIT[x] for x in order[:k])) for order in map("".join, permutations(FILTERS)) for k, f in enumerate(order)]
    told = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k},"own":{b},"before":{p}}}' for o, k, b, p in steps) + "]"), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = cells.select("*", F.explode(told).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    # of all orders, each of a row's failures comes first equally often
    share = F.sum(F.when(fails, F.expr(f"n * {factorial(len(FILTERS))} div bit_count(mask)")).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, as longs.

    Rows, nulls and repeats count as `failures` and `counters` say; an empty table gives no rows.
    """
    return every_order(counters(failures(docs), labels))
