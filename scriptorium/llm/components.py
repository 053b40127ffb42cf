"""Connected components of a distributed edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Edges that one task finishes at once (16 MB of pairs); more go through star rounds until so few are left, or nothing changes.
AT_ONCE = 1 << 20


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node's neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges point down (a > b): every node below a node, and the node, are tied to the least of them."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    tied = edges.join(least, F.col("a") == F.col("u")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of edges, by hooking roots to smaller ones and halving paths until nothing changes."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], low)
        np.minimum.at(new, up[y], low)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        if (new == up).all():
            return nodes, nodes[up]
        up = new


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if held:
        nodes, roots = rooted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["id", "root"])


def components(edges: DataFrame, label: str = "components", at_once: int = AT_ONCE) -> DataFrame:
    """(id, root) for every node of edges (a, b): root is the least node that it is connected with.

    Null ends and loops are no edges; repeated edges count once; no edges give no rows; other
    columns are ignored. Each round is written to the shared folder and the one before
    removed; the loop ends once at most `at_once` edges are left, which one task finishes, or a
    round changes nothing. Nothing is collected but one fingerprint row a round.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if seen[0] <= at_once:
            found = written(now.repartition(1).mapInArrow(_at_once, "id long, root long"), label)
            discard(now)
            return found
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        before, now = now, written(_small(_large(now).distinct()).distinct(), label)
        discard(before)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
