"""Pairs of like names (L16, J6, F8): blocks of names meet, each pair of blocks in one task, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of a block, rows of one that meet the other at a time, and pairs that are measured or sent at a time.
BLOCK, STRIP, PAIRS = 4096, 64, 1 << 15
#: Signs of a name that the bits of a long stand for, and bits of a sketch that stand for one sign only (rarer ones share the rest).
LONGEST, ALONE = 64, 96
FOUND = "a string, b string, ratio double"


def pairs_alike(named: DataFrame, ratio: float) -> DataFrame:
    """(a, b, ratio) of every two rows (key, name) with a < b whose names' ratio is above `ratio`; names are not empty.

    The ratio is 2 * (length of the longest common subsequence) / (both lengths). Names are dealt
    into blocks of about BLOCK; a task holds two of them, whatever the number of names.
    """
    named = named.select("key", "name").persist()
    blocks = max(1, -(-named.count() // BLOCK))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(low == high, 0).when(F.col("_own") == low, 1).otherwise(2)
    placed = named.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = placed.select((F.floor(high * (high + 1) / 2) + low).cast("int").alias("_cell"), side.alias("side"), "key", "name")
    dealt = cells.repartitionById(blocks * (blocks + 1) // 2, F.col("_cell")).select("side", "key", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        if rows:
            yield from _met(sorted(rows, key=lambda r: (r[0], len(r[2]))), ratio)

    return dealt.mapInArrow(run, FOUND)


def _met(rows: list[tuple[int, str, str]], ratio: float) -> Iterator[pa.RecordBatch]:
    """The pairs of one cell: rows (side, key, name) by side and length; those of side 0 meet each other, those of 1 meet those of 2."""
    sides, keys, names = zip(*rows, strict=True)
    table, n = pa.array(keys, pa.string()), np.array([len(x) for x in names])
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    rank = np.array([place[k] for k in keys])
    words, lost, signs = _sketched(names, n)
    need = np.array([_least(total, ratio) for total in range(2 * int(n.max()) + 1)])
    within = sides[-1] == 0
    cut = len(rows) if within else sides.index(2) if 2 in sides else len(rows)
    first, second = range(0, cut), (0, len(rows)) if within else (cut, len(rows))
    held, size = [], 0
    for at in _strips(n[: len(first)]):
        for i, j, common in _strip(at, second, within, names, n, words, lost, signs, need):
            other = rank[i] != rank[j]
            held.append((i[other], j[other], common[other]))
            size += len(held[-1][0])
            if size >= PAIRS:
                yield _told(held, rank, table, n)
                held, size = [], 0
    if size:
        yield _told(held, rank, table, n)


def _told(held: list[tuple], rank: np.ndarray, table: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    i, j, common = (np.concatenate(x) for x in zip(*held, strict=True))
    swap = rank[i] > rank[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return pa.RecordBatch.from_arrays([table.take(pa.array(a)), table.take(pa.array(b)), pa.array(2.0 * common / (n[i] + n[j]))], names=["a", "b", "ratio"])


def _least(total: int, ratio: float) -> int:
    """How many signs two names of `total` signs must have in common."""
    s = max(0, int(ratio * total / 2) - 1)
    while total and not 2.0 * s / total > ratio:
        s += 1
    return s


def _strips(n: np.ndarray) -> Iterator[slice]:
    """Pieces of up to STRIP rows of one length each."""
    ends = [*(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)]
    for low, high in zip([0, *ends], ends, strict=False):
        for at in range(low, high, STRIP):
            yield slice(at, min(at + STRIP, high))


def _sketched(names: tuple[str, ...], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each name's multiset of signs as 128 bits, how many signs share a bit in it, and its signs as numbers (the last one fills up; names over LONGEST have none)."""
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((flat, row))
    code, of = flat[order].astype(np.int64), row[order]
    new = np.concatenate(([True], (np.diff(code) != 0) | (np.diff(of) != 0)))
    times = np.arange(len(code)) - np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
    _, which, often = np.unique((code << 32) + times, return_inverse=True, return_counts=True)
    place = np.empty(len(often), np.int64)
    place[np.argsort(-often, kind="stable")] = np.arange(len(often))
    bit = np.where(place < ALONE, place, ALONE + place % (128 - ALONE))[which].astype(np.uint64)
    starts = np.cumsum(n) - n
    one = np.uint64(1) << (bit % np.uint64(64))
    words = [np.bitwise_or.reduceat(np.where(bit // np.uint64(64) == w, one, np.uint64(0)), starts) for w in (0, 1)]
    lost = n - np.bitwise_count(words[0]) - np.bitwise_count(words[1])
    alphabet, number = np.unique(flat, return_inverse=True)
    signs = np.full((len(n), min(LONGEST, int(n.max()))), len(alphabet), np.int64)
    short = n[row] <= LONGEST
    signs[row[short], (np.arange(len(flat)) - np.repeat(starts, n))[short]] = number[short]
    return words, lost, signs


def _strip(at: slice, among: tuple[int, int], within: bool, names, n, words, lost, signs, need) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, common signs in order) of the pairs of rows of one length with others: those whose sketches share enough bits are measured."""
    own, other = int(n[at.start]), n[among[0] : among[1]]
    wanted = need[own + other]
    fit = np.flatnonzero(np.minimum(own, other) >= wanted)
    if not len(fit):
        return
    low, high = among[0] + int(fit[0]), among[0] + int(fit[-1]) + 1  # lengths are in order
    least = np.clip(wanted[fit[0] : fit[-1] + 1] - lost[low:high], 0, 255).astype(np.uint8)
    shared = np.bitwise_count(words[0][at, None] & words[0][None, low:high])
    shared += np.bitwise_count(words[1][at, None] & words[1][None, low:high])
    i, j = np.divmod(np.flatnonzero(shared >= least), high - low)
    i, j = i + at.start, j + low
    if within:
        i, j = i[i < j], j[i < j]
    short = (n[j] <= LONGEST) & (own <= LONGEST)
    if not short.all():
        common = np.array([_common(names[x], names[y]) for x, y in zip(i[~short], j[~short], strict=True)])
        kept = common >= need[own + n[j[~short]]]
        yield i[~short][kept], j[~short][kept], common[kept]
        i, j = i[short], j[short]
    if not len(i):
        return
    # a row for each name of the strip: where each sign stands in it, as bits; other names' signs are places in that row
    mine = np.unique(signs[at, :own])
    width = len(mine) + 1
    local = np.full(int(signs.max()) + 2, len(mine))
    local[mine] = np.arange(len(mine))
    local[-1] = len(mine)
    places = np.zeros((at.stop - at.start, width), np.uint64)
    for t in range(own):
        places[np.arange(len(places)), local[signs[at, t]]] |= np.uint64(1 << t)
    theirs = local[signs[low:high]]
    full = np.uint64((1 << own) - 1)
    for p in range(0, len(i), PAIRS):
        x, y = i[p : p + PAIRS], j[p : p + PAIRS]
        common = _common_of(places.ravel(), (x - at.start) * width, theirs[y - low, : int(n[y].max())], full, own)
        kept = common >= need[own + n[y]]
        yield x[kept], y[kept], common[kept]


def _common_of(places: np.ndarray, base: np.ndarray, theirs: np.ndarray, full: np.uint64, own: int) -> np.ndarray:
    """Lengths of longest common subsequences: open bits that match the other's next sign are added to all open ones; the carry runs to the next match, which closes."""
    open_ = np.full(len(base), full)
    for t in range(theirs.shape[1]):
        hit = open_ & places[base + theirs[:, t]]
        open_ = (open_ + hit) | (open_ - hit)
    return own - np.bitwise_count(open_ & full).astype(np.int64)


def _common(a: str, b: str) -> int:
    """The same of two names of any lengths."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    open_ = full = (1 << len(a)) - 1
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()
