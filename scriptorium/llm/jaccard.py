"""N-gram Jaccard join: all documents whose shingle sets have a Jaccard similarity of 0.8 or more.

The Jaccard distance 1 - |x & y| / |x | y| is a metric. The join is exact and has two parts.

Regions. Pivots alone cannot part a corpus: nearly all documents are at distance 1 from
every pivot (measured in the README), all are equally near to all regions, and every window
holds everything. So the first cut is lossless and cheap: in one fixed order of shingles a
document is a member of the region of each of its first n - ceil(0.8 n) + 3 shingles, and two
linked documents that differ always share three regions. Shingles that come often in the
corpus (counted over all of it) stand last in that order, so that shared passages make no
regions. A region is cut where its sizes leave a gap that no linked pair can bridge. Its pairs
are counted, and those that meet in three regions stay: documents that share a few words by
chance, as ever more do in a growing corpus, are not tied. Where a region has many members, or
some of nearly one size (near copies), it becomes a star around its least document instead;
very large ones do so where they are found, before anything is shuffled. Documents that such
pairs and stars connect form a block, which holds every link of its documents.

Blocks. A block is taken apart first by the parities of its sets (a lower bound of their
difference, 16 to 32 times smaller than the sets), so that documents that only share passages
are never loaded. Inside a block, of any size, documents are near each other, and distances tell: pivots
are taken, and documents within 0.2 of a pivot are linked with it at once. If the block is
not one component then, each document goes to the Voronoi cell of its nearest pivot, and by
the triangle inequality visits each further cell whose pivot is at most 2 * 0.2 farther away;
pivots, whose links are all known, stay behind. Cells are joined recursively until they are
one component or no longer shrink. In such a last cell two documents are compared only where
no pivot tells them apart (their distances to it differ by 0.2 at most) and a bound on their
overlap leaves a link possible. A block of more shingles than one task should hold is cut in
the same way by rounds of tasks: each measures a part of it against the block's pivots and
deals it into cells, which are the blocks of the next round. Only a cell that pivots do not
part goes into tiles, and pairs of tiles whose documents are all known as connected are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import FEW_ROWS, discard, written
from .components import components
from .shingles import column_bytes, mix64, shingle_set

#: Jaccard similarity at least PER / OUT_OF.
PER, OUT_OF = 8, 10
#: Bits that name a cell of the table of common shingles; most cells marked common; least count.
CELL_BITS, MOST_COMMON, LEAST_COMMON = 23, 1 << 20, 4
#: Shingles that a worker holds at a time while counting, and members of regions while forming these (about 250 MB of work space each).
HELD, HELD_MEMBERS = 1 << 21, 1 << 18
#: Regions that two linked documents share at least. Linked sets that differ have 4 shingles in common, so this is 4 at most.
SHARED = 3
#: Members of a region whose pairs are counted: of one whose sizes differ by a twentieth at most, and of any other. Positions that are paired at a time.
FEW, MANY, PAIRED = 4, 64, 1 << 16
#: Bits of the filter of documents that are in blocks.
BLOCK_BITS = 24
#: Members, and shingles, of a block that one task takes apart by parities (a quarter to half a byte a shingle).
APART_MEMBERS, APART_SHINGLES = 4096, 1 << 26
#: Words of 64 bits that mark a cell's most common shingles.
MARKS = 4
#: Shingles of a block that one task joins; pivots at a time; rounds in which large blocks are cut.
BLOCK_SHINGLES, PIVOTS, ROUNDS = 4_000_000, 6, 8
#: Largest distance of linked documents.
NEAR = 1 - PER / OUT_OF
#: A cell with a larger share of its block's members counts as not parted.
SHRUNK = 0.8


def linked(common: int, a: int, b: int) -> bool:
    return common > 0 and OUT_OF * common >= PER * (a + b - common)


def prefix_length(n: int) -> int:
    """Two linked sets that differ have SHARED of their first shingles in common at least: after the SHARED-th common one, each set holds all others."""
    return min(n, n - -(-PER * n // OUT_OF) + SHARED)


# --- pass 1: sizes, signatures and common shingles


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (shingle_set(b) for b in column_bytes(batch.column("text")))


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that do not depend on order."""
    if not len(s):
        return 0, 0
    other = mix64(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(other.sum(dtype=np.uint64).view(np.int64))


def _class_key(n: int, s1: int, s2: int) -> int:
    """A set's name of 48 bits in the region pass, the same for all copies. Two sets that share a name only add candidates."""
    return int(mix64(np.array([s1], np.int64).view(np.uint64) ^ mix64(np.array([s2], np.int64).view(np.uint64) ^ np.uint64(n)))[0] >> np.uint64(16))


def _parity(s: np.ndarray) -> bytes:
    """Parities of the counts of shingles in cells, at least two cells a shingle: two sets differ in as many shingles at least as parities."""
    bits = max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes() if len(s) else b""


def _apart(a: bytes, b: bytes) -> int:
    """Parities in which two sets differ; the finer one is folded to the coarser one."""
    x, y = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (a, b))
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[::2] ^ x[1::2]
        else:
            y = y[::2] ^ y[1::2]
    return int(np.count_nonzero(x != y))


def may_link(n_a: int, n_b: int, apart: int) -> bool:
    """False only where no two sets of these sizes that differ so much can be linked."""
    least = -(-PER * (n_a + n_b) // (PER + OUT_OF))
    return apart <= n_a + n_b - 2 * least


def _repeated(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the shingles that come in more than one of some sets."""
    h = np.sort(np.concatenate(held))
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
    count = np.diff(edge)
    often = count > 1
    return (h[edge[:-1]][often] >> np.uint64(64 - CELL_BITS)).astype(np.int64), count[often].astype(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, signature, n, class key) of every row; kind 1: (cell, count) of shingles repeated among different sets."""
    names = ["kind", "a", "b", "c", "n", "k", "bits"]
    held, size, seen = [], 0, set()

    def common():
        cells, counts = _repeated(held)
        zero = np.zeros(len(cells), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero + 1), pa.array(cells), pa.array(counts), pa.array(zero), pa.array(zero), pa.array(zero), pa.nulls(len(cells), pa.binary())], names=names)

    for batch in batches:
        rows, bits = [], []
        for s in _sets(batch):
            key = (len(s), *_signature(s))
            rows.append(key)
            bits.append(_parity(s))
            if len(s) and key not in seen:
                seen.add(key)
                held.append(s)
                size += len(s)
                if size > HELD:
                    yield common()
                    held, size, seen = [], 0, set()
        n, s1, s2 = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 3
        k = np.array([_class_key(*row) for row in rows], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int64)), batch.column("doc_id").cast(pa.int64()), pa.array(s1), pa.array(s2), pa.array(n), pa.array(k), pa.array(bits, pa.binary())], names=names)
    if held:
        yield common()


def _test(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _marks(cells: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of some cells (of 2^bits), put together on executors: a long of 64 marks each."""
    words = cells.select(F.expr("shiftrightunsigned(cell, 6)").alias("word"), F.expr("shiftleft(1L, cast(cell & 63 AS int))").alias("mark"))
    found = words.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("mark").to_numpy()
    # the k-th cell of a long is its k-th lowest bit; `_test` wants a byte's first cell in its highest
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


def common_cells(counts: DataFrame) -> np.ndarray:
    """The bitmap of the cells of the most common shingles: at most MOST_COMMON, and none with a count under LEAST_COMMON.

    Any choice keeps the join exact: it only settles the order of shingles.
    """
    cells = written(counts.groupBy(F.col("a").alias("cell")).agg(F.sum("b").alias("times")).where(F.col("times") >= LEAST_COMMON), "jaccard-common")
    steps = F.floor(F.log2("times") * 8).cast("int")
    histogram = sorted(((r[0], r[1]) for r in cells.groupBy(steps.alias("step")).count().collect()), reverse=True)
    least, total = 1 << 30, 0
    for step, n in histogram:
        if total + n > MOST_COMMON:
            break
        least, total = step, total + n
    marks = _marks(cells.where(steps >= least), CELL_BITS)
    discard(cells)
    return marks


# --- pass 2: regions


def _prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set: uncommon ones by hash, then common ones by hash."""
    k = prefix_length(len(s))
    late = _test(common, s >> np.uint64(64 - CELL_BITS))
    early = s[~late]
    return early[:k] if len(early) >= k else np.concatenate((early, s[late][: k - len(early)]))


def _stars(key: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, star: np.ndarray, few: int):
    """Members of regions -> (edges of stars, members left, the part of a region that each of these is in, members that stand for a star).

    Regions go by key and are cut at gaps of size that no linked pair bridges; repeated
    members count once. A part of more than MANY members, of more than `few` of nearly one
    size, or with a member that stands for a star, becomes a star around its least document,
    which stands for it.
    """
    order = np.lexsort((doc, low, key))
    rows = [x[order] for x in (key, doc, low, high, star)]
    again = np.logical_and.reduce([x[1:] == x[:-1] for x in rows])
    key, doc, low, high, star = (x[np.concatenate(([True], ~again))] for x in rows)
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.cumsum(new_key).astype(np.int64) << 31  # sizes have 30 bits
    reach = np.maximum.accumulate(group + high) - group
    cut = new_key
    cut[1:] |= PER * low[1:] > OUT_OF * reach[:-1]
    at, of = np.flatnonzero(cut), np.cumsum(cut) - 1
    size = np.diff(np.concatenate((at, [len(key)])))
    pivot, most = np.minimum.reduceat(doc, at), np.maximum.reduceat(high, at)
    alike = 20 * most <= 21 * low[at]
    starred = (size > MANY) | ((size > few) & alike) | ((size > 1) & np.logical_or.reduceat(star, at))
    far = starred[of] & (doc != pivot[of])
    edges = _distinct(doc[far], pivot[of][far])
    one = ~starred[of]
    left = (key[one], doc[one], low[one], high[one], star[one])
    stands = (key[at][starred], pivot[starred], low[at][starred], most[starred], np.ones(int(starred.sum()), bool))
    return edges, left, of[one], stands


def _pairs(doc: np.ndarray, n: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members (by size) of the same part of a region whose sizes a link can bridge, once for each region that they share."""
    for start in range(0, len(doc), PAIRED):
        at, found = np.arange(start, min(start + PAIRED, len(doc))), []
        for lag in range(1, MANY):
            at = at[at + lag < len(doc)]
            at = at[(of[at + lag] == of[at]) & (PER * n[at + lag] <= OUT_OF * n[at])]
            if not len(at):
                break
            a, b = doc[at], doc[at + lag]
            found.append(np.stack((np.maximum(a, b), np.minimum(a, b)))[:, a != b])
        if found:
            yield tuple(np.concatenate(found, axis=1))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


#: Kinds of rows that leave the region pass: a member, a member that stands for a star, an edge of a star.
MEMBER, STAND, EDGE = 0, 1, 2
#: a: region (or an edge's end), b: class, c: kind and sizes in one, since this is the largest exchange.
_REGION = "a long, b long, c long"


def _packed(kind: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (kind.astype(np.int64) << 60) | (high << 30) | low


def _unpacked(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    small = np.int64((1 << 30) - 1)
    return c >> 60, c & small, (c >> 30) & small


def _rows(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.int64)) for x in (a, b, c)], names=["a", "b", "c"])


def _regions(common: np.ndarray):
    """Members of regions (region, class, least and largest size), and edges between classes found in the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def out():
            key, doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
            edges, left, _, stands = _stars(key, doc, n, n, np.zeros(len(key), bool), MANY)
            key, doc, low, high, star = (np.concatenate(x) for x in zip(left, stands, strict=True))
            none = np.zeros(len(edges[0]), np.int64)
            yield _rows(*edges, _packed(none + EDGE, none, none))
            yield _rows(key, doc, _packed(star, low, high))

        for batch in batches:
            for s in _sets(batch):
                if not len(s):
                    continue
                sign = (len(s), *_signature(s))
                if sign in seen:  # copies have one class
                    continue
                seen.add(sign)
                p = _prefix(s, common).view(np.int64)
                held.append((p, np.full(len(p), _class_key(*sign), np.int64), np.full(len(p), len(s), np.int64)))
                size += len(p)
                if size > HELD_MEMBERS:
                    yield from out()
                    held, size, seen = [], 0, set()
        if held:
            yield from out()

    return work


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of all tasks, dealt by key: star edges (of any task; sure), and the pairs of other regions (to be counted)."""
    held = []
    names = ["a", "b", "sure"]

    def told(edges, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1]), pa.array(np.full(len(edges[0]), sure))], names=names)

    for batch in batches:
        a, b, c = (batch.column(i).to_numpy() for i in range(3))
        known = c >> 60 == EDGE
        if known.any():
            yield told((a[known], b[known]), True)
        held.append((a[~known], b[~known], c[~known]))
    if held:
        key, doc, c = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(key):
            kind, low, high = _unpacked(c)
            edges, (_, doc, low, _, _), of, _ = _stars(key, doc, low, high, kind == STAND, FEW)
            yield told(edges, True)
            for pairs in _pairs(doc, low, of):
                yield told(pairs, False)


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities leave a link possible."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]
        keep = pa.array([may_link(na, nb, _apart(x, y)) for na, nb, x, y in zip(*columns, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _folded(bits: np.ndarray) -> np.ndarray:
    """Parities over half as many cells: of cells that become one."""
    return bits[..., ::2] ^ bits[..., 1::2]


def _refine(rows: pd.DataFrame) -> pd.DataFrame:
    """A block by what parities alone tell: (rep, root) of the documents that may be linked with another; a root names a block of such links.

    Sizes of linked sets differ by a quarter at most, so their parities have as many cells or
    twice as many; the finer ones are folded for that.
    """
    rows = rows.sort_values(["n", "rep"], kind="stable")
    n, reps, forest = rows["n"].to_numpy(np.int64), rows["rep"].to_numpy(np.int64), Forest(len(rows))
    marks = [np.unpackbits(np.frombuffer(b, np.uint8)) for b in rows["bits"]]
    size = np.array([len(m) for m in marks])
    levels = {}
    for level in np.unique(size):
        same, finer = np.flatnonzero(size == level), np.flatnonzero(size == 2 * level)
        held = [marks[i] for i in same] + [_folded(marks[i]) for i in finer]
        levels[level] = np.concatenate((same, finer)), np.packbits(np.stack(held), axis=1)
    for i in range(len(rows)):
        ids, packed = levels[size[i]]
        at = np.flatnonzero((ids > i) & (OUT_OF * n[i] >= PER * n[ids]))
        if len(at):
            apart = np.bitwise_count(packed[at] ^ packed[np.searchsorted(ids, i)]).sum(axis=1, dtype=np.int64)
            least = -(-PER * (n[i] + n[ids[at]]) // (PER + OUT_OF))
            for j in ids[at[apart <= n[i] + n[ids[at]] - 2 * least]]:
                forest.tie(i, j)
    roots = np.array([forest.root(i) for i in range(len(rows))], np.int64)
    kept = np.bincount(roots, minlength=len(rows))[roots] > 1
    return pd.DataFrame({"rep": reps[kept], "root": reps[roots[kept]]})


# --- pass 3: blocks


class Forest:
    """Union-find over positions; the least position is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        #: Links that were measured, by what told them: a pivot's ball, or the bound in a last cell.
        self.told = {"ball": 0, "bound": 0}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _overlaps(pivot: np.ndarray, sets: list[np.ndarray], members: list[int]) -> np.ndarray:
    """|pivot & set| for the members, by one search over their shingles laid end to end."""
    laid = np.concatenate([sets[m] for m in members])
    at = np.searchsorted(pivot, laid)
    at[at == len(pivot)] = 0
    hit = pivot[at] == laid
    ends = np.cumsum([len(sets[m]) for m in members])
    sums = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], ends))]
    return np.diff(sums)


def _near(common: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return (common > 0) & (OUT_OF * common >= PER * (n + size - common))


def _by_bounds(sets: list[np.ndarray], members: list[int], forest: Forest, distance: np.ndarray) -> None:
    """Exact join of a cell that pivots do not part. distance: of the pivots (rows) to the members.

    Bits mark the cell's most common shingles in each set. Two sets share at most their common
    bits and the smaller number of their other shingles that come twice in the cell at all;
    pairs whose bound cannot reach the similarity, that a pivot tells apart (triangle
    inequality), or that are connected already, are never compared.
    """
    by_size = sorted(range(len(members)), key=lambda i: len(sets[members[i]]))
    members, distance = [members[i] for i in by_size], distance[:, by_size]
    n = np.array([len(sets[m]) for m in members])
    of = np.repeat(np.arange(len(members)), n)
    values, code, count = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True, return_counts=True)
    bit = np.full(len(values), -1)
    often = np.argsort(-count, kind="stable")[: 64 * MARKS]
    often = often[count[often] > 1]
    bit[often] = np.arange(len(often))
    own = bit[code]
    bits = np.zeros((len(members), MARKS), np.uint64)
    marked = own >= 0
    np.bitwise_or.at(bits, (of[marked], own[marked] >> 6), np.uint64(1) << (own[marked] & 63).astype(np.uint64))
    rest = np.bincount(of[~marked & (count[code] > 1)], minlength=len(members))
    part = np.array([forest.root(m) for m in members])
    ends = np.searchsorted(n, n * OUT_OF // PER, side="right")
    for i in range(len(members)):
        js = slice(i + 1, ends[i])
        bound = np.bitwise_count(bits[js] & bits[i]).sum(axis=1, dtype=np.int64) + np.minimum(rest[js], rest[i])
        fit = i + 1 + np.flatnonzero(((PER + OUT_OF) * bound >= PER * (n[js] + n[i])) & (part[js] != part[i]))
        if len(fit):
            fit = fit[(np.abs(distance[:, fit] - distance[:, i, None]) <= NEAR + 1e-9).all(axis=0)]
        if not len(fit):
            continue
        common = _overlaps(sets[members[i]], sets, [members[j] for j in fit])
        for j in fit[_near(common, n[fit], n[i])]:
            forest.tie(members[i], members[j])
            forest.told["bound"] += 1
            part[part == part[j]] = part[i]


class _Laid:
    """The shingles of some members laid end to end, for many comparisons with one set."""

    def __init__(self, sets: list[np.ndarray], members: list[int]) -> None:
        self.n = np.array([len(sets[m]) for m in members])
        values, self.code = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True)
        self.values, self.starts = values, np.concatenate(([0], np.cumsum(self.n)[:-1]))

    def common(self, s: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with a set."""
        at = np.searchsorted(self.values, s)
        at[at == len(self.values)] = 0
        mark = np.zeros(len(self.values), np.int32)
        mark[at[self.values[at] == s]] = 1
        return np.add.reduceat(mark[self.code], self.starts)


def _pivots(sets: list[np.ndarray], members: list[int], forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Ties the balls of pivots; (distances of the first PIVOTS pivots to the members, which members were pivots).

    Pivots are taken from members that no ball holds yet, and go on while balls hold others.
    """
    laid, apart, left, idle = _Laid(sets, members), [], np.ones(len(members), bool), 0
    was = np.zeros(len(members), bool)
    while left.any() and idle < PIVOTS:
        open_ = np.flatnonzero(left)
        pick = int(open_[len(open_) // 2])
        s = sets[members[pick]]
        common = laid.common(s)
        if len(apart) < PIVOTS:
            apart.append(1.0 - common / (laid.n + len(s) - common))
        ball = np.flatnonzero(_near(common, laid.n, len(s)))
        for x in ball:
            forest.tie(members[pick], members[x])
        forest.told["ball"] += len(ball) - 1
        idle += not left[ball].sum() > 1
        left[ball] = left[pick] = False
        was[pick] = True
    return np.stack(apart), was


def _cells(distance: np.ndarray) -> np.ndarray:
    """Which cells (rows) each document (columns) visits: its nearest pivot's, and those whose pivots are at most 2 * NEAR farther."""
    return distance <= distance.min(axis=0) + 2 * NEAR + 1e-9


def metric_join(sets: list[np.ndarray], members: list[int], forest: Forest) -> None:
    """Ties all members that are connected by links among them: Voronoi cells of pivots, one inside the other."""
    waiting = [members]
    while waiting:
        members = waiting.pop()
        if len({forest.root(m) for m in members}) < 2:
            continue
        distance, was = _pivots(sets, members, forest)
        # a pivot has met all others of its cell
        rest = np.flatnonzero(~was)
        members, distance = [members[i] for i in rest], distance[:, rest]
        if len({forest.root(m) for m in members}) < 2:
            continue
        cells = _cells(distance)
        if cells.sum(axis=1).max() > SHRUNK * len(was):
            _by_bounds(sets, members, forest, distance)
        else:
            waiting += [[members[i] for i in np.flatnonzero(cell)] for cell in cells]


def _join_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges (document, least document that it is connected with) inside a block or a pair of tiles.

    Documents with one label of 0 or more are connected through its pivot already.
    """
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
    ids, forest, first = rows["doc_id"].to_numpy(dtype=np.int64), Forest(len(sets)), {}
    for i, label in enumerate(rows["label"].tolist()):
        if label >= 0:
            forest.tie(i, first.setdefault(label, i))
    metric_join(sets, list(range(len(sets))), forest)
    roots = np.array([forest.root(i) for i in range(len(sets))], np.int64)
    tied = roots != np.arange(len(roots))
    return pd.DataFrame({"a": ids[tied], "b": ids[roots[tied]]}, dtype="int64")


def _cell(column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 64 - BLOCK_BITS)


def told_apart(rows: DataFrame, ids: DataFrame, *, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among `ids`, rows whose id is not): by a bitmap of 2 MB, so that the latter need no join.

    `ids` has one column. The bitmap goes when nothing holds the results any more.
    """
    (name,) = ids.columns
    held = rows.sparkSession.sparkContext.broadcast(_marks(ids.select(_cell(name).alias("cell")), BLOCK_BITS))

    @F.pandas_udf("boolean")
    def among(cells: pd.Series) -> pd.Series:
        return pd.Series(_test(held.value, cells.to_numpy().astype(np.uint64)))

    maybe = among(_cell(id_col))
    return rows.where(maybe), rows.where(~maybe)


def _loaded(docs: DataFrame, places: DataFrame, done: list) -> DataFrame:
    """(block, doc_id, n, shingles) of the documents in places (rep, s1, block); a bounded filter spares the others. Broadcasts are added to `done`."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(_marks(places.select(_cell("rep").alias("cell")), BLOCK_BITS))
    done.append(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _test(wanted.value, batch.column("cell").to_numpy().astype(np.uint64))
            part = batch.filter(pa.array(keep))
            sets = list(_sets(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([_signature(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "s1", "shingles"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", _cell("doc_id").alias("cell"))
    found = rows.mapInArrow(work, "doc_id long, s1 long, shingles binary")
    keys = places.select("block", "rep", F.col("s1").alias("_s1"))
    met = found.join(keys, (F.col("doc_id") == F.col("rep")) & (F.col("s1") == F.col("_s1")))
    return met.select("block", "doc_id", (F.octet_length("shingles") / 8).cast("long").alias("n"), "shingles")


_MEASURED = "kind int, block string, doc_id long, label long, cells array<long>"
#: Kinds of rows that leave a round: a document and the cells it visits, an edge to a pivot, two pivots whose balls share a document.
_PLACE, _EDGE, _SAME = 0, 1, 2


def _measure(rows: pd.DataFrame) -> pd.DataFrame:
    """A part of a large block against the block's pivots: edges to pivots, the cells of each document, and pivots that share one."""
    block, pivot = rows["block"].iloc[0], rows["pivot"].to_numpy()
    pivots = rows[pivot].sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    rest = rows[~pivot & ~rows["doc_id"].isin(pivots["doc_id"])].drop_duplicates("doc_id")
    every = pd.concat([pivots, rest])
    sets = [np.frombuffer(b, np.uint64) for b in every["shingles"]]
    laid, ids, names = _Laid(sets, list(range(len(sets)))), every["doc_id"].to_numpy(np.int64), pivots["doc_id"].to_numpy(np.int64)
    common = np.stack([laid.common(sets[i]) for i in range(len(names))])
    size = np.array([len(sets[i]) for i in range(len(names))])
    near = np.stack([_near(common[i], laid.n, size[i]) for i in range(len(names))])
    label = np.where(near.any(axis=0), names[near.argmax(axis=0)], -1)
    p, x = np.nonzero(near)
    told = lambda kind, ids, label, cells=None: pd.DataFrame({"kind": kind, "block": block, "doc_id": ids, "label": label, "cells": cells})
    out = [told(_EDGE, ids[x], names[p]), told(_SAME, names[p], label[x]).drop_duplicates(["doc_id", "label"])]
    after = np.arange(len(names), len(ids))
    if len(after):
        visits = _cells((1.0 - common / (laid.n[None, :] + size[:, None] - common))[:, after])
        out.append(told(_PLACE, ids[after], label[after], [names[v].tolist() for v in visits.T]))
    return pd.concat(out, ignore_index=True).astype({"block": object})  # plain strings: Arrow-backed ones may come in pieces


def _cut(cells: DataFrame, total: DataFrame, limit: int, done: list) -> tuple[DataFrame, DataFrame]:
    """One round: (edges, (block, doc_id, label, cells)) of large blocks (block, label, doc_id, n, shingles).

    A block is dealt into parts of a quarter of what a task holds; each part gets the block's
    pivots, the members with the least hash in PIVOTS classes, so that no task sees all of it.
    """
    parts = F.ceil(F.col("size") / (limit / 4)).cast("int")
    deal = cells.select("block", "doc_id").groupBy("block", F.pmod(F.xxhash64("doc_id", "block"), F.lit(PIVOTS)).alias("turn")).agg(F.min(F.struct(F.xxhash64("block", "doc_id").alias("h"), "doc_id")).alias("p"))
    few = written(deal.select("block", F.col("p.doc_id").alias("doc_id")), "jaccard-pivots")
    done.append(few)
    chosen = few.join(cells, ["block", "doc_id"]).join(total.select("block", parts.alias("parts")), "block")
    pivots = chosen.select("block", "doc_id", "shingles", F.lit(True).alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rest = cells.join(total.select("block", parts.alias("parts")), "block").select("block", "doc_id", "shingles", F.lit(False).alias("pivot"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    found = written(pivots.unionByName(rest).groupBy("block", "part").applyInPandas(_measure, _MEASURED), "jaccard-round")
    done.append(found)
    edges = found.where(f"kind = {_EDGE}").select(F.col("label").alias("a"), F.col("doc_id").alias("b"))
    # balls that share a document are one: PIVOTS rows a block and part at most
    same = components(found.where(f"kind = {_SAME}").select(F.col("label").alias("a"), F.col("doc_id").alias("b")).distinct(), "jaccard-balls")
    done.append(same)
    placed = found.where(f"kind = {_PLACE}").join(same.withColumnRenamed("id", "label"), "label", "left")
    return edges, placed.select("block", "doc_id", F.coalesce("root", "label").alias("label"), "cells")


def _tiles(cells: DataFrame, limit: int) -> DataFrame:
    """(block, tile, label, doc_id) of blocks (block, label, doc_id, n) that pivots do not part, dealt into pairs of tiles.

    A block's documents go by size into tiles of half of what a task holds: by steps of size
    (four to the ratio 1.25), and by hash where one step is too large. Two tiles meet where a
    link between them is possible and not known: a quotient of their sizes reaches 0.8, and
    they have not one label of 0 or more (only labels with a tile of their own count here).
    A tile that meets another needs no task of its own.
    """
    half, none = limit / 2, F.lit(-1).cast("long")
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(OUT_OF / PER)) * 4).cast("int")
    stepped = cells.withColumn("step", step)
    counts = stepped.groupBy("block", "label", "step").agg(F.sum("n").alias("size"))
    own = counts.groupBy("block", "label").agg(F.sum("size").alias("size")).where((F.col("label") >= 0) & (F.col("size") > half)).select("block", "label", F.col("label").alias("lab"))
    kept = counts.join(own, ["block", "label"], "left").withColumn("lab", F.coalesce("lab", none))
    steps = kept.groupBy("block", "lab", "step").agg(F.sum("size").alias("size"))
    up = W.partitionBy("block", "lab").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    laid = steps.withColumn("run", F.floor(F.coalesce(F.sum("size").over(up), F.lit(0)) / half).cast("int")).withColumn("subs", F.ceil(F.col("size") / half).cast("int"))
    tiles = laid.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).groupBy("block", "lab", "run", "sub").agg(F.min("step").alias("low"), F.max("step").alias("high"))
    tiles = tiles.withColumn("tile", F.concat_ws(".", "lab", "run", "sub"))
    other = tiles.select("block", *[F.col(c).alias(f"{c}2") for c in ("lab", "tile", "low", "high")])
    near = (F.col("low2") <= F.col("high") + 5) & (F.col("low") <= F.col("high2") + 5)
    meets = tiles.join(other, "block").where((F.col("tile") != F.col("tile2")) & near & ((F.col("lab") != F.col("lab2")) | (F.col("lab") < 0)))
    pair = F.concat_ws("+", F.least("tile", "tile2"), F.greatest("tile", "tile2"))
    partners = tiles.join(meets.groupBy("block", "tile").agg(F.collect_set(pair).alias("pairs")), ["block", "tile"], "left")
    # a tile without partners: a task of its own, unless its documents are connected
    alone = F.when(F.col("lab") < 0, F.array("tile")).otherwise(F.array().cast("array<string>"))
    places = partners.select("block", "lab", "run", "sub", F.coalesce("pairs", alone).alias("pairs"))
    where = laid.select("block", "lab", "step", "run", "subs")
    named = stepped.join(own, ["block", "label"], "left").withColumn("lab", F.coalesce("lab", none)).join(where, ["block", "lab", "step"]).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("subs")).cast("int"))
    met = named.join(places, ["block", "lab", "run", "sub"])
    return met.select("block", F.explode("pairs").alias("tile"), "label", "doc_id")


def large_blocks(loaded: DataFrame, limit: int, done: list) -> tuple[DataFrame, list[DataFrame]]:
    """Blocks (block, doc_id, n, shingles) of more than `limit` shingles each, cut: (block, tile, label, doc_id, shingles) for tasks, and lists of edges.

    Rounds work with places alone (block, label, doc_id, n); sets are read where they are measured and at the end.
    """
    sets = loaded.select("doc_id", "shingles").dropDuplicates(["doc_id"])
    cells = loaded.select("block", F.lit(-1).cast("long").alias("label"), "doc_id", "n")
    ready, edges = _tiles(cells.limit(0), limit), []
    one_of = lambda rows, which: rows.join(which.select("block"), "block", "left_semi")
    total = written(cells.groupBy("block").agg(F.sum("n").alias("size"), F.count("*").alias("members")), "jaccard-totals")
    done.append(total)
    for turn in range(ROUNDS + 1):
        large = total.where(F.col("size") > limit)
        if large.limit(1).count() == 0:
            break
        if turn == ROUNDS:
            ready = ready.unionByName(_tiles(one_of(cells, large), limit))
            break
        told, placed = _cut(one_of(cells, large).join(sets, "doc_id"), large, limit, done)
        edges.append(told)
        # what pivots do not part is dealt into tiles as it is; what is one component by now is done
        placed = placed.join(cells.select("block", "doc_id", "n"), ["block", "doc_id"])
        visits = placed.select("block", "label", "doc_id", "n", F.explode("cells").alias("cell"))
        most = visits.groupBy("block", "cell").agg(F.count("*").alias("visitors")).groupBy("block").agg(F.max("visitors").alias("visitors"))
        open_ = placed.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high OR low < 0")
        judged = written(open_.join(most, "block").join(large, "block").withColumn("parted", F.col("visitors") <= F.col("members") * SHRUNK), "jaccard-judged")
        done.append(judged)
        ready = ready.unionByName(_tiles(one_of(placed, judged.where("NOT parted")).select(*cells.columns), limit))
        cells = written(one_of(visits, judged.where("parted")).select(F.concat_ws("/", "block", "cell").alias("block"), "label", "doc_id", "n"), "jaccard-cells")
        done.append(cells)
        sums = cells.groupBy("block").agg(F.sum("n").alias("size"), F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
        total = written(sums.where("(low < high OR low < 0) AND members > 1").select("block", "size", "members"), "jaccard-totals")
        done.append(total)
        fits = one_of(cells, total.where(F.col("size") <= limit)).withColumn("tile", F.lit(""))
        ready = ready.unionByName(fits.select(*ready.columns))
    places = written(ready, "jaccard-tiles")
    done.append(places)
    return places.join(sets, "doc_id").select("block", "tile", "label", "doc_id", "shingles"), edges


def block_links(rows: DataFrame, places: DataFrame, done: list, limit: int) -> DataFrame:
    """Edges (a, b) that connect what links connect inside each block of places (rep, s1, n, block)."""
    large = written(places.groupBy("block").agg(F.sum("n").alias("size")).where(F.col("size") > limit), "jaccard-large")
    done.append(large)
    any_large = large.limit(1).count() > 0
    small = places.join(large, "block", "left_anti") if any_large else places
    ready = _loaded(rows, small, done).select("block", F.lit("").alias("tile"), F.lit(-1).cast("long").alias("label"), "doc_id", "shingles")
    edges: list[DataFrame] = []
    if any_large:
        loaded = written(_loaded(rows, places.join(large, "block", "left_semi"), done), "jaccard-loaded", FEW_ROWS)
        done.append(loaded)
        parts, edges = large_blocks(loaded, limit, done)
        ready = ready.unionByName(parts)
    links = ready.groupBy("block", "tile").applyInPandas(_join_block, "a long, b long")
    for told in edges:
        links = links.unionByName(told)
    return links


def _class_members(one: DataFrame, rows: int) -> DataFrame:
    """(doc_id, n, s1, s2, k, rep) of (doc_id, n, s1, s2, k): rep is the least id of the same set.

    In two levels, so that a set that a third of all rows have is no single task: the least id
    of a set's rows in one of `salts` parts, then the least of these.
    """
    salts = 1 << max(4, int(max(rows, 1) ** 0.5 / 4).bit_length() - 1)
    key = ["n", "s1", "s2"]
    first = one.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).withColumn("rep1", F.min("doc_id").over(W.partitionBy(*key, "salt")))
    heads = first.where("doc_id = rep1").select("rep1", F.min("rep1").over(W.partitionBy(*key)).alias("rep2")).where("rep1 <> rep2")
    return first.join(heads, "rep1", "left").select("doc_id", *key, "k", F.coalesce("rep2", "rep1").alias("rep"))


def with_set(rows: DataFrame, column: str) -> DataFrame:
    """rows of one struct column that holds a `text`, with the size n and the signature (s1, s2) of its shingle set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(len(s), *_signature(s)) for s in (shingle_set(b) for b in column_bytes(batch.column(1)))]
            columns = [pa.array([t[i] for t in told], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[column, "n", "s1", "s2"])

    schema = StructType([rows.schema[column], *[StructField(c, LongType()) for c in ("n", "s1", "s2")]])
    return rows.select(column, F.col(f"{column}.text").alias("_text")).mapInArrow(work, schema)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a set holds
    the distinct five-word shingles, or all words as one where there are fewer. A document
    without words or text has an empty set and is linked with nothing. component_id is the
    smallest id reachable by links. Ids are keys: where rows repeat an id with different
    texts, the one with the smallest set stands for the id's links. A null id has a null
    component and links nothing. An empty table gives none; other columns are ignored.
    """
    spark, done = docs.sparkSession, []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey = written(rows.mapInArrow(_survey, "kind long, a long, b long, c long, n long, k long, bits binary"), "jaccard-survey", FEW_ROWS)
    facts = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("s1"), F.col("c").alias("s2"), "n", "k", "bits")
    one = facts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2", "k")).alias("f")).select("doc_id", "f.*").where("n > 0")
    members = written(_class_members(one, facts.count()), "jaccard-members")
    sizes = members.where("doc_id = rep").select("rep", "k", "n", "s1")

    common = spark.sparkContext.broadcast(common_cells(survey.where("kind = 1")))
    done.append(common)
    regions = rows.mapInArrow(lambda batches: _regions(common.value)(batches), _REGION)
    met = regions.repartition("a").mapInArrow(_meet, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"), F.count("*").alias("times")).where(F.col("sure") | (F.col("times") >= SHARED))
    # classes of the region pass become the documents that stand for them
    rep = sizes.select("k", "rep")
    ends = met.join(rep, F.col("a") == F.col("k")).select(F.col("rep").alias("a"), "b", "sure").join(rep, F.col("b") == F.col("k")).select("a", F.col("rep").alias("b"), "sure")
    edges = written(ends.where("a <> b").groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.max("sure").alias("sure")), "jaccard-edges", FEW_ROWS)
    done.append(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(sizes.select("rep", F.col("s1").alias("_s1")), "rep")
    known = facts.select("doc_id", "s1", "n", "bits").join(nodes, (F.col("doc_id") == F.col("rep")) & (F.col("s1") == F.col("_s1"))).dropDuplicates(["rep"])
    known = written(known.select("rep", "s1", "n", "bits"), "jaccard-known")
    done.append(known)
    side = lambda x: known.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    possible = edges.where("NOT sure").join(side("a"), "a").join(side("b"), "b").mapInArrow(_look, "a long, b long")
    blocks = components(edges.where("sure").select("a", "b").unionByName(possible), "jaccard-blocks")
    done.append(blocks)
    # blocks are chains of documents that share a region: most are no links, as parities tell before any set is read
    placed = blocks.select(F.col("id").alias("rep"), F.col("root").cast("string").alias("block")).join(known.select("rep", "s1", "n"), "rep")
    weights = placed.groupBy("block").agg(F.count("*").alias("members"), F.sum("n").alias("size"))
    weighed = written(placed.join(weights, "block"), "jaccard-weighed")
    done.append(weighed)
    small = (F.col("members") <= APART_MEMBERS) & (F.col("size") <= APART_SHINGLES)
    apart = weighed.where(small).select("rep", "block").join(known.select("rep", "n", "bits"), "rep").groupBy("block").applyInPandas(_refine, "rep long, root long").select("rep", F.col("root").cast("string").alias("block"))
    every = apart.unionByName(weighed.where(~small).select("rep", "block"))
    places = written(every.join(known.select("rep", "s1", "n"), "rep"), "jaccard-places")
    done.append(places)
    links = written(block_links(rows, places, done, BLOCK_SHINGLES), "jaccard-links", FEW_ROWS)
    done.append(links)
    roots = components(links, "jaccard-roots").select(F.col("id").alias("rep"), "root")
    found = members.join(roots, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("component_id"))
    for held in done:
        held.destroy() if hasattr(held, "destroy") else discard(held)
    out = facts.join(found, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
