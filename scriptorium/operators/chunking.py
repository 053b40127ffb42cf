"""Sentence spans and chunks.

Cutting a document is a fold with a resetting buffer, so it is one Arrow function that maps a
text to arrays of spans; texts, identifiers and row numbers are derived from the spans by
built-in expressions. Offsets are code points of the normalised text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import SOFT, TERMINATORS, chunk_id, few


@dataclass(frozen=True)
class ChunkSpec:
    """Sizes in characters, and where sentences end or may be cut."""

    target: int = 500
    overlap: int = 100
    limit: int = 1500
    terminators: str = TERMINATORS
    soft: tuple[str, ...] = SOFT

    def __post_init__(self) -> None:
        if self.target <= 0 or self.overlap < 0 or self.limit < self.target:
            raise ValueError("chunks need target > 0, overlap >= 0 and limit >= target")


def sentence_spans(text: str, terminators: str) -> list[tuple[int, int]]:
    """Stripped, non-empty pieces between terminators, as (start, end)."""
    out, at = [], 0
    stops = [m.end() for m in re.finditer(f"[{re.escape(terminators)}]", text)]
    for stop in [*stops, len(text)] if not stops or stops[-1] < len(text) else stops:
        piece = text[at:stop]
        body = piece.strip()
        if body:
            start = at + len(piece) - len(piece.lstrip())
            out.append((start, start + len(body)))
        at = stop
    return out


def _soft_cuts(text: str, start: int, end: int, spec: ChunkSpec) -> Iterator[tuple[int, int]]:
    """C4: a sentence over the limit, cut after the last separator of the first sort that its window has."""
    while end - start > spec.limit:
        window = text[start : start + spec.limit]
        places = ((window.rfind(sep), len(sep)) for sep in spec.soft)
        size = next((at + n for at, n in places if at > 0), spec.limit)
        yield start, start + size
        start += size
    if start < end:
        yield start, end


def fold(text: str, spans: list[tuple[int, int]], spec: ChunkSpec) -> tuple[list[tuple[int, int]], list[tuple[str, str, int]]]:
    """Spans gathered until they reach the target; a span over the target stands alone."""
    chunks, warnings, open_at, shut_at, held = [], [], None, 0, 0

    def flush():
        nonlocal open_at, held
        if open_at is not None:
            chunks.append((open_at, shut_at))
        open_at, held = None, 0

    for start, end in spans:
        size = end - start
        if size > spec.target:
            flush()
            if size > spec.limit:
                warnings.append(("sentence_soft_split", f"sentence {size} chars > max {spec.limit}", start))
                chunks.extend(_soft_cuts(text, start, end, spec))
            else:
                warnings.append(("sentence_over_target", f"sentence {size} chars > target {spec.target}", start))
                chunks.append((start, end))
            continue
        open_at = start if open_at is None else open_at
        shut_at, held = end, held + size
        if held >= spec.target:
            flush()
    flush()
    return chunks, warnings


def overlapped(chunks: list[tuple[int, int]], spans: list[tuple[int, int]], spec: ChunkSpec) -> tuple[list[tuple[int, int]], list[tuple[str, str, int]]]:
    """Chunks begin earlier, at the last sentence boundary from 2N to N before the raw end of the chunk before."""
    if not spec.overlap or not chunks:
        return chunks, []
    bounds = sorted({b for span in spans for b in span})
    out, warnings = [chunks[0]], []
    for (_, before), (start, end) in zip(chunks, chunks[1:], strict=False):
        at = bisect_right(bounds, before - spec.overlap) - 1
        snap = bounds[at] if at >= 0 and bounds[at] >= before - 2 * spec.overlap else None
        if snap is None or snap >= start:
            warnings.append(("overlap_skipped", f"no boundary from {before - 2 * spec.overlap} to {before - spec.overlap}", start))
            snap = start
        out.append((snap, end))
    return out, warnings


_CHUNK = "source string, ord int, char_start int, char_end int, text string"
_WARNING = "source string, kind string, detail string, char_offset int"
_TYPES = {"string": pa.string(), "int": pa.int32()}


def _cut(text: str, spec: ChunkSpec) -> tuple[list[tuple[int, int]], list[tuple[str, str, int]]]:
    """Chunks and warnings of one text."""
    spans = sentence_spans(text, spec.terminators)
    raw, told = fold(text, spans, spec)
    final, more = overlapped(raw, spans, spec)
    return final, [*told, *more]


def _cut_documents(docs: DataFrame, of: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    """Rows that `of` makes of each source and text; null and empty texts have none."""
    names, types = zip(*(field.split() for field in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 1):
            rows = [r for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for r in of(source, text)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, kind in zip(columns, types, strict=True)], names=list(names))

    return docs.select("source", "text").mapInArrow(run, schema)


def with_sentences(docs: DataFrame, terminators: str = TERMINATORS) -> DataFrame:
    """P5: (source, ord, start, end), one row a sentence; null and empty texts have none."""
    return _cut_documents(docs, lambda source, text: [(source, i, a, b) for i, (a, b) in enumerate(sentence_spans(text, terminators))], "source string, ord int, start int, end int")


def chunk_documents(docs: DataFrame, spec: ChunkSpec | None = None) -> DataFrame:
    """(source, ord, char_start, char_end, text, chunk_id) of every chunk of docs (source, text)."""
    spec = spec or ChunkSpec()
    rows = _cut_documents(docs, lambda source, text: [(source, i, a, b, text[a:b]) for i, (a, b) in enumerate(_cut(text, spec)[0])], _CHUNK)
    return rows.withColumn("chunk_id", chunk_id(F.col("source"), F.col("char_start"), F.col("char_end"), F.col("text")))


def chunk_warnings(docs: DataFrame, spec: ChunkSpec | None = None) -> DataFrame:
    """(source, kind, detail, char_offset)."""
    spec = spec or ChunkSpec()
    return _cut_documents(docs, lambda source, text: [(source, *w) for w in _cut(text, spec)[1]], _WARNING)


def with_row_index(rows: DataFrame, *order: str) -> DataFrame:
    """A dense global number from 0 in the given order, without a window over one partition.

    Rows are range-sorted and kept; each partition's size goes to the driver (one number a
    partition) and its start back as a literal. Both passes read the same kept partitions, so
    a lost one is rebuilt with the same bounds.
    """
    kept = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_id", 33).cast("int")
    sizes = dict(kept.groupBy(part.alias("p")).count().collect())
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return kept.withColumn("row_index", F.lit(0).cast("long")).drop("_id")
    offsets = F.create_map(*[F.lit(x) for p, n in starts.items() for x in (p, n)])
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("row_index", (F.element_at(offsets, part) + inside).cast("long")).drop("_id")
