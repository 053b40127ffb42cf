"""Packing into optimal length buckets.

Documents are cut into pieces of at most `max_len` words (or tokens of a vocabulary), so that
the global histogram of lengths has at most max_len bars, however many documents there are. Dynamic programming over
it chooses the boundaries of at most `buckets` buckets that minimise padding. Inside each
bucket pieces form batches of a fixed token budget: a batch of a bucket with boundary b
holds budget // b pieces, each padded to b.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import BLANKS, prefix_sums, word_count, written

MAX_LEN, BUCKETS, BUDGET = 2048, 16, 32768


def boundaries(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of the buckets that leave the least padding, ascending; the last is the largest length.

    counts: pieces by length (1 and more). cost(i, j] = j * pieces - words of the lengths in (i, j].
    """
    lengths = sorted(k for k, v in counts.items() if v > 0 and k > 0)
    if not lengths:
        return []
    n = len(lengths)
    at = np.array(lengths, np.int64)
    c = np.concatenate(([0], np.cumsum([counts[k] for k in lengths]))).astype(np.int64)
    s = np.concatenate(([0], np.cumsum([counts[k] * k for k in lengths]))).astype(np.int64)
    # cost[i, j]: lengths i+1..j (1-based) in one bucket that ends at the j-th
    cost = at[None, :] * (c[None, 1:] - c[:-1, None]) - (s[None, 1:] - s[:-1, None])
    never = np.iinfo(np.int64).max // 4
    cost[np.tril_indices(n, -1)] = never
    best, cuts = cost[0].copy(), [np.zeros(n, np.int64)]
    for _ in range(min(buckets, n) - 1):
        total = np.concatenate(([never], best[:-1]))[:, None] + cost
        pick = total.argmin(axis=0)
        nxt = total[pick, np.arange(n)]
        better = nxt < best
        cuts.append(np.where(better, pick, -1))
        best = np.where(better, nxt, best)
    out, j = [], n
    for k in range(len(cuts) - 1, -1, -1):
        i = cuts[k][j - 1]
        if i < 0:
            continue
        out.append(int(at[j - 1]))
        j = int(i)
        if j == 0:
            break
    return sorted(out)


def _spans(text, size, max_len: int):
    """(start, end, length, over) of each piece of a text of `size` words, in code points; pieces lie end to end and are the text."""
    long = F.lit(max_len).cast("long")
    span = lambda a, b, n: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), n.cast("long").alias("length"), F.lit(0).cast("long").alias("over"))
    whole = F.array(span(F.lit(0), F.length(text), size))
    # parts that end with a word; the last also has what follows it
    parts = F.transform(F.split(text, rf"(?<=[^{BLANKS}])(?=[{BLANKS}])"), F.length)

    def cut(parts):
        # a text that ends with blanks has one part more than words
        n_pieces = F.ceil(size / max_len).cast("int")
        own = lambda p: F.aggregate(F.slice(parts, (p * max_len + 1).cast("int"), F.when(p + 1 == n_pieces, F.size(parts)).otherwise(max_len).cast("int")), F.lit(0).cast("long"), lambda n, x: n + x)
        chars = F.transform(F.sequence(F.lit(0), n_pieces - 1), own)
        step = lambda out, n: F.array_append(out, F.element_at(out, -1) + n)
        ends = F.aggregate(chars, F.array(F.lit(0).cast("long")), step)
        return F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda p: span(F.element_at(ends, p + 1), F.element_at(ends, p + 2), F.least(long, size - p * max_len)))

    return F.when(size <= max_len, whole).otherwise(F.transform(F.array(parts), cut)[0])


def _token_spans(texts: DataFrame, vocabulary: str, max_len: int) -> DataFrame:
    """(row, spans) of (row, text): pieces of at most max_len tokens, cut between words, as the tokenizer counts them.

    Words are split off at white space, which no token crosses. A word of more tokens than
    max_len is a piece of its own; its length is told as max_len, so that a batch can hold it,
    and `over` how many tokens that leaves out.
    """
    from .token_counts import counter

    def cut(text: str) -> list[dict]:
        count, out, at, n, start = counter(vocabulary), [], 0, 0, 0
        for m in _WORD.finditer(text):
            k = count(m.group())
            if n and n + k > max_len:
                out.append({"start": start, "end": at, "length": min(n, max_len), "over": max(0, n - max_len)})
                start, n = at, 0
            n, at = n + k, m.end()
        return [*out, {"start": start, "end": len(text), "length": min(n, max_len), "over": max(0, n - max_len)}]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "length", "over")]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cut(t.as_py() or "") for t in batch.column(1)], kind)], names=["row", "spans"])

    fields = StructType([texts.schema["row"], StructField("spans", ArrayType(StructType([StructField(c, LongType()) for c in ("start", "end", "length", "over")])))])
    return texts.mapInArrow(work, fields)


_WORD = re.compile("[^ \t\n\r\f\v]+")


def pack(docs: DataFrame, *, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, keep: tuple[str, ...] = (), vocabulary: str | None = None) -> DataFrame:
    """One row per piece: (doc_id, piece, n_pieces, length, char_start, char_end, bucket_len, batch, slot, padding, over, ...keep).

    Length counts `[^\\x20\\x09-\\x0D]+` words, or with a `vocabulary` file its tokens. A piece is
    text[char_start:char_end] in code points; the pieces of a document lie end to end.
    (bucket_len, batch) names a batch, slot a place in it: a row of bucket_len places, of which
    the first `length` are its piece's and `padding` are masked. Batches of a bucket hold
    budget // bucket_len rows and are full but for the last. A document without words has one
    piece of length 0 outside all batches (bucket_len, batch, slot and padding are null).
    `over` counts tokens of a single word beyond max_len; it is 0 without a vocabulary. Pieces
    go by MD5 of their id, so reruns agree; rows that repeat an id are pieces of their own;
    null ids sort as empty strings; an empty table gives none; columns other than `keep` are
    ignored.
    """
    if not 0 < max_len <= budget:
        raise ValueError("a batch must hold a piece")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    base = docs.select("doc_id", *kept, F.coalesce("text", F.lit("")).alias("text"))
    held = [c for c in base.columns if c != "text"]
    if vocabulary is None:
        # a lambda's variable is computed once, however often the spans use it
        spans = F.transform(F.array(word_count(F.col("text"))), lambda size: _spans(F.col("text"), size, max_len))[0]
        cut = base.select(*held, spans.alias("spans"))
    else:
        cut = _token_spans(base.select(F.struct(*held).alias("row"), "text"), vocabulary, max_len).select("row.*", "spans")
    exploded = cut.select(*held, key.alias("key"), F.size("spans").cast("long").alias("n_pieces"), F.posexplode("spans").alias("piece", "s"))
    pieces = written(exploded.select(*held, "key", "n_pieces", F.col("piece").cast("long").alias("piece"), F.col("s.length").alias("length"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.col("s.over").alias("over")), "packing-pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most max_len + 1 rows
    bounds = boundaries(histogram, buckets)
    n = sum(histogram.values())
    digits = 1
    while 16 ** (2 * digits) < n and digits < 7:
        digits += 1
    ends = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    placed = pieces.where("length > 0").withColumn("bucket_len", F.array_min(F.filter(ends, lambda b: b >= F.col("length"))))
    counted = placed.withColumn("part", F.substring("key", 1, digits)).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(counted, ["bucket_len"], "part", [F.col(c) for c in ("key", "doc_id", "piece", "n_pieces", "char_start", "char_end")], "one", "rank")
    batched = ranked.withColumn("batch", F.expr(f"rank div ({budget}L div bucket_len)")).withColumn("slot", F.expr(f"rank % ({budget}L div bucket_len)")).withColumn("padding", F.col("bucket_len") - F.col("length"))
    none = pieces.where("length = 0").withColumns({c: F.lit(None).cast("long") for c in ("bucket_len", "batch", "slot", "padding")})
    columns = ["doc_id", "piece", "n_pieces", "length", "char_start", "char_end", "bucket_len", "batch", "slot", "padding", "over"]
    named = [*columns, *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]]
    return batched.select(*named).unionByName(none.select(*named))


def batches(docs: DataFrame, **options) -> DataFrame:
    """The packed batches: (bucket_len, batch, n_rows, n_real, n_padding, rows), rows by slot: (slot, doc_id, piece, text, length, mask).

    mask is the attention mask of a row as its one run of ones: (0, length), of bucket_len
    places. A batch is bounded by its budget. Options are those of `pack`; its ids must tell
    documents apart (of rows that repeat an id, texts go by whichever is the smallest).
    """
    packed = pack(docs, **options).where("batch IS NOT NULL")
    texts = docs.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("text").alias("_text"))
    met = packed.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")))
    piece = F.substring("_text", F.col("char_start") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    row = F.struct("slot", "doc_id", "piece", piece.alias("text"), "length", F.struct(F.lit(0).cast("long").alias("start"), F.col("length").alias("end")).alias("mask"))
    return met.groupBy("bucket_len", "batch").agg(F.count("*").alias("n_rows"), F.sum("length").alias("n_real"), F.sum("padding").alias("n_padding"), F.array_sort(F.collect_list(row)).alias("rows"))
