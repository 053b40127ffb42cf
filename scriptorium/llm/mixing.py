"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

The words of a source, its documents in a shuffled order (MD5 of the id), form one stream
that is cut into blocks of equal length. Slots 1, 2, 3, ... of the mix are dealt to sources
by golden-ratio points frac(i * 0.618...) that fall into the sources' cumulative weights; the
r-th slot of a source joins block r of its stream, and starts the stream anew (another epoch)
after the last block. A source's last slot is cut so that its target is met to the word;
where the points leave a source short by a slot or two, closing slots follow the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, free_names, prefix_sums, word_count, written

#: Words in a block, and slots that are ranked together.
BLOCK, CHUNK = 256, 4096
#: No document is taken more often than this.
MOST = 3
WEIGHTS = (1, 2, 3)
GOLDEN = 0.6180339887498949
#: Equal steps of the unit interval by which points find their source.
CELLS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Sources by code point, null last, weigh `weights`, repeating. They share the total size
    by weight; a target stops at `most` times its source's size and the excess is shared
    by weight among the rest, until none is above. That level is found in one pass: with
    sources in the order of most * size / weight, the first k are capped, where k is the
    least number for which the share of the rest is within the next one's cap.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    up = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0))
    level = ranked.withColumn("level", (F.sum("source_size").over(all_rows) - before("cap")).cast("double") / (F.sum("weight").over(all_rows) - before("weight")).cast("double"))
    fits = level.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    water = fits.withColumn("water", F.coalesce(F.max("fits").over(all_rows), F.lit(0.0)))
    return water.select("source", "source_size", "weight", F.least(F.col("weight") * F.col("water"), F.col("cap").cast("double")).alias("target"))


def _key(group: Column) -> Column:
    return F.md5(F.coalesce(group.cast("string"), F.lit("")).cast("binary"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, source, size, key): what the schedule needs of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _key(F.col(id_col)).alias("key"))


def _digits(rows: int) -> int:
    """Hex digits of a bucket of keys: about the square root of the rows in each, 16 at least."""
    n = 1
    while 16 ** (2 * n) < rows and n < 7:
        n += 1
    return n


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source, rank): slots dealt to sources by golden-ratio points; closing slots are numbered on, by rank.

    Needs (source, n_slots). Ranks count each source's slots from 0 and stay under n_slots.
    """
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    up = W.orderBy(F.col("source").asc_nulls_last())
    share = sources.where("n_slots > 0").select("source", "n_slots", (F.sum("n_slots").over(up.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_slots")).alias("low"), F.sum("n_slots").over(up.rowsBetween(W.unboundedPreceding, 0)).alias("high"))
    scale = F.lit(float(max(total, 1)))
    share = share.withColumn("low", F.col("low") / scale).withColumn("high", F.col("high") / scale)
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int"))))
    points = spark.range(total).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    dealt = points.join(cells, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("slot", "source", "n_slots", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).cast("long").alias("one"))
    ranked = prefix_sums(dealt, ["source"], "chunk", [F.col("slot")], "one", "rank")
    used = ranked.where(F.col("rank") < F.col("n_slots")).select("slot", "source", "rank")
    counts = dealt.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("given"))
    short = sources.join(counts, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("given", F.coalesce("given", F.lit(0))).where(F.col("given") < F.col("n_slots"))
    closing = short.withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("n_slots") - 1)))
    return used.unionByName(closing.select((F.lit(total) + F.col("rank")).alias("slot"), "source", "rank"))


def _laid_out(docs: DataFrame, weights, most, block, id_col, text_col, source_col):
    """(rows, sources, slots placed on blocks, pieces of documents in blocks): what `mix` and `in_order` are made of."""
    rows = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    n = rows.count()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, most)
    goal = F.floor("target").cast("long")
    length = F.ceil(F.col("source_size") / F.ceil(F.col("source_size") / block)).cast("long")
    sources = sources.withColumn("goal", goal).withColumn("length", F.when(F.col("source_size") > 0, length).otherwise(F.lit(1)))
    sources = sources.withColumn("n_blocks", F.expr("(source_size + length - 1) div length"))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal div greatest(source_size, 1)")).otherwise(0)).withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    sources = written(sources.withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + F.expr("(rest + length - 1) div length")), "mix-sources")
    slots = schedule(sources.select("source", "n_slots"))
    about = sources.select(F.col("source").alias("_source"), "n_blocks", "length", "epochs", "rest")
    same = F.col("source").eqNullSafe(F.col("_source"))
    placed = slots.join(about, same).drop("_source").withColumn("block", F.expr("rank % n_blocks")).withColumn("cut", F.when(F.expr("rank div n_blocks") == F.col("epochs"), F.col("rest") - F.col("block") * F.col("length")))
    laid = prefix_sums(rows.withColumn("bucket", F.substring("key", 1, _digits(n))), ["source"], "bucket", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_hash")], "size", "begin")
    laid = laid.join(about, same).drop("_source")
    pieces = laid.where("size > 0").withColumn("block", F.explode(F.expr("sequence(begin div length, (begin + size - 1) div length)")))
    first = F.col("block") * F.col("length")
    pieces = pieces.withColumn("low", F.greatest(F.col("begin"), first) - first).withColumn("high", F.least(F.col("begin") + F.col("size"), first + F.col("length")) - first)
    return rows, sources, placed, pieces


def in_order(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (slot, place, source, doc_id, first_word, n_words), in the order (slot, place).

    Slot by slot as the golden-ratio points deal them; a slot's block gives its words piece by
    piece, each a run of words of one document. Closing slots come after all others. Rows that
    `mix` takes nothing of have none; nulls, ties and empty tables are as there.
    """
    _, sources, placed, pieces = _laid_out(docs, weights, most, block, id_col, text_col, source_col)
    slots = placed.select("slot", F.col("source").alias("_source"), F.col("block").alias("_block"), "cut")
    met = slots.join(pieces, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    end = F.least(F.col("high"), F.coalesce("cut", F.col("high")))
    return met.where(end > F.col("low")).select("slot", F.col("low").alias("place"), "source", "doc_id", (F.col("block") * F.col("length") + F.col("low") - F.col("begin")).alias("first_word"), (end - F.col("low")).alias("n_words"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, source, text_hash) of every row.

    taken: words of the row that the mix takes, repeats counted: whole epochs, then what the
    last, cut epoch reaches; first_slot: the slot in which its first words come, null if none do. A null or empty text has size 0 and is never taken; a null
    source is a source of its own, the last; null ids sort as empty strings; repeated rows
    are rows like others; an empty table gives none; other columns are ignored. Reruns agree.
    """
    rows, sources, placed, pieces = _laid_out(docs, weights, most, block, id_col, text_col, source_col)
    uses = placed.groupBy("source", "block").agg(
        F.count_if(F.col("cut").isNull() | (F.col("cut") >= F.col("length"))).alias("full"),
        F.max(F.when(F.col("cut") < F.col("length"), F.col("cut"))).alias("cut"), F.min("slot").alias("slot"),
    )
    used = uses.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "full", "cut", "slot")
    joined = pieces.join(used, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    low, high = F.col("low"), F.col("high")
    words = F.coalesce("full", F.lit(0)) * (high - low) + F.greatest(F.least(high, F.coalesce("cut", F.lit(0))) - low, F.lit(0))
    taken = joined.withColumn("words", words).groupBy("doc_id", "source", "begin", "size", "text_hash").agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"))
    none = F.lit(None).cast("long")
    every = taken.unionByName(rows.where("size = 0").select("doc_id", "source", F.lit(0).cast("long").alias("begin"), "size", "text_hash", F.lit(0).cast("long").alias("taken"), none.alias("first_slot")))
    facts = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return every.join(facts, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot", "source", "text_hash")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with its mix in place of its texts: a row for each whole time that a document is
    taken, and one with its first words where the last epoch stops inside it; n_chars follows.

    Rows that repeat an id, source and text share what their copies take evenly, rounded
    down. Texts without words, null ones included, are never taken; null ids and sources are
    values like others; an empty table gives none; further columns, of any name and type, are
    kept.
    """
    row, of, words, key = free_names(docs, "row", "of", "words", "key")
    place = lambda i, s, h: F.struct(i.alias("i"), s.alias("s"), h.alias("h"))
    takes = mix(docs, **options).groupBy(place(F.col("doc_id"), F.col("source"), F.col("text_hash")).alias(of)).agg(F.expr("sum(taken) div count(*)").alias("taken"), F.max("size").alias("size"))
    whole, rest = F.expr("taken div size"), F.expr("taken % size")
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    takes = takes.where("taken > 0").select(of, parts.alias(words))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(row))
    packed = packed.withColumn(key, place(F.col(f"{row}.doc_id"), F.col(f"{row}.source"), F.xxhash64(F.coalesce(F.col(f"{row}.text"), F.lit("")))))
    found = packed.join(takes, F.col(key).eqNullSafe(F.col(of))).select(row, F.explode(words).alias(words))
    # pieces of a text that end with a word; the first n of them hold its first n words
    ends = rf"(?<=[^{BLANKS}])(?=[{BLANKS}])"
    text = F.col(f"{row}.text")
    head = F.array_join(F.slice(F.split(text, ends), F.lit(1), F.col(words).cast("int")), "")
    new = F.when(F.col(words) > 0, head).otherwise(text)
    out = found.select(*[new.alias(c) if c == "text" else F.col(row).getField(c).alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
