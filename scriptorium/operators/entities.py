"""Entities over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTITY = ["name", "ner_label"]


def with_mentions(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks with the array `entities` in the order of offsets; empty where there are none."""
    told = F.array_sort(F.collect_list(F.struct("char_start", "char_end", "name", "ner_label")))
    lists = mentions.groupBy("chunk_id").agg(F.transform(told, lambda m: F.struct(m["name"].alias("name"), m["ner_label"].alias("ner_label"), m["char_start"].alias("char_start"), m["char_end"].alias("char_end"))).alias("entities"))
    none = F.array().cast("array<struct<name:string,ner_label:string,char_start:int,char_end:int>>")
    return chunks.join(lists, "chunk_id", "left").withColumn("entities", F.coalesce("entities", none))


def counted(mentions: DataFrame) -> DataFrame:
    """(chunk_id, entity, times): the pre-aggregate that all else is made from. All functions here take it in the place of mentions; kept by the caller, it saves finding them again."""
    return mentions if "times" in mentions.columns else mentions.groupBy("chunk_id", *ENTITY).agg(F.count("*").alias("times"))


def entity_counts(mentions: DataFrame) -> DataFrame:
    """A4, A5: (name, ner_label, mention_count, chunk_count)."""
    return counted(mentions).groupBy(*ENTITY).agg(F.sum("times").alias("mention_count"), F.count("*").alias("chunk_count"))


def accepted(min_mentions: int = 3, min_chunks: int = 2) -> Column:
    """F3."""
    return (F.col("mention_count") >= min_mentions) & (F.col("chunk_count") >= min_chunks)


def entity_members(mentions: DataFrame, *, min_mentions: int = 3, min_chunks: int = 2) -> DataFrame:
    """(chunk_id, name, ner_label) of accepted entities, one row a chunk."""
    counts = counted(mentions)
    kept = entity_counts(counts).where(accepted(min_mentions, min_chunks))
    return counts.join(kept.select(*ENTITY), ENTITY, "left_semi").select("chunk_id", *ENTITY)


def entity_chunks(mentions: DataFrame, positions: DataFrame, *, min_mentions: int = 3, min_chunks: int = 2) -> DataFrame:
    """A6 as a long table: (name, ner_label, row_index, chunk_id) of accepted entities, one row a chunk, of any number of chunks an entity."""
    own = entity_members(mentions, min_mentions=min_mentions, min_chunks=min_chunks)
    return own.join(positions.select("chunk_id", "row_index"), "chunk_id").select(*ENTITY, "row_index", "chunk_id").distinct()


def entity_pairs(mentions: DataFrame, *, min_mentions: int = 3, min_chunks: int = 2) -> DataFrame:
    """A7 as a long table: (name, ner_label, other_label, other_name) of accepted entities and those that share a chunk with them, which need not be accepted themselves."""
    counts = counted(mentions)
    own = entity_members(counts, min_mentions=min_mentions, min_chunks=min_chunks)
    other = counts.select("chunk_id", F.col("name").alias("other_name"), F.col("ner_label").alias("other_label"))
    pairs = own.join(other, "chunk_id").where((F.col("name") != F.col("other_name")) | (F.col("ner_label") != F.col("other_label")))
    return pairs.select(*ENTITY, "other_label", "other_name").distinct()


def _first(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first `most` rows of each entity; Spark keeps so many a task before it shuffles them."""
    if most is None:
        return rows
    return rows.withColumn("_at", F.row_number().over(W.partitionBy(*ENTITY).orderBy(*order))).where(F.col("_at") <= most).drop("_at")


def aggregate_entities(mentions: DataFrame, positions: DataFrame, *, min_mentions: int = 3, min_chunks: int = 2, most: int | None = None) -> DataFrame:
    """Accepted entities with chunk_ids in corpus order and co-occurring entities by label and name.

    positions: (chunk_id, row_index); row_index is anything that sorts as the corpus does. `most` bounds both lists (counts stay those of all); what
    they leave out is in `entity_chunks` and `entity_pairs`, which have a row an item. Without it
    an entity's lists are as long as it is frequent, and must fit in one row.
    """
    counts = counted(mentions).persist()
    return with_lists(entity_counts(counts).where(accepted(min_mentions, min_chunks)), counts, positions, min_mentions=min_mentions, min_chunks=min_chunks, most=most)


def with_lists(kept: DataFrame, mentions: DataFrame, positions: DataFrame, *, min_mentions: int = 3, min_chunks: int = 2, most: int | None = None) -> DataFrame:
    """Accepted entities with both lists, by left joins with one row an entity, so that a list which nothing reads is not made."""
    least = {"min_mentions": min_mentions, "min_chunks": min_chunks}
    places = _first(entity_chunks(mentions, positions, **least), ["row_index", "chunk_id"], most)
    lists = places.groupBy(*ENTITY).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    pairs = _first(entity_pairs(mentions, **least), ["other_label", "other_name"], most)
    together = pairs.groupBy(*ENTITY).agg(F.array_sort(F.collect_list(F.struct(F.col("other_label").alias("ner_label"), F.col("other_name").alias("name")))).alias("cooccurring_entities"))
    none = F.array().cast("array<struct<ner_label:string,name:string>>")
    return kept.join(lists, ENTITY, "left").join(together, ENTITY, "left").withColumn("cooccurring_entities", F.coalesce("cooccurring_entities", none))


def in_priority(entities: DataFrame) -> list[Column]:
    """Most mentions, most chunks, then name (and label, to break the last ties)."""
    return [F.desc("mention_count"), F.desc("chunk_count"), F.asc("name"), F.asc("ner_label")]


def entity_stats(mentions: DataFrame, *, min_mentions: int = 3, min_chunks: int = 2) -> DataFrame:
    """One row (total_detected, accepted, skipped)."""
    ok = accepted(min_mentions, min_chunks)
    return entity_counts(mentions).agg(F.count("*").alias("total_detected"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("skipped"))


def entity_key(label: Column, name: Column) -> Column:
    """M1."""
    return F.concat(label, F.lit("__"), name)
