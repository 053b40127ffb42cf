"""The corpus pipeline: quality, near duplicates, personal data, source mix, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import jaccard, mixing, packing, pii, quality
from scriptorium.llm.common import free_names, table, written

#: Documents whose quality score is below this go.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not reject.

    Null and empty texts are scored like others; repeated rows and null ids stay or go each by
    their text; an empty table gives none; further columns, of any name, are kept.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = free_names(docs, "quality_score")
    return quality.score(docs, model, keep=docs.columns, at_least=LEAST_QUALITY, name=name).drop(name)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of links.

    Of rows that repeat an id the one stays whose shingle set stands for the id in the join
    (the smallest), the first text of those by code point; documents without words, and all rows
    without an id, are linked with nothing and stay; an empty table gives none; further
    columns, of any name and type, are kept.
    """
    found = written(jaccard.jaccard_components(docs), "pipeline-components")
    of, row, stands = free_names(docs, "of", "row", "stands")
    held = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(of)).agg(F.min("component_id").alias("least"), F.count("*").alias("times"))
    first, once = F.col("least") == F.col(of), F.col("times") == 1
    # most rows are neither copies nor repeated: they stay where they are, and only the others' texts are joined
    odd = written(held.where(~(first & once)).select(of, first.alias(stands)), "pipeline-copies")
    some, others = jaccard.told_apart(docs, odd.select(of))
    single = others.unionByName(some.join(odd.select(of), some["doc_id"] == F.col(of), "left_anti"))
    several = some.join(odd.where(F.col(stands)).select(of), some["doc_id"] == F.col(of), "left_semi").select(F.struct("*").alias(row))
    order = F.struct("n", "s1", "s2", F.col(f"{row}.text"))
    one = jaccard.with_set(several, row).groupBy(F.col(f"{row}.doc_id").alias(of)).agg(F.min_by(row, order).alias(row)).select(f"{row}.*")
    return single.unionByName(one)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in the place of personal data; n_chars follows.

    Null and empty texts stay as they are; repeated rows and null ids are rows like others; an
    empty table gives none; further columns, of any name, are kept.
    """
    out = pii.replace_pii(docs, count=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix takes them; n_chars follows.

    Texts without words are never taken; a null source is a source of its own; repeated rows
    share what the mix takes of them; an empty table gives none; further columns, of any
    name, are kept.
    """
    return mixing.apply_mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of every piece of every document.

    A text without words is one piece outside of all batches; repeated rows and null ids are
    pieces of their own; an empty table gives none; further columns are not returned.
    """
    return packing.pack(docs, keep=("source", "lang"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_batches),
]

#: The classifier, the join and the bucket boundaries are not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
