"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, filter_audit, jaccard, licenses, mixing, packing, pii, quality, simhash, token_counts, topk, whitening
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document by gated attention over its passages."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and the slot of the schedule in which its first ones come."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other vectors for every hundredth vector."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's side; mask spans as text, and the masked characters' number."""
    rows = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    masked = F.aggregate("masks", F.lit(0), lambda n, m: n + m["end"] - m["start"])
    return rows.select("conv_id", "assistant", "part", "char_start", "n_turns", "text", spans.alias("mask_spans"), masked.cast("long").alias("masked_chars"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document by the public word-level BPE file."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document, of its edited text, and their likeness."""
    return simhash.compare_with_edits(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch and place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses found in every document, as `name:coefficient` parts; their number and the best coefficient."""
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    parts = F.array_join(F.transform("licenses", lambda m: F.concat(m["name"], F.lit(":"), F.round(m["dice"], 4).cast("string"))), ";")
    return rows.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), parts.alias("licenses"), F.coalesce(F.round(F.array_max(F.transform("licenses", lambda m: m["dice"])), 4), F.lit(0.0)).alias("best_dice"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links at Jaccard 0.8 over five-word shingles."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many entities that took."""
    return pii.replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "pii_count")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened coordinates, one row a component."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.by_component(vectors, whitening.fit(vectors))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every language, in every order and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal texts and the document of it that stays."""
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_source_mix, op3_exact_topk, op4_chat_format, op5_token_counts, op6_simhash, op7_packing, op8_license_scan, op9_jaccard_join, op10_pii_surrogates, op11_whitening, op12_filter_audit, op13_exact_dedup)}
