"""Corpus health as one table of findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import single_sentence

from .names import pairs_alike
from .search import row_shapes, similar_pairs

FINDING = "check_order int, severity string, category string, message string, detail string"
SEVERITIES = ("fatal", "warning", "info")


@dataclass(frozen=True)
class Thresholds:
    """L18."""

    pairwise: int = 2000
    cosine: float = 0.95
    degenerate_l2: float = 1e-6
    degenerate_terms: int = 3
    name_ratio: float = 0.85
    target: int = 500
    limit: int = 1500
    terminator: str = "。"
    few_entities: int = 3
    few_chunks: int = 20


def _finding(order: int, severity: str, category: str, message, detail=None):
    cast = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(order).alias("check_order"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), cast(message).alias("message"), (F.lit("") if detail is None else cast(detail)).alias("detail"))


def by_length(chunks: DataFrame, t: Thresholds) -> DataFrame:
    """L7-L10 in one pass over (chunk_id, text)."""
    n, told = F.length("text"), lambda what: F.concat(F.col("chunk_id"), F.lit(what))
    size = F.concat(n.cast("string"), F.lit(" chars"))
    length = F.when(n == 0, _finding(7, "warning", "empty_chunk", told(" is empty"))).when(n > t.limit, _finding(8, "warning", "over_max_chunk", told(" is over the limit"), size)).when(n > 2 * t.target, _finding(9, "warning", "over_2x_target", told(" is over twice the target"), size))
    single = F.when((n > 0) & single_sentence(F.col("text"), t.terminator), _finding(10, "info", "single_sentence", told(" has one sentence")))
    return chunks.select(F.explode(F.array_compact(F.array(length, single))).alias("f")).select("f.*")


def degenerate(chunks: DataFrame, weighted: DataFrame, t: Thresholds, shapes: DataFrame | None = None) -> DataFrame:
    """Too few terms or no norm; chunks without any term count too. `shapes` (`search.row_shapes`) have both already."""
    if shapes is None:
        stats = weighted.groupBy("chunk_id").agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    else:
        stats = shapes.select("chunk_id", "n", F.sqrt("total").alias("norm"))
    found = chunks.select("chunk_id").join(stats, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("norm", F.lit(0.0)).alias("norm"))
    bad = found.where((F.col("n") < t.degenerate_terms) | (F.col("norm") < t.degenerate_l2))
    return bad.select(_finding(11, "warning", "degenerate_vector", F.concat(F.col("chunk_id"), F.lit(" has a degenerate vector")), F.concat(F.col("n").cast("string"), F.lit(" terms"))).alias("f")).select("f.*")


def duplicates(weighted: DataFrame, n_chunks: int, t: Thresholds, parts: int | None = None, of: Callable[[DataFrame], DataFrame] | None = None, shapes: DataFrame | None = None) -> DataFrame:
    """Pairs above the cosine; only told to be skipped where there are more chunks than `pairwise`."""
    if n_chunks > t.pairwise:
        row = _finding(13, "info", "pairwise_skipped", "pairwise checks are skipped", f"{n_chunks} chunks > {t.pairwise}")
        return weighted.sparkSession.range(1).select(row.alias("f")).select("f.*")
    pairs = similar_pairs(weighted, t.cosine, parts=parts, of=of, shapes=shapes)
    return pairs.select(_finding(12, "warning", "duplicate", F.concat_ws(" ", F.col("a"), F.lit("and"), F.col("b"), F.lit("are near duplicates")), F.format_string("%.4f", F.round("cosine", 4))).alias("f")).select("f.*")


def orphans(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries that succeeded, none of whose chunks is in the corpus."""
    ok = manifest.where("status = 'success'")
    alive = ok.select("entity_name", "ner_label", F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("entity_name", "ner_label").distinct()
    lost = ok.join(alive, ["entity_name", "ner_label"], "left_anti")
    return lost.select(_finding(14, "warning", "orphan_wiki", F.concat(F.col("ner_label"), F.lit("__"), F.col("entity_name"), F.lit(" has no chunk in the corpus"))).alias("f")).select("f.*")


def few_entities(spark: SparkSession, n_success: int, n_chunks: int, t: Thresholds) -> DataFrame:
    """L15."""
    row = _finding(15, "warning", "wiki_disabled", "too few entities and chunks for summaries", f"{n_success} entities, {n_chunks} chunks")
    return spark.range(1 if n_success < t.few_entities and n_chunks < t.few_chunks else 0).select(row.alias("f")).select("f.*")


def similar_names(manifest: DataFrame, t: Thresholds) -> DataFrame:
    """(a, b, ratio) of success entries with names alike, by their keys (LABEL__name), a < b; exact, at any number of entries.

    The ratio is 2 * (length of the longest common subsequence) / (both lengths).
    """
    ok = manifest.where("status = 'success'").select(F.concat_ws("__", "ner_label", "entity_name").alias("key"), F.col("entity_name").alias("name")).where("name <> ''")
    return pairs_alike(ok, t.name_ratio)


def findings(chunks: DataFrame, weighted: DataFrame, manifest: DataFrame | None, t: Thresholds | None = None, *, has_pages: bool = True, parts: int | None = None, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All findings; check_order tells the rule. `parts` and `of` as in `search.similar_pairs`."""
    t = t or Thresholds()
    spark, n_chunks = chunks.sparkSession, chunks.count()
    shapes = row_shapes(weighted, t.cosine) if n_chunks <= t.pairwise else None
    out = by_length(chunks, t).unionByName(degenerate(chunks, weighted, t, shapes)).unionByName(duplicates(weighted, n_chunks, t, parts, of, shapes))
    if manifest is None:
        return out.unionByName(few_entities(spark, 0, n_chunks, t))
    n_success = manifest.where("status = 'success'").count()
    out = out.unionByName(orphans(manifest, chunks)).unionByName(few_entities(spark, n_success, n_chunks, t))
    if has_pages and n_success <= t.pairwise:
        names = similar_names(manifest, t)
        out = out.unionByName(names.select(_finding(16, "info", "similar_entity", F.concat_ws(" ", F.col("a"), F.lit("and"), F.col("b"), F.lit("are alike")), F.format_string("%.4f", F.round("ratio", 4))).alias("f")).select("f.*"))
    return out


def fatal(spark: SparkSession, category: str, message: str) -> DataFrame:
    """What stops a run."""
    return spark.createDataFrame([(0, "fatal", category, message, "")], FINDING)


def severity_counts(found: DataFrame) -> DataFrame:
    """A10: one row (fatal, warning, info)."""
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def exit_code(found: DataFrame) -> int:
    """2, 1 or 0."""
    row = severity_counts(found).first()
    return 2 if row["fatal"] else 1 if row["warning"] else 0
