"""The three verbs: ingest, query, lint."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import normalize, positive_int
from scriptorium.operators import analysis, chunking, entities, lint, manifest, search, summaries, tfidf
from scriptorium.progress import Progress
from scriptorium.sources import artifacts, corpus, store
from scriptorium.sources.store import join

#: V5: how a run ended.
OK, NO_INPUT, NO_CLIENT, MISMATCH, NO_CHUNKS, SUMMARIES_FAILED, BROKEN = 0, 2, 3, 4, 5, 6, 10


@dataclass(frozen=True)
class IngestConfig:
    spec: chunking.ChunkSpec = field(default_factory=chunking.ChunkSpec)
    top_keywords: int = 10
    min_mentions: int = 3
    min_chunks: int = 2
    skip_summaries: bool = False
    max_calls: int | None = None
    force: bool = False
    retry_failed: bool = False
    backend: str = "offline"
    model: str | None = None
    parallelism: int | None = None
    analyzer_backend: str = "rules"
    device: str = "cpu"
    progress: Progress = field(default_factory=lambda: Progress(enabled=False))


@dataclass
class IngestResult:
    exit_code: int
    warnings: list[str] = field(default_factory=list)
    counters: dict = field(default_factory=dict)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _config(analyzer, cfg: IngestConfig) -> dict:
    return artifacts.analyzer_config(analyzer.settings, {"min_df": 1, "max_df": 1.0, "sublinear_tf": True, "top_keywords": cfg.top_keywords}, analyzer.versions)


#: Environment variables, the Spark settings they stand for, and their defaults.
ENVIRONMENT = {"SCRIPTORIUM_BATCH_SIZE": ("spark.sql.execution.arrow.maxRecordsPerBatch", 32), "SCRIPTORIUM_N_PROCESS": ("spark.sql.shuffle.partitions", None)}


def apply_environment(spark: SparkSession, analyzer_backend: str, env=os.environ) -> dict[str, str]:
    """Overrides, at least 1; a bad value counts as none. Batches are small for models alone."""
    done = {}
    for name, (key, default) in ENVIRONMENT.items():
        try:
            value = positive_int(env[name])
        except (KeyError, ValueError):
            value = default if analyzer_backend != "rules" else None
        if value:
            spark.conf.set(key, value)
            done[key] = str(value)
    return done


def ingest(spark: SparkSession, input_dir: str, out: str, cfg: IngestConfig | None = None, *, analyzer=None, make_client: Callable[..., summaries.Client] = summaries.client) -> IngestResult:
    """A directory of texts to chunks, weights, entities and summaries; the output changes only if all went well."""
    cfg = cfg or IngestConfig()
    apply_environment(spark, cfg.analyzer_backend)
    progress = cfg.progress
    files = corpus.scan_directory(spark, input_dir).persist()
    n_files = files.count()
    if n_files == 0:
        return IngestResult(NO_INPUT, ["no input files"])
    warnings, retry = [], cfg.retry_failed
    if cfg.force and retry:  # M7
        warnings, retry = ["retry-failed is ignored with force"], False
    try:
        model = summaries.NoClient() if cfg.skip_summaries else make_client(cfg.backend, **({"model": cfg.model} if cfg.model else {}))
    except summaries.ModelError as e:
        return IngestResult(NO_CLIENT, [*warnings, str(e)])
    try:  # SC12: what a corpus was made with wins over the configuration
        if store.exists(join(out, "analyzer.json")):
            analyzer, told = artifacts.load_and_verify(out, analyzer)
            warnings += told
        else:
            analyzer = analyzer or analysis.by_name(cfg.analyzer_backend, cfg.device)
        now = _config(analyzer, cfg)
    except (artifacts.AnalyzerMismatch, ValueError, KeyError, RuntimeError) as e:
        return IngestResult(MISMATCH, [*warnings, str(e)])
    staging = f"{out}.staging"
    try:
        artifacts.carry_over(out, staging)
        docs, skipped = corpus.usable(files), corpus.skipped(files)
        n_skipped = skipped.count()
        with progress.phase("chunks", n_files - n_skipped):
            raw = chunking.with_row_index(chunking.chunk_documents(docs, cfg.spec), "source", "ord").persist()
            n_chunks = raw.count()
        left_out = skipped.select(F.lit(0).alias("rank"), "source", F.lit(0).alias("char_offset"), F.concat("source", F.lit(": "), "reason").alias("line"))
        cut = chunking.chunk_warnings(docs, cfg.spec).select(F.lit(1).alias("rank"), "source", "char_offset", F.concat(F.lit("chunker/"), "kind", F.lit(": "), "detail").alias("line"))
        n_told, told = artifacts.write_warnings(left_out.unionByName(cut), staging)
        warnings += told
        if n_chunks == 0:
            return IngestResult(NO_CHUNKS, [*warnings, "no chunks"])
        parts = tfidf.parts_of(n_chunks, spark.sparkContext.defaultParallelism)
        counts = tfidf.term_counts(raw, analyzer.tokens(F.col("text")), parts=parts).persist()
        if counts.limit(1).count() == 0:
            raise tfidf.EmptyVocabulary("no chunk has a term")
        vocab = tfidf.vocabulary(counts, n_chunks).persist()
        weighted = tfidf.weights(counts, vocab, parts=parts).persist()
        mentions = raw.select("chunk_id", F.explode(analyzer.mentions(F.col("text"))).alias("m")).select("chunk_id", "m.*").where(F.col("ner_label").isin(*analysis.LABELS)).persist()
        keywords = tfidf.keyword_lists(tfidf.top_keywords(weighted, cfg.top_keywords), raw)
        chunks = entities.with_mentions(raw.join(keywords, "chunk_id"), mentions).select("chunk_id", "row_index", "source", "char_start", "char_end", "text", "top_keywords", "entities")
        artifacts.write_chunks(chunks, staging)
        with progress.phase("weights"):
            artifacts.write_index(weighted, vocab, now["tfidf"], staging, n_chunks)
        artifacts.write_json(join(staging, "analyzer.json"), now)
        least = {"min_mentions": cfg.min_mentions, "min_chunks": cfg.min_chunks}
        found = entities.aggregate_entities(mentions, raw, **least).persist()
        counters = {"input_files": n_files, "skipped_files": n_skipped, "chunks": n_chunks, "text_warnings": n_told, **{k: int(v) for k, v in entities.entity_stats(mentions, **least).first().asDict().items()}}
        if not cfg.skip_summaries:
            told, aborted = _summarize(spark, found, raw, staging, cfg, retry, model, analyzer.version)
            counters |= told
            if aborted:
                artifacts.keep_failed(staging, out)
                return IngestResult(SUMMARIES_FAILED, [*warnings, "too many calls failed"], counters)
        artifacts.write_index_page(manifest.index_lines(artifacts.load_manifest(spark, staging)[0]), staging)
        artifacts.write_log(staging, counters, warnings, _now())
        artifacts.swap(staging, out)
        artifacts.write_json(join(out, "ingest_result.json"), {"exit_code": OK, "warnings": warnings, **counters})  # SK8, D20
        return IngestResult(OK, warnings, counters)
    except summaries.Permanent as e:
        artifacts.keep_failed(staging, out)
        return IngestResult(SUMMARIES_FAILED, [*warnings, str(e)])
    except (tfidf.EmptyVocabulary, OSError) as e:
        artifacts.keep_failed(staging, out)
        return IngestResult(BROKEN, [*warnings, str(e)])
    finally:
        store.remove(staging)
        spark.catalog.clearCache()


def _summarize(spark, found: DataFrame, chunks: DataFrame, staging: str, cfg: IngestConfig, retry: bool, model, analyzer_version: str) -> tuple[dict, bool]:
    """Cache, budget, calls, manifest, pages. An empty run keeps the entries of the manifest (M6 wipes them by an oversight; see README)."""
    known, _ = artifacts.load_manifest(spark, staging)
    llm, at = model.model_id, _now()
    versions = {"analyzer_hash": artifacts.config_hash(staging), "model_version": analyzer_version, "llm": llm}
    planned = manifest.with_budget(manifest.decide(manifest.source_hashes(found, chunks, **versions), known, force=cfg.force, retry_failed=retry), cfg.max_calls).persist()
    actions = dict(planned.groupBy("action").count().collect())
    calls, rows, aborted = planned.where("action = 'call'"), [], False
    if sum(actions.values()):
        summaries.preflight(model)
    over = manifest.as_entries(planned.where("action = 'budget_skipped'"), F.lit("budget_skipped"), F.coalesce("prior_hash", F.lit("")), F.lit("budget exhausted"), at)

    def entries(rows: list) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What the calls made so far give: their entities, the manifest's rows, the answers."""
        answers = spark.createDataFrame([(r["name"], r["ner_label"], r["ok"], r["text"]) for r in rows], "name string, ner_label string, ok boolean, text string")
        done = calls.join(answers, entities.ENTITY)
        ok = F.col("ok")
        return done, manifest.as_entries(done, F.when(ok, "success").otherwise("failed"), F.col("source_hash"), F.when(ok, "").otherwise("retries exhausted"), at), answers

    def save(rows: list) -> None:
        """The manifest with what is known so far."""
        artifacts.save_manifest(manifest.merge(known, entries(rows)[1].unionByName(over)), staging, model_version=versions["model_version"], llm=llm, at=at)

    if actions.get("call"):
        tasks = calls.join(manifest.prompts(calls, chunks), entities.ENTITY).orderBy(*entities.in_priority(calls))
        with cfg.progress.phase("summaries", actions["call"]) as step:
            rows, aborted = summaries.summarize(tasks, model, parallelism=summaries.parallelism_of(cfg.backend, cfg.parallelism), on_checkpoint=save, on_wave=step)
    done, new, answers = entries(rows)
    save(rows)
    if not aborted:
        artifacts.write_pages(new.where("status = 'success'"), answers.where("ok"), manifest.snippets(done, chunks), staging, model_version=versions["model_version"], llm=llm)
    return {"calls": len(rows), "succeeded": sum(r["ok"] for r in rows), "failed": sum(not r["ok"] for r in rows), "cached": actions.get("cached", 0), "budget_skipped": actions.get("budget_skipped", 0), "input_tokens": sum(r["input_tokens"] for r in rows), "output_tokens": sum(r["output_tokens"] for r in rows)}, aborted


@dataclass
class QueryResult:
    exit_code: int
    hits: list[dict] = field(default_factory=list)
    message: str = ""


def query(spark: SparkSession, out: str, text: str, top_k: int = 5, *, analyzer=None) -> QueryResult:
    """The best chunks for a text; 2: artifacts are missing, 3: they are broken or of other settings, 4: nothing matches."""
    if missing := artifacts.missing_artifacts(out):
        return QueryResult(2, message=f"missing: {', '.join(missing)}")
    try:
        analyzer, _ = artifacts.load_and_verify(out, analyzer)
        chunks = artifacts.verified_chunks(spark, out)
        vocab = spark.read.parquet(join(out, "vocab"))
    except (artifacts.AnalyzerMismatch, artifacts.CorruptChunks, artifacts.EmptyCorpus, artifacts.RowMismatch, ValueError, KeyError, AnalysisException) as e:
        return QueryResult(3, message=str(e))
    tokens = spark.range(1).select(analyzer.tokens(normalize(F.lit(text))).alias("t")).first()["t"]
    vector = search.query_vector(tokens or [], vocab)
    if not vector:
        return QueryResult(4, message="no term of the query is in the corpus")
    rows = search.hits(artifacts.query_index(spark, out, vector, top_k), chunks).orderBy("rank").collect()
    return QueryResult(OK if rows else 4, [r.asDict(recursive=True) for r in rows], "" if rows else "nothing matches")


def run_lint(spark: SparkSession, out: str, thresholds: lint.Thresholds | None = None, as_json: bool = False) -> tuple[int, DataFrame]:
    """(exit code, findings); lint.md is written where the directory exists."""
    if missing := artifacts.missing_artifacts(out):
        found = lint.fatal(spark, "missing_artifact", f"missing: {', '.join(missing)}")
    else:
        found = _lint(spark, out, thresholds or lint.Thresholds())
    found = found.persist()
    if store.is_dir(out):
        artifacts.write_lint(found, out, as_json)
    return lint.exit_code(found), found


def _lint(spark, out: str, t: lint.Thresholds) -> DataFrame:
    """L2-L6 stop the run, in this order; then the rules."""
    try:
        artifacts.load_config(out)
    except (ValueError, KeyError) as e:
        return lint.fatal(spark, "schema", f"analyzer.json: {e}"[:200])
    try:
        weighted, _ = spark.read.parquet(join(out, "tfidf")).select("chunk_id", "term", "weight"), spark.read.parquet(join(out, "vocab")).select("term", "df", "idf")
    except AnalysisException as e:
        return lint.fatal(spark, "schema", f"the weights cannot be read: {e}"[:200])
    try:
        chunks = artifacts.verified_chunks(spark, out)
    except artifacts.EmptyCorpus as e:
        return lint.fatal(spark, "empty_corpus", str(e))
    except (artifacts.CorruptChunks, artifacts.RowMismatch, ValueError, KeyError, AnalysisException) as e:
        return lint.fatal(spark, "schema", str(e)[:200])
    known = artifacts.load_manifest(spark, out)[0] if store.exists(join(out, "entities", "manifest.json")) else None
    return lint.findings(chunks, weighted, known, t, has_pages=store.is_dir(join(out, "entities")))
