"""The engine's own queries over the documents table, a row of which stands for a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import analysis, chunking, entities, lint, manifest, search, tfidf
from scriptorium.sources import artifacts, corpus, npz, store
from scriptorium.sources.store import join

#: The tables hold Latin text: sentences end with full stops and line feeds.
SPEC = chunking.ChunkSpec(terminators=".\n")
ANALYZER = analysis.RuleAnalyzer()
LEAST = {"min_mentions": 5, "min_chunks": 3}
QUERY = "the and thing other that with stat"
CHECKS = lint.Thresholds(pairwise=10**9, terminator=".")
VERSIONS = {"analyzer_hash": "rules", "model_version": "rules@1", "llm": "first-lines@1"}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.usable(corpus.scan_documents(spark, f"{sf_dir}/documents.parquet"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept, since most queries read the chunks more than once and their cutting is the one Python step."""
    return chunking.chunk_documents(_docs(spark, sf_dir), SPEC).persist()


def _parts(chunks: DataFrame) -> int:
    return tfidf.parts_of(chunks.count(), chunks.sparkSession.sparkContext.defaultParallelism)


def _weighted(chunks: DataFrame, placed: bool = False) -> tuple[DataFrame, DataFrame]:
    n, parts = chunks.count(), _parts(chunks)
    counts = tfidf.term_counts(chunks, ANALYZER.tokens(F.col("text")), parts=parts).persist()
    vocab = tfidf.vocabulary(counts, n)
    return tfidf.weights(counts, vocab, parts=parts, placed=placed), vocab


def _kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as a table, for queries of many steps."""
    return store.kept(chunking.chunk_documents(_docs(spark, sf_dir), SPEC), "chunks")


def _weigher(chunks: DataFrame) -> tuple[Callable[[DataFrame | None], DataFrame], int, DataFrame]:
    """What makes the placed weights of all chunks, or of those with some ids, of their texts; parts; and the vocabulary. No counts are kept."""
    parts, tokens = _parts(chunks), ANALYZER.tokens(F.col("text"))
    vocab = store.kept(tfidf.vocabulary(tfidf.document_frequencies(chunks, tokens), chunks.count()), "vocabulary")

    def of(keys: DataFrame | None = None) -> DataFrame:
        some = chunks if keys is None else chunks.join(keys, "chunk_id", "left_semi")
        return tfidf.weights(tfidf.term_counts(some, tokens, parts=parts), vocab, parts=parts, placed=True)

    return of, parts, vocab


def _mentions(chunks: DataFrame) -> DataFrame:
    found = chunks.select("chunk_id", F.explode(ANALYZER.mentions(F.col("text"))).alias("m")).select("chunk_id", "m.*")
    return found.where(F.col("ner_label").isin(*analysis.LABELS))


def _positions(chunks: DataFrame) -> DataFrame:
    """Places that sort as the corpus does; their numbers are not needed, and so no sort of all chunks."""
    return chunks.select("chunk_id", F.struct("source", "ord").alias("row_index"))


def _counted(chunks: DataFrame) -> DataFrame:
    """Mentions counted by chunk, for all that needs no offsets."""
    found = chunks.select("chunk_id", F.explode(ANALYZER.names(F.col("text"))).alias("m")).select("chunk_id", "m.*")
    return entities.counted(found.where(F.col("ner_label").isin(*analysis.LABELS)))


def _entities(chunks: DataFrame) -> DataFrame:
    return entities.aggregate_entities(_counted(chunks), _positions(chunks), **LEAST)


def _hashed(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted entities with their hashes, and the mentions counted by chunk, found once."""
    counts = _counted(chunks).persist()
    kept = entities.entity_counts(counts).where(entities.accepted(**LEAST))
    return manifest.source_hashes(kept, chunks, **VERSIONS, places=entities.entity_members(counts, **LEAST)), counts


def normalize_docs(spark, sf_dir):
    """SC1-SC4, P1."""
    return _docs(spark, sf_dir)


def sentence_spans(spark, sf_dir):
    """P2, P5, W9."""
    return chunking.with_sentences(_docs(spark, sf_dir), SPEC.terminators)


def segment_bytes(spark, sf_dir):
    """Segments of 4000 bytes, as their offsets and sizes."""
    return analysis.with_segments(_docs(spark, sf_dir), 4000, ".").select("source", "char_offset", F.octet_length("segment").alias("n_bytes"), F.sha2(F.col("segment").cast("binary"), 256).alias("sha"))


def chunk_documents(spark, sf_dir):
    """C1-C8, P6, P7, J12."""
    return chunking.chunk_documents(_docs(spark, sf_dir), SPEC)


def chunk_warnings(spark, sf_dir):
    """C9, S6."""
    return chunking.chunk_warnings(_docs(spark, sf_dir), SPEC).select("source", "kind", "char_offset")


def chunk_row_index(spark, sf_dir):
    """C10, W1."""
    rows = chunking.with_row_index(_chunks(spark, sf_dir).select("source", "ord", "chunk_id"), "source", "ord")
    return rows.select("row_index", "chunk_id")


def chunk_length_stats(spark, sf_dir):
    """One row over all chunks."""
    n = F.length("text").cast("long")
    return _chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("documents"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"))


def doc_freq_idf(spark, sf_dir):
    """Terms of at least two chunks."""
    chunks = _chunks(spark, sf_dir)
    vocab = tfidf.vocabulary(tfidf.document_frequencies(chunks, ANALYZER.tokens(F.col("text"))), chunks.count(), min_df=2)
    return vocab.select("term", "df", F.round("idf", 6).alias("idf"))


def vocabulary_ids(spark, sf_dir):
    """Vocabulary order."""
    chunks = _chunks(spark, sf_dir)
    return tfidf.with_term_ids(tfidf.vocabulary(tfidf.document_frequencies(chunks, ANALYZER.tokens(F.col("text"))), chunks.count(), min_df=2).select("term"))


def tfidf_weights(spark, sf_dir):
    """A3, J2."""
    return _weighted(_chunks(spark, sf_dir))[0].select("chunk_id", "term", "tf", F.round("weight", 6).alias("weight"))


def npz_weights(spark, sf_dir):
    """SC6, SK2: the weights as an NPZ matrix in blocks of rows, with its vocabulary, written and read back.

    Texts are dealt by the blocks of the matrix, so that no entry is moved before it is written;
    they are taken apart twice, for the vocabulary and for the entries, and no counts are kept.
    Each block is read with the names of its own rows and terms, so that none is moved afterwards.
    """
    block, chunks = 8192, _kept_chunks(spark, sf_dir)
    first = chunks.groupBy("chunk_id").agg(F.min(F.struct("source", "ord")).alias("at")).select("at.source", "at.ord", "chunk_id")
    rows = store.kept(chunking.with_row_index(first, "source", "ord").select("chunk_id", "row_index"), "rows")
    n, n_chunks = rows.count(), chunks.count()
    parts, tokens = max(2, -(-n // block)), ANALYZER.tokens(F.col("text"))
    numbered = store.kept(chunks.select("chunk_id", "text").join(rows.hint("shuffle_hash"), "chunk_id").select("row_index", "text"), "numbered")
    store.dropped(chunks)
    texts = numbered.withColumn("_part", F.floor(F.col("row_index") / block).cast("int")).repartitionById(parts, F.col("_part"))
    found = store.kept(tfidf.document_frequencies(texts, tokens, "row_index"), "found")
    vocab = tfidf.vocabulary(found.groupBy("term").agg(F.sum("df").alias("df")), n_chunks)
    ids = store.kept(tfidf.with_term_ids(vocab.select("term", "idf")).select("term", "term_id", "idf"), "ids")
    path = store.scratch(spark, "npz")
    entries = tfidf.matrix_entries(tfidf.term_counts(texts, tokens, "row_index", parts), found, ids, parts)
    npz.write_matrix(entries, join(path, "matrix"), n, ids.count(), block, placed=True)
    npz.write_vocabulary(ids, join(path, "vocabulary"))
    store.dropped(numbered)
    own = found.select("_part", "term").join(ids.select("term", "term_id"), "term").select("_part", "term_id")
    terms = own.join(npz.read(spark, join(path, "vocabulary"), "vocabulary"), "term_id").select("_part", F.col("term_id").alias("col"), "term")
    back = npz.named_entries(rows.select(F.col("row_index").alias("row"), F.col("chunk_id").alias("name")), terms, join(path, "matrix"), block, parts)
    return back.select(F.col("name").alias("chunk_id"), "term", F.round("value", 6).alias("weight"))


def top_keywords(spark, sf_dir):
    """T2, W4."""
    return tfidf.top_keywords(_weighted(_chunks(spark, sf_dir))[0])


def query_topk(spark, sf_dir):
    """J2-J4, T1, F4, W3."""
    chunks = _chunks(spark, sf_dir)
    weighted, vocab = _weighted(chunks)
    tokens = spark.range(1).select(ANALYZER.tokens(T.normalize(F.lit(QUERY))).alias("t")).first()["t"]
    best = search.top_chunks(weighted, search.query_vector(tokens, vocab), 10)
    return search.hits(best, chunks).select("rank", "chunk_id", "score", "source")


def indexed_topk(spark, sf_dir):
    """SK2, J3, T1, V4: the same query of an index in the order of its impacts, written and read."""
    chunks = _kept_chunks(spark, sf_dir)
    of, _, vocab = _weigher(chunks)
    tokens = spark.range(1).select(ANALYZER.tokens(T.normalize(F.lit(QUERY))).alias("t")).first()["t"]
    path = store.scratch(spark, "index")
    artifacts.write_placed_index(of(), vocab, {}, path, chunks.count())
    vocab = spark.read.parquet(join(path, "vocab"))
    best = artifacts.query_index(spark, path, search.query_vector(tokens, vocab), 10)
    return search.hits(best, chunks).select("rank", "chunk_id", "score", "source")


def token_slice(spark, sf_dir):
    """The number of tokens that start in each chunk, from tokens with offsets in the document."""
    found = analysis.word_places(_docs(spark, sf_dir))
    return analysis.tokens_in_chunks(found, _chunks(spark, sf_dir)).groupBy("chunk_id").agg(F.count("*").alias("n_tokens"))


def entity_slice(spark, sf_dir):
    """C12, J13, F1, P12."""
    found = _docs(spark, sf_dir).select("source", F.explode(ANALYZER.mentions(F.col("text"))).alias("m")).select("source", "m.*")
    return analysis.entities_in_chunks(found, _chunks(spark, sf_dir))


def bio_spans(spark, sf_dir):
    """Tags are made of the words of a text: capitals begin, words of three letters go on, others are outside."""
    words = F.posexplode(F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")).alias("i", "token")
    each = _docs(spark, sf_dir).select("source", words)
    n, kind = F.length("token"), F.when(F.length("token") % 2 == 0, "Person").otherwise("City")
    iob = F.when(F.col("token").rlike(r"^\p{Lu}"), "B").when(n <= 4, "I").otherwise("O")
    tags = each.select("source", "i", analysis.entity_tag(iob, kind, {"Person": "PERSON", "City": "LOC"}).alias("tag"), (F.col("i") * 10).alias("char_start"), (F.col("i") * 10 + n).alias("char_end"), "token")
    return analysis.bio_spans(tags)


def entity_attach(spark, sf_dir):
    """Each chunk's mentions as one string."""
    chunks = _chunks(spark, sf_dir)
    rows = entities.with_mentions(chunks.select("chunk_id"), _mentions(chunks))
    return rows.select("chunk_id", F.array_join(F.transform("entities", lambda m: F.concat_ws(":", m["ner_label"], m["name"])), " ").alias("entities"))


def entity_aggregate(spark, sf_dir):
    """A4-A7, F3, J10, J15, S2, T3."""
    rows = _entities(_chunks(spark, sf_dir))
    together = F.array_join(F.transform("cooccurring_entities", lambda e: entities.entity_key(e["ner_label"], e["name"])), " ")
    return rows.select("name", "ner_label", "mention_count", "chunk_count", F.array_join("chunk_ids", " ").alias("chunk_ids"), together.alias("cooccurring"))


def entity_stats(spark, sf_dir):
    """A8."""
    return entities.entity_stats(_counted(_chunks(spark, sf_dir)), **LEAST)


def entity_filenames(spark, sf_dir):
    """P14."""
    rows = entities.entity_counts(_counted(chunking.chunk_documents(_docs(spark, sf_dir), SPEC))).where(entities.accepted(**LEAST))
    return rows.select("name", "ner_label", T.entity_filename(F.col("ner_label"), F.col("name")).alias("file_name"))


def source_hash(spark, sf_dir):
    """P19, J9."""
    chunks = _chunks(spark, sf_dir)
    return _hashed(chunks)[0].select("name", "ner_label", "source_hash")


def _planned(spark, sf_dir):
    """Entities with hashes, and a manifest that knows a part of them: some alike, some changed, some failed."""
    chunks = _chunks(spark, sf_dir)
    hashed, counts = _hashed(chunks)
    found = entities.with_lists(hashed.persist(), counts, _positions(chunks), **LEAST)
    return chunks, found, _entries(found, F.when(F.length("name") % 3 == 0, "").otherwise(F.col("source_hash")))


def _entries(found: DataFrame, hash_: Column) -> DataFrame:
    n = F.length("name")
    status = F.when(n % 4 == 0, "success").when(n % 4 == 1, "failed").otherwise("budget_skipped")
    return manifest.as_entries(found.where(n % 5 != 0), status, hash_, F.lit(""), "2026-01-01T00:00:00+00:00")


def _known(counts: DataFrame, positions: DataFrame) -> DataFrame:
    """Of the same entries what the rules of lint read: no rule reads a hash, so no texts are sorted for one."""
    found = entities.with_lists(entities.entity_counts(counts).where(entities.accepted(**LEAST)), counts, positions, **LEAST)
    return store.kept(_entries(found, F.lit("")).select("entity_name", "ner_label", "status", "chunk_ids"), "known")


def cache_decision(spark, sf_dir):
    """What is called, without and with retries, and when forced."""
    _, found, known = _planned(spark, sf_dir)
    plain = manifest.decide(found, known).select("name", "ner_label", "action")
    retried = manifest.decide(found, known, retry_failed=True).select("name", "ner_label", F.col("action").alias("retried"))
    forced = manifest.decide(found, known, force=True).select("name", "ner_label", F.col("action").alias("forced"))
    return plain.join(retried, entities.ENTITY).join(forced, entities.ENTITY)


def budget_plan(spark, sf_dir):
    """T3, T4, M3."""
    _, found, known = _planned(spark, sf_dir)
    return manifest.with_budget(manifest.decide(found, known), 25).select("name", "ner_label", "action")


def manifest_merge(spark, sf_dir):
    """M4: results of the calls, good and failed, over what was known of all states."""
    _, found, known = _planned(spark, sf_dir)
    called = manifest.decide(found, known).where("action = 'call'")
    status = F.when(F.length("name") % 2 == 0, "success").otherwise("failed")
    new = manifest.as_entries(called, status, F.col("source_hash"), F.lit(""), "2026-02-02T00:00:00+00:00")
    return manifest.merge(known, new).select("entity_name", "ner_label", "source_hash", "status", "last_attempt_at")


def systemic_abort(spark, sf_dir):
    """Attempts are documents in order of id; those of an odd number of characters failed."""
    attempts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("n"), (F.col("n_chars") % 2 == 1).alias("failed"))
    return manifest.abort_point(attempts)


def prompt_build(spark, sf_dir):
    """P17, T6."""
    chunks = _chunks(spark, sf_dir)
    places = entities.entity_chunks(_counted(chunks).persist(), _positions(chunks), **LEAST)
    return manifest.prompts_of_places(places, chunks)


def page_snippets(spark, sf_dir):
    """P16, J9."""
    chunks = _chunks(spark, sf_dir)
    return manifest.snippets(_entities(chunks), chunks)


def entity_index(spark, sf_dir):
    """SK6, A11, F5, T5."""
    return manifest.index_lines(_planned(spark, sf_dir)[2])


def lint_length(spark, sf_dir):
    """L7-L10, F6, P22."""
    return lint.by_length(_chunks(spark, sf_dir), CHECKS).select("severity", "category", "message", "detail")


def lint_degenerate(spark, sf_dir):
    """L11, A9, F7."""
    chunks = _chunks(spark, sf_dir)
    return lint.degenerate(chunks, _weighted(chunks)[0], CHECKS).select("severity", "category", "message", "detail")


def lint_duplicates(spark, sf_dir):
    """Pairs with a cosine over 0.95."""
    of, parts, _ = _weigher(_kept_chunks(spark, sf_dir))
    pairs = search.similar_pairs(of(), 0.95, parts=parts, of=of)
    return pairs.select("a", "b", F.round("cosine", 4).alias("cosine"))


def lint_orphans(spark, sf_dir):
    """The manifest with some entries more, whose chunks are gone, is held against all chunks."""
    named = chunking.chunk_documents(_docs(spark, sf_dir), SPEC).select("source", "ord", "chunk_id", ANALYZER.names(F.col("text")).alias("names"))
    chunks = store.kept(named, "names")
    found = chunks.select("chunk_id", F.explode("names").alias("m")).select("chunk_id", "m.*").where(F.col("ner_label").isin(*analysis.LABELS))
    known = _known(store.kept(entities.counted(found), "mentions"), _positions(chunks))
    gone = known.withColumn("entity_name", F.concat(F.lit("Lost "), "entity_name")).withColumn("chunk_ids", F.transform("chunk_ids", lambda x: F.concat(F.lit("lost-"), x)))
    return lint.orphans(known.unionByName(gone), chunks).select("severity", "category", "message", "detail")


def _all_known(spark, sf_dir):
    """The name and label of every accepted entity as those of a summary that succeeded."""
    found = entities.entity_counts(_counted(chunking.chunk_documents(_docs(spark, sf_dir), SPEC))).where(entities.accepted(**LEAST))
    return found.select(F.col("name").alias("entity_name"), "ner_label", F.lit("success").alias("status")).persist()


def lint_similar_names(spark, sf_dir):
    """Pairs of accepted entities whose names have a ratio over 0.7."""
    rows = lint.similar_names(_all_known(spark, sf_dir), lint.Thresholds(name_ratio=0.7))
    return rows.select("a", "b", F.round("ratio", 4).alias("ratio"))


def lint_summary(spark, sf_dir):
    """All rules over all chunks and entries: findings by severity and category, and the exit code they lead to."""
    chunks = _kept_chunks(spark, sf_dir)
    known = _known(store.kept(_counted(chunks), "mentions"), _positions(chunks))
    of, parts, _ = _weigher(chunks)
    found = lint.findings(chunks, of(), known, CHECKS, parts=parts, of=of)
    groups = store.kept(found.groupBy("severity", "category").agg(F.count("*").alias("n")), "groups")
    counts = groups.agg(*[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in lint.SEVERITIES])
    code = F.when(F.col("fatal") > 0, 2).when(F.col("warning") > 0, 1).otherwise(0)
    return groups.crossJoin(F.broadcast(counts.select(code.alias("exit_code"))))


def lint_switches(spark, sf_dir):
    """What is told where a check is switched off or there is too little to summarise: more chunks than a threshold of 100, and no entity at all."""
    chunks = _chunks(spark, sf_dir)
    n = chunks.count()
    few = lint.few_entities(spark, 0, n, lint.Thresholds(few_chunks=10**9))
    return lint.duplicates(_weighted(chunks)[0], n, lint.Thresholds(pairwise=100)).unionByName(few).select("severity", "category", "message", "detail")


def text_functions(spark, sf_dir):
    """P15, P16, P21, P22, P24, SC4, F12's share: the small text functions over every document."""
    docs, text = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("file:///data/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    version = F.concat_ws(".", (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 11).cast("string"), F.col("doc_id").cast("string"))
    reason = F.element_at(F.array(*map(F.lit, ("stop", "stop_sequence", "length", "", "refusal"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        "doc_id", T.relative_source(path, "/data/in").alias("source"), T.major_minor(version).alias("short"), T.finish_reason(reason).alias("finish"),
        F.sha2(T.fence(F.replace(text, F.lit("."), F.lit("\n---\n"))).cast("binary"), 256).alias("fenced"), T.excerpt(text).alias("excerpt"), T.single_sentence(text, ".").alias("single"),
    )


def file_names(spark, sf_dir):
    """Safe names of any text: the source and the whole text of every document, cut to what a file system takes, and one of the reserved names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("text", F.lit("")))
    reserved = F.element_at(F.array(*map(F.lit, T.RESERVED)), (F.col("doc_id") % len(T.RESERVED)).cast("int") + 1)
    return docs.select("doc_id", T.entity_filename(F.lit("PRODUCT"), name).alias("file_name"), T.entity_filename(F.lit("ORG"), reserved).alias("reserved"))


def stub_tokens(spark, sf_dir):
    """The tokens of the plain contract (split at stops, line feeds and blanks, without `、.,`, two signs at least), then those that carry meaning."""
    words = F.filter(F.transform(F.split("text", "[。\n ]"), lambda w: F.translate(w, "、.,", "")), lambda w: F.length(w) >= 2)
    tagged = F.transform(words, lambda w: F.struct(F.when(F.length(w) % 3 == 0, "NOUN").when(F.length(w) % 3 == 1, "VERB").otherwise("ADP").alias("pos"), F.lower(w).alias("lemma")))
    kept = analysis.keep_tokens(tagged, ("the", "and"))
    return _docs(spark, sf_dir).select("source", F.size(words).cast("long").alias("n_tokens"), F.size(kept).cast("long").alias("n_kept"), F.sha2(F.array_join(kept, " ").cast("binary"), 256).alias("sha"))


def skipped_files(spark, sf_dir):
    """SC2, SC3, A13, S6: documents that are left out, and why: those with ids divisible by 7 count as not decoded, those divisible by 5 as blank."""
    rows = corpus.scan_documents(spark, f"{sf_dir}/documents.parquet")
    number = F.col("source").cast("long")
    made = rows.select("source", F.when(number % 7 == 0, F.lit(None)).when(number % 5 == 0, F.lit(" \n\t ")).otherwise(F.col("text")).alias("text"))
    return corpus.skipped(made)


QUERIES = {f.__name__: f for f in (
    normalize_docs, sentence_spans, segment_bytes, chunk_documents, chunk_warnings, chunk_row_index, chunk_length_stats, doc_freq_idf, vocabulary_ids, tfidf_weights, npz_weights, top_keywords, query_topk, indexed_topk,
    token_slice, entity_slice, bio_spans, entity_attach, entity_aggregate, entity_stats, entity_filenames, source_hash, cache_decision, budget_plan, manifest_merge, systemic_abort,
    prompt_build, page_snippets, entity_index, lint_length, lint_degenerate, lint_duplicates, lint_orphans, lint_similar_names, lint_summary, lint_switches, text_functions, file_names, stub_tokens, skipped_files,
)}
