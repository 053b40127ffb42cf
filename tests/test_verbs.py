"""Ingest, query and lint end to end, and the command line."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium import cli
from scriptorium.operators import analysis, chunking, summaries
from scriptorium.plans import ingest
from scriptorium.progress import Progress
from scriptorium.sources import artifacts, store

CFG = ingest.IngestConfig(spec=chunking.ChunkSpec(60, 20, 200, terminators=".\n"), min_mentions=2, min_chunks=1)


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.txt").write_text(f"Professor Lindqvist opened the laboratory number {i}. The optics group of Lindqvist measures light.\nVisitors came from Gothenburg today.", encoding="utf-8")
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "in" / "blank.txt").write_text(" \n", encoding="utf-8")
    (tmp_path / "in" / "other.md").write_text("not read", encoding="utf-8")
    return tmp_path


def test_end_to_end(spark, corpus, capsys):
    out = str(corpus / "out")
    result = ingest.ingest(spark, str(corpus / "in"), out, CFG)
    assert result.exit_code == ingest.OK, result
    assert result.counters["input_files"] == 6 and result.counters["skipped_files"] == 2 and result.counters["succeeded"] > 0
    assert not artifacts.missing_artifacts(out) and (corpus / "out" / "index.md").read_text().count("[Lindqvist](entities/LOC__Lindqvist_") == 1
    rows = artifacts.read_chunks_jsonl(spark, f"{out}/chunks.jsonl").orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(result.counters["chunks"])) and rows[0]["source"] == "0.txt"
    pages = list((corpus / "out" / "entities").glob("*.md"))
    assert len(pages) == result.counters["succeeded"] and "<!-- summary-begin -->" in pages[0].read_text()
    # a second run finds everything cached
    again = ingest.ingest(spark, str(corpus / "in"), out, CFG)
    assert again.exit_code == ingest.OK and again.counters["calls"] == 0 and again.counters["cached"] == result.counters["succeeded"]
    found = ingest.query(spark, out, "Optics of Light", 3)
    assert found.exit_code == 0 and found.hits[0]["rank"] == 1 and "optics" in found.hits[0]["text"]
    assert ingest.query(spark, out, "zzzz qqqq").exit_code == 4 and ingest.query(spark, str(corpus / "none"), "x").exit_code == 2
    code = cli.main(["lint", out, "--format", "json"], spark)
    told = json.loads(capsys.readouterr().out)
    assert code in (0, 1) and (corpus / "out" / "lint.json").exists() and all(f["severity"] != "fatal" for f in told)
    assert cli.main(["query", out, "light", "--top-k", "2", "--format", "human"], spark) == 0 and capsys.readouterr().out.startswith("1. ")


def test_many_warnings(spark, corpus, monkeypatch):
    """The result and the log tell some, warnings.txt has all, in order; an index of postings alone still answers."""
    monkeypatch.setattr(artifacts, "TOLD", 1)
    out = corpus / "out"
    result = ingest.ingest(spark, str(corpus / "in"), str(out), CFG)
    lines = (out / "warnings.txt").read_text(encoding="utf-8").splitlines()
    assert lines[:2] == ["bad.txt: not UTF-8", "blank.txt: empty"] and result.counters["text_warnings"] == len(lines) > 2
    assert all(x.startswith("chunker/") for x in lines[2:]) and f"{len(lines) - 1} warnings more in warnings.txt" in result.warnings and lines[1] not in result.warnings
    found = ingest.query(spark, str(out), "optics of light", 3)
    store.remove(str(out / "tfidf_blocks"))
    assert found.hits and ingest.query(spark, str(out), "optics of light", 3) == found


def test_failures(spark, corpus, monkeypatch):
    out = str(corpus / "out")
    assert ingest.ingest(spark, str(corpus / "none"), out, CFG).exit_code == ingest.NO_INPUT

    class Down:
        model_id = "down"

        def generate(self, prompt, max_tokens):
            raise summaries.Permanent("no credentials")

    assert ingest.ingest(spark, str(corpus / "in"), out, CFG, make_client=lambda *_, **__: Down()).exit_code == ingest.SUMMARIES_FAILED
    assert not (corpus / "out").exists() and not (corpus / "out.staging").exists()
    code, found = ingest.run_lint(spark, out)
    assert code == 2 and found.first()["category"] == "missing_artifact"


def test_broken_chunk_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "row_index": 0}\n\n{"chunk_id": \n')
    with pytest.raises(artifacts.CorruptChunks):
        artifacts.read_chunks_jsonl(spark, str(tmp_path / "c.jsonl"))


def test_every_broken_line_is_numbered(spark, tmp_path):
    """Exact numbers over several files, splits, equal lines, blank lines and line ends."""
    r, want = random.Random(3), set()
    (tmp_path / "c").mkdir()
    for f in range(3):
        lines = []
        for i in range(1, 4001):
            kind = r.random()
            lines.append("{broken" if kind < 0.01 else "" if kind < 0.05 else json.dumps({"chunk_id": f"{f}-{i}", "row_index": i, "text": "x" * r.randrange(300)}))
            if lines[-1] == "{broken":
                want.add((f"{f}.jsonl", i))
        (tmp_path / "c" / f"{f}.jsonl").write_text(("\r\n" if f == 1 else "\n").join(lines) + ("\n" if f else ""), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        found = artifacts.bad_lines(spark, str(tmp_path / "c")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(x["file"].rsplit("/", 1)[1], x["line"]) for x in found} == want and len(found) == len(want) > 60
    first = min(want)
    with pytest.raises(artifacts.CorruptChunks, match=f"corrupt line {first[1]} in .*{first[0]} and {len(want) - 1} more"):
        artifacts.read_chunks_jsonl(spark, str(tmp_path / "c"))


def test_one_file_of_chunk_lines(spark, tmp_path):
    rows = spark.range(5000).select(F.format_string("c%d", "id").alias("chunk_id"), F.pmod(F.col("id") * 7919, 5000).alias("row_index"), F.lit("line\nfeed ö").alias("text")).repartition(7)
    artifacts.write_chunks(rows, str(tmp_path / "o"))
    lines = (tmp_path / "o" / "chunks.jsonl").read_text(encoding="utf-8").splitlines()
    assert [json.loads(x)["row_index"] for x in lines] == list(range(5000)) and json.loads(lines[0])["text"] == "line\nfeed ö"
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["chunks", "chunks.jsonl"]


def entries(spark, n):
    return spark.range(n).select(
        F.format_string('N"ö\\%d', "id").alias("entity_name"), F.lit("ORG").alias("ner_label"), F.lit("h").alias("source_hash"), F.lit("success").alias("status"), F.col("id").alias("mention_count"), F.lit(1).cast("long").alias("chunk_count"),
        F.array(F.format_string("c%d", "id")).alias("chunk_ids"), F.array(F.struct(F.lit("LOC").alias("ner_label"), F.lit("X").alias("name"))).alias("cooccurring_entities"), F.lit("t").alias("last_attempt_at"), F.lit("").alias("failure_reason"),
    )


def test_manifests_are_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """A document that JSON readers read, in the order of keys; and the same rows back, whatever the layout."""
    out = str(tmp_path)
    for n in (0, 1, 20_000):
        artifacts.save_manifest(entries(spark, n), out, model_version="m", llm="l", at="now")
        whole = json.loads((tmp_path / "entities" / "manifest.json").read_text(encoding="utf-8"))
        assert whole["version"] == 1 and whole["llm_model"] == "l" and len(whole["entries"]) == n and list(whole["entries"]) == sorted(whole["entries"])
        back, wrong = artifacts.load_manifest(spark, out)
        assert wrong == "" and back.exceptAll(entries(spark, n)).count() == 0 and back.count() == n
    assert sorted(p.name for p in (tmp_path / "entities").iterdir()) == ["manifest.json"]
    few = {"version": 1, "entries": {"ORG__A": {"entity_name": "A", "ner_label": "ORG", "status": "failed"}}}
    (tmp_path / "entities" / "manifest.json").write_text(json.dumps(few, indent=2))
    row = artifacts.load_manifest(spark, out)[0].first()
    assert (row["entity_name"], row["status"], row["mention_count"], row["chunk_ids"], row["source_hash"]) == ("A", "failed", 0, [], "")
    # a write that is cut off leaves the former version
    artifacts.save_manifest(entries(spark, 5), out, model_version="m", llm="l", at="now")
    monkeypatch.setattr(store, "join_parts", lambda *a, **k: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError):
        artifacts.save_manifest(entries(spark, 9), out, model_version="m", llm="l", at="later")
    assert artifacts.load_manifest(spark, out)[0].count() == 5
    text = (tmp_path / "entities" / "manifest.json").read_text(encoding="utf-8")
    for broken in ("{", text[:-200], text.replace('"status"', '"status', 1), "[]", '{"a": 1}'):
        (tmp_path / "entities" / "manifest.json").write_text(broken, encoding="utf-8")
        found, wrong = artifacts.load_manifest(spark, out)
        assert found.count() == 0 and "broken" in wrong, broken


def test_pages_come_whole(spark, tmp_path):
    """Files of a task that fails half-way are written again; none is left half, and none beside the others."""
    rows = spark.range(200).select(F.format_string("p%d.md", "id").alias("name"), F.format_string("text ö %d", "id").alias("text")).repartition(5)
    assert store.write_files(rows, str(tmp_path / "e")) == 200
    bad = rows.withColumn("text", F.when(F.col("name") == "p7.md", F.raise_error(F.lit("lost"))).otherwise(F.concat("text", F.lit("!"))))
    with pytest.raises(Exception, match="lost"):
        store.write_files(bad, str(tmp_path / "e"))
    assert {p.read_text(encoding="utf-8").rstrip("!") for p in (tmp_path / "e").glob("p*.md")} == {f"text ö {i}" for i in range(200)}
    assert store.write_files(rows, str(tmp_path / "e")) == 200 and {p.name for p in (tmp_path / "e").iterdir()} == {f"p{i}.md" for i in range(200)}


def test_parts_through_sparks_own_store(spark, tmp_path):
    """Where only Spark reaches a folder, its own file system joins and writes."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.rack.link./c", tmp_path.as_uri())
    out = "viewfs://rack/c"
    artifacts.save_manifest(entries(spark, 50), out, model_version="m", llm="l", at="now")
    assert artifacts.load_manifest(spark, out)[0].count() == 50 == len(json.loads((tmp_path / "entities" / "manifest.json").read_text(encoding="utf-8"))["entries"])
    spark.range(30).select(F.col("id").cast("string").alias("value")).repartition(3).sortWithinPartitions("value").write.text(f"{out}/parts")
    store.join_parts(spark, f"{out}/parts", f"{out}/all.txt", head="<", tail=">")
    assert (tmp_path / "all.txt").read_text().startswith("<") and (tmp_path / "all.txt").read_text().count("\n") == 30 and not (tmp_path / "parts").exists()
    assert store.write_files(spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "name string, text string"), f"{out}/e") == 2 and (tmp_path / "e" / "b.md").read_text() == "y"


def test_settings_must_match():
    a = artifacts.analyzer_config({"word": "x"}, {}, {"lib": "4.1.2"})
    assert artifacts.verify_analyzer(a, artifacts.analyzer_config({"word": "x"}, {}, {"lib": "4.1.9"})) == []
    assert artifacts.verify_analyzer(a, artifacts.analyzer_config({"word": "x"}, {}, {"lib": "4.2.0"})) == ["lib was 4.1.2, is 4.2.0"]
    with pytest.raises(artifacts.AnalyzerMismatch):
        artifacts.verify_analyzer(a, artifacts.analyzer_config({"word": "y"}, {}, {"lib": "4.1.2"}))


def test_swap_restores(tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old").touch()
    with pytest.raises(OSError):
        artifacts.swap(str(tmp_path / "missing"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "old").exists()


def test_corrupt_artifacts(spark, corpus):
    """SC5, L3-L6, V4: what lint and query tell of broken chunk lines, missing rows, no rows, settings that are no JSON."""
    out = corpus / "out"
    assert ingest.ingest(spark, str(corpus / "in"), str(out), CFG).exit_code == ingest.OK
    part = out / "chunks.jsonl"
    lines = part.read_text(encoding="utf-8")

    def told(change):
        part.write_text(lines, encoding="utf-8")
        change()
        code, found = ingest.run_lint(spark, str(out))
        return code, found.first()["category"], found.first()["message"], ingest.query(spark, str(out), "light").exit_code

    first = part.read_text(encoding="utf-8")
    code, category, message, status = told(lambda: part.write_text(first.replace("\n", "\n\n{broken\n", 1), encoding="utf-8"))
    assert (code, category, status) == (2, "schema", 3) and "corrupt line 3" in message
    code, category, message, status = told(lambda: part.write_text("".join(first.splitlines(keepends=True)[1:]), encoding="utf-8"))
    assert (code, category, status) == (2, "schema", 3) and "rows" in message
    code, category, _, status = told(lambda: part.write_text("\n"))
    assert (code, category, status) == (2, "empty_corpus", 3)
    assert told(lambda: None)[3] == 0
    (out / "analyzer.json").write_text("{")
    assert ingest.query(spark, str(out), "light").exit_code == 3 and ingest.run_lint(spark, str(out))[1].first()["category"] == "schema"


def test_saved_settings_make_the_analyzer(spark, corpus):
    """SC12: a corpus of another analyzer is queried and ingested again by that one, whatever the flags say."""
    out, own = str(corpus / "out"), analysis.RuleAnalyzer(word=r"\p{L}{5,}")
    assert ingest.ingest(spark, str(corpus / "in"), out, CFG, analyzer=own).exit_code == ingest.OK
    assert ingest.query(spark, out, "of by a").exit_code == 4 and ingest.query(spark, out, "Optics group").exit_code == 0
    again = ingest.ingest(spark, str(corpus / "in"), out, CFG)
    assert again.exit_code == ingest.OK and again.counters["calls"] == 0
    assert ingest.ingest(spark, str(corpus / "in"), out, CFG, analyzer=analysis.RuleAnalyzer()).exit_code == ingest.MISMATCH


def test_failed_entities_do_not_stop_a_run(spark, corpus):
    """A permanent error fails its entity; a crash leaves the manifest of the last checkpoint."""
    out = str(corpus / "out")
    wrong = lambda *_, **__: Picky("Gothenburg")
    result = ingest.ingest(spark, str(corpus / "in"), out, CFG, make_client=wrong)
    assert result.exit_code == ingest.OK and result.counters["failed"] == 1 and result.counters["succeeded"] > 1
    entries = json.loads((corpus / "out" / "entities" / "manifest.json").read_text())["entries"]
    assert [k for k, e in entries.items() if e["status"] == "failed"] == ["LOC__Gothenburg"]
    assert not list((corpus / "out" / "entities").glob("*Gothenburg*.md"))


class Picky:
    model_id = "picky"

    def __init__(self, bad):
        self.bad = bad

    def generate(self, prompt, max_tokens):
        if self.bad in prompt.split("\n")[0]:
            raise summaries.Permanent("refused")
        return summaries.Answer("fine.", 1, 1, "picky")


def test_checkpoints(spark, tmp_path):
    tasks = spark.createDataFrame([(f"n{i:02d}", "ORG", "p") for i in range(12)], "name string, ner_label string, prompt string").coalesce(1)
    seen, steps = [], []
    rows, aborted = summaries.summarize(tasks, Picky("none"), parallelism=4, on_checkpoint=lambda r: seen.append(len(r)), on_wave=steps.append)
    assert seen == [8, 12] and steps == [4, 4, 4] and not aborted and [r["name"] for r in rows] == [f"n{i:02d}" for i in range(12)]
    # a run that was killed leaves its staging directory: its manifest goes into the next run
    (tmp_path / "out" / "entities").mkdir(parents=True)
    (tmp_path / "out" / "entities" / "manifest.json").write_text("old")
    (tmp_path / "out.staging" / "entities").mkdir(parents=True)
    (tmp_path / "out.staging" / "entities" / "manifest.json").write_text("new")
    artifacts.carry_over(str(tmp_path / "out"), str(tmp_path / "out.staging"))
    assert (tmp_path / "out.staging" / "entities" / "manifest.json").read_text() == "new"


def test_environment(spark):
    """X4."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        assert ingest.apply_environment(spark, "rules", {}) == {}
        assert ingest.apply_environment(spark, "electra", {"SCRIPTORIUM_BATCH_SIZE": "no"}) == {"spark.sql.execution.arrow.maxRecordsPerBatch": "32"}
        assert ingest.apply_environment(spark, "rules", {"SCRIPTORIUM_BATCH_SIZE": "7", "SCRIPTORIUM_N_PROCESS": "0"}) == {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_progress():
    clock = iter(range(100))
    out = io.StringIO()
    with Progress(stream=out, clock=lambda: next(clock)).phase("chunks", 4) as step:
        step(1)
        step(3)
    assert out.getvalue().splitlines() == ["chunks ...", "chunks: 1/4 (1.0/s, 3 s left)", "chunks: 4/4 (2.0/s, 0 s left)", "chunks: 4/4 in 3.0 s"]
    quiet = io.StringIO()
    with Progress(enabled=False, stream=quiet).phase("x") as step:
        step()
    assert quiet.getvalue() == ""


def test_stores_beyond_this_machine(spark, tmp_path):
    """The same functions through Spark's file systems, for paths that only these reach."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./c", tmp_path.as_uri())
    base = "viewfs://shelf/c"
    store.write_text(f"{base}/a/x.txt", "one")
    store.write_text(f"{base}/a/x.txt", "two")
    assert store.read_text(f"{base}/a/x.txt") == "two" == (tmp_path / "a" / "x.txt").read_text() and store.is_dir(f"{base}/a") and not store.exists(f"{base}/b")
    store.copy(f"{base}/a", f"{base}/d/b")
    store.move(f"{base}/a", f"{base}/e")
    assert store.exists(f"{base}/d/b/x.txt") and not store.exists(f"{base}/a") and store.read_text(f"{base}/e/x.txt") == "two"
    store.remove(f"{base}/e")
    assert not (tmp_path / "e").exists() and store.local("file:///x/y") == store.local("/x/y") and store.local("s3a://b/y") is None
