"""NPZ matrices: round trips, files of other tools, splits, refusal of pickles, commits."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import tfidf
from scriptorium.plans import queries
from scriptorium.sources import npz


def entries(spark, n_rows, n_columns, seed=1):
    r = random.Random(seed)
    rows = sorted({(r.randrange(n_rows), r.randrange(n_columns)) for _ in range(n_rows * 3)})
    return spark.createDataFrame([(i, j, r.random()) for i, j in rows], "row long, col long, value double")


def values(df):
    return sorted(map(tuple, df.select("row", "col", "value").collect()))


@pytest.mark.parametrize("block, split", [(7, 3), (1000, 10), (50, 10**6)])
def test_round_trip_equals_parquet(spark, tmp_path, block, split):
    df = entries(spark, 101, 40)
    df.write.parquet(str(tmp_path / "p"))
    npz.write_matrix(df, str(tmp_path / "m"), 101, 40, block)
    assert values(npz.read(spark, str(tmp_path / "m"), split=split)) == values(spark.read.parquet(str(tmp_path / "p")))
    assert sorted(p.name[:6] for p in (tmp_path / "m").iterdir()) == ["block-"] * -(-101 // block)
    vocab = spark.createDataFrame([(i, f"wörd {i} 日本", float(i)) for i in range(40)], "term_id long, term string, idf double")
    npz.write_vocabulary(vocab, f"file:{tmp_path}/v", block)
    assert sorted(map(tuple, npz.read(spark, str(tmp_path / "v"), "vocabulary", split).collect())) == sorted(map(tuple, vocab.collect()))


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_one_file_of_another_tool(spark, tmp_path, save):
    """One file with matrix and vocabulary, empty rows first, amid and last, narrow types."""
    data, indices, indptr = np.array([0.5, 0.25, 1.0], dtype=np.float32), np.array([2, 0, 1], dtype=np.int32), np.array([0, 0, 2, 2, 3, 3], dtype=np.int32)
    save(tmp_path / "vocab.npz", matrix_data=data, matrix_indices=indices, matrix_indptr=indptr, matrix_shape=np.array([5, 3]), vocabulary_terms=np.array(["a", "bb", "光学"]), idf=np.array([1.0, 2.0, 3.0]), config_json=np.frombuffer(b"{}", dtype=np.uint8))
    for split in (1, 2, 100):
        assert values(npz.read(spark, str(tmp_path / "vocab.npz"), split=split)) == [(1, 0, 0.25), (1, 2, 0.5), (3, 1, 1.0)]
    assert [tuple(r) for r in npz.read(spark, str(tmp_path / "vocab.npz"), "vocabulary").orderBy("term_id").collect()] == [(0, "a", 1.0), (1, "bb", 2.0), (2, "光学", 3.0)]


def test_blocks_are_read_by_numpy(spark, tmp_path):
    df = entries(spark, 30, 9)
    npz.write_matrix(df, str(tmp_path / "m"), 33, 9, 1000)
    with np.load(next((tmp_path / "m").glob("*.npz")), allow_pickle=False) as z:
        assert tuple(z["matrix_shape"]) == (33, 9) and len(z["matrix_indptr"]) == 34
        got = sorted((i, int(j), float(v)) for i in range(33) for j, v in zip(z["matrix_indices"][z["matrix_indptr"][i] : z["matrix_indptr"][i + 1]], z["matrix_data"][z["matrix_indptr"][i] : z["matrix_indptr"][i + 1]]))
    assert got == values(df)


def test_broken_files(spark, tmp_path):
    with pytest.raises(Exception, match="No|not"):
        npz.read(spark, str(tmp_path / "none.npz")).count()
    np.savez(tmp_path / "o.npz", matrix_data=np.array([{}], dtype=object), matrix_indices=np.array([0]), matrix_indptr=np.array([0, 1]), matrix_shape=np.array([1, 1]))
    with pytest.raises(Exception, match="Python objects"):
        npz.read(spark, str(tmp_path / "o.npz")).collect()
    np.savez(tmp_path / "s.npz", matrix_data=np.array([1.0]), matrix_indices=np.array([0]), matrix_indptr=np.array([0, 5]), matrix_shape=np.array([1, 1]))
    with pytest.raises(Exception, match="too early"):
        npz.read(spark, str(tmp_path / "s.npz")).collect()


def test_empty_and_overwritten(spark, tmp_path):
    npz.write_matrix(entries(spark, 20, 5), str(tmp_path / "m"), 20, 5, 4)
    npz.write_matrix(entries(spark, 20, 5).where("row < 0"), str(tmp_path / "m"), 20, 5, 4)
    assert npz.read(spark, str(tmp_path / "m")).count() == 0 and not list((tmp_path / "m").iterdir())


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """A task that fails for good leaves the former blocks and no other file."""
    npz.write_matrix(entries(spark, 20, 5), str(tmp_path / "m"), 20, 5, 4)
    before = values(npz.read(spark, str(tmp_path / "m")))
    bad = entries(spark, 20, 5, 2).withColumn("value", F.when(F.col("row") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        npz.write_matrix(bad, str(tmp_path / "m"), 20, 5, 4)
    assert values(npz.read(spark, str(tmp_path / "m"))) == before and not list((tmp_path / "m").glob("_*"))


def test_the_query_equals_the_weights(spark):
    got = {(r["chunk_id"], r["term"]): r["weight"] for r in queries.QUERIES["npz_weights"](spark, "/root/testdata/sf0.001").collect()}
    want = {(r["chunk_id"], r["term"]): r["weight"] for r in queries.QUERIES["tfidf_weights"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(got) > 1000 and io


def test_placed_blocks(spark, tmp_path):
    """Entries that lie by blocks are written where they are; a block that two tasks hold is refused, and the former blocks stay."""
    whole = entries(spark, 20, 5).coalesce(1).sortWithinPartitions("row", "col")
    npz.write_matrix(whole, str(tmp_path / "m"), 20, 5, 4, placed=True)
    before = values(npz.read(spark, str(tmp_path / "m")))
    npz.write_matrix(whole, str(tmp_path / "n"), 20, 5, 4)
    assert before == values(npz.read(spark, str(tmp_path / "n"))) and before
    with pytest.raises(Exception, match="two tasks"):
        npz.write_matrix(whole.unionAll(whole), str(tmp_path / "m"), 20, 5, 4, placed=True)
    with pytest.raises(Exception, match="in order"):
        npz.write_matrix(whole.sortWithinPartitions(F.desc("row")), str(tmp_path / "m"), 20, 5, 32, placed=True)
    assert values(npz.read(spark, str(tmp_path / "m"))) == before and not list((tmp_path / "m").glob("_*"))


def test_entries_stay_where_their_texts_are(spark):
    """Weights by row and column are those of the long table, each part in one partition, in order; a row of two texts counts once."""
    texts = spark.createDataFrame([(i, " ".join(f"t{(i * j) % 17}" for j in range(i % 9 + 1))) for i in range(60)] + [(7, "t1 t99")], "row_index long, text string")
    dealt, tokens = texts.withColumn("_part", F.floor(F.col("row_index") / 20).cast("int")).repartitionById(3, F.col("_part")), F.split("text", " ")
    found = tfidf.document_frequencies(dealt, tokens, "row_index").persist()
    vocab = tfidf.vocabulary(found.groupBy("term").agg(F.sum("df").alias("df")), 60)
    ids = tfidf.with_term_ids(vocab.select("term", "idf")).select("term", "term_id", "idf")
    got = tfidf.matrix_entries(tfidf.term_counts(dealt, tokens, "row_index", 3), found, ids, 3).withColumn("at", F.spark_partition_id()).collect()
    counts = tfidf.term_counts(texts, tokens, "row_index")
    want = tfidf.weights(counts, tfidf.vocabulary(counts, 60), "row_index").join(ids.select("term", "term_id"), "term")
    assert {(r["row"], r["col"]): round(r["value"], 9) for r in got} == {(r["row_index"], r["term_id"]): round(r["weight"], 9) for r in want.collect()}
    assert all(r["at"] == r["row"] // 20 for r in got) and [(r["row"], r["col"]) for r in got] == sorted((r["row"], r["col"]) for r in got)


def test_entries_are_named_where_their_block_is_read(spark, tmp_path):
    """Names and terms meet their block in its task, also beside a block without entries; a term that is missing is an error, and the query moves no entry."""
    some = entries(spark, 20, 5).where("row < 4 OR row >= 8")
    npz.write_matrix(some, str(tmp_path / "m"), 20, 5, 4)
    rows = spark.range(20).select(F.col("id").alias("row"), F.concat(F.lit("c"), "id").alias("name"))
    terms = spark.range(5).crossJoin(spark.range(5).withColumnRenamed("id", "col")).select(F.col("id").cast("int").alias("_part"), "col", F.concat(F.lit("t"), "col").alias("term"))
    got = {(r["name"], r["term"]): r["value"] for r in npz.named_entries(rows, terms, str(tmp_path / "m"), 4, 5).collect()}
    assert got == {(f"c{r['row']}", f"t{r['col']}"): r["value"] for r in some.collect()} and len(got) > 20
    with pytest.raises(Exception, match="no name or no term"):
        npz.named_entries(rows, terms.where("col > 0"), str(tmp_path / "m"), 4, 5).count()
    plan = queries.QUERIES["npz_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(col#" not in plan and "hashpartitioning(row#" not in plan
