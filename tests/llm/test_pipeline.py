import random
import re
from collections import Counter

import corpus_pipeline
from scriptorium.llm import mixing, pii
from scriptorium.llm.common import written


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark, tmp_path):
    """Each stage on its own input, against what plain Python says of it."""
    r = random.Random(6)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(140):
        said = r.choices(vocabulary, k=r.randrange(20, 120))
        good = i % 5 != 0
        text = " ".join(said if good else [w + "***" for w in said])
        if i % 7 == 1 and good:
            text += f" mail ann.{i}@corp{i}.example.com"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[i][1] + " more", "en", "s1", len(rows[i][1]) + 5) for i in range(1, 60) if i % 5]
    rows.append((2000, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), "test")
        kept[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    ids = lambda name: {x["doc_id"] for x in kept[name]}
    good = {i for i, q, _ in labels if q} | {x[0] for x in rows if 1000 <= x[0] < 2000}
    assert good <= ids("quality classifier") and len(ids("quality classifier") - good - {2000}) <= 2
    assert {i for i in ids("n-gram Jaccard join") if i < 1000} == {i for i in ids("quality classifier") if i < 1000}
    assert not any(1000 <= i < 2000 for i in ids("n-gram Jaccard join"))
    assert len(kept["PII"]) == len(kept["n-gram Jaccard join"]) and not any("corp" in (x["text"] or "") for x in kept["PII"])
    before = spark.createDataFrame(kept["PII"], docs.schema)
    takes = {x["doc_id"]: x["taken"] for x in mixing.mix(before).collect()}
    mixed = Counter()
    for x in kept["mixing sources to target weights"]:
        mixed[x["doc_id"]] += words(x["text"])
    assert dict(mixed) == {i: t for i, t in takes.items() if t}
    packed = Counter()
    for x in kept["packing"]:
        packed[x["doc_id"]] += x["length"]
    assert packed == mixed
    assert pii.KEY and corpus_pipeline.ORACLE_SQL is None


LABELS = "doc_id long, quality int, toxic int"
#: Columns whose names the stages use inside.
EXTRA = "map('a', 1) AS m, 1 AS _id, 2 AS row, 3 AS of, 4 AS words, 5 AS key, 6 AS hits, 7 AS again, 8 AS quality_score, 9 AS pii_count, 10 AS n, 11 AS s1, 12 AS size, 13 AS taken, 14 AS _k0, 15 AS component_id, 16 AS `a.b`"


def tables(spark, path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.createOrReplaceTempView("pipeline_docs")
    spark.sql(f"SELECT *, {EXTRA} FROM pipeline_docs").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(3)] + [(None, 1, 0), (5, None, 0)], LABELS).write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (1, "other words that are not the same at all", "en", "a", 1), (2, "one two three four five six", None, None, None), (3, None, "en", "a", None), (4, "", "en", "b", 0), (5, " \n", "en", "b", 2), (None, "no id here at all today", "en", "b", 23), (None, "no id here at all today", "en", "b", 23), (6, long, "en", "c", len(long)), (7, "x" * 30000, "en", "c", 30000)]
    docs = tables(spark, tmp_path, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), "test")
        if name == "packing":
            assert out.where("length > 0").count() > 5
        else:
            assert out.columns == docs.columns and out.schema["m"].dataType == docs.schema["m"].dataType
            assert all(x["a.b"] == 16 and x["key"] == 5 and x["quality_score"] == 8 for x in out.collect())
        if name == "n-gram Jaccard join":
            kept = [(x["doc_id"], x["text"]) for x in out.collect()]
            assert sorted(i for i, _ in kept if i) == [1, 3, 4, 5, 6, 7] and sum(i is None for i, _ in kept) == 2
            assert dict(kept)[1] == "one two three four five six"  # the smallest set stands for the id
        docs = out


def test_the_join_stage_moves_no_texts_that_stay(spark, tmp_path, monkeypatch):
    """Of 400 documents only the copies and the rows that repeat an id are joined with what the join found."""
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(30)), "en", "a", 1) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more", "en", "a", 1) for i in range(5)] + [(9, rows[8][1], "en", "a", 1), (None, rows[3][1], "en", "a", 1), (None, None, "en", "a", 1)]
    docs, joined = tables(spark, tmp_path, rows), []
    join = type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, *a, **k: ("a.b" in self.columns and joined.append(self.count())) or join(self, *a, **k))
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path)).collect()
    # the row that stands for id 9 by its smaller set, or, of equal sizes, signature is a copy of 8 or not
    assert sorted(x["doc_id"] for x in out if x["doc_id"] is not None and x["doc_id"] != 9) == [i for i in range(400) if i != 9]
    assert sum(x["doc_id"] is None for x in out) == 2 and 0 < max(joined) <= 8


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = tables(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), "test")
        assert out.count() == 0
        docs = out if name != "packing" else docs
