import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import analysis, chunking
from scriptorium.operators.chunking import ChunkSpec, fold, overlapped, sentence_spans

FOUR = "".join(f"これは文章その{c}です。" for c in "一二三四")


def cut(text, spec):
    spans = sentence_spans(text, spec.terminators)
    raw, told = fold(text, spans, spec)
    final, more = overlapped(raw, spans, spec)
    return raw, final, told + more


def test_sizes_and_overlap():
    n = len(FOUR) // 4
    raw, final, _ = cut(FOUR, ChunkSpec(3 * n - 3, 0, 80))
    assert raw == final == [(0, 3 * n), (3 * n, 4 * n)]
    _, final, told = cut(FOUR, ChunkSpec(3 * n - 3, n - 1, 80))
    assert final == [(0, 3 * n), (2 * n, 4 * n)] and not told
    _, final, told = cut(FOUR, ChunkSpec(3 * n - 3, 2, 80))
    assert final == raw and [w[0] for w in told] == ["overlap_skipped"]


def test_long_sentences():
    text = "あ" * 30 + "。"
    assert cut(text, ChunkSpec(20, 0, 200))[0] == [(0, 31)]
    assert [w[0] for w in cut(text, ChunkSpec(20, 0, 200))[2]] == ["sentence_over_target"]
    soft = "あ" * 12 + "、" + "い" * 12 + "," + "う" * 12 + "。"
    raw, _, told = cut(soft, ChunkSpec(10, 0, 20))
    assert raw == [(0, 13), (13, 26), (26, 39)] and told[0][0] == "sentence_soft_split"
    assert cut("x" * 45, ChunkSpec(10, 0, 20))[0] == [(0, 20), (20, 40), (40, 45)]


def test_parameters():
    for bad in ({"target": 0}, {"overlap": -1}, {"target": 10, "limit": 9}):
        with pytest.raises(ValueError, match="chunks need"):
            ChunkSpec(**bad)


@given(st.text(alphabet="ab 。、\n,", max_size=200), st.integers(1, 30), st.integers(0, 20), st.integers(0, 30))
def test_properties(text, target, overlap, more):
    spec = ChunkSpec(target, overlap, target + more)
    raw, final, _ = cut(text, spec)
    spans = sentence_spans(text, spec.terminators)
    assert all(text[a:b] == text[a:b].strip() != "" for a, b in spans)
    assert [b for _, b in raw] == [b for _, b in final]
    assert all(x[1] <= y[0] for x, y in zip(raw, raw[1:], strict=False))
    assert all(f[0] <= r[0] for f, r in zip(final, raw, strict=True))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == "".join(text[a:b] for a, b in raw).replace(" ", "").replace("\n", "")


def test_documents(spark):
    docs = spark.createDataFrame([("b", FOUR), ("a", FOUR), ("c", ""), ("d", None)], "source string, text string")
    rows = chunking.with_row_index(chunking.chunk_documents(docs, ChunkSpec(30, 10, 80)), "source", "ord").orderBy("row_index").collect()
    assert [(r["row_index"], r["source"], r["ord"]) for r in rows] == [(0, "a", 0), (1, "a", 1), (2, "b", 0), (3, "b", 1)]
    assert all(FOUR[r["char_start"] : r["char_end"]] == r["text"] for r in rows)
    assert len({r["chunk_id"] for r in rows}) == 4


@given(st.text(alphabet="aé漢😀。\n", max_size=120), st.integers(4, 40))
def test_segments(text, limit):
    parts = analysis.byte_segments(text, limit)
    assert "".join(s for _, s in parts) == text
    at = 0
    for offset, s in parts:
        assert offset == at and len(s.encode()) <= limit
        at += len(s)


def test_segments_prefer_paragraphs():
    assert analysis.byte_segments("ab。\n\ncd。ef\n", 11)[0] == (0, "ab。\n\n")


def test_bio(spark):
    tags = ["B-A", "I-A", "I-B", "I-A", None, "I-A", "B-A", "B-B", "I-B"]
    df = spark.createDataFrame([("s", i, t, i * 2, i * 2 + 2, str(i)) for i, t in enumerate(tags)], "source string, i int, tag string, char_start int, char_end int, token string")
    rows = sorted((r["char_start"], r["char_end"], r["ner_label"], r["name"]) for r in analysis.bio_spans(df).collect())
    assert rows == [(0, 4, "A", "01"), (12, 14, "A", "6"), (14, 18, "B", "78")]


def test_python_holds_few_texts_at_a_time():
    """However many rows a batch has, a few hundred texts or a megabyte of them are objects at once; longer ones stand alone."""
    import pyarrow as pa

    from scriptorium.functions import text as T

    texts = ["x" * 3000] * 2000 + ["", None] * 1500 + ["y" * (3 << 20)] + ["é" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], names=["source", "text"])
    pieces = list(T.normalized_rows(iter([batch, batch.slice(0, 0)])))
    assert [t for p in pieces for t in p.column(1).to_pylist()] == texts
    assert max(p.num_rows for p in pieces) == T.ROWS
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()) <= T.BYTES or p.num_rows == 1 for p in pieces)


def test_names_are_the_mentions(spark):
    text = "Anna met Bertrand Wolfeschlegel in Constantinopel, and Überlingen. Bo left."
    one = spark.createDataFrame([(text,), (None,), ("",)], "text string").persist()
    found = one.select(analysis.RuleAnalyzer().mentions(F.col("text")).alias("m"), analysis.RuleAnalyzer().names(F.col("text")).alias("n")).collect()
    assert [(m["name"], m["ner_label"]) for m in found[0]["m"]] == [(n["name"], n["ner_label"]) for n in found[0]["n"]] and len(found[0]["n"]) == 5
    assert not found[1]["n"] and not found[2]["n"]
