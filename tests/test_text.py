import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first()["x"]


def plain(t):
    t = unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub("[ \t　]+$", "", t, flags=re.M)
    return re.sub("[ \t　]+", " ", t).strip()


@pytest.mark.parametrize(("raw", "want"), [("ＡＢＣ１２３", "ABC123"), ("a\r\nb\rc", "a\nb\nc"), ("a  \nb\t\n", "a\nb"), ("あ　　い", "あ い"), ("　 x", "x"), ("", ""), ("﻿a", "﻿a"), ("x\n  テスト", "x\n テスト"), ("a \u0085b", "a \u0085b")])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize, raw) == want == plain(raw)
    assert one(spark, T.normalize, want) == want


def test_normalize_many(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("aé　 \t\n\rｱ１。\u0085\x1c﻿ﬁ"), max_size=30), min_size=1, max_size=20))
    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        assert {r["i"]: r["x"] for r in df.select("i", T.normalize(F.col("t")).alias("x")).collect()} == {i: plain(t) for i, t in enumerate(texts)}

    run()


def test_sentences(spark):
    assert one(spark, T.sentences, "一。二\n三 。。 ") == ["一。", "二", "三 。", "。"]
    assert "".join(one(spark, T.pieces, "一。二\n三 。。 ")) == "一。二\n三 。。 "


def test_chunk_id(spark):
    want = hashlib.sha256(f"a.txt|3|9|{hashlib.sha256('日本'.encode()).hexdigest()}".encode()).hexdigest()[:12]
    assert one(spark, lambda s, t: T.chunk_id(s, F.lit(3), F.lit(9), t), "a.txt", "日本") == want


def test_small_functions(spark):
    assert one(spark, T.fence, "a\n---\n--- b\n---") == "a\n\\---\n--- b\n\\---"
    assert one(spark, lambda t: T.excerpt(t, 5), "ab\ncdefg") == "ab cd"
    assert one(spark, T.major_minor, "3.11.4") == "3.11"
    assert [one(spark, T.finish_reason, x) for x in ("stop", "length", "", "safety")] == ["stop", "max_tokens", "end_turn", "safety"]
    assert one(spark, T.single_sentence, "一。二") and not one(spark, T.single_sentence, "一。二。")
    assert one(spark, lambda p: T.relative_source(p, "/data/in"), "file:///data/in/x.txt") == "x.txt"
    assert T.positive_int("3") == 3
    with pytest.raises(ValueError, match="positive"):
        T.positive_int(0)


def test_file_names(spark):
    name = lambda n: one(spark, lambda x: T.entity_filename(F.lit("ORG"), x), n)
    mark = lambda n: hashlib.sha256(f"ORG\0{n}".encode()).hexdigest()[:6]
    assert name("東京") == f"ORG__東京_{mark('東京')}.md"
    assert name("A/B") == f"ORG__A_B_{mark('A/B')}.md" != name("A\\B")
    assert name("nul") == f"ORG__nul__{mark('nul')}.md"
    long = name("漢" * 100)
    assert len(long.encode()) <= 131 and long.endswith(".md") and "�" not in long
    with pytest.raises(PySparkException):
        name("..")
