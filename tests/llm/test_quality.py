import math
import random
import re
import zlib

import numpy as np

from scriptorium.llm import quality

from .helpers import documents, empty, odd_documents

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def model_and_numbers(seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((30, quality.FEATURES))
    bag = np.sort(r.integers(0, 6, 30))
    return quality.Model.start(3), x, bag, 6, r.integers(0, 2, 6).astype(float)


def test_gradients_are_those_of_the_log_loss():
    model, x, bag, n, y = model_and_numbers()
    grad = model.gradients(x, bag, n, y)

    def loss():
        p = model.score(x, bag, n)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    r = np.random.default_rng(1)
    for name, value in vars(model).items():
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in value.shape)
            old, step = value[at], 1e-6
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - getattr(grad, name)[at]) < 1e-6


def corpus(seed=1, n=260):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randrange(1, 300))
        good = r.random() < 0.75
        if not good:
            words = [w + r.choice(["***", "&&&", "$$$"]) for w in words]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(good), 0, "other", 0.5))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    out = quality.classify(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    truth = {x[0]: x[1] for x in labels}
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus(2, 120)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, *rest) for i, q, *rest in labels]
    one, two = (quality.classify(documents(spark, rows), spark.createDataFrame(x, LABELS)).collect() for x in (labels, flipped))
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_passages_cover_whole_texts():
    text = np.frombuffer(b" ".join(b"word" for _ in range(1000)), np.uint8)
    x, of = quality.encode([text, text[:0], text[:4]])
    assert list(np.bincount(of, minlength=3)) == [16, 0, 1] and np.isfinite(x).all()


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0, "t", 0.0), (1, 0, 0, "t", 0.0), (None, 1, 0, "t", 0.0), (6, None, 0, "t", 0.0), (7, 0, 0, "t", 0.0), (8, 1, 0, "t", 0.0), (9, 1, 0, "t", 0.0)], LABELS)
    rows = quality.classify(odd_documents(spark), labels).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1
    assert quality.classify(empty(spark), labels).count() == 0
    assert {r["score"] for r in quality.classify(odd_documents(spark), labels.limit(0)).collect()} == {0.5}


def plain_features(text: bytes) -> list[list[float]]:
    """Features of each passage, by loops over its words."""
    words, out = re.findall(rb"[^\x20\x09-\x0D]+", text), []
    for at in range(0, len(words), quality.PASSAGE):
        own = words[at : at + quality.PASSAGE]
        letters = b"".join(own)
        shares = [0.0] * 132
        for b in letters:
            shares[b if b < 128 else 128 + ((b >> 4) & 3)] += 1 / len(letters)
        same = lambda lag: sum(own[i] == own[i - lag] for i in range(lag, len(own))) / len(own)  # noqa: B023, E731
        odd = sum(w[-1] < 128 and not chr(w[-1]).isalnum() for w in own) / len(own)
        extra = [same(1), same(2), odd, sum(len(w) == 1 for w in own) / len(own), math.log1p(len(own)) / 4, len(letters) / len(own) / 10]
        out.append([math.sqrt(x) for x in shares] + extra)
    return out


def plain_score(model, passages: list[list[float]]) -> float:
    """Gated attention by loops: softmax over w . (tanh(Vh) * sigmoid(Uh)), then a logistic unit."""
    dot = lambda row, m, j: sum(v * m[i][j] for i, v in enumerate(row))
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    hidden = [[math.tanh(dot(x, model.E, j) + model.e[j]) for j in range(quality.HIDDEN)] for x in passages]
    logits = [sum(model.w[k] * math.tanh(dot(h, model.V, k)) * sigmoid(dot(h, model.U, k)) for k in range(quality.ATTENTION)) for h in hidden]
    weights = [math.exp(v) for v in logits]
    z = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) if hidden else 0.0 for j in range(quality.HIDDEN)]
    return sigmoid(sum(a * c for a, c in zip(z, model.c, strict=True)) + model.b[0])


def test_scores_against_plain_loops(spark):
    rows, labels = corpus(3, 60)
    rows += [(1000, "", "s"), (1001, None, "s"), (1002, "Ünïcode 日本語 ok ok ok? x y !", "s"), (1003, "a", "s")]
    docs = documents(spark, rows)
    model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model, keep=["doc_id"]).collect()}
    for i, text, _ in rows:
        assert abs(got[i] - plain_score(model, plain_features((text or "").encode()))) < 1e-5


def test_the_sample_is_bounded_and_made_of_whole_documents(spark, monkeypatch):
    """The passages that one task learns from stay under the bound; reruns over other partitions agree."""
    rows, labels = corpus(4, 60)
    docs, known = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    size = {i: -(-len(t.split()) // quality.PASSAGE) for i, t, _ in rows}
    monkeypatch.setattr(quality, "TRAIN_PASSAGES", 40)
    kept = []
    real = quality.written
    monkeypatch.setattr(quality, "written", lambda df, label, *more: kept.append((label, real(df, label, *more))) or kept[-1][1])
    one, two = quality.fit(docs, known), quality.fit(docs.repartition(3), known.repartition(2))
    assert all((getattr(one, k) == getattr(two, k)).all() for k in vars(one))
    turns = [r["doc_id"] for r in kept[0][1].orderBy("turn", "doc_id").collect()]
    assert {r["doc_id"]: r["passages"] for r in kept[0][1].collect()} == {i: size[i] for i in turns} and sum(size[i] for i in turns) > 40


def test_kept_columns_of_any_name_and_type(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'some words here' AS text, map('a', 1) AS m, 0.5D AS quality_score, struct(1 AS x) AS `_0`, DATE'2024-01-01' AS `a.b`, NULL AS nothing")
    out = quality.score(df, quality.Model.start(), keep=df.columns)
    assert out.columns == ["doc_id", "text", "m", "_0", "a.b", "nothing", "quality_score"]
    row = out.first()
    assert row["m"] == {"a": 1} and row["_0"]["x"] == 1 and row["quality_score"] != 0.5
