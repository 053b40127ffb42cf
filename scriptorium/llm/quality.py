"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded: shares of its bytes,
and the form and repetition of its words, through a learned tanh layer. Gated attention
(a = softmax(w . (tanh(Vh) * sigmoid(Uh)))) weighs the passages, and a logistic unit scores
the weighted passage representation. Only documents are labelled; encoder, attention and
score are learned together (NumPy, Adam) on a bounded sample of labelled documents: whole
documents in the order of a hash of their ids, as many as the two bounds below leave room for.
One task of an executor learns; the driver sees nothing but the finished parameters (20 KB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import FEW_ROWS, word_count, written
from .shingles import _BASE, column_bytes, mix64

PASSAGE = 64
#: The sample that is learned from: labelled documents at most, and passages of all of them together at most (36 MB of features).
TRAIN_DOCUMENTS, TRAIN_PASSAGES = 3000, 65536
HIDDEN, ATTENTION, STEPS, RATE, DECAY = 24, 12, 400, 0.01, 1e-4
#: Bytes that are encoded together.
SPAN = 1 << 20
_BYTES = 128 + 4
FEATURES = _BYTES + 6


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end with a line feed after each, and where each begins."""
    gap = np.array([10], np.uint8)
    data = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap[:0]
    return data, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1].astype(np.int64)


def encode(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the text of each passage, in order."""
    data, begins = _laid(texts)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(np.concatenate(([1], blank.view(np.int8))))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    ends = ends[1:] if len(ends) > len(starts) else ends
    if not len(starts):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    text = np.searchsorted(begins, starts, side="right") - 1
    first = np.searchsorted(text, np.arange(len(texts)))
    number = (np.arange(len(starts)) - first[text]) // PASSAGE
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (number[1:] != number[:-1])))
    at, passage = np.flatnonzero(new), np.cumsum(new) - 1
    n = len(at)
    lengths = ends - starts
    # bytes of words only
    of_byte = np.repeat(passage, lengths)
    letters = data[~blank]
    kinds = np.where(letters < 128, letters, 128 + ((letters >> 4) & 3)).astype(np.int64)
    shares = np.bincount(of_byte * _BYTES + kinds, minlength=n * _BYTES).reshape(n, _BYTES).astype(np.float32)
    shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1)
    # words: a cheap hash by first, last and summed bytes tells repetition
    sums = np.add.reduceat(letters.astype(np.uint64) * (letters.astype(np.uint64) + np.uint64(257)), np.concatenate(([0], np.cumsum(lengths)))[:-1])
    word = mix64(sums * _BASE + (data[starts].astype(np.uint64) << np.uint64(32)) + lengths.astype(np.uint64))
    words = np.diff(np.concatenate((at, [len(starts)]))).astype(np.float32)
    share = lambda mark: np.add.reduceat(mark.astype(np.float32), at) / words
    same = lambda lag: np.concatenate((np.zeros(min(lag, len(word)), bool), (word[lag:] == word[:-lag]) & (passage[lag:] == passage[:-lag])))
    tails = data[ends - 1]
    odd = (tails < 128) & ~(((tails >= 48) & (tails <= 57)) | ((tails >= 65) & (tails <= 90)) | ((tails >= 97) & (tails <= 122)))
    extra = np.stack((share(same(1)), share(same(2)), share(odd), share(lengths == 1), np.log1p(words) / 4, np.add.reduceat(lengths.astype(np.float32), at) / words / 10), axis=1)
    return np.concatenate((np.sqrt(shares), extra), axis=1).astype(np.float32), text[at]


@dataclass
class Model:
    """Parameters of encoder (E, e), attention (V, U, w) and score (c, b)."""

    E: np.ndarray
    e: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        return Model(g(FEATURES, HIDDEN), np.zeros(HIDDEN), g(HIDDEN, ATTENTION), g(HIDDEN, ATTENTION), g(ATTENTION), g(HIDDEN), np.zeros(1))

    def score(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        """Scores of n bags; a bag without passages has the representation 0."""
        return _sigmoid(self._forward(x, bag, n)["logit"])

    def _forward(self, x, bag, n):
        """bag: ascending; x may be float32, which halves the largest arrays."""
        h = np.tanh(x @ self.E.astype(x.dtype) + self.e)
        t, g = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        a = (t * g) @ self.w
        z = np.zeros((n, HIDDEN))
        at = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1]))) if len(bag) else np.zeros(0, np.int64)
        of = np.cumsum(np.diff(np.concatenate((bag[:1] - 1, bag))) != 0) - 1 if len(bag) else at
        p = a
        if len(at):
            p = np.exp(a - np.maximum.reduceat(a, at)[of])
            p = p / np.add.reduceat(p, at)[of]
            z[bag[at]] = np.add.reduceat(p[:, None] * h, at, axis=0)
        return {"h": h, "t": t, "g": g, "p": p, "z": z, "at": at, "of": of, "logit": z @ self.c + self.b[0]}

    def gradients(self, x, bag, n, y):
        f = self._forward(x, bag, n)
        h, t, g, p, z, at, of = (f[k] for k in ("h", "t", "g", "p", "z", "at", "of"))
        d = (_sigmoid(f["logit"]) - y) / n
        dz = d[:, None] * self.c
        along = (dz[bag] * h).sum(axis=1)
        da = p * (along - np.add.reduceat(p * along, at)[of]) if len(at) else p
        dt, dg = da[:, None] * self.w * g * (1 - t * t), da[:, None] * self.w * t * g * (1 - g)
        dh = p[:, None] * dz[bag] + dt @ self.V.T + dg @ self.U.T
        dpre = dh * (1 - h * h)
        return Model(x.T @ dpre.astype(x.dtype), dpre.sum(axis=0), h.T @ dt, h.T @ dg, (da[:, None] * t * g).sum(axis=0), z.T @ d, np.array([d.sum()]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def learn(x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Model:
    """Full-batch Adam on the log loss. Deterministic. Without both labels the score is the labels' share (0.5 without labels)."""
    model = Model.start()
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        model.c[:], model.b[0] = 0, np.log(rate / (1 - rate))
        return model
    names = list(vars(model))
    first, second = ({k: np.zeros_like(getattr(model, k)) for k in names} for _ in range(2))
    for step in range(1, steps + 1):
        grad = model.gradients(x, bag, len(y), y)
        rate = RATE * (1 - 0.9 * step / steps)
        for k in names:
            g = getattr(grad, k) + DECAY * getattr(model, k) * (k not in ("e", "b"))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            getattr(model, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _groups(column) -> Iterator[list[np.ndarray]]:
    """Texts in groups of bounded size; a longer text is a group of its own."""
    held, size = [], 0
    for text in column_bytes(column):
        if held and size + len(text) > SPAN:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, x) of (doc_id, y, text): the features of each document's passages, as bytes."""
    for batch in batches:
        ids, y, at = batch.column("doc_id"), batch.column("y"), 0
        for group in _groups(batch.column("text")):
            x, of = encode(group)
            ends = np.searchsorted(of, np.arange(len(group) + 1))
            rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), y.slice(at, len(group)), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])
            at += len(group)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the parameters learned from all rows (doc_id, y, x) of the bounded sample."""
    found = sorted({r["doc_id"]: (r["doc_id"], r["y"], r["x"]) for batch in batches for r in batch.to_pylist()}.values())
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, _, x in found]
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags]).astype(np.int64)
    model = learn(x, bag, np.array([y == 1 for _, y, _ in found], np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([[v.astype(np.float64).tobytes() for v in vars(model).values()]], pa.list_(pa.binary()))], names=["parts"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Learns from whole labelled documents that are not held out, in the order of a hash of their ids.

    At most TRAIN_DOCUMENTS, and no more passages together than TRAIN_PASSAGES: a document that
    would go beyond is left out of the sample, whatever its length. Of labels that repeat an
    id the least counts, of texts that do the least; null labels and ids do not count; a null
    text is empty; other columns are ignored; no labels, or none of one kind, give a constant.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
    order = F.xxhash64("_id")
    chosen = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(order, "_id").limit(TRAIN_DOCUMENTS)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    sized = met.groupBy("_id", "_y").agg(F.min("text").alias("text"))
    sample = written(sized.select(F.col("_id").cast("long").alias("doc_id"), F.col("_y").alias("y"), order.alias("turn"), F.ceil(word_count(F.col("text")) / PASSAGE).alias("passages"), "text"), "quality-sample")
    taken, room = [], TRAIN_PASSAGES
    for r in sample.select("doc_id", "turn", "passages").orderBy("turn", "doc_id").collect():
        if r["passages"] <= room:
            taken.append(r["doc_id"])
            room -= r["passages"]
    few = sample.where(F.col("doc_id").isin(taken)) if taken else sample.limit(0)
    features = few.select("doc_id", "y", "text").mapInArrow(_features, "doc_id long, y int, x binary")
    row = written(features.repartition(1).mapInArrow(_learned, "parts array<binary>"), "quality-model", FEW_ROWS).first()
    if row is None:  # no partition, no task
        return learn(np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0))
    return Model(*[np.frombuffer(bytes(b), np.float64).reshape(v.shape) for b, v in zip(row["parts"], vars(Model.start()).values(), strict=True)])


def score(docs: DataFrame, model: Model, *, keep: list[str], at_least: float | None = None, name: str = "quality_score") -> DataFrame:
    """The columns `keep` and `name`, the probability of label 1, over whole texts.

    Null and empty texts score as an empty bag; null ids and repeated rows are rows like
    others; an empty table gives none; kept columns may have any name and type (an old column
    `name` is replaced). With `at_least`, rows below it go.
    """
    keep = [c for c in dict.fromkeys(keep) if c.lower() != name.lower()]
    inner = [f"_{i}" for i in range(len(keep))]
    schema = StructType([StructField(i, docs.schema[c].dataType) for i, c in zip(inner, keep, strict=True)] + [StructField("score", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group in _groups(batch.column("text")):
                x, of = encode(group)
                out.append(model.score(x.astype(np.float64), of, len(group)))
            found = np.concatenate(out) if out else np.zeros(0)
            rows = pa.RecordBatch.from_arrays([*[batch.column(c) for c in inner], pa.array(found)], names=[*inner, "score"])
            yield rows if at_least is None else rows.filter(pa.array(found >= at_least))

    rows = docs.select(*[docs[f"`{c}`"].alias(i) for c, i in zip(keep, inner, strict=True)], docs["text"].alias("text")).mapInArrow(work, schema)
    return rows.select(*[F.col(i).alias(c) for c, i in zip(keep, inner, strict=True)], F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from `threshold` on.

    Inputs of a score are the text alone. Null and empty texts get the score of an empty bag,
    null ids are scored and not held out, repeated rows are scored each, an empty table gives
    none, further columns are ignored; without labels every score is 0.5.
    """
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
