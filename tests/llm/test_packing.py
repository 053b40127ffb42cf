import random
from itertools import combinations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import packing, token_counts

from .helpers import documents, empty, odd_documents


def padding(counts, bounds):
    return sum(n * (min(b for b in bounds if b >= k) - k) for k, n in counts.items())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(counts, buckets):
    bounds = packing.boundaries(counts, buckets)
    lengths = sorted(counts)
    assert bounds[-1] == lengths[-1] and len(bounds) <= buckets and set(bounds) <= set(lengths)
    best = min(padding(counts, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
    assert padding(counts, bounds) == best


def check(rows, max_len, budget):
    places = [(r["bucket_len"], r["batch"], r["slot"]) for r in rows if r["length"]]
    assert len(set(places)) == len(places)
    by = {}
    for b, batch, slot in places:
        assert slot < budget // b
        by.setdefault(b, []).append(batch * (budget // b) + slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(0 < r["length"] <= r["bucket_len"] <= max_len for r in rows if r["length"])


def test_batches(spark):
    r = random.Random(3)
    docs = documents(spark, [(i, "w " * r.randrange(0, 260), "s") for i in range(120)])
    rows = packing.pack(docs, max_len=100, buckets=4, budget=500, keep=("source",)).collect()
    check(rows, 100, 500)
    size = {d["doc_id"]: len((d["text"] or "").split()) for d in docs.collect()}
    for i, n in size.items():
        own = [x for x in rows if x["doc_id"] == i]
        assert sum(x["length"] for x in own) == n and len(own) == max(1, -(-n // 100)) == own[0]["n_pieces"]
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack(docs.repartition(5), max_len=100, buckets=4, budget=500, keep=("source",)).collect()))


def test_odd_rows(spark):
    rows = packing.pack(odd_documents(spark)).collect()
    check(rows, packing.MAX_LEN, packing.BUDGET)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) - 1
    assert all(r["bucket_len"] is None for r in rows if not r["length"])
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(documents(spark, [(1, None, "a")])).collect()[0]["length"] == 0


def test_pieces_are_spans_of_whole_texts(spark):
    r = random.Random(5)
    blanks = [" ", "  ", "\n", "\t \n"]
    texts = {i: r.choice(["", " ", "\n\n"]) + "".join(r.choice(["Wörter", "x", "日本語", "😀"]) + r.choice(blanks) for _ in range(n)) + r.choice(["", "end"]) for i, n in enumerate([0, 1, 6, 7, 8, 13, 14, 15, 60, 61])}
    rows = packing.pack(documents(spark, [(i, t, "s") for i, t in texts.items()]), max_len=7, budget=21).collect()
    for i, t in texts.items():
        own = sorted((x for x in rows if x["doc_id"] == i), key=lambda x: x["piece"])
        parts = [t[x["char_start"] : x["char_end"]] for x in own]
        words = t.split()
        assert "".join(parts) == t and [p.split() for p in parts] == ([words[k : k + 7] for k in range(0, len(words), 7)] or [[]])
        assert [x["length"] for x in own] == [len(p.split()) for p in parts]
    assert all(x["padding"] == x["bucket_len"] - x["length"] for x in rows if x["length"]) and {x["over"] for x in rows} == {0}


def test_packed_batches_hold_their_texts(spark):
    docs = documents(spark, [(i, " ".join(f"d{i}w{k}" for k in range(i % 23)), "s") for i in range(80)])
    held = packing.batches(docs, max_len=10, buckets=3, budget=40).collect()
    seen = {}
    for b in held:
        assert b["n_rows"] == len(b["rows"]) <= 40 // b["bucket_len"] and b["n_real"] + b["n_padding"] == b["n_rows"] * b["bucket_len"]
        assert [x["slot"] for x in b["rows"]] == list(range(len(b["rows"])))
        for x in b["rows"]:
            assert (x["mask"]["start"], x["mask"]["end"]) == (0, len(x["text"].split())) and x["length"] <= b["bucket_len"]
            seen.setdefault(x["doc_id"], []).append((x["piece"], x["text"]))
    assert {i: "".join(t for _, t in sorted(p)) for i, p in seen.items()} == {d["doc_id"]: d["text"] for d in docs.collect() if d["text"]}


def test_lengths_in_tokens(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    count = token_counts.counter(path)
    r = random.Random(6)
    texts = {i: " ".join(r.choice(["the", "Quixotically", "zzyzx", "don't", "3.14", "naïve", "x" * 40]) for _ in range(n)) for i, n in enumerate([0, 1, 5, 40, 90])}
    rows = packing.pack(documents(spark, [(i, t, "s") for i, t in texts.items()]), max_len=24, budget=96, vocabulary=path).collect()
    for i, t in texts.items():
        own = sorted((x for x in rows if x["doc_id"] == i), key=lambda x: x["piece"])
        assert "".join(t[x["char_start"] : x["char_end"]] for x in own) == t
        assert [x["length"] + x["over"] for x in own] == [count(t[x["char_start"] : x["char_end"]]) for x in own] and sum(x["length"] + x["over"] for x in own) == count(t)
        assert all(x["length"] <= 24 for x in own)
    check(rows, 24, 96)


def test_kept_columns_of_any_name(spark):
    df = spark.sql("SELECT 1 AS doc_id, 'a b c' AS text, 4 AS size, 5 AS key, 6 AS length, map('a', 1) AS rank")
    row = packing.pack(df, keep=("size", "key", "rank")).first()
    assert (row["size"], row["key"], row["rank"]) == (4, 5, {"a": 1}) and row["length"] == 3
