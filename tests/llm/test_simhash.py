import hashlib
import random
import re
from functools import reduce

import pytest
import xxhash

from scriptorium.llm import simhash

from .helpers import PROSE, documents, empty, odd_documents


def check(docs, rows):
    """Edited texts by brute force, and likeness from the strings themselves."""
    order = sorted(docs, key=lambda d: (d["doc_id"] is None, -(d["doc_id"] or 0), d["text"] or ""))
    want = []
    for i, d in enumerate(order):
        t, after = d["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        half = len(t) // 2
        want.append((d["doc_id"] or -1, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    for r in rows:
        bits = int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)
        assert r["near_edited"] == pytest.approx(1 - bits.bit_count() / 128)


def test_edits(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = documents(spark, [(i * 37 % 1009, " ".join(r.choices(vocabulary, k=r.randrange(1, 200))), "s") for i in range(300)])
    rows = simhash.compare_with_edits(docs).collect()
    check(docs.collect(), rows)
    assert sum(x["near_edited"] > x["near_next"] for x in rows) > 0.9 * len(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = simhash.compare_with_edits(docs).collect()
    check(docs.collect(), rows)
    assert len({x["fingerprint"] for x in rows if x["n_chars"] == len(PROSE) and x["doc_id"] == 1}) == 1
    assert simhash.compare_with_edits(empty(spark)).count() == 0
    one = simhash.compare_with_edits(documents(spark, [(4, PROSE, "a")])).collect()
    assert one[0]["near_next"] == 1.0


def test_sub_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CUTS", 5)
    monkeypatch.setattr(simhash, "TOGETHER", 4)
    docs = documents(spark, [(i**3 % 5003, f"{PROSE} {i}", "s") for i in range(200)])
    check(docs.collect(), simhash.compare_with_edits(docs).collect())


def test_near_pairs_against_brute_force(spark):
    r = random.Random(4)
    prints = []
    for i in range(60):
        base = r.getrandbits(128) if i % 4 == 0 or not prints else prints[-1][1]
        for _ in range(r.randrange(0, 4)):
            base ^= 1 << r.randrange(128)
        prints.append((i, base))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(i, signed(p & (2**64 - 1)), signed(p >> 64)) for i, p in prints], "doc_id long, low long, high long")
    members, pairs = simhash.near_pairs(df, 3)
    first = {}
    for i, p in prints:
        first.setdefault(p, i)
    assert {(m["id"], m["class_id"]) for m in members.collect()} == {(i, first[p]) for i, p in prints}
    known = {i: p for p, i in first.items()}
    want = {(a, b, (known[a] ^ known[b]).bit_count()) for a in known for b in known if a < b and (known[a] ^ known[b]).bit_count() <= 3}
    assert {(p["class_a"], p["class_b"], p["bits"]) for p in pairs.collect()} == want
    assert want


def plain_print(text):
    """Votes of all three-word shingles, by loops."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    chain = lambda ws: reduce(lambda seed, w: xxhash.xxh64_intdigest(w.encode(), seed), ws, 42)
    terms = [chain(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [chain(words)] if words else []
    other = [xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(t.to_bytes(8, "little"), 42)) for t in terms]
    bits = lambda hashes: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    return f"{bits(other):016X}{bits(terms):016X}"


def test_fingerprints_against_plain_votes(spark):
    r = random.Random(7)
    texts = [None, "", " ", "one", "one two", "a b c", "a b c a b c a b c", "Ünïcode 日本語\tx  y\n z"] + [" ".join(r.choices("abcdefgh", k=r.randrange(3, 60))) for _ in range(40)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    rows = {x["doc_id"]: x for x in simhash.compare_with_edits(docs).collect()}
    edited = lambda i: (lambda t, after: t[: len(t) - len(t) // 2] + after[: len(t) // 2])(texts[i] or "", texts[i - 1] or "")
    for i, t in enumerate(texts):
        x = rows[i]
        assert x["fingerprint"] == plain_print(t) and x["edited_fingerprint"] == plain_print(edited(i))
        assert x["near_next"] == pytest.approx(1 - (int(x["fingerprint"], 16) ^ int(plain_print(texts[i - 1]), 16)).bit_count() / 128)
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    first = {p: min(j for j in prints if prints[j] == p) for p in prints.values()}
    near = lambda p: sum(0 < (int(p, 16) ^ int(q, 16)).bit_count() <= simhash.RADIUS for q in first)
    assert all((rows[i]["class_id"], rows[i]["n_near"]) == (first[p], near(p)) for i, p in prints.items())


def test_large_buckets_are_keyed_anew(spark, monkeypatch):
    """A group of near fingerprints in one bucket of every table: second tables and chunks lose no pair."""
    monkeypatch.setattr(simhash, "LARGE", 20)
    monkeypatch.setattr(simhash, "CHUNK", 6)
    r = random.Random(8)
    base = r.getrandbits(128)
    known = {}
    for i in range(150):
        p = base
        for _ in range(r.randrange(0, 5)):
            p ^= 1 << r.randrange(40)
        known.setdefault(p, i)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(i, signed(p & (2**64 - 1)), signed(p >> 64)) for p, i in known.items()], "doc_id long, low long, high long")
    _, pairs = simhash.near_pairs(df, 3)
    want = {(min(i, j), max(i, j), (p ^ q).bit_count()) for p, i in known.items() for q, j in known.items() if i < j and (p ^ q).bit_count() <= 3}
    found = [tuple(x) for x in pairs.collect()]
    assert set(found) == want and len(found) == len(want) > 200
