import hashlib
import random
import re
from collections import defaultdict

import pytest

from scriptorium.llm import mixing

from .helpers import documents, empty, odd_documents


def levels(sizes):
    """Water-filling, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = {}
    total = sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, left * weight[s] / w if w else 0.0) for s in order}
        capped |= {s: 3.0 * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += words(d["text"])
    goal = levels(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(goal[r["source"]], rel=1e-12)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == int(goal[s] + 1e-9)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((d["doc_id"] or -1, words(d["text"])) for d in docs)


def test_targets_and_takes(spark):
    r = random.Random(5)
    docs = documents(spark, [(i, " ".join("w" for _ in range(r.randrange(0, 900))), r.choice(["a", "a", "a", "b", "c", None, "dd"])) for i in range(150)])
    rows = mixing.mix(docs).collect()
    check(rows, docs.collect())
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_capped_sources(spark):
    docs = documents(spark, [(1, "w " * 1000, "a"), (2, "w " * 10, "b"), (3, "w", "c"), (4, "", "d")])
    check(mixing.mix(docs).collect(), docs.collect())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(mixing.mix(docs).collect(), docs.collect())
    assert mixing.mix(empty(spark)).count() == 0


def test_schedule_is_low_discrepancy(spark):
    sources = spark.createDataFrame([("a", 600), ("b", 300), (None, 100)], "source string, n_slots long")
    rows = sorted((r for r in mixing.schedule(sources).collect() if r["slot"] is not None), key=lambda r: r["slot"])
    for n in (50, 100, 500, 900):
        share = sum(r["source"] == "a" for r in rows if r["slot"] < n) / n
        assert abs(share - 0.6) < 0.06
    assert sorted((r["source"] or "", r["rank"]) for r in mixing.schedule(sources).collect()) == sorted([("a", i) for i in range(600)] + [("b", i) for i in range(300)] + [("", i) for i in range(100)])


def test_mixed_texts(spark):
    docs = documents(spark, [(i, "\n ".join(f"w{i}x{j}" for j in range(5 + i)), "ab"[i % 2]) for i in range(12)])
    takes = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    rows = mixing.apply_mix(docs).collect()
    got, texts = defaultdict(int), {d["doc_id"]: d["text"] for d in docs.collect()}
    for r in rows:
        got[r["doc_id"]] += words(r["text"])
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert dict(got) == {i: t for i, (t, _) in takes.items() if t}


def simulated(rows, block=8):
    """The schedule by loops: streams by MD5 of the id, blocks, golden-ratio points, slot after slot."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    order = sorted(sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), sum(sizes.values())
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in order if s not in open_)
    length = {s: -(-sizes[s] // -(-sizes[s] // block)) for s in order}
    stream = {s: [(i, w) for _, i, n in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, len(t.split())) for i, t, x in rows if x == s) for w in range(n)] for s in order}
    goal = {s: int(target[s]) for s in order}
    blocks = {s: -(-sizes[s] // length[s]) for s in order}
    slots = {s: goal[s] // sizes[s] * blocks[s] + -(-(goal[s] % sizes[s]) // length[s]) for s in order}
    total, low, dealt = sum(slots.values()), {}, []
    at = 0
    for s in order:
        low[s] = (at / total, (at + slots[s]) / total)
        at += slots[s]
    given = dict.fromkeys(order, 0)
    for slot in range(total):
        u = (slot + 1) * 0.6180339887498949 % 1.0
        s = next(s for s in order if low[s][0] <= u < low[s][1])
        if given[s] < slots[s]:
            dealt.append((slot, s, given[s]))
        given[s] += 1
    for s in order:
        dealt += [(total + r, s, r) for r in range(given[s], slots[s])]
    out = []
    for slot, s, rank in sorted(dealt):
        b = rank % blocks[s]
        words = stream[s][b * length[s] : (b + 1) * length[s]]
        if rank // blocks[s] == goal[s] // sizes[s]:
            words = words[: goal[s] % sizes[s] - b * length[s]]
        out += [(slot, s, i, w) for i, w in words]
    return out


def test_against_a_plain_simulation(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{k}" for k in range(r.randrange(1, 30))), r.choice("aaaabcd")) for i in range(60)]
    want = simulated(rows)
    docs = documents(spark, rows)
    got = sorted(mixing.in_order(docs, block=8).collect(), key=lambda x: (x["slot"], x["place"]))
    assert [(x["slot"], x["source"], x["doc_id"], x["first_word"] + k) for x in got for k in range(x["n_words"])] == want
    taken = {x["doc_id"]: (x["taken"], x["first_slot"]) for x in mixing.mix(docs, block=8).collect()}
    assert taken == {i: (sum(d == i for _, _, d, _ in want), min((s for s, _, d, _ in want if d == i), default=None)) for i, _, _ in rows}
