import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from scriptorium.llm import jaccard, shingles
from scriptorium.llm.components import components

from .helpers import documents, empty, odd_documents


def shingle_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: shingle_sets(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 10 * common >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    """Clusters of copies with few and many edits, chains of copies, a passage that half the documents share."""
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    texts = []
    while len(texts) < n:
        words = r.choices(vocabulary, k=r.choice([3, 5, 8, 40, 120, 300]))
        if r.random() < 0.5:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        for _ in range(r.choice([1, 1, 2, 6])):
            texts.append(" ".join(words).lower() if r.random() < 0.3 else "  ".join(words))
            for _ in range(r.choice([0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
    r.shuffle(texts)
    return dict(enumerate(texts[:n]))


def run(spark, docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, [(i, t, "s") for i, t in docs.items()])).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    want = brute(docs)
    assert run(spark, docs) == want
    assert len({c for _, c in want.values()}) < len(docs) - 20


@pytest.mark.parametrize("limit", [400, 2000])
def test_large_blocks_are_cut_by_pivots(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", limit)
    monkeypatch.setattr(jaccard, "LEAST_COMMON", 1 << 20)  # the shared passage makes one block
    monkeypatch.setattr(jaccard, "APART_MEMBERS", 0)  # and parities leave it whole
    rounds, tiles = [], []
    cut, laid = jaccard._cut, jaccard._tiles
    monkeypatch.setattr(jaccard, "_cut", lambda *a: rounds.append(1) or cut(*a))
    monkeypatch.setattr(jaccard, "_tiles", lambda *a: tiles.append(1) or laid(*a))
    docs = corpus(3)
    assert run(spark, docs) == brute(docs)
    assert rounds and tiles


def test_a_large_group_of_near_copies_needs_no_tiles(spark):
    """All are in one ball: a round of pivots tells every link, and no pair of tiles is left."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    loaded = []
    for i in range(80):
        words = list(base)
        words[r.randrange(300)] = f"x{i}"
        loaded.append(("b", i, words))
    rows = [(b, i, len(s), s.tobytes()) for b, i, w in loaded for s in [shingles.shingle_set(np.frombuffer(" ".join(w).encode(), np.uint8))]]
    table = spark.createDataFrame(rows, "block string, doc_id long, n long, shingles binary")
    ready, edges = jaccard.large_blocks(table, 5000, [])
    assert ready.count() == 0 and len(edges) == 1
    assert {r["root"] for r in components(edges[0]).collect()} == {0}


def met(docs, tasks, common):
    """Regions of some tasks, met: (star edges, pairs that come often enough) as positions of different sets."""
    keys, texts = {}, {}
    for i, t in docs.items():
        s = shingles.shingle_set(np.frombuffer(t.encode(), np.uint8))
        keys.setdefault(jaccard._class_key(len(s), *jaccard._signature(s)), i)
        texts.setdefault(i % tasks, []).append(t)
    out = [b for part in texts.values() for b in jaccard._regions(common)(iter([pa.RecordBatch.from_pydict({"text": pa.array(part)})]))]
    stars, times = set(), {}
    for batch in jaccard._meet(iter(out)):
        for a, b, sure in zip(*batch.to_pydict().values(), strict=True):
            pair = keys[a], keys[b]
            if sure:
                stars.add(pair)
            else:
                times[pair] = times.get(pair, 0) + 1
    return stars, {p for p, n in times.items() if n >= jaccard.SHARED}


@pytest.mark.parametrize("few, many, held, paired", [(4, 64, 1 << 18, 1 << 16), (2, 5, 700, 50), (1000, 1000, 1 << 18, 64)])
def test_regions_keep_every_link_together(monkeypatch, few, many, held, paired):
    for name, value in (("FEW", few), ("MANY", many), ("HELD_MEMBERS", held), ("PAIRED", paired)):
        monkeypatch.setattr(jaccard, name, value)
    for seed in range(4):
        docs = corpus(seed, 120)
        # every other cell counts as common
        stars, pairs = met(docs, 3, np.full((1 << jaccard.CELL_BITS) // 8, 0x55, np.uint8))
        forest = jaccard.Forest(len(docs))
        for a, b in stars | pairs:
            forest.tie(a, b)
        sets = {i: shingle_sets(t) for i, t in docs.items()}
        links = [(a, b) for a in docs for b in docs if a < b and sets[a] != sets[b] and jaccard.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))]
        first = {}
        for i in docs:
            first.setdefault(frozenset(sets[i]), i)
        assert links and all(forest.root(first[frozenset(sets[a])]) == forest.root(first[frozenset(sets[b])]) for a, b in links)
        assert stars or many == 1000


def chained():
    """Documents of many sizes; each shares five words with six that follow and no more, and so all touch. Two are near copies."""
    r = random.Random(11)
    docs = {i: [f"d{i}_{j}" for j in range(100 + 3 * (i % 12))] for i in range(72)}
    for g in range(0, 72, 4):
        for k in range(8):
            words = docs[(g + k) % 72]
            at = r.randrange(0, len(words) - 20) if k < 4 else len(words)
            words[at:at] = [f"p{g}_{j}" for j in range(5)]
    docs[72] = docs[7][:-1] + ["other"]
    return {i: " ".join(w) for i, w in docs.items()}


def test_words_shared_by_chance_make_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_COMMON", 1 << 20)
    monkeypatch.setattr(jaccard, "APART_MEMBERS", 0)  # blocks as regions leave them
    placed, links = [], jaccard.block_links
    monkeypatch.setattr(jaccard, "block_links", lambda rows, places, *a: placed.extend(x["rep"] for x in places.collect()) or links(rows, places, *a))
    docs = chained()
    assert run(spark, docs) == brute(docs)
    assert sorted(placed) == [7, 72]


def test_links_come_through_pivots():
    """Of the links that the join measures, most are told by the balls of pivots, in blocks of every size."""
    told = {"ball": 0, "bound": 0}
    for seed in range(6):
        docs = corpus(seed, 120)
        sets = [shingles.shingle_set(np.frombuffer(t.encode(), np.uint8)) for t in docs.values()]
        for size in (2, 3, 8, 24, 120):
            for at in range(0, 120, size):
                forest = jaccard.Forest(len(sets))
                jaccard.metric_join(sets, list(range(at, min(at + size, 120))), forest)
                told = {k: told[k] + forest.told[k] for k in told}
    assert told["ball"] > 10 * told["bound"] and told["ball"] > 100


def test_repeated_ids_lose_no_link_of_others(spark):
    """A row whose id stands for another text does not hide a text from the documents that have it."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a few words only here now", "s"), (1, text, "s"), (2, text, "s"), (3, text + " more", "s")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert got == {(1, 1), (2, 2), (3, 2)}


def test_metric_join_against_brute_force():
    """Cells, windows and recursion alone, without regions before them."""
    for seed in range(12):
        docs = corpus(seed, 120)
        sets = [np.sort(shingles.shingle_set(np.frombuffer(t.encode(), np.uint8))) for t in docs.values()]
        forest = jaccard.Forest(len(sets))
        jaccard.metric_join(sets, list(range(len(sets))), forest)
        assert {i: forest.root(i) for i in docs} == {i: c for i, (_, c) in brute(docs).items()}


def test_parities_keep_every_link_together():
    for seed in range(8):
        docs = corpus(seed, 120)
        sets = {i: shingles.shingle_set(np.frombuffer(t.encode(), np.uint8)) for i, t in docs.items()}
        rows = pd.DataFrame({"rep": list(docs), "n": [len(s) for s in sets.values()], "bits": [jaccard._parity(s) for s in sets.values()], "block": "0"})
        got = dict(zip(*jaccard._refine(rows[rows["n"] > 0]).to_numpy().T, strict=True))
        linked = [(a, b) for a in docs for b in docs if a < b and jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
        assert linked and all(got[a] == got[b] for a, b in linked) and len(got) < 120


def test_word_hashes_over_spans(monkeypatch):
    text = ("Ab cd\n" * 500 + "e" * 400 + " f").encode()
    whole = shingles.word_hashes(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(shingles, "SPAN", 64)
    shingles._powers.cache_clear()
    assert (shingles.word_hashes(np.frombuffer(text, np.uint8)) == whole).all() and len(whole) == 1002
    shingles._powers.cache_clear()


def test_parities_never_exclude_a_link():
    r = random.Random(8)
    for _ in range(300):
        a = np.unique(np.array([r.getrandbits(64) for _ in range(r.randrange(1, 200))], np.uint64))
        b = np.unique(np.concatenate((a[r.randrange(0, len(a)) // 4 :], np.array([r.getrandbits(64) for _ in range(r.randrange(0, 30))], np.uint64))))
        common = len(np.intersect1d(a, b))
        if jaccard.linked(common, len(a), len(b)):
            assert jaccard.may_link(len(a), len(b), jaccard._apart(jaccard._parity(a), jaccard._parity(b)))


def test_odd_rows(spark):
    rows = jaccard.jaccard_components(odd_documents(spark)).collect()
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in rows)
    want = {1: (17, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (1, 5), 7: (1, 7), 8: (17, 1), 9: (2, 9)}
    for i, n, c in got:
        if i in want:
            assert (n, c) == want[i]
    assert len(rows) == 11 and [c for i, _, c in got if i == -1] == [None]
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 201), (201, 200)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["root"] for r in rows} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200} and len(rows) == 46


def test_components_in_rounds_and_at_once(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, other = ({x["id"]: x["root"] for x in components(df, at_once=n).collect()} for n in (1 << 20, 2))
    assert one == other and len(one) > 100
    assert components(df.limit(0)).count() == 0
