import hashlib
import random
import re
from collections import defaultdict

import pytest

from scriptorium.llm import exact_dedup

from .helpers import documents, empty, odd_documents


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of every row, and how many rows stay in each group."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, least, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(df, rows, **options):
    got = exact_dedup.mark_copies(df, **options).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    kept = defaultdict(list)
    for r in got:
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]].append(r["doc_id"])
    assert {k: len(v) for k, v in kept.items()} == {r["text_sha256"]: 1 for r in got}


@pytest.mark.parametrize("first, growth", [(1, 2), (4, 3), (128, 8)])
def test_against_brute_force(spark, first, growth):
    """Texts that share prefixes of every length, end inside others, and come several times."""
    r = random.Random(first)
    stem = "the same beginning of many texts, é日😀 " * 3
    texts = [stem[: r.randrange(len(stem))] + r.choice(["", "a", "b", " ", "\t\n", "ab" * r.randrange(4)]) for _ in range(300)]
    rows = [(i, r.choice([t, t, t.replace(" ", " \x0b "), None if r.random() < 0.02 else t])) for i, t in enumerate(texts)]
    check(documents(spark, [(i, t, "a") for i, t in rows]), rows, first=first, growth=growth)


def test_white_space_is_ascii_only(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "a \x1c b"), (4, "a\t\x0c\r b"), (5, " a b"), (6, "a b ")]
    check(documents(spark, [(i, t, "a") for i, t in rows]), rows)


def test_lengths_at_the_digits_ends(spark):
    rows = [(i, "x" * n) for i, n in enumerate([*range(12), *range(5, 10), 16, 17, 16, 17, 15])]
    check(documents(spark, [(i, t, "a") for i, t in rows]), rows, first=4, growth=2)


def test_one_group_of_a_third_of_all(spark):
    rows = [(i, "the same long text " * 200 if i % 3 else f"{i} other") for i in range(900)]
    check(documents(spark, [(i, t, "a") for i, t in rows]), rows)


def test_odd_rows(spark):
    df = odd_documents(spark)
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert exact_dedup.mark_copies(empty(spark)).count() == 0
    rows = [(None, None), (None, ""), (7, "t"), (None, "t"), (7, "t"), (7, "u"), (None, "z"), (None, "z")]
    check(documents(spark, [(i, t, "a") for i, t in rows]), rows)


def test_kept_rows_whole(spark):
    """All columns of the rows that stay, names that the operator uses itself included."""
    df = documents(spark, [(2, "t", "a"), (1, "t ", "b"), (3, "t ", "c"), (4, None, None)]).withColumnRenamed("key", "kept").withColumnRenamed("block", "digit").withColumnRenamed("one", "odd.name")
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["source"], r["kept"], r["digit"], r["odd.name"]) for r in got.collect()) == [(1, "b", "x", "b", "o"), (2, "a", "x", "b", "o"), (4, None, "x", "b", "o")]
    marked = exact_dedup.mark_copies(df, keep=("kept", "source"))
    assert marked.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "_kept", "source"]
