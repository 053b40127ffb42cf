import re
from collections import defaultdict
from itertools import permutations

from scriptorium.llm import filter_audit
from scriptorium.llm.query_set import QUERIES

from .helpers import documents, empty, odd_documents

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(rows):
    """The set of letters that each row (doc_id, text) fails, by the contract's own words."""
    out = []
    for i, t in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": any(j is not None and i is not None and j < i and (u or "") == text for j, u in rows),
        }
        out.append({k for k, v in tests.items() if v})
    return out


def brute(rows, labels):
    """Every order applied to every row, one step at a time."""
    sets = failing([(i, t) for i, t, _ in rows])
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    report, by_filter = {}, defaultdict(int)
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, s) for (i, _, lang), s in zip(rows, sets, strict=True) if (lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            alive = list(mine)
            for k, f in enumerate(order):
                gone, stay = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
                before = len([x for x in mine if f in x[1]]) - len(gone)
                report[part, order, k + 1] = [len(stay), len(gone), before, sum(s == {f} for _, s in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                by_filter[part, f] += len(gone)
                alive = stay
    return {(p, o, k): (*v, by_filter[p, o[k - 1]]) for (p, o, k), v in report.items()}


def as_table(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in df.collect()}


def frames(spark, rows, labels):
    docs = documents(spark, [(i, t, "s") for i, t, _ in rows]).drop("lang")
    docs = spark.createDataFrame([(*r[:2], lang, *r[2:]) for r, (_, _, lang) in zip(docs.collect(), rows, strict=True)], "doc_id long, text string, lang string, source string, n_chars long, part string, mask long, fp string, bucket string, n string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


LONG = " ".join(f"word{i}" for i in range(220))


def sample():
    texts = [None, "", "short", LONG, LONG + " #", "A " * 300, ("one two " * 150), LONG.upper(), LONG, "short", " ".join(f"Xy{i}" for i in range(199)), " ".join(f"xy{i}" for i in range(200)), "é" * 97 + "ABC", "é" * 96 + "ABC", "a\x1cb " * 200, LONG + " " + LONG]
    rows = [(i * 7 % 101, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts * 3)]
    rows += [(5, LONG, "en"), (5, LONG, "en"), (None, LONG, "en"), (None, "", None), (0, "new text " * 150, "fr")]
    labels = [(i, [0, 1, None][i % 3], [1, 0, None][i % 3]) for i in range(0, 101, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1)]
    return rows, labels


def test_against_every_order_applied(spark):
    rows, labels = sample()
    assert as_table(filter_audit.audit(*frames(spark, rows, labels))) == brute(rows, labels)


def test_a_group_of_copies_over_many_partitions(spark):
    """Groups that begin, go on and end in other partitions than their least row."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i, LONG if i % 3 else f"text {i}", "en") for i in range(400)] + [(200, LONG, "en")] * 150
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        marks = filter_audit.failures(frames(spark, rows, [])[0]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(marks) == len(rows)
    assert sorted(r["doc_id"] for r in marks if not r["mask"] & 16) == sorted([*range(0, 400, 3), 1]) and len({r["mask"] for r in marks if r["doc_id"] == 200}) == 1


def test_texts_of_one_fingerprint(spark, monkeypatch):
    """Full texts decide where fingerprints are alike."""
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: filter_audit.F.lit(7).cast("long"))
    rows, labels = sample()
    assert as_table(filter_audit.audit(*frames(spark, rows, labels))) == brute(rows, labels)


def test_odd_rows(spark):
    assert filter_audit.audit(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    df = odd_documents(spark)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
    assert as_table(filter_audit.audit(df, spark.createDataFrame([(1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int"))) == brute(rows, [(1, 1, 0), (2, None, 1)])


def test_query_has_every_step(spark):
    got = QUERIES["op12_filter_audit"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang").distinct().count()
    assert got.count() == n * 600 and got.where("kept + removed + redundant < 0").count() == 0
