"""Document fingerprints: SimHash. DataFrame functions only.

The terms of a text are its shingles of three words (all of it, where it has fewer), weighted
by their number. Each term's 128-bit hash votes on 128 signed bits. Votes are counted in
32-bit lanes of longs, two bits a sum, so that one hash aggregate inside generated code
counts all of them (up to 2^31 terms a text).

`near_pairs` finds all fingerprints within a Hamming radius: the 128 bits are cut into
radius + k blocks, and for every choice of k blocks a permuted table is keyed by them. Two
fingerprints within the radius agree on at least k blocks, so they meet in a table. k is 2;
what a large bucket of such a table holds is keyed anew with k = 4, whose buckets are far
smaller. Equal fingerprints are one class, so no group of copies is multiplied: at most 256
different ones can all be within 3 bits of each other. Buckets are compared in chunks, inside
arrays, and give only the pairs that are near.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, written

BITS = 128
SHINGLE = 3
#: Bits within which the registered query looks for near fingerprints.
RADIUS = 3
#: Members of a bucket that are compared as they are, and of a chunk of it, about.
LARGE, CHUNK = 256, 64
#: Cuts of the ids' range, and documents that are put in order together, about.
CUTS, TOGETHER = 512, 1024


def _terms(text: Column) -> Column:
    """Hashes of all three-word shingles; of all words together where there are one or two; none without words."""
    words = F.filter(F.split(text, rf"[{BLANKS}]+"), lambda w: w != "")
    inner = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(SHINGLE)]))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= SHINGLE, inner(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))[0]


def _votes(term: Column) -> list[Column]:
    """Sums of the set bits of 64-bit hashes: bits i and i + 32 in one long."""
    lanes = F.lit((1 << 32) | 1)
    return [F.sum(F.shiftrightunsigned(term, i).bitwiseAND(lanes)) for i in range(32)]


def _word64(sums: list[str], n: str) -> Column:
    """The 64 majorities of 32 sums of n votes."""
    bits = []
    for i, s in enumerate(sums):
        low, high = F.col(s).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(s), 32)
        for votes, at in ((low, i), (high, i + 32)):
            value = (1 << at) - (1 << 64 if at == 63 else 0)
            bits.append(F.when(votes * 2 > F.col(n), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, low, high): a fingerprint of 128 bits in two longs for every row; keys must tell rows apart.

    A null or empty text, or one without words, has the fingerprint 0.
    """
    term, other = F.col("term"), F.xxhash64(F.col("term"), F.lit(1))
    exploded = texts.select(*keys, F.explode_outer(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    lows, highs = [f"a{i}" for i in range(32)], [f"b{i}" for i in range(32)]
    votes = exploded.withColumn("other", F.when(term.isNotNull(), other)).groupBy(*keys).agg(
        F.count("term").alias("n"), *[v.alias(c) for v, c in zip(_votes(term), lows, strict=True)], *[v.alias(c) for v, c in zip(_votes(F.col("other")), highs, strict=True)]
    )
    return votes.select(*keys, F.when(F.col("n") > 0, _word64(lows, "n")).otherwise(0).alias("low"), F.when(F.col("n") > 0, _word64(highs, "n")).otherwise(0).alias("high"))


def distance(low: str, high: str, low2: str, high2: str) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(F.col(low).bitwiseXOR(F.col(low2))) + F.bit_count(F.col(high).bitwiseXOR(F.col(high2)))


def as_string(low: str, high: str) -> Column:
    return F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0"))


def likeness(bits_apart: Column) -> Column:
    return F.lit(1.0) - bits_apart / F.lit(float(BITS))


def _tables(radius: int, k: int) -> Column:
    """(t, key) of each permuted table of a fingerprint: k of radius + k blocks."""
    bits = F.concat(F.lpad(F.bin(F.col("high")), 64, "0"), F.lpad(F.bin(F.col("low")), 64, "0"))
    n = radius + k
    edges = [i * BITS // n for i in range(n + 1)]
    of = lambda bits: F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[F.substring(bits, edges[i] + 1, edges[i + 1] - edges[i]) for i in some]).alias("key")) for t, some in enumerate(combinations(range(n), k))])
    return F.transform(F.array(bits), of)[0]


def _several(keyed: DataFrame) -> DataFrame:
    """Keys that more than one fingerprint has, and how many."""
    return keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def near_pairs(prints: DataFrame, radius: int, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All fingerprints within `radius` of each other: (members, pairs).

    members: (id, low, high, class_id), class_id the smallest id with the same fingerprint;
    pairs: (class_a, class_b, bits) of different fingerprints, class_a < class_b. Copies
    are held by their class. Rows without an id are members of no class of their own: a
    fingerprint that only they have has a null class and no pairs. Texts without words share the
    fingerprint 0. An empty table gives none; other columns are ignored.
    """
    if not 0 <= radius <= BITS - 4:
        raise ValueError("radius is out of range")
    ids = prints.select(F.col(id_col).alias("id"), "low", "high")
    classes = ids.groupBy("low", "high").agg(F.min("id").alias("class_id"))
    members = ids.join(classes, ["low", "high"]).select("id", "low", "high", "class_id")
    known = written(classes.where("class_id IS NOT NULL"), "simhash-classes")
    keyed = known.select("class_id", "low", "high", F.explode(_tables(radius, 2)).alias("k")).select("class_id", "low", "high", "k.key")
    several = written(_several(keyed), "simhash-keys")
    met = keyed.join(several, "key")
    again = met.where(F.col("n") > LARGE).drop("n").withColumn("k", F.explode(_tables(radius, 4))).select("class_id", "low", "high", F.xxhash64("key", "k.t", "k.key").alias("key"))
    again = again.join(_several(again), "key")
    dealt = met.where(F.col("n") <= LARGE).unionByName(again.select(*met.columns))
    chunked = dealt.groupBy("key", F.pmod(F.xxhash64("class_id"), F.ceil(F.col("n") / CHUNK)).alias("chunk")).agg(F.collect_list(F.struct("class_id", "low", "high")).alias("held"))
    other = chunked.select("key", F.col("chunk").alias("chunk2"), F.col("held").alias("held2"))
    apart = lambda x, y: F.bit_count(x["low"].bitwiseXOR(y["low"])) + F.bit_count(x["high"].bitwiseXOR(y["high"]))
    near = lambda x, ys: F.filter(ys, lambda y: ((F.col("chunk") < F.col("chunk2")) | (x["class_id"] < y["class_id"])) & (apart(x, y) <= radius))
    pair = lambda x, y: F.struct(F.least(x["class_id"], y["class_id"]).alias("class_a"), F.greatest(x["class_id"], y["class_id"]).alias("class_b"), apart(x, y).cast("int").alias("bits"))
    found = F.flatten(F.transform("held", lambda x: F.transform(near(x, F.col("held2")), lambda y: pair(x, y))))
    pairs = chunked.join(other, "key").where(F.col("chunk") <= F.col("chunk2")).select(F.explode(found).alias("p")).select("p.*").distinct()
    return members, pairs


def _placed(docs: DataFrame, cuts: list[int], parts: int) -> DataFrame:
    """docs with the bucket (q, sub) of its id: q by cuts of the ids' range, sub by equal steps between two cuts."""
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    q = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    if parts == 1 or not cuts:
        return docs.withColumn("q", q).withColumn("sub", F.lit(0))
    low, high = F.element_at(bounds, F.greatest(F.col("q"), F.lit(1))), F.element_at(bounds, F.least(F.col("q") + 1, F.lit(len(cuts))))
    step = (F.col("doc_id").cast("double") - low.cast("double")) / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0)) * parts
    return docs.withColumn("q", q).withColumn("sub", F.when((F.col("q") <= 0) | (F.col("q") >= len(cuts)), 0).otherwise(F.floor(step)).cast("int"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, q, sub, pos, next_text, next_q, next_sub, next_pos): each row and the next by descending id; the first follows the last.

    (q, sub, pos) tells rows apart. Rows that repeat an id go by text. The ids' range is cut
    at quantiles (at most CUTS numbers on the driver); a bucket's last row sees the first row
    of the next bucket, which is copied into it. Buckets are ordered by their ids alone.
    """
    n = docs.count()
    ids = docs.select(F.col("doc_id"))
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / CUTS for i in range(1, CUTS)], 10 * CUTS)).first()[0] or []))
    parts = max(1, n // (CUTS * TOGETHER))
    heads = _placed(ids, cuts, parts).groupBy("q", "sub").agg(F.max("doc_id").alias("head"))
    down = F.col("sub").desc()
    inner = W.partitionBy("q").orderBy(down)
    tops = heads.groupBy("q").agg(F.max(F.struct("sub", "head")).alias("top"))
    tops = tops.select(F.col("q").alias("_q"), F.coalesce(F.lead(F.struct("q", "top")).over(W.orderBy(F.desc("q"))), F.first(F.struct("q", "top")).over(W.orderBy(F.desc("q")))).alias("after"))
    chain = heads.withColumn("then", F.lead(F.struct("sub", "head")).over(inner)).join(tops, F.col("q") == F.col("_q"))
    inside = F.when(F.col("then").isNotNull(), F.struct(F.col("q"), F.col("then.sub").alias("sub"), F.col("then.head").alias("head")))
    across = F.struct(F.col("after.q").alias("q"), F.col("after.top.sub").alias("sub"), F.col("after.top.head").alias("head"))
    chain = chain.select("q", "sub", F.coalesce(inside, across).alias("nx"))
    chain = written(chain.select(F.col("q").alias("to_q"), F.col("sub").alias("to_sub"), F.col("nx.q").alias("nq"), F.col("nx.sub").alias("nsub"), F.col("nx.head").alias("head")), "simhash-chain")
    own = _placed(docs.select("doc_id", "text"), cuts, parts).withColumn("guest", F.lit(0)).withColumn("nq", F.lit(None).cast("int")).withColumn("nsub", F.lit(None).cast("int"))
    # of rows that share a bucket's first id only the smallest text is that bucket's first row
    first_rows = docs.select("doc_id", "text").join(chain, F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("doc_id", "to_q", "to_sub", "nq", "nsub").agg(F.min(F.struct("text")).alias("t"))
    guests = first_rows.select("doc_id", F.col("t.text").alias("text"), F.col("to_q").alias("q"), F.col("to_sub").alias("sub"), F.lit(1).alias("guest"), "nq", "nsub")
    order = W.partitionBy("q", "sub").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    seen = own.unionByName(guests).select(
        "*", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("next_text"),
        F.lead(F.when(F.col("guest") == 1, F.struct(F.col("nq").alias("q"), F.col("nsub").alias("sub"), F.lit(1).alias("pos")))).over(order).alias("jump"),
    )
    return seen.where("guest = 0").select(
        "doc_id", "text", "q", "sub", "pos", "next_text",
        F.coalesce("jump.q", "q").alias("next_q"), F.coalesce("jump.sub", "sub").alias("next_sub"), F.coalesce(F.col("jump.pos"), F.col("pos") + 1).alias("next_pos"),
    )


def compare_with_edits(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, n_near) of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document, by descending id; the first follows the last, and an
    only document follows itself. class_id is the smallest id with the same fingerprint,
    n_near the number of other fingerprints within `radius` bits, found in block tables. A
    null text is empty; a null id comes last; rows that repeat an id go by text; an empty
    table gives none; other columns are ignored.
    """
    pairs = with_next(docs)
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))
    facts = pairs.select(F.struct("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("sha"), "next_q", "next_sub", "next_pos").alias("about"), "q", "sub", "pos", F.explode(F.array(F.struct(F.lit(0).alias("side"), text.alias("text")), F.struct(F.lit(1).alias("side"), edited.alias("text")))).alias("s"))
    prints = fingerprints(facts.select("about", "q", "sub", "pos", F.col("s.side").alias("side"), F.col("s.text").alias("text")), ["q", "sub", "pos", "side", "about"])
    both = prints.groupBy("q", "sub", "pos", "about").agg(F.max(F.when(F.col("side") == 0, F.struct("low", "high"))).alias("f"), F.max(F.when(F.col("side") == 1, F.struct("low", "high"))).alias("e"))
    rows = written(both.select("q", "sub", "pos", "about.*", F.col("f.low").alias("low"), F.col("f.high").alias("high"), F.col("e.low").alias("elow"), F.col("e.high").alias("ehigh")), "simhash-prints")
    _, near = near_pairs(rows, radius)
    counts = near.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_near"))
    classes = rows.groupBy("low", "high").agg(F.min("doc_id").alias("class_id")).join(counts, "class_id", "left")
    classes = classes.select(F.col("low").alias("clow"), F.col("high").alias("chigh"), "class_id", F.coalesce("n_near", F.lit(0)).alias("n_near"))
    other = rows.select(F.col("q").alias("next_q"), F.col("sub").alias("next_sub"), F.col("pos").alias("next_pos"), F.col("low").alias("nlow"), F.col("high").alias("nhigh"))
    met = rows.join(other, ["next_q", "next_sub", "next_pos"]).join(classes, (F.col("low") == F.col("clow")) & (F.col("high") == F.col("chigh")))
    return met.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_string("low", "high").alias("fingerprint"), as_string("elow", "ehigh").alias("edited_fingerprint"),
        likeness(distance("low", "high", "elow", "ehigh")).alias("near_edited"), likeness(distance("low", "high", "nlow", "nhigh")).alias("near_next"), "class_id", "n_near",
    )
