"""Tokens, entity mentions and their places."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import sentences

from .joins import inside

#: Labels of interest, parts of speech that carry meaning, and words that do not.
LABELS = ("PERSON", "ORG", "LOC", "PRODUCT")
PARTS_OF_SPEECH = ("NOUN", "VERB", "ADJ", "PROPN")
STOPWORDS = ("こと", "もの", "ため", "よう", "ところ", "これ", "それ", "あれ", "いる", "ある", "する", "なる", "くる")
SEGMENT_BYTES = 40000

MENTIONS = "array<struct<name:string,ner_label:string,char_start:int,char_end:int>>"


@dataclass(frozen=True)
class RuleAnalyzer:
    """The default analyzer: words by a pattern, entities by one pattern a label.

    Any object with `tokens(Column) -> array<string>`, `mentions(Column) -> MENTIONS`,
    `sentences(Column) -> array<string>`, a `settings` mapping, `versions` and a `version` is an
    analyzer; `models.ModelAnalyzer` wraps a language model.
    """

    word: str = r"\p{L}{3,}"
    stopwords: tuple[str, ...] = STOPWORDS
    entities: tuple[tuple[str, str], ...] = (("OTHER", r"\p{Lu}\p{Ll}{14,}"), ("PRODUCT", r"\p{Lu}\p{Ll}{10,}"), ("LOC", r"\p{Lu}\p{Ll}{8,}"), ("ORG", r"\p{Lu}\p{Ll}{6,}"), ("PERSON", r"\p{Lu}\p{Ll}{3,}"))

    @property
    def settings(self) -> dict:
        return {"kind": "rules", "word": self.word, "stopwords": list(self.stopwords), "entities": [list(e) for e in self.entities]}

    @property
    def versions(self) -> dict:
        return {"pyspark": pyspark.__version__}

    @property
    def version(self) -> str:
        """P20: changes with the rules themselves."""
        return "rules@" + hashlib.sha256(json.dumps(self.settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    def sentences(self, text: Column) -> Column:
        """P3, for an analyzer of patterns."""
        return sentences(text)

    def tokens(self, text: Column) -> Column:
        """lower-case words without stopwords."""
        words = F.regexp_extract_all(F.lower(text), F.lit(self.word), F.lit(0))
        return F.filter(words, lambda w: ~w.isin(*self.stopwords)) if self.stopwords else words

    def mentions(self, text: Column) -> Column:
        """Entities in order. Matches and the gaps between them lie end to end, so their lengths give the offsets: no Python."""
        every = "|".join(f"(?:{p})" for _, p in self.entities)
        told = lambda names, gaps: F.aggregate(
            F.arrays_zip(names.alias("name"), F.slice(F.transform(gaps, F.length), 1, F.size(names)).alias("gap")), F.struct(F.lit(0).alias("at"), F.array().cast(MENTIONS).alias("out")),
            lambda s, m: F.struct((s["at"] + m["gap"] + F.length(m["name"])).alias("at"), F.array_append(s["out"], F.struct(m["name"].alias("name"), self._label(m["name"]).alias("ner_label"), (s["at"] + m["gap"]).alias("char_start"), (s["at"] + m["gap"] + F.length(m["name"])).alias("char_end"))).alias("out")),
            lambda s: s["out"],
        )
        body = F.coalesce(text, F.lit(""))
        found = F.struct(F.regexp_extract_all(body, F.lit(every), F.lit(0)).alias("names"), F.split(body, every, -1).alias("gaps"))
        return F.transform(F.array(found), lambda x: told(x["names"], x["gaps"]))[0]

    def names(self, text: Column) -> Column:
        """array<struct<name, ner_label>>: the same entities without their offsets, by one pass."""
        every = "|".join(f"(?:{p})" for _, p in self.entities)
        return F.transform(F.regexp_extract_all(text, F.lit(every), F.lit(0)), lambda n: F.struct(n.alias("name"), self._label(n).alias("ner_label")))

    def _label(self, name: Column) -> Column:
        """The label of the first pattern that the whole name is of."""
        out = F.lit(None).cast("string")
        for label, pattern in reversed(self.entities):
            out = F.when(name.rlike(rf"\A(?:{pattern})\z"), label).otherwise(out)
        return out


def restore(settings: dict):
    """SC12: the analyzer that saved settings describe."""
    kind = settings.get("kind", "rules")
    if kind == "rules":
        return RuleAnalyzer(settings["word"], tuple(settings["stopwords"]), tuple(tuple(e) for e in settings["entities"]))
    if kind == "model":
        from .models import ModelAnalyzer

        return ModelAnalyzer(settings["model"], stopwords=tuple(settings["stopwords"]))
    raise ValueError(f"unknown analyzer {kind!r}")


def by_name(backend: str = "rules", device: str = "cpu"):
    """An analyzer by the name that the command line knows."""
    if backend == "rules":
        return RuleAnalyzer()
    from .models import MODELS, ModelAnalyzer

    return ModelAnalyzer(MODELS[backend], device)


def keep_tokens(tokens: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lemmas of array<struct<pos, lemma>> with an allowed part of speech, stripped, without empty ones and stopwords."""
    allowed = F.filter(tokens, lambda t: t["pos"].isin(*PARTS_OF_SPEECH))
    return F.filter(F.transform(allowed, lambda t: F.trim(t["lemma"])), lambda x: (x != "") & ~x.isin(*stopwords))


def entity_tag(iob: Column, label: Column, names: dict[str, str]) -> Column:
    """P10: `B-PERSON` and the like; null outside of entities. `names` maps a model's labels to ours."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    known = F.coalesce(F.try_element_at(table, label), label) if names else label
    return F.when(F.coalesce(iob, F.lit("")).isin("", "O"), F.lit(None).cast("string")).otherwise(F.concat_ws("-", iob, known))


def bio_spans(tags: DataFrame) -> DataFrame:
    """Spans (source, ner_label, char_start, char_end, name) of tags (source, i, tag, char_start, char_end, token).

    A span begins with B-, goes on with I- of the same label, and is broken by anything else;
    I- tags that no B- opened are dropped until the next B-.
    """
    label, head = F.substring("tag", 3, 1000), F.col("tag").startswith("B-")
    order = W.partitionBy("source").orderBy("i")
    broken = head | F.col("tag").isNull() | F.coalesce(F.lag("tag").over(order).isNull(), F.lit(True)) | (F.lag(label).over(order) != label)
    island = F.sum(broken.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = tags.withColumn("island", island).where(F.col("tag").isNotNull())
    spans = marked.groupBy("source", "island").agg(F.min(F.struct("i", "tag", "char_start")).alias("first"), F.max("char_end").alias("char_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), "").alias("name"))
    return spans.where(F.col("first.tag").startswith("B-")).select("source", F.substring("first.tag", 3, 1000).alias("ner_label"), F.col("first.char_start").alias("char_start"), "char_end", "name")


def shift(mentions: Column, by: Column) -> Column:
    """Mentions moved by an offset."""
    return F.transform(mentions, lambda m: F.struct(m["name"].alias("name"), m["ner_label"].alias("ner_label"), (m["char_start"] + by).alias("char_start"), (m["char_end"] + by).alias("char_end")))


def word_places(docs: DataFrame, pattern: str = r"\p{L}{3,}") -> DataFrame:
    """(source, start, token) of every match in docs (source, text), start in characters of the document.

    Matches and the gaps between them lie end to end, so a running sum of their lengths gives
    the offsets: linear in the length of a document.
    """
    body = F.coalesce("text", F.lit(""))
    found = docs.select("source", F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("tokens"), F.transform(F.split(body, pattern, -1), F.length).alias("gaps"))
    each = found.select("source", F.posexplode(F.arrays_zip("tokens", F.slice("gaps", 1, F.size("tokens")).alias("gap"))).alias("i", "m")).select("source", "i", F.col("m.tokens").alias("token"), F.col("m.gap").alias("gap"))
    to_here = W.partitionBy("source").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return each.select("source", (F.sum(F.col("gap") + F.length("token")).over(to_here) - F.length("token")).cast("int").alias("start"), "token")


def tokens_in_chunks(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tokens (source, start, token) that start inside a chunk; an interval join by offset buckets."""
    low, high = F.col("char_start"), F.col("char_end")
    met = inside(tokens, "start", chunks, low, high, [F.col("chunk_id"), low.alias("_from"), high.alias("_to")])
    return met.where((F.col("start") >= F.col("_from")) & (F.col("start") < F.col("_to"))).select("chunk_id", "start", "token")


def entities_in_chunks(mentions: DataFrame, chunks: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Mentions wholly inside a chunk, with a label of interest, relative to the chunk; an interval join by offset buckets."""
    low, high = F.col("char_start"), F.col("char_end")
    met = inside(mentions.where(F.col("ner_label").isin(*labels)), "char_start", chunks, low, high, [F.col("chunk_id"), low.alias("_from"), high.alias("_to")])
    within = met.where((low >= F.col("_from")) & (high <= F.col("_to")))
    return within.select("chunk_id", "name", "ner_label", (low - F.col("_from")).alias("char_start"), (high - F.col("_from")).alias("char_end"))


def byte_segments(text: str, limit: int = SEGMENT_BYTES, terminator: str = "。") -> list[tuple[int, str]]:
    """(offset, segment) of at most `limit` UTF-8 bytes each; laid end to end they are the text.

    A cut goes after the last blank line of what fits, else after the last sentence end, else
    after the last line feed, else where the bytes are used up.
    """
    out, chars, at = [], 0, 0
    raw = text.encode()
    marks = [m.encode() for m in ("\n\n", terminator, "\n")]
    while len(raw) - at > limit:
        end = at + limit
        while end > at and raw[end] & 0xC0 == 0x80:  # not inside a character
            end -= 1
        if end == at:  # one character alone is over the limit
            end = next((i for i in range(at + 1, len(raw)) if raw[i] & 0xC0 != 0x80), len(raw))
        end = next((found + len(m) for m in marks if (found := raw.rfind(m, at, end)) >= 0), end)
        piece = raw[at:end].decode()
        out.append((chars, piece))
        chars, at = chars + len(piece), end
    return [*out, (chars, raw[at:].decode())] if at < len(raw) else out


def with_segments(docs: DataFrame, limit: int = SEGMENT_BYTES, terminator: str = "。") -> DataFrame:
    """(source, char_offset, segment) of docs (source, text)."""

    @F.pandas_udf("array<struct<char_offset:int,segment:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"char_offset": a, "segment": s} for a, s in byte_segments(t or "", limit, terminator)])

    return docs.select("source", F.explode(cut("text")).alias("s")).select("source", "s.char_offset", "s.segment")
