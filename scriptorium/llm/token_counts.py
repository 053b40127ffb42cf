"""Token counts: heap-and-linked-list byte-pair merging, counting without emitting identifiers.

A word of n initial symbols that takes m merges has n - m tokens. Merges are found with a
heap of adjacent pairs keyed by (rank, position) over a doubly linked list of symbols; an
entry is stale once one of its two symbols has been merged away or changed. Only the merge
table is needed: symbols are looked up as pairs, no vocabulary identifiers are produced.

Text handling follows the tokenizer file: special strings are split out first and count one
each, then NFC, lower case by code point, and the file's split pattern.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept by each worker; past that the cache starts anew (counts never depend on it).
CACHED_WORDS = 400_000
#: Long texts are worked through in pieces of about so many characters, cut before white space.
PIECE = 1_000_000

#: Letters (first and last of each run) that Unicode has had since version 17. The library splits by version 16, the `regex` module by a later one.
NEWER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Numbers, likewise.
NEWER_NUMBERS = [(0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6)]
#: Small letters of those that versions 16 and 17 added, which Python's tables (15.1) lack; the library lowers by version 17.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {i: i + 0x20 for i in range(0x10D50, 0x10D66)} | {i: i + 0x1B for i in range(0x16EA0, 0x16EB9)}

#: All of these tables lies here; other texts take the plain pattern, which is faster.
_LATE = regex.compile(f"[{chr(NEWER_LETTERS[0][0])}-{chr(0x10FFFF)}]")
_SPACE = regex.compile(r"[ \t\n\r\f\v]")


class Merges(dict):
    """word -> number of tokens, filled as words come."""

    def __init__(self, ranks: dict[tuple[str, str], tuple[int, str]], suffix: str) -> None:
        super().__init__()
        self.ranks, self.suffix = ranks, suffix
        self.alphabet = _byte_alphabet()

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = self[word] = self.count(word)
        return n

    def count(self, word: str) -> int:
        """Initial symbols minus merges."""
        symbols: list[str | None] = [self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        if n == 0:
            return 0
        symbols[-1] += self.suffix
        after, before, ranks = [*range(1, n), -1], [*range(-1, n - 1)], self.ranks
        heap = [(found[0], i, found[1]) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or (found := ranks.get((symbols[i], symbols[j]))) is None or found[0] != rank:
                continue
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((joined, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((symbols[h], joined))):
                heapq.heappush(heap, (found[0], h, found[1]))
            merges += 1
        return n - merges


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 stands for itself, the rest follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts the tokens of whole texts as the tokenizer file of `path` gives them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.words = Merges({p: (rank, p[0] + p[1]) for rank, p in enumerate(pairs)}, model["end_of_word_suffix"] or "")
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = specials
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V0)
        runs = lambda table: "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in table)
        known = split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{runs(NEWER_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{runs(NEWER_NUMBERS)}]]")
        self.wide = regex.compile(known, regex.V1)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(x in text for x in self.specials):
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])

    def _plain(self, text: str) -> int:
        total, at = 0, 0
        while len(text) - at > PIECE:
            cut = _SPACE.search(text, at + PIECE)
            if cut is None:
                break
            total += self._piece(text[at : cut.start()])
            at = cut.start()
        return total + self._piece(text[at:] if at else text)

    def _piece(self, text: str) -> int:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes by single code points: no final form
                text = text.replace("Σ", "σ")
            if _LATE.search(text):
                return sum(map(self.words.__getitem__, self.wide.findall(text.lower().translate(LOWER))))
        return sum(map(self.words.__getitem__, self.pattern.findall(text.lower())))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each worker process and file."""
    return Counter(path)


def count_tokens(docs: DataFrame, *, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    A null or empty text has 0 bytes and 0 tokens; a null id is kept; repeated rows each
    give a row; an empty table gives an empty result; other columns are ignored, whatever
    their names. `vocabulary` is a path on each machine, or None-safe callable result.
    One map over the rows, no shuffle; each worker holds the merge table and a bounded cache.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((count(t.as_py()) for t in texts), pa.int64())], names=["id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = rows.select(F.struct("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("id"), "text")
    counted = sizes.mapInArrow(work, f"id struct<id:{kind},n_bytes:bigint>, n_tokens long")
    return counted.select(F.col("id.id").alias(id_col), F.col("id.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
