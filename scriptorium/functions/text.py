
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  reached as pa.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: All characters that count as white space: spelled out, since regular expression engines differ.
SPACE = r"\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What `normalize` does, as it is kept with a corpus.
NORMALIZATION = {"nfkc": True, "newlines": "lf", "trailing_blanks": "strip", "blank_runs": "collapse", "trim": True}
#: File names that some systems reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
NAME_BYTES = 128
#: Sentence terminators and soft separators, in order of preference.
TERMINATORS, SOFT = "。\n", ("、", "\n", ",", " ")


_BLANKS_AT_ENDS, _BLANK_RUNS = re.compile("[ \t\u3000]+$", re.MULTILINE), re.compile("[ \t\u3000]{2,}|[\t\u3000]")


def normalized(text: str | None) -> str | None:
    """P1 for one text: NFKC, line ends to LF, no blanks at line ends, runs of blanks to one, stripped. Idempotent; null stays null."""
    if not text:
        return text
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _BLANK_RUNS.sub(" ", _BLANKS_AT_ENDS.sub("", text)).strip()


#: Texts that Python functions hold as objects at a time: so many at most, of so many bytes together unless one alone is longer.
ROWS, BYTES = 256, 1 << 20


def few(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces, so that what a task's Python holds does not grow with the batches that Spark sends."""
    for batch in batches:
        low, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            n = n or 0
            if i > low and (i - low == ROWS or held + n > BYTES):
                yield batch.slice(low, i - low)
                low, held = i, 0
            held += n
        if low < batch.num_rows:
            yield batch.slice(low)


def normalized_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """P1 for rows (source, text)."""
    for batch in few(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normalized(t) for t in batch.column(1).to_pylist()], pa.string())], names=["source", "text"])


@F.pandas_udf(StringType())
def _normalize(texts: pd.Series) -> pd.Series:
    return texts.map(normalized)


#: P1 as a column function. NFKC has no builtin, so all of it is one Arrow function; it counts as
#: not deterministic so that no rule of the optimizer copies it into each place that uses its result.
normalize = _normalize.asNondeterministic()


def strip(text: Column) -> Column:
    """Without white space at both ends. The look-behind keeps long inner runs linear."""
    return F.regexp_replace(text, rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z", "")


def pieces(text: Column, terminators: str = TERMINATORS) -> Column:
    """A text cut after each terminator; the pieces laid end to end are the text."""
    stop = "".join(f"\\u{ord(c):04x}" for c in terminators)
    return F.regexp_extract_all(text, F.lit(f"[^{stop}]*[{stop}]|[^{stop}]+"), F.lit(0))


def sentences(text: Column, terminators: str = TERMINATORS) -> Column:
    """Stripped pieces without the empty ones."""
    return F.filter(F.transform(pieces(text, terminators), strip), lambda s: s != "")


def chunk_id(source: Column, start: Column, end: Column, text: Column) -> Column:
    """Twelve hex digits from source, offsets and the hash of the text."""
    return F.substring(F.sha2(F.concat_ws("|", source, start.cast("string"), end.cast("string"), F.sha2(text.cast("binary"), 256)).cast("binary"), 256), 1, 12)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.substring(text, start + 1, end - start)


def relative_source(path: Column, base: str) -> Column:
    """SC4: a path below `base` with forward slashes; other paths only get the slashes."""
    clean = F.replace(F.regexp_replace(path, "^file:/*(?=/)", ""), F.lit("\\"), F.lit("/"))
    root = base.replace("\\", "/").removeprefix("file://").rstrip("/") + "/"
    return F.when(clean.startswith(root), F.substring(clean, F.lit(len(root) + 1), F.length(clean))).otherwise(clean)


@F.pandas_udf(StringType())
def _cut_bytes(names: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([n.encode()[:k].decode(errors="ignore") for n, k in zip(names, sizes, strict=True)], dtype=object)


def entity_filename(label: Column, name: Column) -> Column:
    """LABEL__name_hash.md, safe on common file systems and distinct for distinct entities; raises on a leading dot."""
    unsafe = rf'[/\\:*?"<>|{SPACE}]'
    safe = F.regexp_replace(name, unsafe, "_")
    safe = F.when(F.upper(safe).isin(*RESERVED), F.concat(safe, F.lit("_"))).otherwise(safe)
    stem = F.concat(safe, F.lit("_"), F.substring(F.sha2(F.concat(label, F.lit("\0"), name).cast("binary"), 256), 1, 6))
    base = F.concat(F.regexp_replace(label, unsafe, "_"), F.lit("__"), stem)
    mark = F.concat(F.lit("_"), F.substring(F.sha2(base.cast("binary"), 256), 1, 6))
    fit = F.when(F.octet_length(base) > NAME_BYTES, F.concat(_cut_bytes(base, F.lit(NAME_BYTES) - F.octet_length(mark)), mark)).otherwise(base)
    return F.when(stem.startswith("."), F.raise_error(F.concat(F.lit("no safe file name for entity "), name))).otherwise(F.concat(fit, F.lit(".md")))


def fence(body: Column) -> Column:
    """Lines of three dashes alone get a backslash, so that they close no front matter."""
    return F.regexp_replace(body, "(?md)^---$", r"\\---")


def excerpt(text: Column, chars: int = 80) -> Column:
    """The first characters on one line."""
    return F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" "))


def count_of(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def single_sentence(text: Column, terminator: str = "。") -> Column:
    """At most one terminator."""
    return count_of(text, terminator) <= 1


def major_minor(version: Column) -> Column:
    """P21."""
    return F.substring_index(version, ".", 2)


def finish_reason(reason: Column) -> Column:
    """The reasons of different back ends as one vocabulary."""
    return F.when(reason.isin("stop", "stop_sequence"), "stop").when(reason == "length", "max_tokens").when(F.coalesce(reason, F.lit("")) == "", "end_turn").otherwise(reason)


def positive_int(value) -> int:
    """P23."""
    number = int(value)
    if number < 1:
        raise ValueError(f"not a positive integer: {value!r}")
    return number
