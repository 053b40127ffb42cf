"""An analyzer backed by a language model of spaCy's interface (P3, P20, U10-U12), such as those for Japanese.

The model runs inside Arrow functions, one loaded instance for each Python worker. One pass over
a text gives sentences, tokens and entities together; each method takes its part of it.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.metadata
import json
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import MENTIONS, PARTS_OF_SPEECH, SEGMENT_BYTES, STOPWORDS, byte_segments

#: Model packages by the names that the command line knows.
MODELS = {"electra": "ja_ginza_electra", "ginza": "ja_ginza"}
#: Fine entity classes as the labels of interest.
CLASSES = {"Person": "PERSON", "Organization": "ORG", "Company": "ORG", "Corporation_Other": "ORG", "Country": "LOC", "City": "LOC", "Province": "LOC", "Location_Other": "LOC", "GPE": "LOC", "FAC": "LOC", "Product_Other": "PRODUCT", "WORK_OF_ART": "PRODUCT"}

_PASS = f"struct<sentences:array<string>,tokens:array<string>,mentions:{MENTIONS}>"


@lru_cache(maxsize=2)
def load(name: str, device: str):
    """The model, on its device, once for each worker; it must have sentences and entities."""
    try:
        spacy = importlib.import_module("spacy")
    except ImportError as e:
        raise RuntimeError(f"the analyzer {name!r} needs spaCy and the package {name}") from e
    if device != "cpu":
        spacy.require_gpu()
    nlp = spacy.load(name)
    lacking = {"ner"} - set(nlp.pipe_names)
    if lacking:
        raise RuntimeError(f"the model {name!r} has no {', '.join(lacking)}")
    return nlp


def model_checksum(nlp) -> str:
    """P20: of the model's description."""
    return "meta:" + hashlib.sha256(json.dumps(getattr(nlp, "meta", None) or {}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


@lru_cache(maxsize=1)
def dictionary_checksum(package: str = "sudachidict_core") -> str:
    """P20: SHA-256 of the dictionary that the tokenizer reads; read once."""
    try:
        module = importlib.import_module(package)
    except ImportError:
        return f"{package}-not-available"
    path = Path(module.__file__).parent / "resources" / "system.dic"
    if not path.exists():
        return "system.dic-not-found"
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def package_version(name: str) -> str:
    """P20."""
    try:
        return importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


def analyze(nlp, text: str, stopwords: frozenset, classes: dict) -> dict:
    """Sentences, lemmas that carry meaning, and entities of a text, segment by segment, with offsets in the whole."""
    out = {"sentences": [], "tokens": [], "mentions": []}
    for offset, segment in byte_segments(text, SEGMENT_BYTES):
        doc = nlp(segment)
        out["sentences"] += [s for x in doc.sents if (s := x.text.strip())]
        out["tokens"] += [w for t in doc if t.pos_ in PARTS_OF_SPEECH and (w := t.lemma_.strip()) and w not in stopwords]
        out["mentions"] += [{"name": e.text, "ner_label": classes.get(e.label_, e.label_), "char_start": offset + e.start_char, "char_end": offset + e.end_char} for e in doc.ents]
    return out


@dataclass(frozen=True)
class ModelAnalyzer:
    """An analyzer whose tokens, mentions and sentences come from a model."""

    model: str = MODELS["electra"]
    device: str = "cpu"
    stopwords: tuple[str, ...] = STOPWORDS
    loader: object = field(default=load, compare=False)

    @property
    def settings(self) -> dict:
        nlp = self.loader(self.model, self.device)
        return {"kind": "model", "model": self.model, "stopwords": list(self.stopwords), "checksum": model_checksum(nlp), "dictionary": dictionary_checksum(), "classes": CLASSES}

    @property
    def versions(self) -> dict:
        return {x: package_version(x) for x in ("spacy", "ginza", "sudachipy", self.model.replace("_", "-"))}

    @property
    def version(self) -> str:
        return f"{self.model}@{package_version(self.model.replace('_', '-'))}"

    def analyze(self, text: Column) -> Column:
        """All three in one pass, a struct; the optimizer may not copy it."""
        model, device, loader, stop = self.model, self.device, self.loader, frozenset(self.stopwords)

        @F.pandas_udf(_PASS)
        def run(texts: pd.Series) -> pd.DataFrame:
            nlp = loader(model, device)
            return pd.DataFrame([analyze(nlp, t or "", stop, CLASSES) for t in texts], columns=["sentences", "tokens", "mentions"])

        return run.asNondeterministic()(text)

    def sentences(self, text: Column) -> Column:
        """P3."""
        return self.analyze(text)["sentences"]

    def tokens(self, text: Column) -> Column:
        return self.analyze(text)["tokens"]

    def mentions(self, text: Column) -> Column:
        return self.analyze(text)["mentions"]
