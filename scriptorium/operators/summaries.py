"""Summaries by an external model."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from .manifest import ABORT_LEAST, ABORT_SHARE

ATTEMPTS = 3


class ModelError(Exception):
    """U13."""


class Retryable(ModelError):
    """Rate limits, time-outs, connections, errors of the server."""


class Permanent(ModelError):
    """Credentials, unknown models, malformed requests."""


class PreflightFailed(Permanent):
    """The first call did not give an answer to build on."""


@dataclass(frozen=True)
class Answer:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    model_id: str = ""
    finish_reason: str = "end_turn"


class Client(Protocol):
    """What a back end offers. It is pickled to the executors."""

    model_id: str

    def generate(self, prompt: str, max_tokens: int) -> Answer: ...


@dataclass(frozen=True)
class FirstLines:
    """The offline default: the first lines of the prompt's material, deterministic."""

    lines: int = 2
    model_id: str = "first-lines@1"

    def generate(self, prompt: str, max_tokens: int) -> Answer:
        told = [x[2:] for x in prompt.splitlines() if x.startswith("- ")][: self.lines]
        text = "\n".join(told)[: max_tokens * 4] or "ok"
        return Answer(text, len(prompt) // 4, max(1, len(text) // 4), self.model_id)


class NoClient:
    """For runs without summaries."""

    model_id = ""

    def generate(self, prompt: str, max_tokens: int) -> Answer:
        raise AssertionError("summaries are switched off")


def _unsupported(name: str) -> Callable[..., Client]:
    def make(**_):
        raise Permanent(f"the back end {name!r} needs its own plug-in: register one in BACKENDS")

    return make


def client(backend: str, **options) -> Client:
    """A client by the name of its back end."""
    from . import clients

    makers: dict[str, Callable[..., Client]] = {"offline": FirstLines, "anthropic": clients.Messages, "ollama": clients.Local, "openai": _unsupported("openai"), **BACKENDS}
    if backend not in makers:
        raise Permanent(f"unknown back end {backend!r}")
    return makers[backend](**options)


#: More makers by name, or others in the place of those above.
BACKENDS: dict[str, Callable[..., Client]] = {}
#: U8: calls at a time where none are asked for.
PARALLELISM = {"anthropic": 5, "ollama": 3}


def parallelism_of(backend: str, asked: int | None) -> int:
    return asked if asked else PARALLELISM.get(backend, 1)


def classify_status(status: int | None) -> type[ModelError]:
    """No status (time-out, connection), 408, 429 and 5xx may be tried again."""
    return Retryable if status is None or status in (408, 429) or status >= 500 else Permanent


def preflight(model: Client, prompt: str = "Answer with one word: ok", max_tokens: int = 16) -> Answer:
    """U7, F11."""
    try:
        answer = model.generate(prompt, max_tokens)
    except ModelError as e:
        raise PreflightFailed(str(e)) from e
    if not answer.text.strip() or answer.output_tokens <= 0 or answer.finish_reason not in ("end_turn", "stop"):
        raise PreflightFailed(f"no usable answer: {answer.finish_reason}")
    return answer


def with_retries(model: Client, prompt: str, max_tokens: int, *, sleep=time.sleep, rng: random.Random | None = None) -> Answer | None:
    """Three attempts on retryable errors with 2, 4, ... and at most 30 seconds (and up to one more) between, one on permanent ones; None without an answer."""
    rng = rng or random.Random(42)
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return model.generate(prompt, max_tokens)
        except Permanent:
            return None
        except Retryable:
            if attempt < ATTEMPTS:
                sleep(min(2**attempt, 30) + rng.random())
    return None


_RESULT = "name string, ner_label string, ok boolean, text string, input_tokens long, output_tokens long, finish_reason string"


#: Completions between two checkpoints.
CHECKPOINT = 5


def summarize(tasks: DataFrame, model: Client, *, max_tokens: int = 400, parallelism: int = 1, on_checkpoint: Callable[[list], None] | None = None, on_wave: Callable[[int], None] | None = None, sleep=time.sleep) -> tuple[list, bool]:
    """Answers for tasks (name, ner_label, prompt) in their order: (rows, aborted).

    Calls run on executors in waves of `parallelism`, one task a call; prompts come to the
    driver a wave at a time. After each wave the driver sees whether at least five calls were
    made and more than half failed; `on_checkpoint` gets all rows so far after every five
    completions, `on_wave` the number of new ones.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a = with_retries(model, r.prompt, max_tokens, sleep=sleep)
                good = a is not None and bool(a.text.strip())
                out.append((r.name, r.ner_label, good, a.text if good else "", a.input_tokens if a else 0, a.output_tokens if a else 0, a.finish_reason if a else ""))
            yield pd.DataFrame(out, columns=["name", "ner_label", "ok", "text", "input_tokens", "output_tokens", "finish_reason"])

    spark, waiting, done = tasks.sparkSession, tasks.select("name", "ner_label", "prompt").toLocalIterator(), []
    while wave := list(islice(waiting, parallelism)):
        rows = spark.createDataFrame(wave, "name string, ner_label string, prompt string").repartition(len(wave)).mapInPandas(call, _RESULT).collect()
        place = {(r["name"], r["ner_label"]): i for i, r in enumerate(wave)}
        before, done = len(done), done + sorted(rows, key=lambda r: place[r["name"], r["ner_label"]])
        if on_wave:
            on_wave(len(rows))
        if on_checkpoint and len(done) // CHECKPOINT > before // CHECKPOINT:
            on_checkpoint(done)
        if len(done) >= ABORT_LEAST and sum(not r["ok"] for r in done) > ABORT_SHARE * len(done):
            return done, True
    return done, False
