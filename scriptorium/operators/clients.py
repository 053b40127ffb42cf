"""Clients of language models over HTTP (U3, U4). They hold plain settings only, so they can go to the executors."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from .summaries import Answer, ModelError, Permanent, Retryable, classify_status

SYSTEM = "Answer from the given text alone, briefly and plainly."


def post(url: str, payload: dict, headers: dict, timeout: float) -> dict:
    """The JSON answer of a JSON request; errors come as Retryable or Permanent."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.loads(response.read())
    except urllib.error.HTTPError as e:
        raise classify_status(e.code)(f"status {e.code}: {e.read()[:200].decode(errors='replace')}") from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Retryable(f"no connection: {e}") from e
    except ValueError as e:
        raise Retryable(f"the answer is not JSON: {e}") from e


@dataclass(frozen=True)
class Messages:
    """A hosted model behind a messages interface. The key is read from the environment where the call is made."""

    model: str = "claude-haiku-4-5"
    system: str = SYSTEM
    url: str = "https://api.anthropic.com/v1/messages"
    timeout: float = 30.0
    key_name: str = "ANTHROPIC_API_KEY"
    send: Callable[..., dict] = field(default=post, compare=False)

    @property
    def model_id(self) -> str:
        return self.model

    def generate(self, prompt: str, max_tokens: int) -> Answer:
        key = os.environ.get(self.key_name)
        if not key:
            raise Permanent(f"{self.key_name} is not set")
        payload = {"model": self.model, "max_tokens": max_tokens, "system": self.system, "messages": [{"role": "user", "content": prompt}]}
        got = self.send(self.url, payload, {"x-api-key": key, "anthropic-version": "2023-06-01"}, self.timeout)
        text = "".join(b.get("text") or "" for b in got.get("content") or [] if b.get("type") == "text")
        usage = got.get("usage") or {}
        return Answer(text, int(usage.get("input_tokens") or 0), int(usage.get("output_tokens") or 0), got.get("model") or "", got.get("stop_reason") or "unknown")


#: Finish reasons of the local interface, as the common vocabulary has them.
_FINISHED = {"stop": "stop", "stop_sequence": "stop", "length": "max_tokens", "": "end_turn"}


@dataclass(frozen=True)
class Local:
    """U4: a model served on a machine of one's own. Its identity is the tag and the digest that the server tells."""

    model: str = "qwen3:8b"
    system: str = SYSTEM
    host: str = "http://127.0.0.1:11434"
    timeout: float = 300.0
    think: bool | None = False
    send: Callable[..., dict] = field(default=post, compare=False)

    @property
    def model_id(self) -> str:
        try:
            told = self.send(f"{self.host}/api/show", {"model": self.model}, {}, self.timeout)
        except ModelError:
            return f"{self.model}@unknown"
        digest = (told.get("details") or {}).get("digest") or told.get("digest")
        if not digest and told.get("modelfile"):
            digest = hashlib.sha256(told["modelfile"].encode()).hexdigest()[:16]
        return f"{self.model}@{digest or 'unknown'}"

    def generate(self, prompt: str, max_tokens: int) -> Answer:
        payload = {"model": self.model, "prompt": f"{self.system}\n\n{prompt}" if self.system else prompt, "options": {"num_predict": max_tokens}, "stream": False}
        try:
            got = self._send(payload)
        except ModelError as e:
            said = str(e).lower()
            if "time" in said and "out" in said:
                raise Retryable(str(e)) from e
            if "not found" in said or "pull" in said:
                raise Permanent(str(e)) from e
            raise Retryable(str(e)) from e
        reason = got.get("done_reason") or ""
        return Answer(got.get("response") or "", int(got.get("prompt_eval_count") or 0), int(got.get("eval_count") or 0), self.model, _FINISHED.get(reason, reason))

    def _send(self, payload: dict) -> dict:
        """With the setting for thinking aloud, and once more without it where the model knows none."""
        url = f"{self.host}/api/generate"
        if self.think is None:
            return self.send(url, payload, {}, self.timeout)
        try:
            return self.send(url, {**payload, "think": self.think}, {}, self.timeout)
        except Permanent as e:
            if "think" not in str(e).lower():
                raise
            return self.send(url, payload, {}, self.timeout)
