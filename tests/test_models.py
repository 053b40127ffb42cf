"""Clients over HTTP with scripted servers, and the model-backed analyzer with a scripted model."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import analysis, clients, models, summaries


def served(script):
    """A server that gives the scripted (status, body) answers in turn; (url, requests)."""
    seen, waiting = [], list(script)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, dict(self.headers), json.loads(self.rfile.read(int(self.headers["content-length"])))))
            status, body = waiting.pop(0)
            data = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}", seen


def test_hosted_client(monkeypatch):
    monkeypatch.setenv("ANTHROPIC_API_KEY", "k")
    good = {"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 3, "output_tokens": 2}, "stop_reason": "end_turn", "model": "m1"}
    url, seen = served([(200, good), (429, "slow"), (503, "down"), (401, "who"), (404, "no model"), (400, "bad"), (200, "not json"), (200, {})])
    model = summaries.client("anthropic", model="m", url=url)
    assert model.model_id == "m" and model.generate("p", 7) == summaries.Answer("ab", 3, 2, "m1", "end_turn")
    path, headers, sent = seen[0]
    assert sent["max_tokens"] == 7 and sent["messages"] == [{"role": "user", "content": "p"}] and {k.lower(): v for k, v in headers.items()}["x-api-key"] == "k"
    for kind in (summaries.Retryable, summaries.Retryable, summaries.Permanent, summaries.Permanent, summaries.Permanent, summaries.Retryable):
        with pytest.raises(kind):
            model.generate("p", 7)
    assert model.generate("p", 7).finish_reason == "unknown"
    with pytest.raises(summaries.Retryable):
        clients.Messages(url="http://127.0.0.1:9/x", timeout=1).generate("p", 1)
    monkeypatch.delenv("ANTHROPIC_API_KEY")
    with pytest.raises(summaries.Permanent):
        model.generate("p", 7)


def test_local_client():
    url, seen = served([(200, {"details": {"digest": "d1"}}), (200, {"modelfile": "FROM x"}), (500, "x"), (200, {"response": "hi", "prompt_eval_count": 4, "eval_count": 1, "done_reason": "length"}), (400, "does not support thinking, think"), (200, {"response": "ok", "done_reason": ""}), (404, "model not found, try pull"), (500, "request timed out"), (418, "odd")])
    model = summaries.client("ollama", model="q", host=url)
    assert model.model_id == "q@d1" and model.model_id.startswith("q@") and len(model.model_id) == 9
    a = model.generate("p", 5)
    assert (a.text, a.input_tokens, a.output_tokens, a.finish_reason) == ("hi", 4, 1, "max_tokens")
    assert seen[3][2]["think"] is False and seen[3][2]["options"] == {"num_predict": 5} and seen[3][2]["stream"] is False
    assert model.generate("p", 5).finish_reason == "end_turn" and "think" not in seen[5][2]
    for kind in (summaries.Permanent, summaries.Retryable, summaries.Retryable):
        with pytest.raises(kind):
            model.generate("p", 5)


def test_back_ends():
    assert summaries.parallelism_of("anthropic", None) == 5 and summaries.parallelism_of("ollama", None) == 3 and summaries.parallelism_of("offline", None) == 1 and summaries.parallelism_of("ollama", 9) == 9
    for name in ("openai", "none"):
        with pytest.raises(summaries.Permanent):
            summaries.client(name)


class Scripted:
    """A model: words by blanks, sentences by full stops, capitals are persons."""

    meta = {"name": "scripted", "version": "1"}
    pipe_names = ["ner"]

    def __call__(self, text):
        words, at = [], 0
        for w in text.split(" "):
            words.append(SimpleNamespace(text=w, lemma_=w.lower(), pos_="NOUN" if len(w) > 2 else "ADP", start=at))
            at += len(w) + 1
        ents = [SimpleNamespace(text=w.text, label_="Person", start_char=w.start, end_char=w.start + len(w.text)) for w in words if w.text[:1].isupper()]

        class Doc(list):
            sents = [SimpleNamespace(text=s) for s in text.split(".")]

        doc = Doc(words)
        doc.ents = ents
        return doc


def load_scripted(name, device):
    return Scripted()


def test_model_analyzer(spark):
    a = models.ModelAnalyzer("m", stopwords=("and",), loader=load_scripted)
    df = spark.createDataFrame([(0, "Ann and Bob of old. They met"), (1, None), (2, "")], "i int, text string")
    t = F.col("text")
    got = {r["i"]: r for r in df.select("i", a.tokens(t).alias("tokens"), a.mentions(t).alias("mentions"), a.sentences(t).alias("sentences")).collect()}
    assert got[0]["tokens"] == ["ann", "bob", "old.", "they", "met"] and got[0]["sentences"] == ["Ann and Bob of old", "They met"]
    assert [(m["name"], m["ner_label"], m["char_start"], m["char_end"]) for m in got[0]["mentions"]] == [("Ann", "PERSON", 0, 3), ("Bob", "PERSON", 8, 11), ("They", "PERSON", 20, 24)]
    assert got[1]["tokens"] == [] == got[2]["mentions"]
    long = "Ann is. " * 9000
    offsets = [m["char_start"] for m in models.analyze(Scripted(), long, frozenset(), models.CLASSES)["mentions"]]
    assert len(offsets) == 9000 and all(long[o : o + 3] == "Ann" for o in offsets)
    assert a.settings["checksum"].startswith("meta:") and a.settings["dictionary"] == "sudachidict_core-not-available" and a.version == "m@unknown"
    assert analysis.restore({"kind": "model", "model": "m", "stopwords": ["x"]}) == models.ModelAnalyzer("m", stopwords=("x",))
    assert analysis.restore(analysis.RuleAnalyzer(word="x").settings) == analysis.RuleAnalyzer(word="x")
    with pytest.raises(RuntimeError, match="spaCy"):
        models.load("ja_ginza", "cpu")


def test_rule_mentions_have_exact_offsets(spark):
    text = "Ärger mit Quixotische 日本 😀 Abcdefghi\nXyzw, Ab Abcdefghijklmnop"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(analysis.RuleAnalyzer().mentions(F.col("t")).alias("m")).collect()
    assert [(m["name"], m["ner_label"]) for m in rows[0]["m"]] == [("Ärger", "PERSON"), ("Quixotische", "PRODUCT"), ("Abcdefghi", "LOC"), ("Xyzw", "PERSON"), ("Abcdefghijklmnop", "OTHER")]
    assert all(text[m["char_start"] : m["char_end"]] == m["name"] for m in rows[0]["m"]) and rows[1]["m"] == rows[2]["m"] == []
