from scriptorium.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, own string, turns int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "o", 3) for r in rows], SCHEMA)


def test_every_perspective(spark):
    rows = chat.rotate(table(spark, [(1, 0, "system", "Be brief."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo"), (1, 3, "ann", "Bye")])).collect()
    by = {r["assistant"]: r for r in rows}
    assert by["ann"]["text"] == "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nYo<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    assert [by["ann"]["text"][m["start"] : m["end"]] for m in by["ann"]["masks"]] == ["Hi<|im_end|>", "Bye<|im_end|>"]
    assert [by["bob"]["text"][m["start"] : m["end"]] for m in by["bob"]["masks"]] == ["Yo<|im_end|>"]


def test_parts_lay_end_to_end(spark):
    turns = [(7, i, "ab"[i % 2], f"t{i} 😀") for i in range(25)]
    whole = {r["assistant"]: r["text"] for r in chat.rotate(table(spark, turns)).collect()}
    parts = sorted(chat.rotate(table(spark, turns), part=10).collect(), key=lambda r: (r["assistant"], r["part"]))
    for who in "ab":
        own = [r for r in parts if r["assistant"] == who]
        assert "".join(r["text"] for r in own) == whole[who] and len(own) == 3
        at = 0
        for r in own:
            assert r["char_start"] == at
            at += len(r["text"])


def test_odd_rows(spark):
    rows = chat.rotate(table(spark, [(1, 0, None, None), (1, 0, None, None), (None, None, "a", "<|im_end|>x"), (2, 0, "system", "alone")])).collect()
    by = {(r["conv_id"], r["assistant"]): r for r in rows}
    assert set(by) == {(1, "unknown"), (None, "a")}
    assert by[1, "unknown"]["n_turns"] == 2
    assert by[None, "a"]["text"].count("<|im_end|>") == 1
    assert chat.rotate(table(spark, [])).count() == 0
