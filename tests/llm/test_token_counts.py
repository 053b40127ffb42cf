import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import token_counts as tc

from .helpers import empty, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = tc.Counter(PATH)


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_equals_the_library(text):
    assert OWN(text) == expected(text)


@pytest.mark.parametrize("text", ["", " ", "it's they'LL we'd", "<|endoftext|>a<|startoftext|><|endoftext|", "ΑΣΣ ΣΑΣ", "İstanbul ſ K", "ée", "a" * 3000, "12 345 x²", "###***$$$ a&&&b"])
def test_hard_texts(text):
    assert OWN(text) == expected(text)


def test_pieces_of_long_texts(monkeypatch):
    text = "The and attion to thanedble 17, anea.\n" * 400
    monkeypatch.setattr(tc, "PIECE", 97)
    assert OWN(text) == expected(text)


def test_table(spark):
    rows = tc.count_tokens(odd_documents(spark), vocabulary=PATH).collect()
    texts = odd_documents(spark).collect()
    assert sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == sorted((t["doc_id"] or 0, len((t["text"] or "").encode()), expected(t["text"] or ""), expected(t["text"] or "") > 2048) for t in texts)


def test_empty_table(spark):
    out = tc.count_tokens(empty(spark), vocabulary=PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


def test_every_letter_of_later_versions():
    """Where the tables of Python, of the `regex` module and of the library differ, the library decides."""
    ends = [c for a, b in tc.NEWER_LETTERS for c in (a - 1, a, b, b + 1)] + list(tc.LOWER)
    for c in ends:
        text = f"quickly{chr(c)} quickly{chr(c)}quickly {chr(c)}1"
        assert OWN(text) == expected(text), hex(c)


def test_pieces_of_every_code_point():
    """Beside a letter and beside a sign, each code point is split off, or not, as the library's own splitter does."""
    splitter, wrong = LIBRARY.pre_tokenizer, []
    for c in (i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and not chr(i).isspace()):
        for before in "a!":
            if len(splitter.pre_tokenize_str(before + chr(c))) != len(OWN.wide.findall(before + chr(c))):
                wrong.append(hex(c))
    assert not wrong


def test_letters_beside_letters_of_other_scripts():
    """Letters of late versions with letters of other scripts on either side: where a split is missed, merges run over it."""
    late = [c for a, b in tc.NEWER_LETTERS for c in {a, (a + b) // 2, b}]
    for c in late:
        for other in "aé\u0416日\uBD62\u0915\U00020000":
            for text in (chr(c) + other, other + chr(c), other + chr(c) + other):
                assert OWN(text) == expected(text), (hex(c), other)
