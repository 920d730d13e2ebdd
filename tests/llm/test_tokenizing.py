import random

import pytest
from tokenizers import Tokenizer

from cairn.llm import tokenizing as tk

VOCABULARY = f"{tk.VOCABULARIES}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_joins_equal_the_whole_encoding(tokenizer):
    rng = random.Random(7)
    bits = ["a", " ", "  ", "\n", "'", "ll", "'re", "1", "日本", "　", "é", "😀", "<|endoftext|>", ".", "word", " the", "\x1c", "​", "\r\n", "́"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(2, 160)))
        leaf = rng.randint(1, 17)
        got = next(tk.encode_texts(tokenizer, [text], leaf))
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, (text, leaf)


def test_one_endless_word_and_long_runs_of_space(tokenizer):
    for text in ("x" * 5000, " " * 5000 + "a", "ab" * 3000 + " " * 3000, "'" * 999):
        assert next(tk.encode_texts(tokenizer, [text], 256)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_corpus(spark, tokenizer):
    rows = [(1, "Hello  world", "x"), (2, "", "x"), (3, None, "x"), (None, "a'll <|endoftext|>", None), (1, "Hello  world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in tk.encode_corpus(df, "doc_id", "text").collect())
    enc = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    assert got == sorted([(1, enc("Hello  world"))] * 2 + [(2, []), (3, []), (0, enc("a'll <|endoftext|>"))])
    assert tk.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    back = tk.decode_corpus(tk.encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert sorted(r["text"] for r in back) == sorted((r[1] or "") for r in rows)


def test_every_text_takes_the_tree(tokenizer):
    text = "Il était une fois, 12 petits ponts ; l'eau coulait. " * 30
    assert len(tk.halves(text, tk.LEAF)) == 8 and "".join(tk.halves(text, tk.LEAF)) == text
    assert next(tk.encode_texts(tokenizer, [text])) == tokenizer.encode(text, add_special_tokens=False).ids
    tokens = tk._token_bytes(VOCABULARY)
    assert tk.decode_tree(tokens, tokenizer.encode(text, add_special_tokens=False).ids).decode() == text


def test_other_split_patterns_are_encoded_whole(spark):
    other = f"{tk.VOCABULARIES}/word_bpe_49k.json"
    assert tk.splits_stably(VOCABULARY) and not tk.splits_stably(other)
    text = "Café AU lait  " * 200
    got = tk.encode_corpus(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text", other).collect()[0]["ids"]
    assert got == tk.load(other).encode(text, add_special_tokens=False).ids
