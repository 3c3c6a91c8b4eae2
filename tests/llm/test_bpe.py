"""Tokens against the library that the vocabulary files are for."""

import random

import numpy as np
import pytest

from corkscan.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def odd_texts():
    rng = random.Random(4)
    texts = ["", " ", "Hello WORLD it's we'll 123 ½ ² Ⅷ <|endoftext|> x<|startoftext|>", "İstanbul ΣΑΣ ﬁ \x85 é é", "</w> a</w>b \t\n",
             "日本語 テキスト 😀😀 a‍b", "don't!!!??? ### $$$", "aaaa aaaaaaaaaaaaaaaaaaaaaaaa ababababab", "<|ENDOFTEXT|> <|endoftext|", "'S 'T o'Re",
             "z" * 5000, "!?" * 3000]
    texts += ["".join(rng.choice("abcdefgh'<>/w éßñ中😀1!? ") for _ in range(60)) for _ in range(300)]
    return texts


def test_tokens_and_decoded_texts_equal_the_library(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(n, text, "clash") for n, text in enumerate(texts)] + [(-1, None, "clash")], "doc_id BIGINT, text STRING, ids STRING")
    encoded = bpe.encode(docs, decoded_col="decoded")
    rows = {r.doc_id: r for r in bpe.decode(encoded, out_col="again").collect()}
    for n, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert rows[n].ids == ids, text
        assert rows[n].decoded == rows[n].again == library.decode(ids, skip_special_tokens=False)
    assert rows[-1].ids == [] and rows[-1].decoded == ""


def test_packed_tokens(spark, library):
    docs = spark.createDataFrame([(1, "pack these words")], "doc_id BIGINT, text STRING")
    packed = bpe.encode(docs, packed=True)
    ids = np.frombuffer(bytes(packed.first().ids), dtype="<u4").tolist()
    assert ids == library.encode("pack these words", add_special_tokens=False).ids
    assert bpe.decode(packed).first().decoded == library.decode(ids, skip_special_tokens=False)


def test_most_new_words_need_no_merging_in_plain_prose():
    vocabulary = bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read())
    words = "the quick brown fox jumps over the lazy dog and then some other words follow in this sentence".split()
    _, counts, merged = vocabulary.tokens_of(words)
    assert len(counts) == len(words) and merged < len(words) / 2


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id BIGINT, text STRING"))).count() == 0
