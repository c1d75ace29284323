import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from guestlens.llm.bpe import decode_documents, encode_documents, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return tokenizer(PATH), Library.from_file(PATH)


def agree(both, texts):
    mine, theirs = both
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        ids = mine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text[:200])
        assert mine.decode(ids).decode() == theirs.decode(want.ids, skip_special_tokens=False)


def test_plain_and_odd_texts(both):
    agree(both, [
        "", " ", "Hello, World!  It's 2024, isn't it?", "I'LL we're THEY'VE 'S", "<|endoftext|>a<|startoftext|> <|endoftext|",
        "straße ÀÉÎ é Å ﬁ Σίσυφος ΟΔΟΣ İstanbul ½ ² Ⅷ ٣ 你好世界 🤗🤗 à́", "\x00\x1c\x1f\x85\xa0 x　y​",
        "</w> a</w>b", "x" * 5000, "ab" * 3000, "é" * 999, "...!!!???---", "tab\tnew\nline\r\n",
    ])


def test_random_texts(both):
    rng = random.Random(5)
    pools = ["abcdefghij '", "etaoinshrdlu", "aàâäæçéèêëîïôœùûüÿß ", "0123456789.,-", "".join(map(chr, range(32, 0x250))), "あいう漢字 한국어 кириллица ΑΒΓ"]
    agree(both, ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for pool in pools for _ in range(300)])


def test_all_characters_below_the_surrogates(both):
    agree(both, ["a" + chr(c) + "b" for c in range(1, 0x3000) if chr(c).isprintable() and chr(c).isalnum() and c < 0x530])


def test_every_token_is_its_own_encoding(both):
    merges = both[0].merges
    rng = random.Random(1)
    for t in rng.sample(range(512, len(merges.text)), 3000):
        raw = merges.text[t]
        if ord(raw[-1]) >= 256:
            try:
                word = (raw[:-1] + chr(ord(raw[-1]) - 256)).encode("latin-1").decode()
            except UnicodeDecodeError:
                continue
            assert merges.encode_word(word) == [t]


def test_documents(spark):
    rows = [(1, "The cat.", "x"), (2, None, "y"), (None, "", "z"), (1, "The cat.", "x"), (3, "long " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_documents(docs, PATH)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, len(r.ids), r.decoded[:20]) for r in out.collect()))
    assert got == [(0, 0, ""), (1, 12, "the</w> cat</w> .</w>"[:20]), (1, 12, "the</w> cat</w> .</w>"[:20]), (2, 0, ""), (3, 80_000, "long</w> long</w> lo")]
    back = decode_documents(out.select("doc_id", "ids"), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in back) == sorted((r.doc_id or 0, r.decoded) for r in out.collect())
    assert encode_documents(docs.limit(0), PATH).count() == 0
