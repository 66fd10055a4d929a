import random

import pytest

from parallaxa.llm.bpe import TOKENIZER_DIR, encode_corpus, load_ranks, merge_piece, text_encoder, token_count

TEXTS = [
    None,
    "",
    " ",
    "a",
    "\n\n  \t x",
    "It's 12345 o'clock!!  and we'll go…",
    "naïve façade — 日本語のテキスト 🙂👨‍👩 <|endoftext|> \u0000 ­",
    "a" * 5000,
    "ab" * 3000 + " " * 700 + "!?" * 900,
    "x1y2" * 50 + "Ünïcödé" * 40,
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_public_library(reference):
    encode = text_encoder(*load_ranks())
    rnd = random.Random(5)
    odd = ["".join(rnd.choice("ab  cdeé日x.,'s19\n") for _ in range(rnd.randrange(200))) for _ in range(300)]
    for text in TEXTS + odd:
        assert encode(text) == (reference(text) if text else [])


def test_merges_take_the_leftmost_lowest_rank():
    ranks = {b"a": 0, b"b": 1, b"ab": 5, b"ba": 4, b"aba": 6}
    assert merge_piece(b"abab", ranks) == [6, 1]
    assert merge_piece(b"aaaa", {b"a": 0, b"aa": 1, b"aaa": 2}) == [1, 1]
    assert merge_piece(b"ababa", ranks) == [6, 4]


def test_encode_corpus(spark, reference):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(1, "twice", "kept")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode_corpus(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == (reference(r.text) if r.text else [])
    counts = df.select("text", token_count(df).alias("n")).collect()
    assert all(r.n == (len(reference(r.text)) if r.text else 0) for r in counts)
    assert encode_corpus(df.limit(0)).count() == 0
