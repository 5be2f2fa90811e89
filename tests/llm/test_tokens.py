import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vectide.llm import tokens as T

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(4)
    parts = ["hello", " world", "\n\n", "   ", "\t", "'s", "don't", "<|endoftext|>", "é", "日本語", "🙂", "123", "!!!", "a" * 90, " \n ", "##", "<|endof", "text|>"]
    return ["".join(r.choice(parts) for _ in range(n)) for n in (0, 1, 5, 50, 400, 3000)] + [" " * 5000, "x" * 5000, "a b " * 2000, "!" * 999 + "x" * 999 + " " * 999]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (200, 70), (1000, 256)])
def test_spliced_counts(own, chunk, overlap):
    for t in texts():
        whole = len(own.encode(t, add_special_tokens=False).ids)
        assert T.count_long(lambda x: own.encode(x, add_special_tokens=False), t, chunk, overlap) == whole


def test_counts(spark, own):
    rows = [(i, t, 7, "n") for i, t in enumerate(texts())] + [(None, "null id", 0, ""), (90, None, 0, None), (1, texts()[3], 0, ""), (1, texts()[3], 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted(map(tuple, T.token_counts(df, PATH, chunk=300, overlap=64).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(df, P.path(name), chunk=500).collect()}
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(p.encode(t))
    else:
        own = Tokenizer.from_file(P.path(name))
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    assert got == {i: count(t) for i, t in enumerate(texts())}


def test_empty_table(spark):
    out = T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0
