"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are resynchronised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .pieces import Pieces

#: Texts above this many characters are cut; also the characters of a chunk without its overlap.
CHUNK_CHARS = 32768
#: Characters that neighbouring chunks share at first; doubled as long as they do not align.
OVERLAP = 512
#: Characters before the end of a chunk in which no boundary counts as stable: the pre-tokenizer looks two characters
#: ahead, and an added token (at most this long) may be cut there.
MARGIN = 64


def starts(encoding) -> dict[int, int]:
    """Offset of the first character of each pre-token -> tokens before it."""
    found, last = {}, object()
    for i, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last or word is None:
            found.setdefault(a, i)
        last = word
    return found


def count_long(encode: Callable, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> int:
    """Tokens of a text by chunks spliced at stable boundaries.

    A pre-token start is a place where the left-to-right scan of the pre-tokenizer keeps no state. If the left chunk,
    whose scan is the true one, and the right chunk both start a pre-token at a character, then from there on the
    right chunk's tokens are those of the whole text. Where the overlap holds no such place the right chunk begins
    earlier and the left one ends later (up to the whole text), so the count is always that of the whole text.
    """
    n, at, tokens = len(text), 0, 0  # the text before `at` is counted; `at` is a true pre-token start
    while True:
        wide = overlap
        while True:
            end = min(n, at + chunk + wide)
            left = encode(text[at:end])
            if end == n:
                return tokens + len(left.ids)
            sure = {at + a: k for a, k in starts(left).items() if 0 < a < end - at - MARGIN}
            back = max(at + 1, end - wide)
            right = starts(encode(text[back : min(n, end + MARGIN)]))
            both = [p for p in sure if p > back and p - back in right]
            if both:
                p = max(both)
                tokens += sure[p]
                at = p
                break
            wide *= 2


def independent(own) -> bool:
    """Whether a Tokenizer encodes the pieces of pieces.cut() independently: plain byte-level BPE, and no added token
    that holds white space or depends on what stands beside it."""
    import json

    pre = json.loads(own.to_str())["pre_tokenizer"] or {}
    added = own.get_added_tokens_decoder().values()
    plain = not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)
    return own.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and plain


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer_path`` is a .json file of the tokenizers library or a .model file of sentencepiece, present on every
    executor. Nothing is added or truncated; special strings in a text count as the library's default has them. A
    null text is empty (0, 0, false). Null ids and repeated rows are counted like any other; other columns are ignored; an empty table
    gives no rows. A task holds one batch of texts, one chunk's encoding and a bounded number of pieces: where the
    tokenizer encodes pieces of a text independently (see pieces.cut), each different piece is encoded once.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches):
        import os

        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            many = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
            long = lambda text: many([text])[0]  # noqa: E731  a piece model has no scan state to resynchronise on
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(tokenizer_path)
            own.no_truncation()
            own.no_padding()
            many = lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
            whole = own.normalizer is not None or "ByteLevel" not in str(own.pre_tokenizer)
            one = lambda text: own.encode(text, add_special_tokens=False)
            each = many
            long = (lambda text: each([text])[0]) if whole else (lambda text: count_long(one, text, chunk, overlap))
            if independent(own):
                pieces = Pieces(each)
                many = lambda texts: [sum(x) for x in pieces(texts)]
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for i in range(0, len(short), 64):
                for j, k in zip(short[i : i + 64], many([texts[j] for j in short[i : i + 64]]), strict=True):
                    n[j] = k
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = long(t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(b.column(1)), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return texts.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
