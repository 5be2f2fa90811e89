import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import tokenout as T

PATH, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_slots_are_a_permutation(n, key):
    s = T.slots(np.arange(n), n, key)
    assert sorted(s.tolist()) == list(range(n))


def test_slots_depend_on_the_key_and_scatter():
    a, b = T.slots(np.arange(1000), 1000, 1), T.slots(np.arange(1000), 1000, 2)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


ROWS = [(i, " ".join(f"word{(i * j) % 97}" for j in range(i * 3 % 200)), "x") for i in range(60)] + [(60, None, None), (61, "", ""), (None, "no id", ""), (5, "twice", ""), (5, "twice", ""), (62, "long " * 5000, "")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('shards')}/s"
    df = spark.createDataFrame(ROWS, "doc_id long, text string, slot string").repartition(3)
    pieces = T.materialise(df, out, PATH, PATTERN, seq_tokens=64, shard_seqs=16)
    return out, pieces.collect()


def test_shards_read_back(written):
    out, pieces = written
    enc, end = T.encoder(PATH, PATTERN)
    n_seqs = max(p.seq for p in pieces) + 1
    shards = sorted({p.shard for p in pieces})
    assert shards == list(range(-(-n_seqs // 16)))
    slots = {}
    for s in shards:
        for i, seq in enumerate(T.read_sequences(out, s, seq_tokens=64)):
            assert len(seq) == 64
            slots[s * 16 + i] = seq
    assert sorted(slots) == list(range(n_seqs))
    assert sum(p.n_tokens for p in pieces) == sum(len(enc.encode_ordinary(t or "")) + 1 for _, t, _ in ROWS)
    order = T.slots(np.arange(n_seqs), n_seqs)
    stream = np.concatenate([slots[s] for s in order])
    texts = sorted(enc.decode(x.tolist()) for x in np.split(stream, np.flatnonzero(stream == end) + 1) for x in [x[x != end]] if True)
    assert [t for t in texts if t] == sorted(t for _, t, _ in ROWS if t)
    for p in pieces:
        ids = slots[p.slot][p["at"] : p["at"] + p.n_tokens]
        assert zlib.crc32(ids.tobytes()) == p.crc32 and p.offset == (p.slot % 16) * 128 + p["at"] * 2 and order[p.seq] == p.slot


def test_reading_resumes_at_any_slot(written):
    out, _ = written
    every = list(T.read_sequences(out, 1, seq_tokens=64))
    assert all(np.array_equal(a, b) for a, b in zip(T.read_sequences(out, 1, 5, 64), every[5:], strict=True))


def test_empty_table(spark, tmp_path):
    assert T.materialise(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/s", PATH, PATTERN).count() == 0


@pytest.mark.parametrize("window", [1, 7, 16, 1000])
def test_windows_are_permuted_in_themselves(window):
    index = np.arange(100)
    got = T.windowed_slots(index, 100, window)
    assert sorted(got.tolist()) == index.tolist() and np.array_equal(got // window, index // window)
    assert np.array_equal(T.windowed_slots(index, 100, None), T.slots(index, 100))


def test_order_of_files_is_kept_by_windows(spark, tmp_path):
    """Whatever order the scan takes the files in, the stream follows their names, and shards follow the stream."""
    rows = [(i, f"word{i} " * (5 + 400 * (i % 40 == 7))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = T.materialise(docs, f"{tmp_path}/out", PATH, PATTERN, seq_tokens=64, shard_seqs=16, window=16).collect()
    by_seq = sorted(got, key=lambda r: (r.seq, r["at"]))
    assert [i for k, i in enumerate(r.doc_id for r in by_seq) if not k or by_seq[k - 1].doc_id != i] == list(range(200))
    assert all(r.slot // 16 == r.seq // 16 == r.shard for r in got)
