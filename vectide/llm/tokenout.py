"""Training-order materialisation: a keyed permutation gives every sequence a slot; shards hold slots in order."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import Scratch, small_batches, table

#: Tokens of a sequence, sequences of a shard file, and the key of the order.
SEQ_TOKENS, SHARD_SEQS, KEY = 2048, 4096, 20260701
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of splitmix type."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The place of each index in a keyed permutation of 0..n-1.

    A balanced Feistel network permutes the smallest even number of bits that holds n. An image outside the range is
    permuted again until it lies inside (cycle-walking), which keeps the map one-to-one.
    """
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int(_mix(np.array([r + 1], np.uint64), key & (2**63 - 1))[0]) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def windowed_slots(index: np.ndarray, n: int, window: int | None, key: int = KEY) -> np.ndarray:
    """As slots(), but each run of ``window`` indexes is permuted in itself, with a key of its own."""
    if not window:
        return slots(index, n, key)
    out = np.empty(len(index), np.int64)
    for w in np.unique(index // window).tolist():
        own, first = np.flatnonzero(index // window == w), w * window
        out[own] = first + slots(index[own] - first, min(window, n - first), int(_mix(np.array([w], np.uint64), key & (2**63 - 1))[0]))
    return out


def encoder(path: str, pattern: str):
    """Encode ordinary text by a .tiktoken file of ranks; the id after the last rank ends a document."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def token_ids(enc, text: str) -> list[int]:
    """Ids of ordinary text; without special tokens no string is special."""
    return enc.encode_ordinary(text)


def _in_files(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns and, of a table read from files, the file and the place in it where a row's split begins."""
    try:
        name = F.concat_ws(":", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
        return docs.select(*columns, name.alias("__run"))
    except AnalysisException:
        return docs.select(*columns, F.lit("").alias("__run"))


def _runs(batch) -> Iterator[tuple]:
    """(split, rows) of a batch, in order."""
    import pyarrow.compute as pc

    ends = pc.run_end_encode(batch.column(2))
    at = 0
    for end, run in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
        yield run, batch.slice(at, end - at)
        at = end


def materialise(
    docs: DataFrame,
    out_dir: str,
    tokenizer_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_tokens: int = SEQ_TOKENS,
    shard_seqs: int = SHARD_SEQS,
    key: int = KEY,
    window: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Write fixed-stride shards and return a row per piece of a document in a sequence.

    The documents, in the order of the scan (of a table's files by name and row, if they are read from files), form one stream of tokens, each ended by the end id. The stream is cut
    into sequences of ``seq_tokens``; only the very last is padded (with the end id). Sequence s has the global slot
    of the keyed permutation of all sequences (with ``window``, of each run of so many, so that an order in which the
    documents were written holds from window to window), shard slot div shard_seqs, and the bytes from (slot mod shard_seqs) * stride on, ids as
    little-endian uint16 (uint32 if there are more than 65536). A reader seeks to any slot and resumes there. Columns: id, piece, seq, at (tokens into the sequence), n_tokens (with the end id), slot, shard,
    offset (bytes into the shard) and crc32 of the ids. A null or empty text is the end id alone. Null ids and
    repeated rows are rows like any other; an empty table writes nothing and gives no rows.

    Texts are encoded twice, once to add up the tokens of each input partition and once to write them: this costs
    less disk than keeping the ids or shuffling the texts. ``docs`` must return the same partitions each time, as a
    written table does; if a partition's tokens differ the second time, the job fails. Shard files appear whole, named
    by their number, so a task that is run again replaces its own output.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = _in_files(docs, [F.col(id_col).alias("__id"), text.alias("__text")])

    def counted(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, n, part = encoder(tokenizer_path, pattern)[0], Counter(), TaskContext.get().partitionId()
        for b in batches:
            for run, own in _runs(b):
                n[run] += sum(len(token_ids(enc, t)) + 1 for t in own.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], ["part", "run", "n"])

    # a row per partition and file split in it
    sizes = sorted((r.run or "", r.part, r.n) for r in base.mapInArrow(counted, "part int, run string, n long").collect())
    starts, n_tokens = {}, 0
    for run, part, n in sizes:
        starts[part, run] = (n_tokens, n)
        n_tokens += n
    n_seqs = -(-n_tokens // seq_tokens)
    known = spark.sparkContext.broadcast(starts)

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end_id = encoder(tokenizer_path, pattern)
        dtype = np.dtype("<u2" if end_id < 65536 else "<u4")
        zipper = zstandard.ZstdCompressor(level=1)
        place, done_tokens = known.value, Counter()
        for b, run in ((own, run) for batch in batches for run, own in _runs(batch)):
            out = [[] for _ in range(6)]
            mine = TaskContext.get().partitionId(), run
            at_token = place[mine][0] + done_tokens[run]
            for one, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*token_ids(enc, t), end_id], dtype)
                done, piece = 0, 0
                while done < len(ids):
                    at = (at_token + done) % seq_tokens
                    n = min(seq_tokens - at, len(ids) - done)
                    for k, v in enumerate((one, piece, (at_token + done) // seq_tokens, at, n, ids[done : done + n].tobytes())):
                        out[k].append(v)
                    done += n
                    piece += 1
                at_token += len(ids)
                done_tokens[run] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], b.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()),
                    pa.array(out[4], pa.int32()), pa.array(windowed_slots(np.array(out[2], np.int64), n_seqs, window, key), pa.int64()),
                    pa.array([zipper.compress(x) for x in out[5]], pa.binary()),
                ],
                ["__id", "piece", "seq", "at", "n", "slot", "ids"],
            )
        if any(place[TaskContext.get().partitionId(), run][1] != n for run, n in done_tokens.items()):
            raise ValueError("the table's partitions changed between counting and writing")

    pieces = base.mapInArrow(cut, f"__id {kind}, piece int, seq long, at int, n int, slot long, ids binary")
    pieces = pieces.withColumn("shard", F.expr(f"cast(slot div {shard_seqs} as int)"))
    n_shards = max(1, -(-n_seqs // shard_seqs))
    ranges = max(1, min(n_shards, 65536))
    dealt = pieces.repartitionById(ranges, F.expr(f"cast(cast(shard as long) * {ranges} div {n_shards} as int)")).sortWithinPartitions("slot", "at")

    def write(batches):
        import pyarrow as pa

        _, end_id = encoder(tokenizer_path, pattern)
        dtype = np.dtype("<u2" if end_id < 65536 else "<u4")
        unzip = zstandard.ZstdDecompressor()
        stride = seq_tokens * dtype.itemsize
        pad = np.full(seq_tokens, end_id, dtype).tobytes()
        shard, f, opened = None, None, None

        def close():
            if opened:
                opened.__exit__(None, None, None)

        done = 0  # bytes written of the open shard
        try:
            for b in batches:
                crcs, offsets = [], []
                slot, at, where = b.column(5).to_pylist(), b.column(3).to_pylist(), b.column(7).to_pylist()
                for i, zipped in enumerate(b.column(6).to_pylist()):
                    if where[i] != shard:
                        if f and done % stride:
                            f.write(pad[done % stride :])
                        close()
                        shard, done = where[i], 0
                        opened = files.writing(f"{out_dir}/shard-{shard:08d}.bin")
                        f = opened.__enter__()
                    ids = unzip.decompress(zipped)
                    offset = (slot[i] % shard_seqs) * stride + at[i] * dtype.itemsize
                    if offset > done:
                        f.write(pad[: offset - done] if offset - done <= stride else b"")
                        done = offset
                    f.write(ids)
                    done += len(ids)
                    offsets.append(offset)
                    crcs.append(zlib.crc32(ids))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in (0, 1, 2, 3, 4, 5, 7)), pa.array(offsets, pa.int64()), pa.array(crcs, pa.int64())],
                    ["__id", "piece", "seq", "at", "n_tokens", "slot", "shard", "offset", "crc32"],
                )
            if f and done % stride:
                f.write(pad[done % stride :])
        except BaseException as e:
            if opened:
                try:
                    opened.__exit__(type(e), e, e.__traceback__)
                except BaseException:
                    pass
                opened = None
            raise
        close()

    found = dealt.mapInArrow(write, f"__id {kind}, piece int, seq long, at int, n_tokens int, slot long, shard int, offset long, crc32 long")
    found = scratch.keep(found, "written")
    return found.withColumnRenamed("__id", id_col)


def read_sequences(out_dir: str, shard: int, first: int = 0, seq_tokens: int = SEQ_TOKENS, dtype: str = "<u2"):
    """Sequences of a shard in slot order, from any slot on."""
    stride = seq_tokens * np.dtype(dtype).itemsize
    with files.reading(f"{out_dir}/shard-{shard:08d}.bin") as f:
        f.seek(first * stride)
        while raw := f.read(stride):
            yield np.frombuffer(raw, dtype)


def shards(docs: DataFrame, window: int | None = None) -> DataFrame:
    """materialise() with a public tokenizer, into a scratch folder."""
    import public_tokenizers

    scratch = Scratch(docs.sparkSession, "tokens")
    return materialise(docs, scratch.path("shards"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, window=window, scratch=scratch)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
