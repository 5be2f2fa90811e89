"""Quality by perplexity under an interpolated modified Kneser-Ney model of word pairs, learnt from trusted text.

1. Trusted texts are counted by task; their distinct pairs of neighbouring words go to shards by hash, with counts.
2. A shard adds up its pairs. What its words stand before and behind goes to word ranges, which add that up in turn.
3. From the counts of counts come the discounts; each word range answers its shards with the words' back-off weights
   and lower-order probabilities.
4. The log probability of a text is a sum of one value for each of its words and one for each of its pairs that was
   seen (by how much the pair beats its back-off). So the texts' words go to the ranges and their pairs to the shards,
   are joined with the counts there, and come back as one partial sum for each text and shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bit_table, by_bytes, marked, release, small_batches, table
from .words import U, hashed, mixed

#: Quantile of the perplexities of a language's held-back trusted texts above which a text is rejected; one of so many
#: trusted texts is held back from the counts.
QUANTILE, HELD = 0.99, 8
#: Bytes of text for each shard, shards at most, words that a task adds up before it hands them on.
SHARD_BYTES, MOST_SHARDS, BLOCK_WORDS = 64 << 20, 1 << 17, 1 << 21
#: The pairs of all texts are joined in so many passes, each with its part of the shards, to hold less on disk at once.
PASSES = 2
#: Bits of the table of trusted ids (8 MB, whatever the input; a full table only sends more texts to the exact join).
ID_BITS = 26
#: Bits of a hash beyond those of the number of bytes: an unseen pair passes for a seen one with odds below 2**-12.
SPARE_BITS = 12
#: Languages up to which their thresholds are broadcast.
LANGUAGES = 4096
#: The hashes of the start and the end of a text.
START, END = U(1), U(2)
STEP = 1 << 20


def pair_key(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return mixed(a * U(0x9E3779B97F4A7C15) + b) >> U(64 - bits)


def part_of(key: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Of n equal ranges of the keys, the one that a key lies in."""
    return ((key >> U(bits - 32)) * U(n) >> U(32)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes: their first bytes, then their second ones, and so on."""
    head = np.array([len(columns), *(x for c in columns for x in (c.itemsize, len(c)))], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns))


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 + 16 * n, []
    for kind, (size, rows) in zip(kinds, np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist(), strict=True):
        out.append(np.frombuffer(raw, np.uint8, size * rows, at).reshape(size, rows).T.copy().view(kind)[:, 0] if rows else np.zeros(0, kind))
        at += size * rows
    return out


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=U(0))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4")


def neighbours(raw: Sequence[bytes], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, text) of all pairs of neighbouring words, with START before and END after a text that has words.

    Words are runs of bytes other than white space, A-Z lower-cased. A text above STEP bytes comes in steps that are cut
    at white space and take the last word along.
    """
    for part in by_bytes(raw, STEP):
        if len(raw[part.start]) > STEP:
            yield from ((a, b, np.full(len(a), part.start)) for a, b in _long(raw[part.start], bits))
            continue
        words, bounds = hashed(raw[part])
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        # one pair more than words: START before the first, END behind the last
        ends = np.cumsum(n[some] + 1)
        left, right = np.empty(ends[-1], U), np.empty(ends[-1], U)
        first, last = np.concatenate(([0], ends[:-1])), ends - 1
        inner = np.ones(len(left), bool)
        inner[last] = False
        right[inner] = words >> U(64 - bits)
        right[last] = END
        inner[last], inner[first] = True, False
        left[inner] = words >> U(64 - bits)
        left[first] = START
        yield left, right, np.repeat(some + part.start, n[some] + 1)


def _long(raw: bytes, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    before, at = START, 0
    while at < len(raw):
        end = min(len(raw), at + STEP)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        words = hashed([raw[at:end]])[0] >> U(64 - bits)
        if len(words):
            yield np.concatenate(([before], words[:-1])), words
            before = words[-1]
        at = end
    if before != START:
        yield np.array([before]), np.array([END])


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Of counts 0, 1, 2 and above, from how many counts are 1, 2, 3 and 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return np.array([0.0, *(min(max(d, 0.05), m) for d, m in ((d1, 0.95), (d2, 1.95), (d3, 2.95)))])


def _of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)], "<u8")


ROWS = "kind int, shard int, range int, data binary"
PAIRS, WORDS, STATS, ANSWERS, MODEL = 0, 1, 2, 3, 4
#: Of texts: what a block of them asks, the prints of its texts, what was found for them.
ASKED, TEXTS, FOUND = 5, 6, 7


def _batch(rows: list[tuple]):
    import pyarrow as pa

    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["kind", "shard", "range", "data"])


def _coded(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs, in the order of their words, by numbers into their distinct words."""
    words, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    order = np.lexsort((y, x))
    return pack(steps(words), _narrow(x[order]), _narrow(y[order]), n[order].astype("<u8"))


def _decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, x, y, n = unpack(raw, "<u8", "<u4", "<u4", "<u8")
    words = np.cumsum(words)
    return words[x], words[y], n


def count_pairs(texts: DataFrame, shards: int, bits: int) -> DataFrame:
    """Pairs of a column of texts and their counts, by shard; each task adds up its own first."""

    def count(batches):
        import pyarrow as pa

        held, total = [], 0

        def out():
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            words, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            code, n = np.unique(at[: len(a)].astype(U) * U(len(words)) + at[len(a) :].astype(U), return_counts=True)
            a, b = words[code // U(len(words))], words[code % U(len(words))]
            where = part_of(pair_key(a, b, bits), shards, bits)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(shards + 1)) if shards < len(a) else None
            for s in range(shards) if cuts is not None else np.unique(where).tolist():
                own = order[cuts[s] : cuts[s + 1]] if cuts is not None else np.flatnonzero(where == s)
                if len(own):
                    yield _batch([(PAIRS, s, 0, _coded(a[own], b[own], n[own]))])

        for batch in batches:
            raw = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b, _ in neighbours(raw, bits):
                held.append((a, b))
                total += len(a)
                if total >= BLOCK_WORDS:
                    yield from out()
                    held, total = [], 0
        if held:
            yield from out()

    return texts.mapInArrow(count, ROWS)


def _merged(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: int):
    """Distinct pairs in the order of their keys, and the sums of their counts."""
    key = pair_key(a, b, bits)
    order = np.argsort(key, kind="stable")
    key, a, b, n = key[order], a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], a[first], b[first], np.add.reduceat(n.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def shard_tables(counted: DataFrame, shards: int, bits: int) -> DataFrame:
    """Of each shard: its pairs (PAIRS), what its words stand beside, by word range (WORDS), counts of counts (STATS)."""

    def add(batches):
        parts, shard = [], None
        for batch in batches:
            for s, raw in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                shard = s
                parts.append(_decoded(raw))
        if shard is None:
            return
        _, a, b, n = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)), bits)
        parts.clear()
        yield _batch([(STATS, shard, 0, pack(_of_counts(n)))])
        for i in range(0, len(a), 1 << 19):
            yield _batch([(PAIRS, shard, 0, _coded(a[i : i + (1 << 19)], b[i : i + (1 << 19)], n[i : i + (1 << 19)]))])
        words, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y, m = at[: len(a)], at[len(a) :], len(words)
        columns = [np.bincount(x, n, m), *(np.bincount(x, c, m) for c in (n == 1, n == 2, n >= 3)), np.bincount(y, minlength=m)]
        where = part_of(words, shards, bits)
        for r in np.unique(where).tolist():
            own = slice(*np.searchsorted(where, (r, r + 1)))
            yield _batch([(WORDS, shard, r, pack(steps(words[own]), *(c[own].astype("<u8") for c in columns)))])

    return counted.repartitionById(shards, "shard").mapInArrow(add, ROWS)


def _words(parts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of a range, the sums of the five numbers of each, and where each part's words are."""
    read = [unpack(p, *["<u8"] * 6) for p in parts]
    own = [np.cumsum(x[0]) for x in read]
    words = np.unique(np.concatenate(own))
    places = [np.searchsorted(words, x) for x in own]
    sums = [np.zeros(len(words)) for _ in range(5)]
    for x, at in zip(read, places, strict=True):
        for s, v in zip(sums, x[1:], strict=True):
            s[at] += v
    return words, sums, places


def _by_range(batches) -> tuple[int | None, list[tuple[int, int, bytes]]]:
    r, rows = None, []
    for batch in batches:
        for kind, shard, r, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rows.append((kind, shard, raw))
    return r, rows


def word_stats(tables: DataFrame, shards: int) -> tuple[np.ndarray, int, int]:
    """Counts of counts of what words stand behind, their sum, and the number of words. A row per range comes back."""

    def add(batches):
        r, rows = _by_range(batches)
        if r is not None:
            words, sums, _ = _words([raw for _, _, raw in rows])
            seen = sums[4][sums[4] > 0]
            yield _batch([(STATS, 0, r, pack(np.concatenate((_of_counts(seen), np.array([seen.sum(), len(seen)], "<u8")))))])

    rows = tables.filter(F.col("kind") == WORDS).repartitionById(shards, "range").mapInArrow(add, ROWS).collect()
    total = sum((unpack(bytes(r.data), "<u8")[0].astype(np.float64) for r in rows), np.zeros(6))
    return total[:4], int(total[4]), int(total[5])


class Model:
    """The numbers that hold for all words: discounts of pairs and of words, continuations, words."""

    def __init__(self, of_pairs: np.ndarray, of_words: np.ndarray, total: int, words: int) -> None:
        self.pairs, self.single, self.total = discounts(*of_pairs), discounts(*of_words), total
        n1, n2 = float(of_words[0]), float(of_words[1])
        rest = self.single[1] * n1 + self.single[2] * n2 + self.single[3] * (words - n1 - n2)
        # what the discounts leave is spread over the words and one for all that were never seen
        self.floor = rest / total / (words + 1)

    def lower(self, behind: np.ndarray) -> np.ndarray:
        """Probability of a word that stands behind so many different words."""
        return (behind - self.single[np.minimum(behind, 3).astype(np.int64)]) / self.total + self.floor

    def back_off(self, sums: Sequence[np.ndarray]) -> np.ndarray:
        """Weight of the lower order behind each word; 1 behind one that nothing was seen behind."""
        left = self.pairs[1] * sums[1] + self.pairs[2] * sums[2] + self.pairs[3] * sums[3]
        return np.where(sums[0] > 0, left / np.maximum(sums[0], 1), 1.0)

    def beats(self, n: np.ndarray, total: np.ndarray, weight: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """By how much the log probability of a pair that was seen n times is above its back-off."""
        return np.log1p((n - self.pairs[np.minimum(n, 3)]) / total / (weight * lower))


def answers(tables: DataFrame, model: Model, shards: int) -> DataFrame:
    """To each shard what its words need (ANSWERS), and of each range the values of its words (MODEL)."""

    def answer(batches):
        r, rows = _by_range(batches)
        if r is None:
            return
        words, sums, places = _words([raw for _, _, raw in rows])
        weight, lower = model.back_off(sums), model.lower(sums[4])
        value = np.log(weight) + np.where(words == START, 0, np.log(lower))
        yield _batch([(MODEL, 0, r, pack(steps(words), value.astype("<f8")))])
        for (_, shard, _), at in zip(rows, places, strict=True):
            yield _batch([(ANSWERS, shard, r, pack(steps(words[at]), sums[0][at].astype("<u8"), weight[at].astype("<f4"), lower[at].astype("<f4")))])

    return tables.filter(F.col("kind") == WORDS).repartitionById(shards, "range").mapInArrow(answer, ROWS)


def _asked(key: np.ndarray, doc: np.ndarray, shards: int, bits: int, keep) -> Iterator[tuple[int, bytes]]:
    """How often each text holds each key, by the keys' range; only ranges that ``keep`` names."""
    good = keep(part_of(key, shards, bits))
    if not good.all():
        key, doc = key[good], doc[good]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((first, [len(key)])))
    key, doc = key[first], doc[first]
    where = part_of(key, shards, bits)
    for s in np.unique(where).tolist():
        own = slice(*np.searchsorted(where, (s, s + 1)))
        new = np.flatnonzero(np.concatenate(([True], key[own][1:] != key[own][:-1])))
        each = np.diff(np.concatenate((new, [len(doc[own])])))
        yield s, pack(steps(key[own][new]), _narrow(each), _narrow(doc[own]), _narrow(times[own]))


BLOCKS = ROWS + ", block long"


def _block_batch(kind: int, shard: int, r: int, data: bytes, block: int):
    import pyarrow as pa

    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, shard, r, data, block), types, strict=True)], ["kind", "shard", "range", "data", "block"])


def asked(texts: DataFrame, shards: int, bits: int, kind: int, part: int = 0, parts: int = 1) -> DataFrame:
    """The words or pairs of texts (h1, h2, text), by range or shard; of the shards every ``parts``-th from ``part`` on.

    The texts of a task go in blocks. A block's prints make a row of their own, so that a text is a small number in
    all its others.
    """

    def ask(batches):
        import pyarrow as pa

        held, prints, total, base = [], [], 0, 0

        def out():
            a, b, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            h1, h2 = (np.concatenate(x) for x in zip(*prints, strict=True))
            block = int(mixed(np.array([h1[0]], np.int64).view(U) + U(len(h1)) * U(31) + U(int(doc[0])))[0].view(np.int64))
            if kind == WORDS:
                starts = a == START
                a, doc = np.concatenate((b, a[starts])), np.concatenate((doc, doc[starts]))
            else:
                a = pair_key(a, b, bits)
            place = lambda s: (s, 0) if kind == PAIRS else (0, s)
            yield _block_batch(TEXTS, *place(block % -(-shards // parts) * parts % shards), pack(h1, h2), block)
            for s, data in _asked(a, doc, shards, bits, lambda s: s % parts == part):
                yield _block_batch(ASKED, *place(s), data, block)

        for batch in batches:
            raw = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            prints.append([batch.column(i).to_numpy() for i in (0, 1)])
            for a, b, doc in neighbours(raw, bits):
                held.append((a, b, doc + base))
                total += len(a)
                if total >= BLOCK_WORDS:
                    yield from out()
                    held, total = [], 0
            base += len(raw)
            if not held:
                prints, base = [], 0
        if held:
            yield from out()

    return texts.mapInArrow(ask, BLOCKS)


def found(rows: DataFrame, column: str, shards: int, model: Model, bits: int) -> DataFrame:
    """For each block and shard (or range) the sums of the values of its texts' pairs (or words); the prints go along."""

    def look(batches):
        keys, values, parts, told = np.zeros(0, U), np.zeros(0), [], []
        ready = False
        for batch in batches:
            for kind, raw, block in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if kind == ANSWERS:
                    told.append(unpack(raw, "<u8", "<u8", "<f4", "<f4"))
                elif kind == PAIRS:
                    parts.append(_decoded(raw))
                elif kind == MODEL:
                    keys, values = unpack(raw, "<u8", "<f8")
                    keys = np.cumsum(keys)
                elif kind == TEXTS:
                    yield _block_batch(TEXTS, 0, 0, raw, block)
                else:
                    if parts and not ready:
                        words = np.concatenate([np.cumsum(x[0]) for x in told])
                        order = np.argsort(words)
                        words, (total, weight, lower) = words[order], (np.concatenate([x[i] for x in told])[order].astype(np.float64) for i in (1, 2, 3))
                        keys, a, b, n = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)), bits)
                        parts.clear()
                        told.clear()
                        x, y = np.searchsorted(words, a), np.searchsorted(words, b)
                        values = model.beats(n, total[x], weight[x], lower[y])
                    ready = True
                    key, each, at, times = unpack(raw, "<u8", "<u4", "<u4", "<u4")
                    key = np.cumsum(key)
                    seen, value = np.zeros(len(key), bool), np.zeros(len(key))
                    if len(keys):
                        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        seen = keys[i] == key
                        value[seen] = values[i[seen]]
                    texts, at = np.unique(at, return_inverse=True)
                    n = times.astype(np.float64)
                    tokens, missing, value = (np.bincount(at, n * x, len(texts)) for x in (1, np.repeat(~seen, each), np.repeat(value, each)))
                    yield _block_batch(FOUND, 0, 0, pack(steps(texts.astype(U)), tokens.astype("<u8"), missing.astype("<u8"), value), block)

    order = F.when(F.col("kind") == ASKED, 1).otherwise(0)
    return rows.repartitionById(shards, column).sortWithinPartitions(order).mapInArrow(look, BLOCKS)


SUMS = "h1 long, h2 long, tokens long, missing long, value double"


def by_text(rows: DataFrame, parts: int) -> DataFrame:
    """A row per text of each block: its print, words and ends, unseen ones, and the sum of the values."""

    def add(batches):
        import pyarrow as pa

        now, prints, held = None, None, []

        def out():
            h1, h2 = prints
            sums = [np.zeros(len(h1)) for _ in range(3)]
            for texts, *columns in held:
                for s, v in zip(sums, columns, strict=True):
                    s[np.cumsum(texts).astype(np.int64)] += v
            some = sums[0] + np.abs(sums[2]) > 0
            return pa.RecordBatch.from_arrays(
                [pa.array(h1[some]), pa.array(h2[some]), pa.array(sums[0][some].astype(np.int64)), pa.array(sums[1][some].astype(np.int64)), pa.array(sums[2][some])],
                ["h1", "h2", "tokens", "missing", "value"],
            )

        for batch in batches:
            for kind, raw, block in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if block != now and now is not None:
                    yield out()
                    held = []
                now = block
                if kind == TEXTS:
                    prints = unpack(raw, "<i8", "<i8")
                else:
                    held.append(unpack(raw, "<u8", "<u8", "<u8", "<f8"))
        if now is not None:
            yield out()

    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(add, SUMS)


def quality(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: id, lang, n_words, perplexity, threshold, kept.

    Words are runs of bytes other than 20 and 09-0D, A-Z lower-cased. The texts of ``trusted_ids`` (one column named
    like the id) train one model, all but those held back, one in HELD by a hash of the id. A row is kept if its
    perplexity is at most the ``quantile`` of those of the held-back texts of its language (of all trusted texts of the
    language, where none of them is held back; of all held-back texts, for a language without trusted text). A null
    language is the empty string. A null, empty or blank text has no perplexity and is not kept; if nothing is trusted,
    no text has one and those with words are kept. Null ids are scored but trusted by nobody; repeated rows are scored
    alike; very long texts are read in steps; an empty table gives no rows; other columns are ignored.

    Everything that is counted or asked is added up by task and goes to as many shards as the texts' bytes call for;
    what reaches the driver is a few numbers for each shard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "quality")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    # a print of the whole row: repeated rows share one
    rows = docs.select(F.col(id_col).alias("__id"), lang.alias("lang"), F.xxhash64(F.col(id_col), text).alias("h1"), F.xxhash64(F.lit("second"), F.col(id_col), text).alias("h2"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(64, max(40, size.bit_length() + SPARE_BITS))
    shards = max(1, min(MOST_SHARDS, -(-size // SHARD_BYTES)))
    known = scratch.keep(trusted_ids.select(F.col(id_col).alias("__t")).filter("__t is not null").distinct().withColumn("__held", F.pmod(F.xxhash64(F.lit("held"), "__t"), F.lit(HELD)) == 0), "known")
    trusted = _trusted(rows, known)
    tables = scratch.keep(shard_tables(count_pairs(trusted, shards, bits), shards, bits), "tables")
    release(spark)
    of_pairs = sum((unpack(bytes(r.data), "<u8")[0].astype(np.float64) for r in tables.filter(F.col("kind") == STATS).collect()), np.zeros(4))
    if not of_pairs.any() and not tables.limit(1).count():
        scored = rows.select("__id", "lang", F.lit(None).cast("double").alias("perplexity"), _n_words().alias("n_words"))
        return scored.select(F.col("__id").alias(id_col), "lang", "n_words", "perplexity", F.lit(None).cast("double").alias("threshold"), (F.col("n_words") > 0).alias("kept"))
    model = Model(of_pairs, *word_stats(tables, shards))
    answered = scratch.keep(answers(tables, model, shards), "answers")
    release(spark)
    texts = rows.select("h1", "h2", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("long").alias("block")
    words = answered.filter(F.col("kind") == MODEL).select("*", none).unionByName(asked(texts, shards, bits, WORDS))
    sums = scratch.keep(by_text(found(words, "range", shards, model, bits), parts), "words")
    release(spark)
    for p in range(PASSES):
        own = tables.filter(F.col("kind") == PAIRS).unionByName(answered.filter(F.col("kind") == ANSWERS)).filter(F.col("shard") % PASSES == p)
        pairs = own.select("*", none).unionByName(asked(texts, shards, bits, PAIRS, p, PASSES))
        part = by_text(found(pairs, "shard", shards, model, bits), parts).select("h1", "h2", F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("missing"), "value")
        sums = sums.unionByName(scratch.keep(part, "pairs"))
        release(spark)
    scratch.drop(answered)
    scratch.drop(tables)
    slim = scratch.keep(rows.drop("text"), "rows")
    times = slim.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"))
    added = sums.groupBy(F.col("h1").alias("__1"), F.col("h2").alias("__2")).agg(F.sum("tokens").alias("tokens"), F.sum("missing").alias("missing"), F.sum("value").alias("value"))
    both = added.join(times, (F.col("h1") == F.col("__1")) & (F.col("h2") == F.col("__2")))
    n = F.expr("tokens div times")  # the words and both ends; an equal row asks for itself
    logs = (F.col("missing") * F.lit(math.log(model.floor)) + F.col("value")) / F.col("times")
    per = scratch.keep(both.select("__1", "__2", (n - 2).alias("words"), F.exp(-logs / (n - 1)).alias("perplexity")), "perplexities")
    scored = slim.join(per, (F.col("h1") == F.col("__1")) & (F.col("h2") == F.col("__2")), "left").join(known, F.col("__id") == F.col("__t"), "left")
    scored = scratch.keep(scored.select("__id", "lang", F.coalesce("words", F.lit(0).cast("long")).alias("n_words"), "perplexity", "__held"), "scored")
    return _judged(scored, quantile).withColumnRenamed("__id", id_col)


def _n_words():
    return F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != "")).cast("long")


def _trusted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The texts that train. A table of their ids' bits thins the texts out before the exact join."""
    own = known.filter("not __held").select("__t")
    bits = bit_table(own.select(F.xxhash64("__t").alias("h")), "h", ID_BITS)
    some = marked(rows.filter("__id is not null").select("__id", "text"), F.xxhash64("__id"), bits, ID_BITS, True)
    own = own.hint("merge")  # however small, so that the shuffle grows with the input
    return some.join(own, F.col("__id") == F.col("__t"), "left_semi").select("text")


def _judged(scored: DataFrame, quantile: float) -> DataFrame:
    cut = F.percentile_approx("perplexity", quantile, 10000)
    trusted = scored.filter("__held is not null and perplexity is not null")
    held = trusted.filter("__held")
    by_lang = (
        trusted.groupBy(F.col("lang").alias("__lang"))
        .agg(F.percentile_approx(F.when(F.col("__held"), F.col("perplexity")), quantile, 10000).alias("a"), cut.alias("b"))
        .select("__lang", F.coalesce("a", "b").alias("__cut"))
    )
    overall = held.agg(cut.alias("c")).first()[0]
    overall = trusted.agg(cut.alias("c")).first()[0] if overall is None else overall
    few = by_lang.limit(LANGUAGES + 1).count() <= LANGUAGES
    joined = scored.join(F.broadcast(by_lang) if few else by_lang, F.col("lang") == F.col("__lang"), "left")
    joined = joined.withColumn("threshold", F.coalesce("__cut", F.lit(overall).cast("double")))
    kept = F.when(F.col("n_words") == 0, False).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return joined.select("__id", "lang", "n_words", "perplexity", "threshold", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality(table(spark, sf_dir, "documents"), trusted)
