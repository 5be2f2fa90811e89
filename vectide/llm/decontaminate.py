"""Benchmark decontamination by spaced seeds: masks that ignore some words, then verified overlaps around the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .words import U, hashed, mixed

#: The words of a window that count (1) or are ignored (0) in each seed. Wherever a fifth of the words of
#: a window of 8 to 24 words is replaced, one of the seeds still fits between them (the tests try every choice).
MASKS = ("1101111", "11110101", "11110011", "10011111", "1101010011", "1110000111", "110011011")
#: Words of a verified window, and the share of them that must agree; words below which an item is looked up whole.
WINDOW, AGREE, SHORT = 24, 0.8, 8
#: Words of the benchmark that are held at once. A larger benchmark is searched in blocks of this size.
BLOCK_WORDS = 1 << 20


def seeds(words: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the counting words of each window that lies inside a text, and the position of the window."""
    span = len(mask)
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.full(n, U(span))
    for i, bit in enumerate(mask):
        if bit == "1":
            h *= U(0x9E3779B97F4A7C15)
            h += words[i : i + n]
    inside = np.ones(n, bool)
    for b in bounds[1:-1]:
        inside[max(0, b - span + 1) : b] = False
    at = np.flatnonzero(inside)
    return mixed(h[at]), at


class Index:
    """The seeds of a block of benchmark items, sorted, behind a bit table of fixed size."""

    BITS = 22

    def __init__(self, ids: list[int], texts: list[bytes], window: int, agree: float) -> None:
        self.ids, self.window, self.agree = ids, window, agree
        self.words, self.bounds = hashed(texts, punctuation=True)
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        self.tables = []
        for mask in MASKS:
            h, at = seeds(self.words, self.bounds, mask)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << self.BITS, bool)
            seen[h >> U(64 - self.BITS)] = True
            self.tables.append((seen, h[order], at[order]))
        # items too short for the seeds are looked up whole
        size = np.diff(self.bounds)
        self.short = []
        for n in np.unique(size[(size > 0) & (size < SHORT)]).tolist():
            items = np.flatnonzero(size == n)
            h = np.array([seeds(self.words[self.bounds[i] : self.bounds[i + 1]], np.array([0, n]), "1" * n)[0][0] for i in items], U)
            order = np.argsort(h, kind="stable")
            self.short.append((n, h[order], items[order]))

    def _whole(self, words: np.ndarray, bounds: np.ndarray, doc: np.ndarray, cover: dict) -> None:
        """Add the places where short items stand word for word."""
        for n, keys, items in self.short:
            h, at = seeds(words, bounds, "1" * n)
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for i in np.flatnonzero(high > low).tolist():
                for item in items[low[i] : high[i]].tolist():
                    cover.setdefault((int(doc[at[i]]), item), []).append(at[i] + np.arange(n))

    def found(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], int]:
        """(text, item) -> words of the text that lie in verified windows."""
        cover: dict[tuple[int, int], list[np.ndarray]] = {}
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        diagonals = []
        for mask, (seen, keys, places) in zip(MASKS, self.tables, strict=True):
            h, at = seeds(words, bounds, mask)
            hit = seen[h >> U(64 - self.BITS)]
            h, at = h[hit], at[hit]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = high - low
            if n.sum():
                which = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                diagonals.append(np.stack((np.repeat(at, n), places[which]), 1))
        self._whole(words, bounds, doc, cover)
        pairs = np.concatenate(diagonals) if diagonals else np.zeros((0, 2), np.int64)
        # one check for each text, item and diagonal; an item is compared over its whole length there
        keys = np.stack((doc[pairs[:, 0]], self.item[pairs[:, 1]], pairs[:, 0] - pairs[:, 1]), 1)
        for d, item, shift in np.unique(keys, axis=0).tolist():
            a, b = int(self.bounds[item]), int(self.bounds[item + 1])
            lo, hi = max(a, int(bounds[d]) - shift), min(b, int(bounds[d + 1]) - shift)
            same = (self.words[lo:hi] == words[lo + shift : hi + shift]).astype(np.int64)
            w = min(self.window, b - a)
            if hi - lo < w:
                continue
            total = np.concatenate(([0], np.cumsum(same)))
            good = np.flatnonzero(total[w:] - total[:-w] >= np.ceil(self.agree * w - 1e-9))
            if len(good):
                marked = np.zeros(hi - lo + 1, np.int64)
                np.add.at(marked, good, 1)
                np.add.at(marked, good + w, -1)
                cover.setdefault((d, item), []).append(np.flatnonzero(np.cumsum(marked)[:-1]) + lo + shift)
        return {k: len(np.unique(np.concatenate(v))) for k, v in cover.items()}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The items in blocks of bounded size; one block at a time is on the driver."""
    held, total = [], 0
    items = benchmark.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for item, text in items.orderBy(*items.columns).toLocalIterator():
        held.append((item, text))
        total += len(text) // 4 + 1
        if total >= block_words:
            yield held
            held, total = [], 0
    if held:
        yield held


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    agree: float = AGREE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per input row: id, items (ids of the items found, ascending), n_words (words covered, added up by item).

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. An item is found in a text if some window
    of ``window`` words of the item (the whole item, if shorter) stands in the text with at least ``agree`` of its
    words at their places; other words may be substituted. Seeds start the search; for items of 8 words and more they
    miss no such window of 24 words or less. Shorter items are found where they stand word for word (of 7 words, also
    where a seed fits). Items of equal text are found together. Null and empty texts and items hold nothing; very long
    texts are searched like others; null ids and repeated rows stay as they are; other columns are ignored; an empty
    benchmark finds nothing; an empty table gives no rows.

    The benchmark is the query set, held in blocks of bounded size; the corpus is scanned once for each block and is
    never shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = texts.select("__id", "text", F.array().cast("array<long>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    for block in _blocks(benchmark, item_col, "text", block_words):
        out = _scan(out, kind, block, window, agree)
    return out.select(F.col("__id").alias(id_col), "items", "n_words")


def _scan(texts: DataFrame, kind: str, block: list, window: int, agree: float) -> DataFrame:
    """Add the items of a block to what earlier blocks found."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        import pyarrow as pa

        items = shared.value
        index = Index([i for i, _ in items], [t.encode() for _, t in items], window, agree)
        for b in batches:
            raw = b.column(1).cast(pa.binary()).to_pylist()
            ids, n = [], []
            for part in _parts(raw):
                words, bounds = hashed(raw[part], punctuation=True)
                found: dict[int, list] = {}
                for (d, item), covered in index.found(words, bounds).items():
                    found.setdefault(d, []).append((index.ids[item], covered))
                for d in range(len(raw[part])):
                    hits = found.get(d, [])
                    ids.append({i for i, _ in hits if i is not None})
                    n.append(sum(c for _, c in hits))
            ids = [sorted(x.union(before)) for x, before in zip(ids, b.column(2).to_pylist(), strict=True)]
            n = [x + before for x, before in zip(n, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["__id", "text", "items", "n_words"]
            )

    return texts.mapInArrow(search, f"__id {kind}, text string, items array<long>, n_words long")


def _parts(raw: list[bytes]):
    from .common import by_bytes

    return by_bytes(raw, 1 << 20)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark item is found.

    The search runs inside the scan of the whole rows, so the rows are not joined back. With more than one block the
    blocks filter in turn.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns, where = docs.columns, docs.columns.index(text_col)
    out = docs
    for block in _blocks(benchmark, "item_id", "text", BLOCK_WORDS):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            import pyarrow as pa

            items = shared.value
            index = Index([i for i, _ in items], [t.encode() for _, t in items], WINDOW, AGREE)
            for b in batches:
                raw = [t or b"" for t in b.column(where).cast(pa.binary()).to_pylist()]
                good = np.ones(len(raw), bool)
                for part in _parts(raw):
                    for d, _ in index.found(*hashed(raw[part], punctuation=True)):
                        good[part.start + d] = False
                yield b.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "items", "n_words", (F.size("items") > 0).alias("contaminated"))
