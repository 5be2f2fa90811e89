"""Exact n-gram Jaccard self-join through a token-group matrix.

Similar documents form groups, each group stores the union of its members' tokens, the overlap of a document or group
with a group's union bounds every similarity inside, and only groups whose bound qualifies are opened.

1. Every text becomes its set of shingles; equal sets become one.
2. Grouping: sets that share a min-hash go through a bounded window in which links are verified; linked sets are one
   class, cut into groups of bounded size. This only finds links early; nothing relies on it finding all of them.
3. Matrix: under one order of all tokens (those seen often last), a set's prefix is so long that two sets of
   similarity t must share a token of both prefixes. A group's row is the union of its prefixes, dealt by token range.
4. Bound: shared tokens are counted for each pair of groups of different classes. Similar members need a number of
   them that follows from their sizes; other pairs are pruned, inside a token range if it holds enough of a group.
5. Qualifying pairs of groups are opened and verified; one link joins two classes.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bit_table, by_bytes, components, in_bits, release, small_batches, table
from .words import U, hashed, mixed, shingles

#: Words of a shingle; similarity that links, in hundredths.
WORDS, SIMILAR = 5, 75
#: Min-hashes of a set, sets in a group.
KEYS, GROUP = 4, 64
#: Sets and bytes that a window holds, and the most alike of them that a new set is compared with.
POOL, POOL_BYTES, TRIES = 512, 32 << 20, 16
#: Pairs of each group that the first rounds open; the last round opens all that are left.
ROUNDS = (1, 4, 16)
#: Tokens counted together for frequency, and the numbers of documents from which on a token is ordered later.
BLOCK_TOKENS, OFTEN = 1 << 21, (6, 12, 24, 48, 96, 384, 1536, 6144)
#: Bits of the tables that the executors get (2 MB for each step of OFTEN and for keys, 8 MB for ids, whatever the
#: input; a full table only prunes less).
BITS, ID_BITS = 24, 26
#: Keys whose sets are dealt out further, and sets of one dealing.
HEAVY, DEAL = 4096, 256
#: Prefix tokens of one token range, tokens of a group there from which on the range bounds the group's pairs, and the
#: quarters of its part that a pair has to reach there.
RANGE_TOKENS, DENSE, QUARTERS = 1 << 20, 3, 2
#: Pairs of groups that a task counts at a time.
PAIRS = 1 << 20
BYTES = 1 << 20


def prefix_length(n: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Tokens of which one at least is shared, in the prefixes of both, by any two sets that are similar."""
    return n - -(-n * similar // 100) + 1


def needed(la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray, at: int) -> np.ndarray:
    """Tokens at least that similar members of two groups share in their prefixes; sizes from la to ha, lb to hb.

    Members of sizes x, y need an overlap of at*(x+y)/(100+at), of which at most ceil(at*size/100)-1 tokens lie
    outside one of the prefixes.
    """
    return np.maximum(1, -(-at * (la + lb) // (100 + at)) + -at * np.maximum(ha, hb) // 100 + 1)


def bit_tables(df: DataFrame, column: str, steps: str, bits: int) -> np.ndarray:
    """A table as of bit_table for each bit of the column ``steps``. At most 2**(bits-6) rows come back."""
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    each = [F.when(F.col(steps).bitwiseAND(1 << i) != 0, F.expr("shiftleft(1L, cast(__at & 63 as int))")).otherwise(0) for i in range(len(OFTEN))]
    words = (
        df.select(steps, at.alias("__at"))
        .select(F.shiftrightunsigned("__at", 6).alias("w"), *(e.alias(f"b{i}") for i, e in enumerate(each)))
        .groupBy("w")
        .agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(len(OFTEN))))
        .toArrow()
    )
    out = np.zeros((len(OFTEN), 1 << (bits - 6)), np.int64)
    for i in range(len(OFTEN)):
        out[i, words.column("w").to_numpy()] = words.column(f"b{i}").to_numpy()
    return out.view(np.uint64)


def _sets(batch, k: int):
    """(positions, shingles, bounds) of the texts of a batch, in parts of bounded size."""
    import pyarrow as pa

    raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
    for part in by_bytes(raw, BYTES):
        yield part, *shingles(*hashed(raw[part]), k)


def _min_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """KEYS min-hashes of each set that is not empty."""
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), KEYS), U)
    for i in range(KEYS):
        out[:, i] = mixed(np.minimum.reduceat(mixed(tokens ^ U(0xA0761D6478BD642F * (i + 1) & (2**64 - 1))), at) + U(i))
    return out


def _prints(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set that is not empty."""
    at = bounds[:-1][np.diff(bounds) > 0]
    return np.add.reduceat(mixed(tokens + U(1)), at), np.bitwise_xor.reduceat(mixed(tokens ^ U(0xE7037ED1A0B428DB)), at)


FEATURES = "doc_id long, hid long, n long, f1 long, f2 long, keys array<long>, often array<long>, seen array<int>"


def features(texts: DataFrame, k: int) -> DataFrame:
    """A row per text (size, fingerprints, min-hashes), and rows of tokens that a block of texts holds repeatedly."""

    def make(batches):
        import pyarrow as pa

        names = [x.split(" ", 1)[0] for x in FEATURES.split(", ")]
        types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        held, total = [], 0

        def often():
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            many = seen > 1
            return pa.RecordBatch.from_arrays(
                [pa.nulls(1, t) for t in types[:6]]
                + [pa.array([tokens[many].view(np.int64)], types[6]), pa.array([seen[many].astype(np.int32)], types[7])],
                names,
            )

        for b in batches:
            ids = b.column(0)
            for part, tokens, bounds in _sets(b, k):
                n = np.diff(bounds)
                some = n > 0
                cols = [np.zeros(len(n), np.int64) for _ in range(2)]
                keys = [None] * len(n)
                if some.any():
                    cols[0][some], cols[1][some] = (x.view(np.int64) for x in _prints(tokens, bounds))
                    for i, v in zip(np.flatnonzero(some), _min_keys(tokens, bounds).view(np.int64), strict=True):
                        keys[i] = v
                own = ids.slice(part.start, len(n))
                hid = mixed(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(hid), pa.array(n.astype(np.int64)), pa.array(cols[0]), pa.array(cols[1]), pa.array(keys, types[5]), pa.nulls(len(n), types[6]), pa.nulls(len(n), types[7])],
                    names,
                )
                held.append(tokens)
                total += len(tokens)
                if total >= BLOCK_TOKENS:
                    yield often()
                    held, total = [], 0
        if total:
            yield often()

    return texts.mapInArrow(make, FEATURES)


def _representatives(batch, k, wanted, seen: set):
    """(id, tokens) of texts that may be the first of their set; wanted: bits of such ids.

    A copy whose id shares its bit with such an id comes too, so what was seen is marked with its id: a copy never
    stands in for the first, and costs a row that a join on sid drops.
    """
    ids = batch.column(0)
    for part, tokens, bounds in _sets(batch, k):
        own = ids.slice(part.start, len(bounds) - 1)
        values = own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        good = in_bits(wanted, mixed(values.view(U)), ID_BITS) & own.is_valid().to_numpy(zero_copy_only=False)
        good &= np.diff(bounds) > 0
        for i in np.flatnonzero(good):
            t = tokens[bounds[i] : bounds[i + 1]]
            mark = (int(values[i]), len(t), int(np.bitwise_xor.reduce(t)), int(t[0]))
            if mark not in seen:
                if len(seen) < 1 << 18:
                    seen.add(mark)
                yield int(values[i]), t


def _emit(rows: list, schema: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])


def _batched(rows, schema, weight):
    """Record batches of bounded size."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += weight(r) + 32
        if total > 4 << 20:
            yield _emit(held, schema)
            held, total = [], 0
    if held:
        yield _emit(held, schema)


def similar(a: np.ndarray, b: np.ndarray, at: int = SIMILAR) -> bool:
    """Whether two ascending sets are similar: 100 * intersection >= at * union."""
    if 100 * min(len(a), len(b)) < at * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    both = int(np.count_nonzero(b[i] == a))
    return 100 * both >= at * (len(a) + len(b) - both)


def _early_links(texts, k, reps, popular, heavy, parts):
    """Verified links between sets that share a min-hash, found in a window over the sets of each key."""

    def emit(batches):
        import pyarrow as pa

        schema = [("key", pa.int64()), ("deal", pa.int32()), ("first", pa.bool_()), ("id", pa.int64()), ("set", pa.binary())]

        def rows():
            seen: set = set()
            for b in batches:
                for one, t in _representatives(b, k, reps.value, seen):
                    keys = _min_keys(t, np.array([0, len(t)]))[0]
                    hit = np.flatnonzero(in_bits(popular.value, keys, BITS))
                    if len(hit):
                        key = int(keys[hit[0]].view(np.int64))
                        deals, anchor = heavy.value.get(key, (1, None))
                        if one == anchor:
                            for d in range(deals):
                                yield key, d, True, one, t.tobytes()
                        else:
                            yield key, one % deals, False, one, t.tobytes()

        yield from _batched(rows(), schema, lambda r: len(r[4]))

    def link(batches):
        import pyarrow as pa

        schema = [("a", pa.int64()), ("b", pa.int64())]

        def rows():
            now, pool, sums, held = None, deque(), np.zeros((0, KEYS), U), 0
            for b in batches:
                for key, deal, one, raw in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                    t = np.frombuffer(raw, U)
                    if (key, deal) != now:
                        now, held = (key, deal), 0
                        pool.clear()
                        sums = np.zeros((0, KEYS), U)
                    own = _min_keys(t, np.array([0, len(t)]))
                    alike = (sums == own).sum(1)
                    alike[:1] += KEYS  # the anchor, or the first of the run, comes first
                    for i in np.argsort(-alike, kind="stable")[:TRIES].tolist():
                        if alike[i] > 1 and pool[i][0] != one and similar(t, pool[i][1]):
                            yield one, pool[i][0]
                            break
                    pool.append((one, t))
                    sums = np.concatenate((sums, own))
                    held += len(raw)
                    while len(pool) > POOL or (held > POOL_BYTES and len(pool) > 1):
                        held -= pool[1][1].nbytes if len(pool) > 1 else 0
                        del pool[1]
                        sums = np.delete(sums, 1, 0)

        yield from _batched(rows(), schema, lambda r: 16)

    found = texts.mapInArrow(emit, "key long, deal int, first boolean, id long, set binary")
    dealt = found.repartition(parts, "key", "deal").sortWithinPartitions("key", "deal", F.desc("first"))
    return dealt.mapInArrow(link, "a long, b long")


def _prefixes(texts, k, reps, often):
    def emit(batches):
        import pyarrow as pa

        schema = [("sid", pa.int64()), ("prefix", pa.binary())]

        def rows():
            seen: set = set()
            for b in batches:
                for one, t in _representatives(b, k, reps.value, seen):
                    step = sum(in_bits(x, t, BITS).astype(np.int8) for x in often.value)
                    p = int(prefix_length(np.int64(len(t))))
                    yield one, np.sort(t[np.argsort(step, kind="stable")[:p]]).tobytes()

        yield from _batched(rows(), schema, lambda r: len(r[1]))

    return texts.mapInArrow(emit, "sid long, prefix binary")


MATRIX = "range int, packed binary"
#: Numbers of a group in the matrix: its class and part, sizes of its members from low to high, its tokens, those of
#: them in dense ranges, and those in this range.
COLUMNS = ("root", "part", "low", "high", "size", "dense", "held")


def _packed(columns: list[np.ndarray], tokens: np.ndarray) -> bytes:
    """Groups, a column after the other, and their tokens, compressed.

    Of a token its lower half is kept, as the range follows from the upper one. Two that agree by chance add to what
    groups seem to share, so they can only open a pair in vain.
    """
    root, _, low, high, size, *_ = columns
    deltas = [np.diff(root, prepend=np.int64(0)), columns[1], low, high - low, size - prefix_length(low), *columns[5:]]
    with_tokens = [*(d.astype("<i8" if i == 0 else "<i4") for i, d in enumerate(deltas)), (tokens & U(0xFFFFFFFF)).astype("<u4")]
    # bytes of one rank together: most of the upper ones are zero
    raw = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in with_tokens)
    return len(root).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(packed: bytes) -> list[np.ndarray]:
    """The columns of _packed(), and the tokens."""
    n = int.from_bytes(packed[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[4:]), np.uint8)
    widths, out, at = [8] + [4] * (len(COLUMNS) - 1), [], 0
    for width in widths:
        out.append(np.ascontiguousarray(raw[at : at + width * n].reshape(width, n).T).view(f"<i{width}").ravel())
        at += width * n
    out.append(np.ascontiguousarray(raw[at:].reshape(4, -1).T).view("<u4").ravel())
    out[0] = np.cumsum(out[0])
    out[3] = out[3] + out[2]
    out[4] = (out[4] + prefix_length(out[2].astype(np.int64))).astype(np.int32)
    return out


def _matrix(rows: DataFrame, n_ranges: int) -> DataFrame:
    """Rows of the matrix by token range: each group's tokens of the range, and their number in all and in dense ranges.

    Input: sorted by group.
    """

    def make(batches):
        import pyarrow as pa

        schema = [("range", pa.int32()), ("packed", pa.binary())]

        def flush(groups):
            tokens = np.concatenate([g[4] for g in groups])
            which = np.repeat(np.arange(len(groups)), [len(g[4]) for g in groups])
            at = ((tokens >> U(40)) * U(n_ranges)) >> U(24)
            order = np.lexsort((which, at))
            tokens, which, at = tokens[order], which[order], at[order]
            cuts = np.searchsorted(at, np.arange(n_ranges + 1))
            start = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (at[1:] != at[:-1]))))
            own, held = which[start], np.diff(np.concatenate((start, [len(which)])))
            dense = np.bincount(own, np.where(held >= DENSE, held, 0), len(groups)).astype(np.int64)
            rows = np.searchsorted(start, cuts)
            known = [np.array([g[c] for g in groups], np.int64) for c in range(4)] + [np.array([len(g[4]) for g in groups], np.int64), dense]
            for r in range(n_ranges):
                i, j = rows[r], rows[r + 1]
                if i < j:
                    yield r, _packed([*(c[own[i:j]] for c in known), held[i:j]], tokens[cuts[r] : cuts[r + 1]])

        def out():
            groups, total, now, members = [], 0, None, []

            def close():
                sizes = [m[0] for m in members]
                t = members[0][1] if len(members) == 1 else np.unique(np.concatenate([m[1] for m in members]))
                groups.append((*now, min(sizes), max(sizes), t))
                return len(t)

            for b in batches:
                for root, part, n, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if (root, part) != now:
                        if members:
                            total += close()
                        if total > BLOCK_TOKENS:
                            yield from flush(groups)
                            groups, total = [], 0
                        now, members = (root, part), []
                    members.append((n, np.frombuffer(raw, U)))
            if members:
                close()
            if groups:
                yield from flush(groups)

        yield from _batched(out(), schema, lambda r: len(r[1]))

    return rows.mapInArrow(make, MATRIX)


SHARED = "ra long, pa int, rb long, pb int, size long, n long, least long"


def _shared(matrix: DataFrame, n_ranges: int, at: int) -> DataFrame:
    """Tokens of a range that two groups of different classes share, where they are enough.

    Groups that hold similar members share ``need`` tokens over all ranges. A range that holds at least DENSE tokens of
    the smaller group is due its part of ``need``, by its part of that group's tokens, and reports a pair only if it
    reaches QUARTERS of that; any other range reports all it has. What a range reports is its count less the most that it could
    have passed over. Dense ranges can have passed over no more than those quarters, so the reports of a pair that
    qualifies add up to ``least``, the rest of ``need``. Thus a few large ranges rule out
    most pairs before the shuffle, and the sum over many small ones rules them out behind it.
    """

    def count(batches):
        import pyarrow as pa

        got = [_unpacked(x) for b in batches for x in b.column(1).to_pylist()]
        if not got:
            return
        root, part, low, high, whole, dense, held, tokens = (np.concatenate(c) for c in zip(*got, strict=True))
        del got
        rank = np.empty(len(root), U)
        order = np.lexsort((part, root))
        rank[order] = np.arange(len(root), dtype=U)
        runs = tokens.astype(U) << U(32)
        runs |= np.repeat(rank, held)
        root, part, low, high, whole, dense, held = (x[order] for x in (root, part, low, high, whole, dense, held))
        del tokens, rank, order
        runs.sort()  # by token, there by class
        which = (runs & U(0xFFFFFFFF)).astype(np.int32)
        runs >>= U(32)
        new = np.concatenate(([True], runs[1:] != runs[:-1]))
        del runs
        start = np.flatnonzero(new)
        end = np.repeat(np.append(start[1:], len(new)).astype(np.int32), np.diff(start, append=len(new)))
        new[1:] |= root[which[1:]] != root[which[:-1]]
        start = np.flatnonzero(new)
        del new
        # each place in the list is paired with those of its token that are of a later class
        after = np.repeat(np.append(start[1:], len(which)).astype(np.int32), np.diff(start, append=len(which)))
        some = np.flatnonzero(after < end)
        some = some[np.argsort(which[some], kind="stable")]
        own, after, later = which[some], after[some], (end[some] - after[some]).astype(np.int64)
        del end, some
        load = np.concatenate(([0], np.cumsum(later)))
        ends = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own))

        def paired(lo, hi):
            n = later[lo:hi]
            a = np.repeat(own[lo:hi], n)
            b = which[np.repeat(after[lo:hi] - (load[lo:hi] - load[lo]), n) + np.arange(len(a))]
            good = (100 * high[a].astype(np.int64) >= at * low[b].astype(np.int64)) & (100 * high[b].astype(np.int64) >= at * low[a].astype(np.int64))
            return np.unique(a[good].astype(np.int64) * len(root) + b[good], return_counts=True)

        names = [x.split(" ")[0] for x in SHARED.split(", ")]
        lo = 0
        while lo < len(own):  # all pairs of some groups, PAIRS at a time
            hi = ends[max(np.searchsorted(ends, np.searchsorted(load, load[lo] + PAIRS, "right") - 1, "right") - 1, np.searchsorted(ends, lo, "right"))]
            parts: list = []
            while lo < hi:
                step = min(hi, max(lo + 1, int(np.searchsorted(load, load[lo] + PAIRS, "right")) - 1))
                parts.append(paired(lo, step))
                if len(parts) > 1:
                    parts = [_merged(parts)]
                lo = step
            pairs, counts = parts[0]
            for i in range(0, len(pairs), 65536):
                a, b, n = pairs[i : i + 65536] // len(root), pairs[i : i + 65536] % len(root), counts[i : i + 65536]
                la, ha, lb, hb, wa, wb, da, db = (x.astype(np.int64) for x in (low[a], high[a], low[b], high[b], whole[a], whole[b], dense[a], dense[b]))
                first = (wa < wb) | ((wa == wb) & (da <= db))
                own_held, size, packed = np.where(first, held[a], held[b]).astype(np.int64), np.where(first, wa, wb), np.where(first, da, db)
                need = needed(la, ha, lb, hb, at)
                due = np.where(own_held >= DENSE, -(-need * own_held * QUARTERS // (4 * size)), 1)
                least = np.maximum(1, -(-need * (4 * size - QUARTERS * packed) // (4 * size)))
                x = n >= due
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(root[a[x]]), pa.array(part[a[x]]), pa.array(root[b[x]]), pa.array(part[b[x]]),
                        pa.array((ha + hb)[x]), pa.array((n - due + 1)[x]), pa.array(least[x]),
                    ],
                    names,
                )

    return matrix.repartitionById(n_ranges, "range").mapInArrow(count, SHARED)


def _merged(parts):
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, counts, len(unique)).astype(np.int64)


def _wanted_sets(texts, k, wanted):
    def emit(batches):
        import pyarrow as pa

        def rows():
            seen: set = set()
            for b in batches:
                for one, t in _representatives(b, k, wanted.value, seen):
                    yield one, t.tobytes()

        yield from _batched(rows(), [("sid", pa.int64()), ("set", pa.binary())], lambda r: len(r[1]))

    return texts.mapInArrow(emit, "sid long, set binary")


def _open(rows: DataFrame, parts: int, at: int) -> DataFrame:
    """One link for each pair of opened groups that holds any. Input columns: pair, side, sid, set; small groups."""

    def verify(batches):
        import pyarrow as pa

        def pairs():
            now, sides = None, ([], [])
            for b in batches:
                for pair, side, one, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if pair != now:
                        if now is not None:
                            yield sides
                        now, sides = pair, ([], [])
                    sides[side].append((one, np.frombuffer(raw, U)))
            if now is not None:
                yield sides

        def rows():
            for left, right in pairs():
                found = next(((i, j) for i, a in left for j, b in right if similar(a, b, at)), None)
                if found:
                    yield found

        yield from _batched(rows(), [("a", pa.int64()), ("b", pa.int64())], lambda r: 16)

    return rows.repartition(parts, "pair").sortWithinPartitions("pair", "side").mapInArrow(verify, "a long, b long")


def _sides(pairs: DataFrame, *columns: str) -> DataFrame:
    """Two rows for each pair, one per group."""
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("ra").alias("r"), F.col("pa").alias("p")), F.struct(F.lit(1).alias("side"), F.col("rb").alias("r"), F.col("pb").alias("p")))
    return pairs.select(*columns, F.explode(both).alias("__x")).select(*columns, "__x.side", "__x.r", "__x.p")


def _merge_classes(scratch: Scratch, pairs: DataFrame, members: DataFrame, of: DataFrame, parts: int, at: int) -> DataFrame:
    """Components (node, root) of classes after all qualifying pairs of groups are opened.

    Pairs inside one class need not be opened. So the most alike pairs of each group come first, their links merge
    classes, and only pairs that still join two classes stay for the next round. Each round opens a few pairs of each
    group; the last one opens whatever is left, so no link is missed.
    """
    spark = scratch.spark
    links = scratch.keep(spark.createDataFrame([], "a long, b long"), "links")
    shown = pairs.columns
    upper = spark.createDataFrame([], "node long, root long")
    for most in (*ROUNDS, None):
        top = upper.select(F.col("node").alias("__n"), F.col("root").alias("__t"))
        left = pairs.join(top, F.col("ra") == F.col("__n"), "left").withColumn("ta", F.coalesce("__t", "ra")).drop("__n", "__t")
        left = left.join(top, F.col("rb") == F.col("__n"), "left").withColumn("tb", F.coalesce("__t", "rb")).drop("__n", "__t")
        left = scratch.keep(left.filter("ta <> tb").select(*shown), "left")
        if not left.limit(1).count():
            return upper
        release(spark)
        sides = _sides(left, "pair", "score")
        if most is not None:
            rank = F.row_number().over(Window.partitionBy("r", "p").orderBy(F.desc("score"), "pair"))
            best = sides.withColumn("__k", rank).filter(F.col("__k") <= most).select("pair").distinct()
            best = scratch.keep(best, "best")
            sides = sides.join(best, "pair", "left_semi")
            pairs = scratch.keep(left.join(best, "pair", "left_anti").select(*shown), "pairs")
        opened = members.join(sides, (F.col("root") == F.col("r")) & (F.col("part") == F.col("p"))).select("pair", "side", "sid", "set")
        found = scratch.keep(_open(opened, parts, at), "found")
        merged = (
            found.join(of, F.col("a") == F.col("__s")).select(F.col("__r").alias("x"), "b")
            .join(of, F.col("b") == F.col("__s")).select(F.col("x").alias("a"), F.col("__r").alias("b"))
        )
        links = scratch.keep(links.unionByName(merged), "links")
        upper = scratch.keep(components(scratch, links, "upper"), "upper")
    return upper


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, at: int = SIMILAR, scratch: Scratch | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Words are runs of bytes other than 20 and 09-0D, A-Z lower-cased; a text's set holds its distinct ``k``-word
    shingles, or its whole sequence if it has fewer words. Two rows are linked if 100 * intersection >= ``at`` *
    union. A null, empty or blank text has an empty set, links with nothing and is its own class. A row with a null
    id takes the class of a row with an id and an equal set, else null, and joins no classes. Repeated rows share
    their class. Ids are integers; other columns are ignored; an empty table gives no rows.

    All links are found: the prefixes of two similar sets always share a token, and the bound never excludes a
    similar pair. Tables that reach all executors are bit tables of fixed size and at most HEAVY keys.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    small_batches(spark)
    sc = spark.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = scratch.keep(features(texts, k), "features")
    each = seen.filter("n is not null").select("doc_id", "hid", "n", "f1", "f2", "keys")
    sets = scratch.keep(
        each.filter("n > 0 and doc_id is not null")
        .groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("sid"), F.min_by("hid", "doc_id").alias("hid"), F.first("n").alias("n"), F.first("keys").alias("keys")),
        "sets",
    )
    often = (
        seen.filter("often is not null").select(F.explode(F.arrays_zip("often", "seen")).alias("x"))
        .groupBy(F.col("x.often").alias("token")).agg(F.sum("x.seen").alias("n")).filter(F.col("n") >= OFTEN[0])
        .select("token", sum(F.when(F.col("n") >= n, 1 << i).otherwise(0) for i, n in enumerate(OFTEN)).alias("steps"))
    )
    often = sc.broadcast(bit_tables(often, "token", "steps", BITS))
    reps = sc.broadcast(bit_table(sets, "hid", ID_BITS))
    keyed = sets.select(F.explode("keys").alias("key"), "sid").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("first"))
    keyed = scratch.keep(keyed.filter("n > 1"), "keys")
    popular = sc.broadcast(bit_table(keyed, "key", BITS))
    heavy = keyed.filter(F.col("n") > DEAL).orderBy(F.desc("n"), "key").limit(HEAVY).collect()
    heavy = sc.broadcast({r.key: (-(-r.n // DEAL), r.first) for r in heavy})
    scratch.drop(keyed)
    release(spark)
    early = scratch.keep(_early_links(texts, k, reps, popular, heavy, parts), "early")
    release(spark)
    roots = scratch.keep(components(scratch, early), "roots")
    scratch.drop(early)
    classed = sets.select("sid", "hid", "n").join(roots, F.col("sid") == F.col("node"), "left").select("sid", "hid", "n", F.coalesce("root", "sid").alias("root"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("__m")).withColumnRenamed("root", "__r")
    groups = scratch.keep(
        classed.join(sizes, F.col("root") == F.col("__r"), "left").select(
            "sid", "hid", "n", "root",
            F.when(F.col("__m") > GROUP, F.pmod(F.xxhash64("sid"), F.ceil(F.col("__m") / F.lit(GROUP)))).otherwise(0).cast("int").alias("part"),
        ),
        "groups",
    )
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_ranges = int(min(1 << 16, total // 4 // RANGE_TOKENS + 1))
    members = (
        _prefixes(texts, k, reps, often).join(groups.select(F.col("sid").alias("__sid"), "n", "root", "part"), F.col("sid") == F.col("__sid"))
        .select("root", "part", "n", "prefix").repartition(parts, "root", "part").sortWithinPartitions("root", "part")
    )
    counted = _shared(_matrix(members, n_ranges), n_ranges, at)
    pairs = (
        counted.groupBy("ra", "pa", "rb", "pb").agg(F.sum("n").alias("n"), F.max("least").alias("least"), F.max("size").alias("size"))
        .filter(F.col("n") >= F.col("least"))
        .select("ra", "pa", "rb", "pb", F.xxhash64("ra", "pa", "rb", "pb").alias("pair"), (F.col("n") / F.col("size")).alias("score"))
    )
    release(spark)
    pairs = scratch.keep(pairs, "pairs")
    release(spark)
    sides = _sides(pairs, "pair", "score")
    opened = groups.join(sides.select("r", "p").distinct(), (F.col("root") == F.col("r")) & (F.col("part") == F.col("p")), "left_semi")
    opened = scratch.keep(opened.select("sid", "hid", "root", "part"), "opened")
    wanted = sc.broadcast(bit_table(opened, "hid", ID_BITS))
    full = _wanted_sets(texts, k, wanted).withColumnRenamed("sid", "__sid")
    full = scratch.keep(full.join(opened, F.col("__sid") == F.col("sid")).select("sid", "set", "root", "part"), "members")
    release(spark)
    of = groups.select(F.col("sid").alias("__s"), F.col("root").alias("__r"))
    upper = _merge_classes(scratch, pairs, full, of, parts, at)
    final = scratch.keep(
        groups.join(upper.withColumnRenamed("root", "__top"), F.col("root") == F.col("node"), "left").select("sid", F.coalesce("__top", "root").alias("component")), "final"
    )
    scratch.drop(full)
    scratch.drop(pairs)
    release(spark)
    named = sets.select(F.col("f1").alias("__f1"), F.col("f2").alias("__f2"), F.col("sid").alias("__sid")).join(final, F.col("__sid") == F.col("sid"))
    out = each.join(named, (F.col("f1") == F.col("__f1")) & (F.col("f2") == F.col("__f2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
