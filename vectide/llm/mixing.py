"""Mixing sources to target weights: Pfair release times and deadlines, earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks_for, running_totals, table

#: Slots that the column ``share`` refers to; the schedule itself follows the exact weights.
PERIOD = 1000
#: Documents in a block at least, and the blocks of all sources beyond which blocks get larger.
BLOCK_ROWS, BLOCKS = 4, 1 << 18
#: Default target weights: a source's rows to this power, so that small sources count for more than their size.
TEMPERATURE = 0.5
#: Blocks that the driver schedules before it hands them on.
PART = 1 << 17
#: Slots beyond this, which only tiny weights reach after the mix, are written as this.
MOST = 1 << 62


def shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares that add up to the period, each less than one from the exact share."""
    names = sorted(k for k, v in weights.items() if v > 0)
    if not names:
        return {}
    whole = whole_weights({k: weights[k] for k in names})
    total = sum(whole.values())
    out = {k: whole[k] * period // total for k in names}
    for k in sorted(names, key=lambda k: (-(whole[k] * period % total), k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights as they are written in decimal."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    up = math.lcm(*(v.denominator for v in exact.values()))
    out = {k: v.numerator * (up // v.denominator) for k, v in exact.items()}
    down = math.gcd(*out.values())
    return {k: v // down for k, v in out.items()}


def period_schedule(parts: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) for one period of sum(parts) slots, one block a slot.

    Block j of a source with p of W shares is released at floor(j*W/p) and due by ceil((j+1)*W/p). In each slot the
    released block of the earliest deadline runs (ties: source name). With all shares used, every slot is filled and
    every block runs in its window, so each source is always less than one block from its fluid share.
    """
    total = sum(parts.values())
    waiting = [(0, k, 0) for k in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[k]), k, j, release))
        due, k, j, release = heapq.heappop(ready)
        assert slot < due
        out.append((k, j, release, due, slot))
        if j + 1 < parts[k]:
            heapq.heappush(waiting, ((j + 1) * total // parts[k], k, j + 1))
    return out


def run_schedule(parts: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """(source, block, release, deadline, slot, in_mix) of all blocks in slot order, as in period_schedule().

    The mix ends at the slot that a source with no block left would get next. From there on such sources take no
    slots, and a slot in which no block is released stays empty. Holds one entry per source.
    """
    total = sum(parts.values())
    waiting = [(0, k, 0) for k in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot, mixed = 0, True
    while waiting or ready:
        if not ready:  # a later release comes up only after the mix
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[k]), k, j, release))
        due, k, j, release = heapq.heappop(ready)
        if j == blocks[k]:
            mixed = False
            continue
        yield k, j, release, due, slot, mixed
        slot += 1
        if j < blocks[k] - 1 or mixed:
            heapq.heappush(waiting, ((j + 1) * total // parts[k], k, j + 1))


def source_key(source: Column) -> Column:
    """The name of a source; a null one is named by the empty string."""
    return F.coalesce(source.cast("string"), F.lit(""))


def rank_key(id_: Column, rows: int) -> list[Column]:
    """Chunk, hash and id, which order the rows of a source in a mix of so many rows."""
    return [F.pmod(F.xxhash64(id_), F.lit(chunks_for(rows))).cast("int"), F.xxhash64(id_), id_]


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | Callable[[Mapping[str, int]], Mapping[str, float]] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    period: int = PERIOD,
    block_rows: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: id, source, share, block, release, deadline, slot, in_mix, position.

    The rows of a source, in the order of a hash of their id (ties: the id), form blocks of ``block_rows``, by default
    BLOCK_ROWS, or so many that all rows make no more than about BLOCKS blocks. Blocks run in the slots
    of run_schedule(), which follows the exact weights over the whole run. ``position`` numbers all rows gapless in
    slot order, ``share`` is the weight in whole shares of ``period``. While every source still has blocks
    (``in_mix``), any prefix holds each source to within one block of its weight; later rows keep their order, so no
    row is lost or repeated. A null source is a source of its own, named by the empty string. Sources that ``weights``
    does not name weigh as much as the least that it does; those of weight 0 take no part and come last, with no
    release or deadline (if no weight is above 0, all weigh the same). ``weights`` may be a function of the sources'
    rows; without it, a source weighs its rows to the power TEMPERATURE. Null ids and repeated rows are rows like any
    other; texts are not read; an empty table gives no rows; other columns are ignored.

    DataFrame operations only; the driver holds one row per source and PART blocks of the schedule, which it computes
    block by block, BLOCKS and one for each source at most.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    keys = docs.select(
        F.col(id_col).alias("__id"),
        source_key(F.col(source_col)).alias("__src"),
    )
    counts = {r["__src"]: r["n"] for r in keys.groupBy("__src").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    block_rows = block_rows or max(BLOCK_ROWS, -(-rows // BLOCKS))
    if callable(weights):
        weights = weights(counts)
    if weights is None:
        given = {k: n**TEMPERATURE for k, n in counts.items()}
    else:
        least = min((weights[k] for k in counts if weights.get(k, 0) > 0), default=0.0)
        given = {k: max(0.0, weights.get(k, least)) for k in counts}
    if not any(given.values()):
        given = dict.fromkeys(counts, 1.0)
    flat = _schedule(scratch, given, counts, period, block_rows)
    chunk, h, _ = rank_key(F.col("__id"), rows)
    keys = keys.withColumn("__h", h).withColumn("__chunk", chunk)
    ranked = running_totals(keys, ["__src"], "__chunk", ["__h", "__id"], "__i").withColumn("__b", F.expr(f"__i div {block_rows}"))
    return ranked.join(flat, (F.col("__src") == F.col("__s")) & (F.col("__b") == F.col("block"))).select(
        F.col("__id").alias(id_col),
        F.col("__src").alias(source_col),
        "share", "block", "release", "deadline", "slot", "in_mix",
        (F.col("__first") + F.col("__i") % block_rows).alias("position"),
    )


def _schedule(scratch: Scratch, given: Mapping[str, float], counts: Mapping[str, int], period: int, block_rows: int) -> DataFrame:
    """A row per block, with the position of its first row; written in parts of bounded size."""
    blocks = {k: -(-n // block_rows) for k, n in counts.items()}
    own = {k: v for k, v in given.items() if v > 0}
    parts, share = (whole_weights(own) if own else {}), shares(own, period)

    def rows():
        first = end = 0
        for k, j, release, due, slot, mixed in run_schedule(parts, blocks):
            yield k, share[k], j, min(release, MOST), min(due, MOST), min(slot, MOST), mixed, first
            first += min(block_rows, counts[k] - j * block_rows)
            end = slot + 1
        for k in sorted(set(blocks) - set(own)):
            for j in range(blocks[k]):
                yield k, 0, j, None, None, min(end, MOST), False, first
                first += min(block_rows, counts[k] - j * block_rows)
                end += 1

    spark, todo, out = scratch.spark, rows(), None
    schema = "__s string, share int, block long, release long, deadline long, slot long, in_mix boolean, __first long"
    while (part := list(islice(todo, PART))) or out is None:
        kept = scratch.keep(spark.createDataFrame(part, schema), "schedule")
        out = kept if out is None else out.unionByName(kept)
    return out


def falling(counts: Mapping[str, int]) -> dict[str, int]:
    """Target weights of the query: n for the first of n sources by name, down to 1 for the last, whatever their rows."""
    return {k: len(counts) - i for i, k in enumerate(sorted(counts))}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), falling)
