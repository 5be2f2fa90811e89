"""Longest-processing-time sharding: groups that stay together, sorted by size, go to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks_for, running_totals, table

#: Groups of more than 1/HEAVY of the rows (fewer than HEAVY of them) reach their rows by broadcast.
HEAVY = 8192
#: Sizes whose places are handed on together.
PART = 1 << 16


def schedule(sizes: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each (size, groups of that size), largest size first: how many of these groups each shard takes.

    Each group goes to the least-loaded shard (ties: shard number), as a heap over single groups would place it. Groups
    of one size are placed together: shards are filled up to the load of the next one first, then all shards in play
    take turns, and the heap deals the rest of a turn.
    """
    load = [0] * n_shards
    for size, groups in sizes:
        took, left = [0] * n_shards, groups
        order = sorted(range(n_shards), key=lambda s: (load[s], s))
        steps = lambda level: [max(0, -(-(level - load[s]) // size)) for s in order]  # noqa: E731  groups that start below a level
        play = 1
        while play < n_shards and sum(steps(load[order[play]])) <= groups:
            play += 1
        for s, n in zip(order, steps(load[order[play - 1]]), strict=True):
            took[s] += n
            left -= n
        for s in order[:play]:
            took[s] += left // play
        heap = [(load[s] + took[s] * size, s) for s in order[:play]]
        heapq.heapify(heap)
        for _ in range(left % play):
            at, s = heapq.heappop(heap)
            took[s] += 1
            heapq.heappush(heap, (at + size, s))
        for s in range(n_shards):
            load[s] += took[s] * size
        yield size, took


def lpt_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text plus 1. Equal texts are one group and share a shard; a null text counts as
    the empty text (size 1, crc 0). Every group is scheduled, largest first; ties go by the texts' SHA-256. The driver
    holds a row per different size of groups, of which there are at most the square root of twice all bytes. Slots are
    gapless from 0 in each shard, in the order of id and crc inside a hash chunk. Null ids and repeated rows are rows
    like any other, a very long text is a group like any other; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lpt")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = scratch.keep(
        docs.select(
            F.col(id_col).alias("__id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("__group"),
        ),
        "keys",
    )
    groups = keys.groupBy("__group").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__n"))
    groups = scratch.keep(groups, "groups")
    sizes = groups.groupBy("__bytes").agg(F.count(F.lit(1)).alias("__groups"), F.sum("__n").alias("__rows")).toArrow().sort_by([("__bytes", "descending")])
    counts = sizes.column("__groups").to_pylist()
    rows = sum(sizes.column("__rows").to_pylist())
    plan = _plan(scratch, schedule(zip(sizes.column("__bytes").to_pylist(), counts, strict=True), n_shards))
    groups = groups.withColumn("__chunk", F.pmod(F.xxhash64("__group"), F.lit(chunks_for(max(counts, default=0)))).cast("int"))
    ranked = running_totals(groups, ["__bytes"], "__chunk", ["__group"], "__rank")
    placed = scratch.keep(
        ranked.join(plan, F.col("__bytes") == F.col("__size")).select(
            F.col("__group").alias("__g"), "__n", F.size(F.filter("__upto", lambda x: x <= F.col("__rank"))).alias("shard")
        ),
        "placed",
    )
    heavy = F.col("__n") * HEAVY > rows
    # bounded: fewer than HEAVY groups hold more than 1/HEAVY of the rows
    large = F.broadcast(placed.filter(heavy).select("__g", "shard"))
    same = F.col("__group") == F.col("__g")
    dealt = keys.join(large, same).unionByName(keys.join(large.select("__g"), same, "left_anti").join(placed.filter(~heavy).select("__g", "shard"), same))
    n_chunks = chunks_for(rows // max(1, n_shards))
    dealt = dealt.select("__id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("__id", "__group"), F.lit(n_chunks)).cast("int").alias("__chunk"))
    dealt = scratch.keep(dealt, "dealt")
    return running_totals(dealt, ["shard"], "__chunk", ["__id", "text_crc32"], "slot").select(
        F.col("__id").alias(id_col), "size", "text_crc32", "shard", "slot"
    )


def _plan(scratch: Scratch, placed: Iterator[tuple[int, list[int]]]) -> DataFrame:
    """(size, ranks of its groups below which each shard's share ends), written in parts of bounded size."""
    from itertools import accumulate, islice

    out = None
    while (part := [(size, list(accumulate(took))) for size, took in islice(placed, PART)]) or out is None:
        kept = scratch.keep(scratch.spark.createDataFrame(part, "__size long, __upto array<long>"), "plan")
        out = kept if out is None else out.unionByName(kept)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
