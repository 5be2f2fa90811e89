"""From documents to training shards, stage by stage; each stage reads what the one before it wrote.

All stages but the last return the columns of documents (COLUMNS) and leave out any others. Rows with nulls in any
column, with empty or very long texts and repeated rows go through like others; what each stage does with them is in
its docstring. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import decontaminate, jaccard, mixing, tokenout
from vectide.llm import toxicity as toxic
from vectide.llm.common import Scratch, bit_table, marked, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Sources, and further sources of single ids, up to which rows look up their place in the mix; beyond, places are joined to the texts.
PLACES = 65536


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. A null or empty text holds no toxic word and stays; repeated rows
    are judged alike; the null in any other column is not looked at."""
    return toxic.keep_clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def _row_key(docs: DataFrame) -> Column:
    """A long per row with an id, equal where id and text are: the id itself, unless some id comes with two texts."""
    keyed = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"))
    if not keyed.groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").limit(1).count():
        return F.col("doc_id").cast("long")
    seed = 0
    while True:  # another seed if two ids or two texts share a key
        key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), "doc_id", "text"))
        keyed = docs.filter("doc_id is not null").select(key.alias("k"), "doc_id", F.xxhash64("text").alias("t"))
        ends = keyed.groupBy("k").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("doc_id", "t")))
        if not ends.filter("min_doc_id <> max_doc_id or min_t <> max_t").limit(1).count():
            return key
        seed += 1


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays: that of the smallest id.

    Repeats of an id with the same text are one document, those with another text are documents of their own. Rows
    without an id all stay.
    """
    scratch = Scratch(spark, "dedup")
    keyed = docs.withColumn("__row", _row_key(docs))
    classes = scratch.keep(jaccard.jaccard_classes(keyed, id_col="__row", scratch=scratch), "classes")
    classes = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    named = keyed.filter("doc_id is not null").groupBy("__row").agg(F.min("doc_id").alias("__id"))
    first = classes.join(named, F.col("doc_id") == F.col("__row")).groupBy("component_id").agg(F.min(F.struct("__id", "__row", "__n")).alias("x"))
    first = scratch.keep(first.select(F.col("x.__row").alias("__kept"), F.col("x.__n").alias("__n")), "first")
    # rows that surely stay are not shuffled: only those that share a bit with one that goes or repeats are joined
    doubtful = classes.select("doc_id").join(first.filter("__n = 1"), F.col("doc_id") == F.col("__kept"), "left_anti")
    bits = bit_table(doubtful.select(F.xxhash64("doc_id").alias("h")), "h", jaccard.ID_BITS)
    # a row without an id has no bit: it stays
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(keyed["__row"].cast("long")))
    sure = marked(keyed, key, bits, jaccard.ID_BITS, False).select(*COLUMNS)
    rest = marked(keyed, key, bits, jaccard.ID_BITS, True)
    first = first.hint("merge")  # however small, so that the shuffle grows with the input
    once = rest.join(first.filter("__n = 1"), F.col("__row") == F.col("__kept"), "left_semi").select(*COLUMNS)
    again = rest.join(first.filter("__n > 1"), F.col("__row") == F.col("__kept"), "left_semi")
    # repeats may differ in other columns: the least of them stays, so that each run keeps the same one
    again = again.groupBy("__row").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return sure.unionByName(once).unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; repeated rows are judged alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def _placed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[Column]]:
    """The rows with the number of their range (__range) and what sorts them within it, in the order of the mix.

    Texts are not joined: within a source, rows of a block follow each other in the order of mixing.rank_key(), so that the
    keys at which blocks begin, a row per block, tell each row its block. Rows of an id that comes earlier in another
    source are exceptions in that table. DataFrame operations only.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = mixing.mix(docs, scratch=scratch).groupBy("source", "doc_id")
    each = each.agg(F.min("position").alias("own"), F.min("block").alias("block"), F.count(F.lit(1)).alias("n"))
    each = scratch.keep(each, "order")
    rows = each.agg(F.sum("n")).first()[0] or 0
    rank = mixing.rank_key(F.col("doc_id"), rows)
    ranges = F.expr(f"cast(__at * {parts} div {max(1, rows)} as int)")  # positions are gapless: no sampling pass
    ids = each.groupBy("doc_id").agg(F.min(F.struct("own", "source", "block")).alias("first"), F.count(F.lit(1)).alias("n"))
    several = scratch.keep(ids.filter("n > 1"), "several")
    strays = several.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    if strays + each.select("source").distinct().count() > PLACES:
        order = ids.select(F.col("doc_id").alias("__id"), F.col("first.own").alias("__at"))
        placed = docs.select(*COLUMNS).join(order, F.col("doc_id").eqNullSafe(F.col("__id")))
        return placed.withColumn("__range", ranges), [F.col("__at"), *rank]

    def key(source: Column, when: int) -> Column:
        return F.struct(source.alias("source"), *(c.alias(f"k{i}") for i, c in enumerate(rank)), F.lit(when).alias("when"))

    # a block begins at (key, 0), rows look for (key, 1); an exception holds from (key, 1) to (key, 2)
    blocks = each.groupBy("source", "block").agg(F.min(key(F.col("source"), 0)).alias("k"), F.min("own").alias("at"))
    starts = blocks = scratch.keep(blocks, "blocks")
    if strays:
        stray = each.join(several.select(F.col("doc_id").alias("id"), "first"), F.col("doc_id").eqNullSafe(F.col("id")))
        stray = stray.filter("source <> first.source")
        at = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "at")
        there = stray.join(at, F.expr("s = first.source and b = first.block")).select(key(F.col("source"), 1).alias("k"), "at")
        back = stray.join(at, F.expr("s = source and b = block")).select(key(F.col("source"), 2).alias("k"), "at")
        starts = scratch.keep(blocks.select("k", "at").unionByName(there).unionByName(back), "starts")
    # one value in the plan: a scalar subquery would be sent to each task once per use
    known = f"starts_{uuid.uuid4().hex}"
    listed = starts.agg(F.sort_array(F.collect_list(F.struct("k", "at"))).alias("starts"))
    spark.sql(f"DECLARE VARIABLE {known} {listed.schema[0].dataType.simpleString()}")
    try:
        spark.sql(f"SET VARIABLE {known} = (SELECT starts FROM {{listed}})", listed=listed)
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(starts.count().bit_length()))), F.lit(0))
        # by halving: how many starts are not beyond the key
        found = F.aggregate(steps, F.lit(0), lambda i, s: i + F.when(F.get(F.expr(known), i + s - 1)["k"] <= F.col("__key"), s).otherwise(0))
        placed = docs.select(*COLUMNS, key(mixing.source_key(F.col("source")), 1).alias("__key"))
        placed = placed.select(*COLUMNS, F.get(F.expr(known), found - 1)["at"].alias("__at"))
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE {known}")
    return placed.withColumn("__range", ranges), [F.col("__at"), *rank]


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixing schedule.

    A null source is a source of its own. Rows of one id, and rows without an id, come together, at the first place
    that the schedule gives to one of them. Texts are not looked at.
    """
    placed, order = _placed(docs, Scratch(spark, "mixture"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionById(parts, "__range").sortWithinPartitions(*order).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, and a row per piece of a document in them.

    Sequences are permuted inside each shard's run of them, so that the order of the mix holds from shard to shard. A
    null or empty text is the end of a document alone; null ids and repeated rows are rows like any other.
    """
    return tokenout.shards(docs, window=tokenout.SHARD_SEQS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("token_binary_output", shards),
]

#: The label model, the components and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        nxt = scratch.keep(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "_scratch_at"):
            scratch.drop(docs)
        docs = nxt
    return docs
