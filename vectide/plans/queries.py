"""The engine's registered queries over the driver's tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, normalize
from ..operators.coder import CoderConfig, Coding, centroid_update
from ..operators.rows import random_batches, union_all, zip_columns
from ..operators.tensors import dequantize, parameters, quantize
from .search import CODE, DISTANCE, probe_mask, read, search, search_many

Query = Callable[[SparkSession, str], DataFrame]
K = 10
#: The codebooks of the code queries: the vectors of ids 0-7, two books of four.
BOOKS, SLOTS = 2, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(df: DataFrame, vec_id: int = 0) -> list[float]:
    return list(df.filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """The distance rounded to 6 digits, under a plain name."""
    return df.select(*names, F.round(F.col(DISTANCE), 6).alias("dist"))


def _scaled(df: DataFrame) -> DataFrame:
    """Vectors of different lengths: each times 1 + label."""
    return df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))))


def knn(metric: str, spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    q = _query(df)
    return _rounded(search(_scaled(df) if scaled else df, "embedding", q, metric, maxval=K, tie="vec_id", exact_type=False), "vec_id", "label")


def knn_filtered(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return _rounded(search(df, "embedding", _query(df), "l2", filter="label in (1, 3, 5)", maxval=K, tie="vec_id", exact_type=False), "vec_id", "label")


def knn_selected(spark, sf_dir):
    """The vector and the filtered column need not be selected."""
    df = table(spark, sf_dir, "embeddings")
    return _rounded(search(df, "embedding", _query(df), "cosine", select=["vec_id"], filter=F.col("label") > 4, maxval=K, tie="vec_id", exact_type=False), "vec_id")


def distance_all(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return _rounded(search(df, "embedding", _query(df), "dot", select=["vec_id"], exact_type=False), "vec_id")


def union_all_search(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    both = union_all(df, df.filter("label = 2"))
    return _rounded(search(both, "embedding", _query(df), "l2", maxval=K, tie="vec_id", exact_type=False), "vec_id", "label")


def coding_of(df: DataFrame, metric: str = "l2") -> Coding:
    rows = df.filter(F.col("vec_id") < BOOKS * SLOTS).select("vec_id", "embedding").orderBy("vec_id").limit(BOOKS * SLOTS).collect()
    books = np.array([r.embedding for r in rows], np.float64).reshape(BOOKS, SLOTS, -1)
    return Coding(books, CoderConfig(metric=metric, codebook_size=SLOTS, num_codebooks=BOOKS))


def _coded(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    coding = coding_of(df)
    return df.withColumn(CODE, coding.code(F.col("embedding"))), coding, _query(df, 9)


def encode_2x4(spark, sf_dir):
    return _coded(spark, sf_dir)[0].select("vec_id", F.col(CODE).alias("code"))


def code_histogram(spark, sf_dir):
    return _coded(spark, sf_dir)[0].groupBy(F.col(CODE).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def probe_codes(spark, sf_dir):
    _, coding, q = _coded(spark, sf_dir)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(coding.ranked(q, 4))], "rank long, code long")


def ann(probes: int, spark, sf_dir):
    df, coding, q = _coded(spark, sf_dir)
    near = search(df, "embedding", q, None, coding=coding, probes=probes, maxval=K, tie="vec_id", exact_type=False)
    return near.select("vec_id", F.col(CODE).alias("code"), F.round(F.col(DISTANCE), 6).alias("dist"))


def read_indexed(spark, sf_dir):
    df, coding, q = _coded(spark, sf_dir)
    return read(df, [CODE, "vec_id"], probe_mask(coding, q, 2, False) & (F.col("label") != 0)).withColumnRenamed(CODE, "code")


def centroids(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    new = centroid_update(df, "embedding", coding_of(df))
    return new.select(F.col("book").cast("long").alias("book"), F.col("slot").cast("long").alias("slot"), "members", F.posexplode("centroid").alias("at", "x")).select(
        "book", "slot", "members", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x")
    )


def normalized(spark, sf_dir):
    df = _scaled(table(spark, sf_dir, "embeddings"))
    flat = df.select("vec_id", F.posexplode(normalize(F.col("embedding"))).alias("at", "x"))
    return flat.select("vec_id", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x"))


def quantized(spark, sf_dir):
    df = quantize(table(spark, sf_dir, "embeddings"), "embedding")
    flat = df.select("vec_id", F.posexplode("embedding").alias("at", "q"))
    return flat.select("vec_id", F.col("at").cast("long").alias("at"), F.col("q").cast("long").alias("q"))


def dequantized(spark, sf_dir):
    df = dequantize(quantize(table(spark, sf_dir, "embeddings"), "embedding"), "embedding")
    flat = df.select("vec_id", F.posexplode("embedding").alias("at", "x"))
    return flat.select("vec_id", F.col("at").cast("long").alias("at"), F.round(F.col("x").cast("double"), 5).alias("x"))


def quantize_parameters(spark, sf_dir):
    scale, shift = parameters(table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(round(scale, 9), shift)], "scale double, shift long")


def batch_sizes(spark, sf_dir):
    batches = random_batches(table(spark, sf_dir, "orders").select("o_orderkey"), 128, seed=7)
    return batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("distinct_rows"))


def read_orders(spark, sf_dir):
    return read(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"], "o_totalprice > 1000 and o_orderpriority is not null")


def read_events(spark, sf_dir):
    return read(table(spark, sf_dir, "events"), ["event_type", "event_id"], (F.col("value") > 10) & F.col("user_id").isin(1, 2, 3, 5, 8, 13))


def positional_zip(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    first = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    second = df.select(F.col("vec_id").alias("again"), (F.col("label") + 1).alias("label"))
    return zip_columns(first, second).select("vec_id", "label", "again")


def top_k_many(spark, sf_dir):
    """The nearest 3 of each of the vectors of ids below 5."""
    df = table(spark, sf_dir, "embeddings")
    queries = df.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("target"))
    near = search_many(df, "embedding", queries, "l2", 3, "vec_id")
    return near.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round(DISTANCE, 6).alias("dist"))


def nested_field(spark, sf_dir):
    """A field inside a struct column, found by its path."""
    df = table(spark, sf_dir, "part").select(F.struct("p_partkey", F.struct("p_size", "p_brand").alias("b")).alias("t"))
    return df.select(F.col("t.p_partkey").alias("p_partkey"), F.col("t.b.p_size").alias("p_size"))


QUERIES: dict[str, Query] = {
    **{f"knn_{m}": partial(knn, m) for m in METRICS},
    **{f"knn_{m}_scaled": partial(knn, m, scaled=True) for m in METRICS},
    "knn_filtered": knn_filtered,
    "knn_selected": knn_selected,
    "distance_all": distance_all,
    "union_all_search": union_all_search,
    "encode_2x4": encode_2x4,
    "code_histogram": code_histogram,
    "probe_codes": probe_codes,
    "ann_2x4_p4": partial(ann, 4),
    "ann_all_probes": partial(ann, SLOTS**BOOKS),
    "read_indexed": read_indexed,
    "centroid_update": centroids,
    "normalize": normalized,
    "quantize": quantized,
    "dequantize": dequantized,
    "quantize_parameters": quantize_parameters,
    "batch_sizes": batch_sizes,
    "read_orders": read_orders,
    "read_events": read_events,
    "positional_zip": positional_zip,
    "top_k_many": top_k_many,
    "nested_field": nested_field,
}

# SQL

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
_SQL_DISTANCE = {
    "l2": "list_distance({v}, {q})",
    "dot": "-list_inner_product({v}, {q})",
    "cosine": "0.5 - 0.5 * list_cosine_similarity({v}, {q})",
}


def _d(metric: str, v: str = "embedding::DOUBLE[]", q: str = _Q.format(0)) -> str:
    return _SQL_DISTANCE[METRICS[metric]].format(v=v, q=q)


def _knn_sql(metric: str, columns: str = "vec_id, label", where: str = "true", v: str = "embedding::DOUBLE[]", source: str = "embeddings") -> str:
    return f"SELECT {columns}, round(d, 6) AS dist FROM (SELECT *, {_d(metric, v)} AS d FROM {source} WHERE {where}) ORDER BY d, vec_id LIMIT {K}"


_LONG = "list_transform(embedding::DOUBLE[], lambda x: x * (1 + label))"
_BOOKS = f"books AS (SELECT vec_id // {SLOTS} AS book, vec_id % {SLOTS} AS slot, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < {BOOKS * SLOTS})"
_DIGITS = f"""{_BOOKS},
digits AS (
  SELECT vec_id, book, slot FROM (
    SELECT e.vec_id, b.book, b.slot, row_number() OVER (PARTITION BY e.vec_id, b.book ORDER BY list_distance(e.embedding::DOUBLE[], b.c), b.slot) AS r
    FROM embeddings e, books b) WHERE r = 1),
codes AS (SELECT vec_id, sum(slot * CASE book WHEN 0 THEN {SLOTS} ELSE 1 END)::BIGINT AS code FROM digits GROUP BY vec_id)"""
_RANKED = f"""ranked AS (
  SELECT a.slot * {SLOTS} + b.slot AS code,
         row_number() OVER (ORDER BY list_distance(a.c, q) + list_distance(b.c, q), a.slot * {SLOTS} + b.slot) AS rank
  FROM books a, books b, (SELECT {_Q.format(9)} AS q) WHERE a.book = 0 AND b.book = 1)"""
_LEVELS = f"""p AS (SELECT (greatest(max(x), 0) - least(min(x), 0)) / 127 AS s, least(min(x), 0) AS lo FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)),
levels AS (
  SELECT vec_id, i - 1 AS at, greatest(0, least(255, round_even(embedding[i]::DOUBLE / s, 0) + round_even(-lo / s, 0)))::BIGINT AS q, s, round_even(-lo / s, 0) AS z
  FROM embeddings, p, range(1, 4097) r(i) WHERE i <= len(embedding))"""


def _ann_sql(probes: int) -> str:
    return f"""WITH {_DIGITS}, {_RANKED}
SELECT vec_id, code, round(d, 6) AS dist FROM (
  SELECT vec_id, code, {_d("l2", q=_Q.format(9))} AS d FROM embeddings JOIN codes USING (vec_id)
  WHERE code IN (SELECT code FROM ranked WHERE rank <= {probes})) ORDER BY d, vec_id LIMIT {K}"""


SQL: dict[str, str] = {
    **{f"knn_{m}": _knn_sql(m) for m in METRICS},
    **{f"knn_{m}_scaled": _knn_sql(m, v=_LONG) for m in METRICS},
    "knn_filtered": _knn_sql("l2", where="label IN (1, 3, 5)"),
    "knn_selected": _knn_sql("cosine", "vec_id", "label > 4"),
    "distance_all": f"SELECT vec_id, round({_d('dot')}, 6) AS dist FROM embeddings",
    "union_all_search": _knn_sql("l2", source="(SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE label = 2)"),
    "encode_2x4": f"WITH {_DIGITS} SELECT vec_id, code FROM codes",
    "code_histogram": f"WITH {_DIGITS} SELECT code, count(*) AS n FROM codes GROUP BY code",
    "probe_codes": f"WITH {_BOOKS}, {_RANKED} SELECT rank, code FROM ranked WHERE rank <= 4",
    "ann_2x4_p4": _ann_sql(4),
    "ann_all_probes": _ann_sql(SLOTS**BOOKS),
    "read_indexed": f"WITH {_DIGITS}, {_RANKED} SELECT code, vec_id FROM embeddings JOIN codes USING (vec_id) WHERE code IN (SELECT code FROM ranked WHERE rank <= 2) AND label <> 0",
    "centroid_update": f"""WITH {_DIGITS}, flat AS (
  SELECT d.book, d.slot, i - 1 AS at, e.embedding[i]::DOUBLE AS x, 1 AS m FROM digits d JOIN embeddings e USING (vec_id), range(1, 4097) r(i) WHERE i <= len(e.embedding)
  UNION ALL SELECT book, slot, i - 1, c[i], 0 FROM books, range(1, 4097) r(i) WHERE i <= len(c))
SELECT book, slot, sum(m)::BIGINT AS members, "at", round(avg(x), 6) AS x FROM flat GROUP BY book, "at", slot""",
    "normalize": f"""SELECT vec_id, i - 1 AS at, round(v[i] / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) AS x
FROM (SELECT vec_id, {_LONG} AS v FROM embeddings), range(1, 4097) r(i) WHERE i <= len(v)""",
    "quantize": f'WITH {_LEVELS} SELECT vec_id, "at", q FROM levels',
    "dequantize": f'WITH {_LEVELS} SELECT vec_id, "at", round((s * (q - z))::FLOAT::DOUBLE, 5) AS x FROM levels',
    "quantize_parameters": f"WITH {_LEVELS} SELECT round(s, 9) AS scale, round_even(-lo / s, 0)::BIGINT AS shift FROM p",
    "batch_sizes": "SELECT i AS batch_id, 128::BIGINT AS n, 128::BIGINT AS distinct_rows FROM range((SELECT count(*) // 128 FROM orders)) r(i)",
    "read_orders": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 1000 AND o_orderpriority IS NOT NULL",
    "read_events": "SELECT event_type, event_id FROM events WHERE value > 10 AND user_id IN (1, 2, 3, 5, 8, 13)",
    "positional_zip": "SELECT vec_id, label + 1 AS label, vec_id AS again FROM embeddings",
    "top_k_many": f"""SELECT query_id, rank, vec_id, round(d, 6) AS dist FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id < 5) WHERE rank <= 3""",
    "nested_field": "SELECT p_partkey, p_size FROM part",
}

