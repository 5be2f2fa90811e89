"""Serve a root folder to remote clients through Spark Connect.

    python -m vectide.serve --root /data --host 0.0.0.0 --port 9001

Clients open SparkSession.builder.remote("sc://host:port"). The server needs Spark's Connect classes, which the full
Spark distribution carries; clients need grpc.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources.catalog import Catalog

SERVICE = "org.apache.spark.sql.connect.service.SparkConnectService"


def launch(root: str, host: str = "127.0.0.1", port: int = 9001, wait: bool = True) -> SparkSession:
    spark = (
        SparkSession.builder.config("spark.connect.grpc.binding.address", host).config("spark.connect.grpc.binding.port", str(port))
        .config("spark.vectide.root", root).getOrCreate()
    )
    Catalog(spark, root)
    jvm = spark.sparkContext._jvm
    try:
        service = jvm.java.lang.Class.forName(SERVICE)
    except Exception as e:
        raise RuntimeError("this Spark has no Connect server") from e
    del service
    jvm.org.apache.spark.sql.connect.service.SparkConnectService.start(spark.sparkContext._jsc.sc())
    if wait:
        import threading

        threading.Event().wait()
    return spark


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--root", required=True)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=9001)
    a = p.parse_args()
    launch(a.root, a.host, a.port)


if __name__ == "__main__":
    main()
