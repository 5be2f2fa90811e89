"""The service API: named tables, indexes and searches, as methods that return lazy frames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from .operators.coder import CoderConfig, train
from .operators.rows import ROW_ID
from .plans import search as plan
from .sources.arrow_stream import to_frame, to_frames
from .sources.catalog import Catalog, names_of

_DEFAULTS = {"metric": "l2"}


class Engine:
    """Options are arguments of each call and nothing is shared between calls. Changes return the engine itself."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.catalog = Catalog(spark, root)

    def make_table(self, name: str, data) -> "Engine":
        """Create or replace a table from a frame, an Arrow table or a record batch reader (written as it is read)."""
        if isinstance(data, pa.RecordBatchReader):
            self.catalog.make_table_of(name, to_frames(self.spark, data))
        else:
            self.catalog.make_table(name, data if isinstance(data, DataFrame) else to_frame(self.spark, data))
        return self

    def read_table(
        self,
        source: str | Sequence[str],
        coding: str | None = None,
        column: str | None = None,
        select: Sequence[str] | None = None,
        filter: Column | str | None = None,
        ordered: bool = False,
    ) -> DataFrame:
        """Rows of one or several tables: filtered, then projected. The code column is there if a coding and a column
        are named; filters may use it. ``ordered`` returns one table's rows in their order."""
        if coding is not None and column is not None:
            df = self.catalog.indexed(coding, source, column, hidden=True)
        else:
            df = self.catalog.table(source, ordinal=True)
        if filter is not None:
            df = df.filter(plan.condition(filter))
        shown = [c for c in df.columns if c not in (ROW_ID, plan.CELL)] if select is None else list(select)
        if ordered:
            if len(names_of(source)) > 1:
                raise ValueError("only one table has an order")
            df = df.orderBy(ROW_ID)
        return df.select(*shown)

    def drop_table(self, name: str) -> "Engine":
        self.catalog.drop_table(name)
        return self

    def make_index(self, name: str, source: str | Sequence[str], column: str, config: CoderConfig | dict | None = None) -> "Engine":
        """Train a coding on all sources together and index each of them."""
        if config is None or isinstance(config, dict):
            config = CoderConfig(**(_DEFAULTS | (config or {})))
        self.catalog.save_coding(name, train(self.catalog.table(source, ordinal=isinstance(source, str)), column, config))
        return self.sync_index(name, source, column)

    def sync_index(self, name: str, source: str | Sequence[str], column: str) -> "Engine":
        """Encode the sources again by the coding that exists."""
        self.catalog.make_index(name, source, column)
        return self

    def drop_index(self, name: str) -> "Engine":
        """Drop a coding and all indexes that are made by exactly this one."""
        self.catalog.drop_coding(name)
        for source, column, coding in self.catalog.indexes():
            if coding == name:
                self.catalog.drop_index(source, column, coding)
        return self

    def search(
        self,
        target,
        source: str | Sequence[str] | DataFrame,
        column: str,
        metric: str | None = None,
        coding: str | None = None,
        select: Sequence[str] | None = None,
        filter: Column | str | None = None,
        maxval: int | None = None,
        probes: int | None = None,
    ) -> DataFrame:
        """Rows with their distance to ``target``, the nearest ``maxval`` or all. Without a coding, or without probes,
        all rows are compared; with both only those in the ``probes`` nearest cells."""
        if isinstance(source, DataFrame):
            if coding is not None:
                raise ValueError("a coding needs named sources")
            return plan.search(source, column, target, metric, select, filter, maxval)
        own = None
        if coding is not None:
            df = self.catalog.indexed(coding, source, column, hidden=True)
            own = self.catalog.coding(coding)
        else:
            df = self.catalog.table(source, ordinal=True)
            probes = None
        if select is None:
            select = [c for c in df.columns if c not in (ROW_ID, plan.CELL)]
        return plan.search(df, column, target, metric, select, filter, maxval, own, probes, dim=self.catalog.vector_dim(source, column))

    def tables(self) -> list[str]:
        return self.catalog.tables()

    def codings(self) -> list[str]:
        return self.catalog.codings()

    def indexes(self) -> list[tuple[str, str, str]]:
        return self.catalog.indexes()

    def list(self) -> dict[str, list]:
        return {"tables": self.tables(), "codings": self.codings(), "indexes": self.indexes()}

    def remove(self) -> None:
        self.catalog.purge()
