"""Named tables, codebooks and indexes under one root folder.

sources/<name>/          Parquet versions of a table and its description
codings/<name>/          codebooks: a small Parquet table and a JSON configuration
indexes/<source>/<column>/<coding>/   the source's rows with their codes, partitioned by cell

A table is replaced by writing a new version and then its description, so readers see the old rows or the new ones.
An index remembers the version and the coding it was made from; reading it after either changed raises.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..operators.coder import CoderConfig, Coding, books_frame
from ..operators.rows import ROW_ID, SLOT, union_all
from ..plans.search import CELL, CELLS, CODE
from .storage import Storage

MARK, META = "_vectide.json", "_table.json"
_NAME = re.compile(r"[^/\s:][^/:]*(/[^/:]+)*")


class StaleIndex(ValueError):
    """The table or the codebook was replaced after the index was built."""


def checked(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name) or any(p in ("", ".", "..") or p.startswith("_") for p in name.split("/")):
        raise ValueError(f"invalid name {name!r}: parts joined by '/', without ':' and not starting with '_'")
    return name


def names_of(source: str | Sequence[str]) -> list[str]:
    return [checked(x) for x in ([source] if isinstance(source, str) else source)]


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.store = Storage(spark, root)
        if not self.store.exists(MARK):
            self.store.write_json(MARK, {"format": 1})

    # tables

    def make_table(self, name: str, df: DataFrame) -> DataFrame:
        """Create or replace a table. Row order, also a sorted frame's, is kept by a hidden ordinal. The version before
        stays until the next one comes, so that frames which were planned on it can still run."""
        return self.make_table_of(name, iter([df]))

    def make_table_of(self, name: str, frames: Iterator[DataFrame]) -> DataFrame:
        """make_table() from the rows of frames of one schema, one after the other; each is written before the next is
        asked for."""
        at = f"sources/{checked(name)}"
        if any(self.store.exists(f"sources/{'/'.join(name.split('/')[:i])}/{META}") for i in range(1, name.count("/") + 1)):
            raise ValueError(f"{name!r} lies inside another table")
        if not self.store.exists(f"{at}/{META}") and next(self.store.walk(at, META), None):
            raise ValueError(f"{name!r} holds other tables")
        old = self.store.read_json(f"{at}/{META}") if self.store.exists(f"{at}/{META}") else None
        version, schema, rows = uuid.uuid4().hex, None, 0
        shifts: list[int] = []  # by written partition: from the number that its rows carry to their ordinal
        for df in frames:
            hidden = [c for c in df.columns if c in (ROW_ID, CODE, CELL)]
            if hidden:
                raise ValueError(f"reserved column names: {hidden}")
            # counted as written, in one run: a sorted frame may be cut into other partitions each time that it runs
            first = F.lit(len(shifts) << SLOT)
            df.withColumn(ROW_ID, F.monotonically_increasing_id() + first).write.mode("append").parquet(self.store.full(f"{at}/v-{version}"))
            new = self.spark.read.schema(f"{ROW_ID} long").parquet(self.store.full(f"{at}/v-{version}")).filter(F.col(ROW_ID) >= first)
            sizes = {r.p: r.n for r in new.groupBy(F.shiftright(ROW_ID, SLOT).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
            for p in range(len(shifts), max(sizes, default=-1) + 1):
                shifts.append(rows - (p << SLOT))
                rows += sizes.get(p, 0)
            schema = schema or df.schema
        dims = self._dims(f"{at}/v-{version}", schema)
        self.store.write_json(f"{at}/{META}", {"version": version, "schema": schema.jsonValue(), "dims": dims, "shifts": shifts})
        self._keep(at, version, old and old["version"])
        return self.table(name)

    def _keep(self, at: str, *versions: str | None) -> None:
        """Delete all other versions."""
        for child, folder in self.store.children(at):
            if folder and child.startswith("v-") and child.removeprefix("v-") not in versions:
                self.store.delete(f"{at}/{child}")

    def _dims(self, at: str, schema: StructType) -> dict[str, int]:
        """Length of each vector column whose vectors are all of one length."""
        arrays = [f.name for f in schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() in ("float", "double", "integer", "long", "short", "byte")]
        if not arrays:
            return {}
        df = self.spark.read.parquet(self.store.full(at))
        got = df.agg(*(x for i, c in enumerate(arrays) for x in (F.min(F.size(F.col(f"`{c}`"))).alias(f"a{i}"), F.max(F.size(F.col(f"`{c}`"))).alias(f"b{i}")))).first()
        return {c: got[f"a{i}"] for i, c in enumerate(arrays) if got[f"a{i}"] is not None and got[f"a{i}"] == got[f"b{i}"]}

    def meta(self, name: str) -> dict:
        at = f"sources/{checked(name)}/{META}"
        if not self.store.exists(at):
            raise ValueError(f"no table {name!r}")
        return self.store.read_json(at)

    def _scan(self, name: str) -> DataFrame:
        meta = self.meta(name)
        schema = StructType.fromJson(meta["schema"]).add(ROW_ID, "long")
        df = self.spark.read.schema(schema).parquet(self.store.full(f"sources/{name}/v-{meta['version']}"))
        if meta.get("shifts"):  # a constant array
            shifts = F.split(F.lit(",".join(map(str, meta["shifts"]))), ",").cast("array<bigint>")
            df = df.withColumn(ROW_ID, F.col(ROW_ID) + F.element_at(shifts, (F.shiftright(ROW_ID, SLOT) + 1).cast("int")))
        return df

    def table(self, source: str | Sequence[str], ordinal: bool = False) -> DataFrame:
        """A table, or the rows of several of one schema. ``ordinal`` shows the hidden row number."""
        frames = [self._scan(n) for n in names_of(source)]
        out = union_all(*frames)
        return out if ordinal else out.drop(ROW_ID)

    def ordered(self, name: str) -> DataFrame:
        """A table in the order of its rows."""
        return self._scan(name).orderBy(ROW_ID).drop(ROW_ID)

    def tables(self) -> list[str]:
        return list(self.store.walk("sources", META))

    def drop_table(self, name: str) -> None:
        """Drop a table and the indexes built on it; nothing happens if it does not exist."""
        if self.store.exists(f"sources/{checked(name)}/{META}"):
            self.store.delete(f"sources/{name}")
            for index in self.indexes():
                if index[0] == name:
                    self.drop_index(*index)

    # codebooks

    def save_coding(self, name: str, coding: Coding) -> None:
        at = f"codings/{checked(name)}"
        version = uuid.uuid4().hex
        books_frame(self.spark, coding).coalesce(1).write.parquet(self.store.full(f"{at}/v-{version}"))
        old = self.store.read_json(f"{at}/{META}") if self.store.exists(f"{at}/{META}") else None
        self.store.write_json(f"{at}/{META}", coding.meta() | {"version": version})
        self._keep(at, version, old and old["version"])

    def coding_meta(self, name: str) -> dict:
        at = f"codings/{checked(name)}/{META}"
        if not self.store.exists(at):
            raise ValueError(f"no coding {name!r}")
        return self.store.read_json(at)

    def coding(self, name: str) -> Coding:
        meta = self.coding_meta(name)
        config = CoderConfig(**{k: meta[k] for k in CoderConfig.__dataclass_fields__})
        rows = self.spark.read.schema("book int, slot int, centroid array<double>").parquet(self.store.full(f"codings/{name}/v-{meta['version']}"))
        books = np.zeros((config.num_codebooks, config.codebook_size, meta["dim"]))
        for r in rows.collect():
            books[r.book, r.slot] = r.centroid
        return Coding(books, config)

    def codings(self) -> list[str]:
        return list(self.store.walk("codings", META))

    def drop_coding(self, name: str) -> None:
        if self.store.exists(f"codings/{checked(name)}/{META}"):
            self.store.delete(f"codings/{name}")

    # indexes

    def _index_at(self, source: str, column: str, coding: str) -> str:
        return f"indexes/{checked(source)}/@{column}/{checked(coding)}"

    def make_index(self, coding: str, source: str | Sequence[str], column: str) -> None:
        """(Re)build the index of each source: its rows with their codes, clustered by cell."""
        own = self.coding(coding)
        for name in names_of(source):
            meta, version = self.meta(name), self.coding_meta(coding)["version"]
            dim = meta["dims"].get(column)
            if dim is not None and dim != own.dim:
                raise ValueError(f"{name}.{column} has length {dim}, coding {coding!r} {own.dim}")
            rows = self._scan(name).withColumn(CODE, own.code(F.col(column)))
            rows = rows.withColumn(CELL, F.pmod(F.col(CODE), F.lit(CELLS)).cast("int"))
            at = self._index_at(name, column, coding)
            old = self.store.read_json(f"{at}/{META}") if self.store.exists(f"{at}/{META}") else None
            build = uuid.uuid4().hex
            # rebalancing splits a large cell over several tasks and files
            rows.hint("rebalance", CELL).write.partitionBy(CELL).parquet(self.store.full(f"{at}/v-{build}"))
            self.store.write_json(f"{at}/{META}", {"build": build, "table": meta["version"], "coding": version})
            self._keep(at, build, old and old["build"])

    def indexed(self, coding: str, source: str | Sequence[str], column: str, hidden: bool = False) -> DataFrame:
        """Source columns and the code; with ``hidden`` also the ordinal and the partition column."""
        frames = []
        for name in names_of(source):
            at = self._index_at(name, column, coding)
            if not self.store.exists(f"{at}/{META}"):
                raise ValueError(f"no index {coding!r} on {name}.{column}")
            own, meta = self.store.read_json(f"{at}/{META}"), self.meta(name)
            if own["table"] != meta["version"] or own["coding"] != self.coding_meta(coding)["version"]:
                raise StaleIndex(f"index {coding!r} on {name}.{column} is older than its table or coding; sync it")
            schema = StructType.fromJson(meta["schema"]).add(ROW_ID, LongType()).add(CODE, LongType()).add(CELL, IntegerType())
            frames.append(self.spark.read.schema(schema).parquet(self.store.full(f"{at}/v-{own['build']}")))
        out = union_all(*frames)
        return out if hidden else out.drop(ROW_ID, CELL)

    def indexes(self) -> list[tuple[str, str, str]]:
        """(source, column, coding) of every index."""
        out = []
        for path in self.store.walk("indexes", META):
            source, _, rest = path.partition("/@")
            column, _, coding = rest.partition("/")
            out.append((source, column, coding))
        return out

    def drop_index(self, source: str, column: str, coding: str) -> None:
        at = self._index_at(source, column, coding)
        if self.store.exists(f"{at}/{META}"):
            self.store.delete(at)

    def vector_dim(self, source: str | Sequence[str], column: str) -> int | None:
        dims = {self.meta(n)["dims"].get(column) for n in names_of(source)}
        return dims.pop() if len(dims) == 1 else None

    def purge(self) -> None:
        """Delete the whole root; refused where it is no catalog."""
        if not self.store.exists(MARK):
            raise ValueError(f"{self.store.root} is no catalog root")
        self.store.delete("")
