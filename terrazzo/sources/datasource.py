"""Extensions of Spark in Python: a data source over the trees that live in a folder, and a table function of a window's cells.

The source reads a version's table straight from its manifest. Filters on the code that Spark pushes down say which parts can hold
rows, so the others' files are never opened, and bound what is read of those that are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import zorder as Z
from ..functions.region import Region


class TreeSource(DataSource):
    """format("terrazzo_tree") with options folder, bits, coarse, and, if it isn't `entries` of the newest version, table and version."""

    @classmethod
    def name(cls) -> str:
        return "terrazzo_tree"

    def _manifest(self) -> dict:
        where, root = pafs.FileSystem.from_uri(self.options["folder"])
        known = sorted(f.path for f in where.get_file_info(pafs.FileSelector(f"{root}/manifests")) if not f.base_name.startswith("."))
        path = f"{root}/manifests/{int(self.options['version']):09d}" if "version" in self.options else known[-1]
        with where.open_input_stream(path) as f:
            return json.loads(f.read())

    def schema(self) -> str:
        return self._manifest()["schemas"][self.options.get("table", "entries")]

    def reader(self, schema) -> TreeReader:
        parts = self._manifest()["tables"].get(self.options.get("table", "entries"), {})
        return TreeReader(self.options["folder"], parts, 2 * (int(self.options["bits"]) - int(self.options["coarse"])), schema.fieldNames())


class TreeReader(DataSourceReader):
    """Reads the parts whose leaves can hold codes from `low` to `high`."""

    def __init__(self, folder: str, parts: dict[str, list[str]], shift: int, names: list[str]):
        self.folder, self.parts, self.shift, self.names = folder, parts, shift, names
        self.low, self.high = 0, (1 << 62) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if getattr(f, "attribute", None) == ("z",) and "z" in self.names:
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value)
            yield f  # Spark tests the rows too

    def _can_hold(self, part: int) -> bool:
        """A leaf that begins in a part ends, at most, where a cell that begins there can end: four to the power of its trailing zero pairs."""
        run = part & -part if part else 1 << 62
        run = run if not part or (run.bit_length() - 1) % 2 == 0 else run >> 1
        return part << self.shift <= self.high and (not part or (part + run) << self.shift > self.low)

    def partitions(self) -> list[InputPartition]:
        chosen = [p for k, paths in self.parts.items() if self._can_hold(int(k)) for p in paths]
        return [InputPartition(p) for p in chosen] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        where, root = pafs.FileSystem.from_uri(self.folder)
        for info in where.get_file_info(pafs.FileSelector(f"{root}/{partition.value}")):
            if info.base_name.endswith(".parquet"):
                with where.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(columns=self.names):
                        yield batch.filter(pc.and_(pc.greater_equal(batch["z"], self.low), pc.less_equal(batch["z"], self.high))) if "z" in self.names else batch


def register(spark: SparkSession, region: Region, bits: int) -> None:
    """The data source, and the table function window_cells(bottom, up, lft, rgt, depth) of the cells that a window meets."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    n = 1 << bits

    @F.udtf(returnType="cell bigint")
    class WindowCells:
        def eval(self, bottom: float, up: float, lft: float, rgt: float, depth: int):
            if None in (bottom, up, lft, rgt) or bottom > up or lft > rgt or bottom > region.up or up < region.bottom or lft > region.right or rgt < region.left:
                return
            at = lambda v, low, extent: max(0, min(n - 1, round((v - low) * n / extent))) >> (bits - depth)
            for x in range(at(lft, region.left, region.width), at(rgt, region.left, region.width) + 1):
                for y in range(at(bottom, region.bottom, region.height), at(up, region.bottom, region.height) + 1):
                    yield (sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(depth)),)

    spark.udtf.register("window_cells", WindowCells)


def code_range(window: Region, region: Region, bits: int) -> str:
    """SQL: the bounds on the code of a window's points."""
    return f"z BETWEEN {Z.code_of(window.left, window.bottom, region, bits)} AND {Z.code_of(window.right, window.up, region, bits)}"
