"""Reading and writing point tables, query sets, index tables and results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import Region


def csv_points(spark: SparkSession, path: str, schema: str, x: str, y: str, time: str, time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """(x, y, t) from CSV with a header, sorted by time; t in epoch seconds, whatever the session's time zone. Only the three columns are parsed."""
    rows = spark.read.schema(schema).option("header", True).csv(path).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(time).alias("_t"))
    stamp = F.call_function("to_timestamp_ntz", "_t", F.lit(time_format))
    return rows.select("x", "y", epoch_seconds(stamp).alias("t")).orderBy("t")


def epoch_seconds(stamp) -> object:
    """Whole seconds since 1970 of a timestamp without a time zone."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), stamp.cast("timestamp_ntz"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def typed(points: DataFrame) -> DataFrame:
    """The table's types: x, y double, z (where there is one), t, id long."""
    kinds = {"x": "double", "y": "double", "z": "long", "t": "long", "id": "long"}
    return points.select(*[F.col(c).cast(k) for c, k in kinds.items() if c in points.columns])


@dataclass(frozen=True)
class Dataset:
    """A named point table: how to read the rows it is built from and those that are inserted later, its region, its decimals, and its query sets by kind (point, range, knn)."""

    build: Callable[[SparkSession], DataFrame]
    update: Callable[[SparkSession], DataFrame] | None
    region: Region
    precision: int
    queries: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)

    @property
    def bits(self) -> int:
        return self.region.bits(self.precision)


CATALOGUE: dict[str, Dataset] = {}


def register(name: str, dataset: Dataset) -> None:
    CATALOGUE[name] = dataset


def load(spark: SparkSession, name: str, update: bool = False) -> DataFrame:
    d = CATALOGUE[name]
    return (d.update if update else d.build)(spark)


def load_queries(spark: SparkSession, name: str, kind: str) -> DataFrame:
    return CATALOGUE[name].queries[kind](spark)


def save_points(points: DataFrame, path: str) -> None:
    typed(points).write.mode("overwrite").parquet(path)


def save_index(folder: str, version: int | None = None, **tables: DataFrame) -> None:
    """Each table as Parquet under `folder`; with a version, beside the earlier ones."""
    for name, df in tables.items():
        path = f"{folder}/{name}" if version is None else f"{folder}/{name}/time_id={version}"
        df.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, folder: str, *names: str, version: int | None = None) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}" if version is None else f"{folder}/{n}/time_id={version}") for n in names]


def save_results(results: DataFrame, path: str) -> None:
    """(qid, id) rows as CSV, a line per query: its ids in order, separated by spaces."""
    lines = results.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("ids"))
    lines.write.mode("overwrite").option("header", True).csv(path)
