"""Point tables and query sets made from the star schema's tables by arithmetic that any engine repeats exactly.

Each has its SQL beside it. pe: points from events, skewed to the left; po: points from orders on a coarse grid, so
with many at one place; query sets: points from customer, windows and neighbours from supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import UNIT
from ..operators import prep
from ..sources import points as src

PRECISION = 5
BITS = UNIT.bits(PRECISION)
START, DAY = 1_704_067_200, 86_400


def _part(a: str, m: int) -> F.Column:
    return F.expr(f"({a}) % {m}") / F.lit(float(m))


def _sql(a: str, m: int) -> str:
    return f"((({a}) % {m})::DOUBLE / {m}.0::DOUBLE)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    u = _part("event_id * 7919 + user_id * 613", 1_000_000)
    out = e.select(F.col("event_id").alias("id"), (u * u).alias("x"), _part("event_id * 104729 + user_id * 31", 1_000_000).alias("y"), src.epoch_seconds(F.col("ts")).alias("t"))
    return prep.coded(out, UNIT, BITS)


def po(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    out = o.select(F.col("o_orderkey").alias("id"), _part("o_orderkey * 17", 1000).alias("x"), _part("o_custkey * 29", 100).alias("y"), src.epoch_seconds(F.col("o_orderdate")).alias("t"))
    return prep.coded(out, UNIT, BITS)


def place_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), _part("c_custkey * 3", 1000).alias("qx"), _part("c_nationkey * 4", 100).alias("qy"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    s = s.select(F.col("s_suppkey").alias("qid"), _part("s_suppkey * 104729", 1000).alias("bottom"), _part("s_suppkey * 7919", 1000).alias("left"), ((F.expr("s_nationkey % 5") + 1) / F.lit(40.0)).alias("h"), ((F.expr("s_suppkey % 7") + 1) / F.lit(50.0)).alias("w"))
    return s.select("qid", "bottom", (F.col("bottom") + F.col("h")).alias("up"), "left", (F.col("left") + F.col("w")).alias("right"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k is 4, 8, 16, 32 or 64."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), _part("s_suppkey * 613", 1000).alias("qx"), _part("s_suppkey * 31", 1000).alias("qy"), F.expr("shiftleft(4, cast(s_nationkey % 5 as int))").alias("k"))


def register(sf_dir: str) -> None:
    """Put the two point tables and their query sets into the catalogue of data sets, as `events` and `orders`."""
    point, box, near = (lambda s, f=f: f(s, sf_dir) for f in (place_queries, windows, neighbours))
    src.register("events", src.Dataset(lambda s: pe(s, sf_dir).where(F.col("t") < START + 15 * DAY), lambda s: pe(s, sf_dir).where(F.col("t") >= START + 15 * DAY), UNIT, PRECISION, {"range": box, "knn": near}))
    src.register("orders", src.Dataset(lambda s: po(s, sf_dir), None, UNIT, PRECISION, {"point": point}))


SIDE = 1 << BITS


def axis_sql(v: str, how: str = "round_even({}, 0)") -> str:
    return f"least(greatest({how.format(f'{v} * {SIDE}.0::DOUBLE')}::BIGINT, 0), {SIDE - 1})"


def spread_sql(x: str, y: str, bits: int = BITS) -> str:
    return "(" + " | ".join(f"((({c} >> {i}) & 1) << {2 * i + up})" for c, up in ((x, 0), (y, 1)) for i in range(bits)) + ")"


def compact_sql(z: str, bits: int = BITS) -> str:
    return "(" + " | ".join(f"((({z} >> {2 * i}) & 1) << {i})" for i in range(bits)) + ")"


def _coded_sql(name: str, inner: str) -> str:
    return f"{name}_0 AS ({inner}), {name}_1 AS (SELECT *, {axis_sql('x')} AS xi, {axis_sql('y')} AS yi FROM {name}_0), {name} AS (SELECT id, x, y, t, {spread_sql('xi', 'yi')} AS z, xi, yi FROM {name}_1)"


_U = _sql("event_id * 7919 + user_id * 613", 1_000_000)
PE = _coded_sql("pe", f"SELECT event_id AS id, {_U} * {_U} AS x, {_sql('event_id * 104729 + user_id * 31', 1_000_000)} AS y, epoch_us(ts) // 1000000 AS t FROM events")
PO = _coded_sql("po", f"SELECT o_orderkey AS id, {_sql('o_orderkey * 17', 1000)} AS x, {_sql('o_custkey * 29', 100)} AS y, epoch_us(o_orderdate) // 1000000 AS t FROM orders")
PQ = f"pq AS (SELECT c_custkey AS qid, {_sql('c_custkey * 3', 1000)} AS qx, {_sql('c_nationkey * 4', 100)} AS qy FROM customer)"
WQ = f"wq_0 AS (SELECT s_suppkey AS qid, {_sql('s_suppkey * 104729', 1000)} AS bottom, {_sql('s_suppkey * 7919', 1000)} AS lft, (s_nationkey % 5 + 1)::DOUBLE / 40.0::DOUBLE AS h, (s_suppkey % 7 + 1)::DOUBLE / 50.0::DOUBLE AS w FROM supplier), wq AS (SELECT qid, bottom, bottom + h AS up, lft, lft + w AS rgt FROM wq_0)"
NQ = f"nq AS (SELECT s_suppkey AS qid, {_sql('s_suppkey * 613', 1000)} AS qx, {_sql('s_suppkey * 31', 1000)} AS qy, 4 << (s_nationkey % 5) AS k FROM supplier)"
