"""Preparing point tables, and query sets made from them by hashing, so the same at each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import zorder as Z
from ..functions.region import Region
from .order import numbered


def in_region(points: DataFrame, region: Region) -> DataFrame:
    return points.where(G.contains(G.Box.region(region), F.col("x"), F.col("y")))


def region_report(points: DataFrame, region: Region) -> DataFrame:
    """One row: n and the extents of x, y, t within the region."""
    return in_region(points, region).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "t") for n, f in (("min", F.min), ("max", F.max))])


def with_keys(rows: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """`rows` with `key`: consecutive numbers from `first`."""
    return numbered(rows, order, first, "key")


def distinct_points(points: DataFrame) -> DataFrame:
    return points.dropDuplicates()


def before(points: DataFrame, end: int) -> DataFrame:
    return points.where(F.col("t") < end)


def up_to(points: DataFrame, end: int) -> DataFrame:
    return points.where(F.col("t") <= end)


def coded(points: DataFrame, region: Region, bits: int) -> DataFrame:
    """`points` with z. Written sorted by it, row groups have tight bounds on x, y and z.

    The generators of one row keep the optimizer from copying the long expression into filters and joins above.
    """
    cell = F.struct(Z.axis_code(F.col("x"), region.left, region.width, bits).alias("_x"), Z.axis_code(F.col("y"), region.bottom, region.height, bits).alias("_y"))
    cells = points.select("*", F.inline(F.array(cell)))
    return cells.select(*points.columns, F.explode(F.array(Z.interleave(F.col("_x"), F.col("_y"), bits))).alias("z"))


def sorted_by_code(points: DataFrame) -> DataFrame:
    return points.repartitionByRange("z", "id").sortWithinPartitions("z", "id")


def hashed_unit(*columns: str | Column) -> Column:
    """A number in [0, 1) from the columns' hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 32)) / F.lit(float(1 << 32))


def mixed(v: str, seed: int) -> Column:
    """A number in [0, 2**32) from a whole number, by arithmetic that any engine repeats."""
    n = F.lit(1 << 32)
    h = F.pmod(F.pmod(F.col(v), F.lit(1 << 31)) * F.lit(1_103_515_245).cast("long") + F.lit(seed * 1_013_904_223).cast("long"), n)
    h = F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(668_265_263).cast("long"), n)
    return h.bitwiseXOR(F.shiftright(h, 15))


def sample_with_replacement(points: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows drawn by hash from keys 0 to count - 1, with `draw`, their number."""
    total = points.count()
    picks = points.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(mixed("id", seed) / F.lit(float(1 << 32)) * total).cast("long").alias(key))
    return picks.join(points, key)


def point_queries(points: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(qid, qx, qy) of n rows, the least by hash."""
    chosen = points.select("id", "x", "y").orderBy(mixed("id", seed), "id").limit(n)
    return chosen.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))


def knn_queries(points: DataFrame, ks: list[int], n: int) -> DataFrame:
    """(qid, qx, qy, k): n drawn points for each k, drawn with k as the seed."""
    out = None
    for k in ks:
        q = point_queries(points, n, k).withColumn("k", F.lit(k))
        out = q if out is None else out.unionByName(q)
    return out


def range_windows(spark: SparkSession, region: Region, ratios: list[float], n: int, grid: int = 100_000, seed: int = 1) -> DataFrame:
    """(qid, bottom, up, left, right, ratio): n windows of each share of the region's area, with its shape and lower
    left corners on a grid; none goes beyond the region, as corners are drawn from where it can't."""
    rows = spark.range(n).crossJoin(spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratios)], "_i long, ratio double"))  # ratios: a short list
    side = F.sqrt("ratio")
    at = lambda lo, extent, salt: F.lit(lo) + F.floor(hashed_unit("id", "_i", F.lit(seed), F.lit(salt)) * (1 - side) * grid) / grid * F.lit(extent)
    rows = rows.withColumns({"bottom": at(region.bottom, region.height, 0), "left": at(region.left, region.width, 1)})
    return rows.select((F.col("_i") * n + F.col("id")).alias("qid"), "bottom", (F.col("bottom") + side * region.height).alias("up"), "left", (F.col("left") + side * region.width).alias("right"), "ratio")


def uniform_points(spark: SparkSession, n: int, start: int, end: int, precision: int = 8, seed: int = 1) -> DataFrame:
    """(id, x, y, t): rounded to `precision`, below 1, with times evenly from start to end."""
    top = 1 - 10.0**-precision
    axis = lambda salt: F.least(F.round(hashed_unit("id", F.lit(seed), F.lit(salt)), precision), F.lit(top))
    return spark.range(n).select("id", axis(0).alias("x"), axis(1).alias("y"), (F.lit(start) + F.floor(F.col("id") * F.lit((end - start) / max(1, n)))).cast("long").alias("t"))


def normal_points(spark: SparkSession, n: int, start: int, end: int, precision: int = 8, seed: int = 1) -> DataFrame:
    """As uniform_points(), normally distributed around the middle and scaled by the largest deviation."""
    two_pi = 6.283185307179586
    u = lambda salt: F.greatest(hashed_unit("id", F.lit(seed), F.lit(salt)), F.lit(1e-12))
    r = F.sqrt(-2 * F.log(u(0)))
    rows = spark.range(n).select("id", (r * F.cos(u(1) * two_pi)).alias("gx"), (r * F.sin(u(1) * two_pi)).alias("gy"))
    most = rows.agg(F.max(F.abs("gx")).alias("mx"), F.max(F.abs("gy")).alias("my"))
    top = 1 - 10.0**-precision
    axis = lambda g, m: F.least(F.round(F.col(g) / F.col(m) / 2 + 0.5, precision), F.lit(top))
    out = rows.join(F.broadcast(most))  # one row
    return out.select("id", axis("gx", "mx").alias("x"), axis("gy", "my").alias("y"), (F.lit(start) + F.floor(F.col("id") * F.lit((end - start) / max(1, n)))).cast("long").alias("t"))
