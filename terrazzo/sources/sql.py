"""The engine from SQL: views of point tables, and SQL functions over them that Catalyst inlines into the query's plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.region import Region


def _axis(v: str, low: float, extent: float, bits: int) -> str:
    return f"greatest(least(CAST(rint(({v} - {low}D) * {float(1 << bits)}D / {extent}D) AS BIGINT), {(1 << bits) - 1}L), 0L)"


def _spread(x: str, y: str, bits: int) -> str:
    return " | ".join(f"shiftleft(shiftright({c}, {i}) & 1L, {2 * i + up})" for c, up in ((x, 0), (y, 1)) for i in range(bits))


def register(spark: SparkSession, name: str, points: DataFrame, region: Region, bits: int, k: int = 10) -> None:
    """Temporary view and functions of a table (id, x, y, z, ...), for this session:

    * `<name>`: the table itself;
    * `<name>_code(x, y)`: the code of a place;
    * `<name>_range(bottom, up, lft, rgt)`: rows (id, x, y) in a closed window, with bounds on the stored code;
    * `<name>_at(px, py)`: rows (id, x, y) at a place, by code;
    * `<name>_nearest(px, py)`: (id, d2) of the `k` nearest rows, ties by id.

    A null argument gives a null code or no rows. Names are plain identifiers.
    """
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a plain identifier: {name}")
    points.createOrReplaceTempView(name)
    inner = f"SELECT {_axis('x', region.left, region.width, bits)} AS a, {_axis('y', region.bottom, region.height, bits)} AS b"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_code(x DOUBLE, y DOUBLE) RETURNS BIGINT RETURN CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (SELECT {_spread('a', 'b', bits)} FROM ({inner})) END")
    put = f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_"
    window = f"z BETWEEN {name}_code(lft, bottom) AND {name}_code(rgt, up) AND y BETWEEN bottom AND up AND x BETWEEN lft AND rgt"
    spark.sql(f"{put}range(bottom DOUBLE, up DOUBLE, lft DOUBLE, rgt DOUBLE) RETURNS TABLE(id BIGINT, x DOUBLE, y DOUBLE) RETURN SELECT id, x, y FROM {name} WHERE {window}")
    spark.sql(f"{put}at(px DOUBLE, py DOUBLE) RETURNS TABLE(id BIGINT, x DOUBLE, y DOUBLE) RETURN SELECT id, x, y FROM {name} WHERE z = {name}_code(px, py) AND x = px AND y = py")
    d2 = "(x - px) * (x - px) + (y - py) * (y - py)"
    spark.sql(f"{put}nearest(px DOUBLE, py DOUBLE) RETURNS TABLE(id BIGINT, d2 DOUBLE) RETURN SELECT id, {d2} AS d2 FROM {name} WHERE px IS NOT NULL AND py IS NOT NULL ORDER BY {d2}, id LIMIT {k}")
