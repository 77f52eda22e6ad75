"""The registered queries, each with its SQL where SQL can express it. All read whole tables."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import zorder as Z
from ..functions.region import UNIT, Region
from ..operators import blocks, cells, learned, medians, metrics, prep, search, series, updates
from ..sources import points as src
from ..sources import sql as sql_functions
from ..sources.session import prepared, shared_folder
from ..streaming import updates as stream
from . import fixtures
from .fixtures import BITS, DAY, NQ, PE, PO, PQ, SIDE, START, WQ, axis_sql, compact_sql, neighbours, pe, place_queries, po, spread_sql, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WINDOW = Region(0.2, 0.5, 0.1, 0.4)
IN_WINDOW = "y BETWEEN 0.2::DOUBLE AND 0.5::DOUBLE AND x BETWEEN 0.1::DOUBLE AND 0.4::DOUBLE"
LEAF_ROWS, DEEPEST = 200, 8
PER_BLOCK = 200
KEY_DEPTH, WIDTH = 2, 10
DAYS = 30
CUT = START + 15 * DAY  # rows before it are history, those from it on are inserted


def query(sql: str | None = None) -> Callable:
    """Register under the function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _written(table: DataFrame) -> DataFrame:
    """An index table as queries see it: built once and read from the shared folder."""
    prepared(table.sparkSession)
    return table.checkpoint()


def index_folder(spark: SparkSession, sf_dir: str) -> str:
    """Where the index tables of a data set lie: a name for its path and the sizes and times of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))
    return f"{shared_folder(prepared(spark))}/index-{zlib.crc32(repr((sf_dir, files)).encode()):08x}"


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An index table by name: written to the shared folder by the first query of a session that asks for it, read by all until the input's files change."""
    path = f"{index_folder(spark, sf_dir)}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


POINTS = {"pe": pe, "po": po}


def _points(spark, sf_dir, name: str) -> DataFrame:
    """The points with their codes, sorted by them."""
    return _stored(spark, sf_dir, f"{name}_by_code", lambda: prep.sorted_by_code(POINTS[name](spark, sf_dir)))


def _placed(spark, sf_dir, name: str) -> DataFrame:
    """The points with their place in order of code."""
    return _stored(spark, sf_dir, f"{name}_places", lambda: search.placed(_points(spark, sf_dir, name)))


def _meta(spark, sf_dir, name: str) -> DataFrame:
    return _stored(spark, sf_dir, f"{name}_leaves", lambda: cells.leaf_meta(cells.leaves(_points(spark, sf_dir, name), LEAF_ROWS, BITS, DEEPEST), UNIT, BITS))


def _entries(spark, sf_dir, name: str) -> DataFrame:
    """The points with their leaf and their place in it."""
    return _stored(spark, sf_dir, f"{name}_entries", lambda: learned.leaf_positions(cells.assign_leaves(_points(spark, sf_dir, name), _meta(spark, sf_dir, name), BITS)))


def _models(spark, sf_dir, name: str) -> DataFrame:
    e = _entries(spark, sf_dir, name)
    return _stored(spark, sf_dir, f"{name}_models", lambda: learned.with_bounds(e, learned.linear_models(e)))


def _blocks_by_code(spark, sf_dir, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with blk, blocks with z_lo): runs of PER_BLOCK rows in order of code."""
    rows = _stored(spark, sf_dir, f"{name}_blocked", lambda: blocks.with_blocks(_points(spark, sf_dir, name), ["z", "id"], PER_BLOCK))
    return rows, _stored(spark, sf_dir, f"{name}_blocks", lambda: blocks.block_ranges(rows).join(rows.groupBy("blk").agg(F.min("z").alias("z_lo")), "blk"))


def _split(spark, sf_dir, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with blk, blocks, splits) of the tree of medians."""
    tree: list[tuple[DataFrame, DataFrame]] = []

    def built(part: int) -> DataFrame:
        if not tree:
            tree.append(medians.median_tree(_points(spark, sf_dir, name), LEAF_ROWS))
        return tree[0][part]

    rows = _stored(spark, sf_dir, f"{name}_split", lambda: built(0))
    splits = _stored(spark, sf_dir, f"{name}_splits", lambda: built(1))
    return rows, _stored(spark, sf_dir, f"{name}_split_boxes", lambda: blocks.block_ranges(rows)), splits


def _packed(spark, sf_dir, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with blk, blocks) of a packed tree, with as many strips as tiles in a strip."""

    def build() -> DataFrame:
        points = _points(spark, sf_dir, name)
        side = _packed_side(points)
        return blocks.packed_rows(points, side, side).withColumn("blk", F.col("strip") * side + F.col("tile") - 1).drop("strip", "tile")

    rows = _stored(spark, sf_dir, f"{name}_packed", build)
    return rows, _stored(spark, sf_dir, f"{name}_packed_boxes", lambda: blocks.block_ranges(rows))


def _leaves(points: DataFrame) -> DataFrame:
    return _written(cells.leaf_meta(cells.leaves(points, LEAF_ROWS, BITS, DEEPEST), UNIT, BITS))


PAIRS_P = f"WITH {PO}, {PQ} SELECT qid, id FROM po JOIN pq ON x = qx AND y = qy"
PAIRS_R = f"WITH {PE}, {WQ} SELECT qid, id FROM pe JOIN wq ON y BETWEEN bottom AND up AND x BETWEEN lft AND rgt"
ONE_RANGE = f"WITH {PE} SELECT id, x, y FROM pe WHERE {IN_WINDOW}"
D2 = "(x - qx) * (x - qx) + (y - qy) * (y - qy)"
PAIRS_K = f"WITH {PE}, {NQ} SELECT qid, id, round({D2}, 12) AS d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {D2}, id) AS rank FROM pe, nq) WHERE rank <= k"
PYRAMID = f"pyr AS (SELECT d, z >> (2 * ({BITS} - d)) AS cell, count(*) AS n FROM pe, range(0, {DEEPEST + 1}) r(d) GROUP BY ALL), leaf AS (SELECT a.d AS depth, a.cell, a.n FROM pyr a LEFT JOIN pyr p ON p.d = a.d - 1 AND p.cell = a.cell >> 2 WHERE (a.n <= {LEAF_ROWS} OR a.d = {DEEPEST}) AND (a.d = 0 OR p.n > {LEAF_ROWS}))"


# -- codes -----------------------------------------------------------------------------------------


@query(f"WITH {PE} SELECT id, z FROM pe")
def z_encode(spark, sf_dir):
    return pe(spark, sf_dir).select("id", "z")


@query(f"WITH {PE}, c AS (SELECT id, {axis_sql('x', 'floor({})')} AS a, {axis_sql('y', 'floor({})')} AS b FROM pe) SELECT id, {spread_sql('a', 'b')} AS z FROM c")
def z_encode_truncated(spark, sf_dir):
    return pe(spark, sf_dir).select("id", Z.encode(F.col("x"), F.col("y"), UNIT, BITS, truncate=True).alias("z"))


@query(f"WITH {PE} SELECT id, round_even(xi / {SIDE}.0::DOUBLE, 5) AS dx, round_even(yi / {SIDE}.0::DOUBLE, 5) AS dy FROM pe")
def z_decode(spark, sf_dir):
    x, y = Z.decode(F.col("z"), UNIT, BITS, 5)
    return pe(spark, sf_dir).select("id", x.alias("dx"), y.alias("dy"))


@query(f"WITH {PE} SELECT z >> {2 * (BITS - 5)} AS cell, count(*) AS n FROM pe GROUP BY 1")
def z_prefix_counts(spark, sf_dir):
    return pe(spark, sf_dir).groupBy(Z.prefix(F.col("z"), BITS, 5).alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH {PE}, c AS (SELECT DISTINCT z >> {2 * (BITS - 5)} AS cell FROM pe), g AS (SELECT cell, {compact_sql('cell', 5)} + dx AS cx, {compact_sql('(cell >> 1)', 5)} + dy AS cy FROM c, range(-1, 2) a(dx), range(-1, 2) b(dy)) SELECT cell, {spread_sql('cx', 'cy', 5)} AS neighbour FROM g WHERE cx BETWEEN 0 AND 31 AND cy BETWEEN 0 AND 31")
def z_neighbours(spark, sf_dir):
    c = pe(spark, sf_dir).select(Z.prefix(F.col("z"), BITS, 5).alias("cell")).distinct()
    return c.select("cell", F.explode(Z.neighbours(F.col("cell"), 5)).alias("neighbour"))


def _geo(v: str, low: str, extent: str, bits: int, bisect: bool = False) -> str:
    n = 1 << bits
    s = f"({v} - ({low})) * {n}.0::DOUBLE / {extent}"
    return f"least(greatest({f'ceil({s})::BIGINT - 1' if bisect else f'floor({s})::BIGINT'}, 0), {n - 1})"


_LNG, _LAT = "(x * 360.0::DOUBLE - 180.0::DOUBLE)", "(y * 180.0::DOUBLE - 90.0::DOUBLE)"
_G = f"WITH {PE}, g AS (SELECT id, {_geo(_LNG, '-180.0::DOUBLE', '360.0::DOUBLE', 30)} AS gx, {_geo(_LAT, '-90.0::DOUBLE', '180.0::DOUBLE', 30)} AS gy, {_geo(_LNG, '-180.0::DOUBLE', '360.0::DOUBLE', 30, True)} AS bx, {_geo(_LAT, '-90.0::DOUBLE', '180.0::DOUBLE', 30, True)} AS by_ FROM pe)"


def _on_earth(points: DataFrame) -> DataFrame:
    return points.select("id", (F.col("x") * 360.0 - 180.0).alias("lng"), (F.col("y") * 180.0 - 90.0).alias("lat"))


@query(f"{_G} SELECT id, lpad(bin({spread_sql('gx', 'gy', 30)}), 60, '0') AS lat_first, lpad(bin({spread_sql('by_', 'bx', 30)}), 60, '0') AS lng_first FROM g")
def geohash_bit_strings(spark, sf_dir):
    lng, lat = F.col("lng"), F.col("lat")
    return _on_earth(pe(spark, sf_dir)).select("id", Z.geohash_bits(lng, lat).alias("lat_first"), Z.geohash_bits(lng, lat, lng_first=True, bisect=True).alias("lng_first"))


@query(f"{_G}, c AS (SELECT id, {spread_sql('gy', 'gx', 30)} AS code FROM g) SELECT id, {' || '.join(f"substr('{Z.BASE32}', (((code >> {5 * i}) & 31) + 1)::INT, 1)" for i in reversed(range(12)))} AS geohash FROM c")
def geohash_base32(spark, sf_dir):
    return _on_earth(pe(spark, sf_dir)).select("id", Z.geohash32(F.col("lng"), F.col("lat")).alias("geohash"))


@query(f"WITH {PE}, c AS (SELECT DISTINCT z >> {2 * (BITS - 5)} AS cell FROM pe), g AS (SELECT cell, {compact_sql('(cell >> 1)', 5)} + dx AS cx, {compact_sql('cell', 5)} + dy AS cy FROM c, range(-1, 2) a(dx), range(-1, 2) b(dy)) SELECT cell, {spread_sql('cy', 'cx', 5)} AS neighbour FROM g WHERE cx BETWEEN 0 AND 31 AND cy BETWEEN 0 AND 31")
def z_neighbours_lng_first(spark, sf_dir):
    c = pe(spark, sf_dir).select(Z.prefix(F.col("z"), BITS, 5).alias("cell")).distinct()
    return c.select("cell", F.explode(Z.neighbours(F.col("cell"), 5, lng_first=True)).alias("neighbour"))


@query(f"{_G} SELECT id, round((gx + 0.5::DOUBLE) * (360.0::DOUBLE / {1 << 30}) - 180.0::DOUBLE, 6) AS lng, round((gy + 0.5::DOUBLE) * (180.0::DOUBLE / {1 << 30}) - 90.0::DOUBLE, 6) AS lat FROM g")
def geohash_decode(spark, sf_dir):
    lng, lat, _, _ = Z.geohash32_decode(F.col("h"))
    h = _on_earth(pe(spark, sf_dir)).select("id", Z.geohash32(F.col("lng"), F.col("lat")).alias("h"))
    return h.select("id", F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


_SHOWN = "rtrim(printf('%.6f', {}), '0')"


@query(f"{_G} SELECT id, {_SHOWN.format(f'(gx + 0.5::DOUBLE) * (360.0::DOUBLE / {1 << 30}) - 180.0::DOUBLE')} AS lng, {_SHOWN.format(f'(gy + 0.5::DOUBLE) * (180.0::DOUBLE / {1 << 30}) - 90.0::DOUBLE')} AS lat FROM g")
def geohash_digits(spark, sf_dir):
    lng, lat = Z.geohash32_digits(F.col("h"))
    return _on_earth(pe(spark, sf_dir)).select("id", Z.geohash32(F.col("lng"), F.col("lat")).alias("h")).select("id", lng.alias("lng"), lat.alias("lat"))


# -- geometry --------------------------------------------------------------------------------------


@query(f"WITH {PO}, {PQ} SELECT qid, id, round(sqrt({D2}), 6) AS d FROM po JOIN pq ON qid = id")
def distance(spark, sf_dir):
    j = po(spark, sf_dir).join(place_queries(spark, sf_dir), F.col("id") == F.col("qid"))
    return j.select("qid", "id", F.round(G.distance(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")), 6).alias("d"))


_BRIN = f"WITH {PE}, {WQ}, nb AS (SELECT *, (row_number() OVER (ORDER BY {{}}) - 1) // {PER_BLOCK} AS blk FROM pe), br AS (SELECT blk, count(*) AS n, min(y) AS b_bottom, max(y) AS b_up, min(x) AS b_left, max(x) AS b_right FROM nb GROUP BY 1)"
_MEET = "bottom <= b_up AND b_bottom <= up AND lft <= b_right AND b_left <= rgt"


def _blocked(spark, sf_dir, order):
    return blocks.with_blocks(pe(spark, sf_dir), order, PER_BLOCK)


@query(f"{_BRIN.format('id')} SELECT blk, n, b_bottom AS bottom, b_up AS up, b_left AS lft, b_right AS rgt FROM br")
def brin_blocks_arrival(spark, sf_dir):
    return blocks.block_ranges(_blocked(spark, sf_dir, ["id"])).withColumnsRenamed({"left": "lft", "right": "rgt"})


@query(f"{_BRIN.format('z, id')} SELECT blk, n, b_bottom AS bottom, b_up AS up, b_left AS lft, b_right AS rgt FROM br")
def brin_blocks_sorted(spark, sf_dir):
    return blocks.block_ranges(_blocked(spark, sf_dir, ["z", "id"])).withColumnsRenamed({"left": "lft", "right": "rgt"})


@query(f"{_BRIN.format('z, id')} SELECT qid, blk, CASE WHEN bottom <= b_bottom AND up >= b_up AND lft <= b_left AND rgt >= b_right THEN 2 WHEN b_bottom <= bottom AND b_up >= up AND b_left <= lft AND b_right >= rgt THEN 3 ELSE 1 END AS relation FROM wq JOIN br ON {_MEET}")
def rect_relation(spark, sf_dir):
    return blocks.pairs_met(_blocks_by_code(spark, sf_dir, "pe")[1], windows(spark, sf_dir), UNIT, BITS)


@query(f"WITH {WQ}, {NQ} SELECT wq.qid, round(greatest(lft - qx, 0, qx - rgt) * greatest(lft - qx, 0, qx - rgt) + greatest(bottom - qy, 0, qy - up) * greatest(bottom - qy, 0, qy - up), 12) AS d2 FROM wq JOIN nq ON wq.qid = nq.qid")
def rect_nearest(spark, sf_dir):
    j = windows(spark, sf_dir).join(neighbours(spark, sf_dir), "qid")
    return j.select("qid", F.round(G.nearest2(G.Box.of(), F.col("qx"), F.col("qy")), 12).alias("d2"))


_ON = "y = 0.2::DOUBLE OR x = 0.1::DOUBLE OR (y > 0.2::DOUBLE AND y < 0.5::DOUBLE AND x > 0.1::DOUBLE AND x < 0.4::DOUBLE)"


@query(f"WITH {PO} SELECT count(*) FILTER ({IN_WINDOW}) AS closed, count(*) FILTER (y >= 0.2::DOUBLE AND y < 0.5::DOUBLE AND x >= 0.1::DOUBLE AND x < 0.4::DOUBLE) AS half_open, count(*) FILTER ({_ON}) AS low_line FROM po")
def region_contains(spark, sf_dir):
    x, y, b = F.col("x"), F.col("y"), G.Box.region(WINDOW)
    return po(spark, sf_dir).agg(F.count_if(G.contains(b, x, y)).alias("closed"), F.count_if(G.contains_half_open(b, x, y)).alias("half_open"), F.count_if(G.contains_or_on_low_line(b, x, y)).alias("low_line"))


@query(f"WITH {WQ}, h AS (SELECT *, (bottom + up) / 2 AS ym, (lft + rgt) / 2 AS xm FROM wq) SELECT qid, q, CASE WHEN q < 2 THEN bottom ELSE ym END AS bottom, CASE WHEN q < 2 THEN ym ELSE up END AS up, CASE WHEN q % 2 = 0 THEN lft ELSE xm END AS lft, CASE WHEN q % 2 = 0 THEN xm ELSE rgt END AS rgt FROM h, range(0, 4) r(q)")
def quarters(spark, sf_dir):
    w = windows(spark, sf_dir).withColumns({"ym": (F.col("bottom") + F.col("up")) / 2, "xm": (F.col("left") + F.col("right")) / 2})
    w = w.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    low, west = F.col("q") < 2, F.col("q") % 2 == 0
    return w.select("qid", "q", F.when(low, F.col("bottom")).otherwise(F.col("ym")).alias("bottom"), F.when(low, F.col("ym")).otherwise(F.col("up")).alias("up"), F.when(west, F.col("left")).otherwise(F.col("xm")).alias("lft"), F.when(west, F.col("xm")).otherwise(F.col("right")).alias("rgt"))


@query(f"WITH {WQ} SELECT qid, greatest(bottom, 0.0::DOUBLE) AS bottom, least(up, 1.0::DOUBLE) AS up, greatest(lft, 0.0::DOUBLE) AS lft, least(rgt, 1.0::DOUBLE) AS rgt FROM wq")
def clip_windows(spark, sf_dir):
    c = G.clipped(G.Box.of(), UNIT)
    return windows(spark, sf_dir).select("qid", c.bottom.alias("bottom"), c.up.alias("up"), c.left.alias("lft"), c.right.alias("rgt"))


# -- the three queries, by each access path --------------------------------------------------------


@query(PAIRS_P)
def point_query_exact(spark, sf_dir):
    return search.point_query(po(spark, sf_dir), place_queries(spark, sf_dir))


@query(f"WITH {PO}, {PQ}, c AS (SELECT qid, {axis_sql('qx')} AS a, {axis_sql('qy')} AS b FROM pq), q AS (SELECT qid, {spread_sql('a', 'b')} AS qz FROM c) SELECT qid, id FROM po JOIN q ON z = qz")
def point_query_cell(spark, sf_dir):
    return search.point_query_z(po(spark, sf_dir), place_queries(spark, sf_dir), UNIT, BITS, exact=False)


@query(PAIRS_P)
def point_query_z(spark, sf_dir):
    return search.point_query_z(po(spark, sf_dir), place_queries(spark, sf_dir), UNIT, BITS)


@query(PAIRS_P)
def point_query_brin(spark, sf_dir):
    return blocks.point_query_blocks(*_blocks_by_code(spark, sf_dir, "po"), place_queries(spark, sf_dir), UNIT, BITS)


@query(PAIRS_P)
def point_query_packed_tree(spark, sf_dir):
    return blocks.point_query_blocks(*_packed(spark, sf_dir, "po"), place_queries(spark, sf_dir), UNIT, BITS)


@query(PAIRS_P)
def point_query_median_tree(spark, sf_dir):
    """By the boxes of the leaves: rows at one place may lie on both sides of a split."""
    return blocks.point_query_blocks(*_split(spark, sf_dir, "po")[:2], place_queries(spark, sf_dir), UNIT, BITS)


@query(PAIRS_P)
def point_query_leaf(spark, sf_dir):
    """By the adaptive cell of the query's place."""
    q = cells.assign_leaves(search.with_query_code(place_queries(spark, sf_dir), UNIT, BITS), _meta(spark, sf_dir, "po"), BITS)
    return _entries(spark, sf_dir, "po").join(q.select("qid", "leaf", F.col("qx").alias("x"), F.col("qy").alias("y")), ["leaf", "x", "y"]).select("qid", "id")


@query(PAIRS_P)
def point_query_asof_leaf(spark, sf_dir):
    """The leaf is the one with the greatest first code that isn't above the query's."""
    meta, q = _meta(spark, sf_dir, "po"), search.with_query_code(place_queries(spark, sf_dir), UNIT, BITS)
    at = search.greatest_at_most(meta.select("value"), "value", q, "z").join(meta.select("leaf", F.col("value").alias("found")), "found")
    return learned.learned_lookup(_entries(spark, sf_dir, "po"), _models(spark, sf_dir, "po"), at.select("qid", "qx", "qy", "z", "leaf")).select("qid", "id")


@query(PAIRS_P)
def point_query_learned(spark, sf_dir):
    probes = cells.assign_leaves(search.with_query_code(place_queries(spark, sf_dir), UNIT, BITS), _meta(spark, sf_dir, "po"), BITS)
    return learned.learned_lookup(_entries(spark, sf_dir, "po"), _models(spark, sf_dir, "po"), probes).select("qid", "id")


@query(PAIRS_P)
def point_query_rmi(spark, sf_dir):
    points = _points(spark, sf_dir, "po")
    n = max(1, points.count() // 1000)
    entries = _stored(spark, sf_dir, "po_routed", lambda: learned.leaf_positions(learned.routed(points, n)))
    models = _stored(spark, sf_dir, "po_routed_models", lambda: learned.with_bounds(entries, learned.linear_models(entries)))
    # the query takes the way its code took in the build: routing is monotone, so its leaf is the last that begins at its code or before
    firsts = entries.groupBy("leaf").agg(F.min("z").alias("found"))
    q = search.with_query_code(place_queries(spark, sf_dir), UNIT, BITS)
    probes = search.greatest_at_most(firsts, "found", q, "z").join(firsts, "found").select("qid", "qx", "qy", "z", "leaf")
    return learned.learned_lookup(entries, models, probes).select("qid", "id")


@query(PAIRS_P)
def point_query_staged(spark, sf_dir):
    """Three stages of models: rows and probes with one code take one way to one leaf."""
    points = _points(spark, sf_dir, "po")
    stages = [1, 8, max(8, points.count() // 1000)]
    models, n = learned.stage_models(points, stages)
    entries = _written(learned.leaf_positions(learned.sent_through(points, models, stages, n)))
    q = search.with_query_code(place_queries(spark, sf_dir), UNIT, BITS)
    probes = learned.sent_through(q, models, stages, n).select("qid", "qx", "qy", "z", "leaf")
    return learned.learned_lookup(entries, _written(learned.with_bounds(entries, learned.linear_models(entries))), probes).select("qid", "id")


@query(ONE_RANGE)
def range_query_scan(spark, sf_dir):
    return search.range_query(pe(spark, sf_dir), WINDOW).select("id", "x", "y")


@query(ONE_RANGE)
def range_query_zbounds(spark, sf_dir):
    """The codes are stored and sorted, so their bounds reach the scan."""
    return search.range_query_z(_points(spark, sf_dir, "pe"), WINDOW, UNIT, BITS).select("id", "x", "y")


@query(PAIRS_R)
def range_query_brin(spark, sf_dir):
    return blocks.range_query_blocks(*_blocks_by_code(spark, sf_dir, "pe"), windows(spark, sf_dir), UNIT, BITS)


@query(PAIRS_R)
def range_query_packed_tree(spark, sf_dir):
    return blocks.range_query_blocks(*_packed(spark, sf_dir, "pe"), windows(spark, sf_dir), UNIT, BITS)


@query(PAIRS_R)
def range_query_median_tree(spark, sf_dir):
    return blocks.range_query_blocks(*_split(spark, sf_dir, "pe")[:2], windows(spark, sf_dir), UNIT, BITS)


@query(f"WITH {PE} SELECT id FROM pe WHERE y BETWEEN 0.25::DOUBLE AND 0.55::DOUBLE AND x BETWEEN 0.15::DOUBLE AND 0.45::DOUBLE AND NOT ({IN_WINDOW})")
def range_query_moved(spark, sf_dir):
    """What a window that moves takes in anew."""
    return search.new_in_window(_points(spark, sf_dir, "pe"), WINDOW, Region(0.25, 0.55, 0.15, 0.45)).select("id")


@query(PAIRS_R)
def range_query_leaves(spark, sf_dir):
    return search.range_join_by_leaf(_entries(spark, sf_dir, "pe"), _meta(spark, sf_dir, "pe"), windows(spark, sf_dir), UNIT, BITS)


@query(PAIRS_R)
def range_query_cells(spark, sf_dir):
    return search.range_join(pe(spark, sf_dir), windows(spark, sf_dir), UNIT, BITS)


@query(f"WITH {PE}, {WQ} SELECT qid, count(id) AS n FROM wq LEFT JOIN pe ON y BETWEEN bottom AND up AND x BETWEEN lft AND rgt GROUP BY qid")
def range_join_counts(spark, sf_dir):
    return search.range_counts(pe(spark, sf_dir), windows(spark, sf_dir), UNIT, BITS)


_AXES = ", ".join(f"{axis_sql(c)} >> {BITS - 5} AS {n}" for c, n in (("lft", "x0"), ("rgt", "x1"), ("bottom", "y0"), ("up", "y1")))
_GRID = f"WITH {WQ}, a AS (SELECT qid, {_AXES} FROM wq), g AS (SELECT qid, x, y, x0, x1, y0, y1 FROM a, range(0, 32) r(x), range(0, 32) s(y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), m AS (SELECT qid, {spread_sql('x', 'y', 5)} AS cell, (CASE WHEN y = y0 THEN 8 ELSE 0 END) + (CASE WHEN y = y1 THEN 4 ELSE 0 END) + (CASE WHEN x = x0 THEN 2 ELSE 0 END) + (CASE WHEN x = x1 THEN 1 ELSE 0 END) AS mask FROM g)"


@query(f"{_GRID} SELECT qid, cell, mask FROM m")
def window_cover_masks(spark, sf_dir):
    return cells.cover_masks(windows(spark, sf_dir), UNIT, BITS, 5)


@query(f"{_GRID} SELECT qid, cell >> 4 AS key, bit_or(mask) AS mask FROM m GROUP BY ALL")
def window_cover_merged(spark, sf_dir):
    m = cells.cover_masks(windows(spark, sf_dir), UNIT, BITS, 5)
    return cells.merged_masks(m.withColumn("key", F.shiftright("cell", 4)), "key")


@query(PAIRS_K)
def knn_join(spark, sf_dir):
    return _as_pairs(search.knn_join(_entries(spark, sf_dir, "pe"), _meta(spark, sf_dir, "pe"), neighbours(spark, sf_dir), UNIT, BITS))


def _as_pairs(out: DataFrame) -> DataFrame:
    return out.select("qid", "id", F.round("d2", 12).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query(PAIRS_K)
def knn_median_tree(spark, sf_dir):
    """The search begins in the query's own leaf."""
    rows, boxes, splits = _split(spark, sf_dir, "pe")
    q = neighbours(spark, sf_dir)
    seeds = medians.located(q, splits, F.col("qx"), F.col("qy")).select("qid", "blk")
    return _as_pairs(blocks.knn_blocks(rows, boxes, seeds, q, UNIT, BITS))


@query(PAIRS_K)
def knn_by_density(spark, sf_dir):
    """The first radius is by the slope of the query's leaf model, and grows for the queries that need it."""
    return _as_pairs(search.knn_by_density(_entries(spark, sf_dir, "pe"), _meta(spark, sf_dir, "pe"), _models(spark, sf_dir, "pe"), neighbours(spark, sf_dir), UNIT, BITS)[0])


@query(PAIRS_K)
def knn_packed_tree(spark, sf_dir):
    """The search begins in the tile whose first code is the last at the query's own or before."""
    rows, boxes = _packed(spark, sf_dir, "pe")
    q = neighbours(spark, sf_dir)
    seeds = blocks.code_seeds(boxes.join(rows.groupBy("blk").agg(F.min("z").alias("z_lo")), "blk"), q, UNIT, BITS)
    return _as_pairs(blocks.knn_blocks(rows, boxes, seeds, q, UNIT, BITS))


@query(PAIRS_K)
def knn_brin(spark, sf_dir):
    """Two phases: the block at the query's code bounds the second, over the blocks within the bound."""
    rows, boxes = _blocks_by_code(spark, sf_dir, "pe")
    q = neighbours(spark, sf_dir)
    return _as_pairs(blocks.knn_blocks(rows, boxes, blocks.code_seeds(boxes, q, UNIT, BITS), q, UNIT, BITS))


@query(PAIRS_K)
def knn_code_neighbours(spark, sf_dir):
    """The k points before and after the query in order of code bound the search."""
    return _as_pairs(search.knn_by_code(_placed(spark, sf_dir, "pe"), *_blocks_by_code(spark, sf_dir, "pe"), neighbours(spark, sf_dir), UNIT, BITS))


@query(f"WITH {PE}, {NQ}, n AS (SELECT *, row_number() OVER (ORDER BY z, id) - 1 AS pos FROM pe), c AS (SELECT qid, k, {axis_sql('qx')} AS a, {axis_sql('qy')} AS b FROM nq), q AS (SELECT qid, k, {spread_sql('a', 'b')} AS qz FROM c), h AS (SELECT z, max(pos) + 1 AS s FROM n GROUP BY z), r AS (SELECT qid, k, coalesce(s, 0) AS place FROM q ASOF LEFT JOIN h ON q.qz >= h.z) SELECT qid, id FROM r JOIN n ON pos BETWEEN place - k AND place + k - 1")
def code_neighbours(spark, sf_dir):
    return search.z_neighbours(_placed(spark, sf_dir, "pe"), neighbours(spark, sf_dir), UNIT, BITS).select("qid", "id")


@query(f"WITH {PE} SELECT id, round((x - 0.3::DOUBLE) * (x - 0.3::DOUBLE) + (y - 0.6::DOUBLE) * (y - 0.6::DOUBLE), 12) AS d2 FROM pe ORDER BY (x - 0.3::DOUBLE) * (x - 0.3::DOUBLE) + (y - 0.6::DOUBLE) * (y - 0.6::DOUBLE), id LIMIT 64")
def knn_scan(spark, sf_dir):
    return search.knn_scan(pe(spark, sf_dir), 0.3, 0.6, 64).select("id", F.round("d2", 12).alias("d2"))


# -- from SQL --------------------------------------------------------------------------------------


def _sql(spark, sf_dir, name: str, text: str) -> DataFrame:
    sql_functions.register(spark, "places", _points(spark, sf_dir, name), UNIT, BITS, k=64)
    return spark.sql(text)


@query(ONE_RANGE)
def sql_range_function(spark, sf_dir):
    return _sql(spark, sf_dir, "pe", "SELECT id, x, y FROM places_range(0.2, 0.5, 0.1, 0.4)")


@query(f"WITH {PO} SELECT id, x, y FROM po WHERE x = 0.032::DOUBLE AND y = 0.37::DOUBLE")
def sql_place_function(spark, sf_dir):
    return _sql(spark, sf_dir, "po", "SELECT id, x, y FROM places_at(0.032, 0.37)")


@query(f"WITH {PE} SELECT id, round((x - 0.3::DOUBLE) * (x - 0.3::DOUBLE) + (y - 0.6::DOUBLE) * (y - 0.6::DOUBLE), 12) AS d2 FROM pe ORDER BY (x - 0.3::DOUBLE) * (x - 0.3::DOUBLE) + (y - 0.6::DOUBLE) * (y - 0.6::DOUBLE), id LIMIT 64")
def sql_nearest_function(spark, sf_dir):
    return _sql(spark, sf_dir, "pe", "SELECT id, round(d2, 12) AS d2 FROM places_nearest(0.3, 0.6)")


# -- index tables ----------------------------------------------------------------------------------


@query(f"{_BRIN.format('z, id')} SELECT wq.qid, count(blk) AS blocks, count(blk) * 4 AS pages FROM wq LEFT JOIN br ON {_MEET} GROUP BY 1")
def brin_io_cost(spark, sf_dir):
    return blocks.io_cost(_blocks_by_code(spark, sf_dir, "pe")[1], windows(spark, sf_dir), 4, UNIT, BITS)


@query(f"WITH {PE}, {PYRAMID} SELECT depth, cell, n FROM leaf")
def quadtree_leaves(spark, sf_dir):
    return cells.leaves(pe(spark, sf_dir), LEAF_ROWS, BITS, DEEPEST).select(F.col("depth").cast("long").alias("depth"), "cell", "n")


@query(f"WITH {PE}, {PYRAMID}, kids AS (SELECT d + 1 AS depth, (cell << 2) + i AS cell FROM pyr, range(0, 4) r(i) WHERE n > {LEAF_ROWS} AND d < {DEEPEST}) SELECT depth, cell, n FROM leaf UNION ALL SELECT k.depth, k.cell, 0 FROM kids k LEFT JOIN pyr p ON p.d = k.depth AND p.cell = k.cell WHERE p.n IS NULL")
def quadtree_leaves_with_empty(spark, sf_dir):
    return cells.all_leaves(pe(spark, sf_dir), LEAF_ROWS, BITS, DEEPEST).select(F.col("depth").cast("long").alias("depth"), "cell", "n")


@query(f"WITH {PE}, {PYRAMID} SELECT cell << (2 * ({BITS} - depth)) AS value, 2 * depth AS length, n, 1::BIGINT << (2 * ({BITS} - depth)) AS value_diff, {compact_sql('(cell >> 1)', DEEPEST)} / (2.0::DOUBLE ** depth) AS bottom, ({compact_sql('(cell >> 1)', DEEPEST)} + 1) / (2.0::DOUBLE ** depth) AS up, {compact_sql('cell', DEEPEST)} / (2.0::DOUBLE ** depth) AS lft, ({compact_sql('cell', DEEPEST)} + 1) / (2.0::DOUBLE ** depth) AS rgt FROM leaf")
def leaf_table(spark, sf_dir):
    m = _leaves(pe(spark, sf_dir))
    return m.select("value", F.col("length").cast("long").alias("length"), "n", "value_diff", F.col("scope_bottom").alias("bottom"), F.col("scope_up").alias("up"), F.col("scope_left").alias("lft"), F.col("scope_right").alias("rgt"))


@query(f"WITH {PE}, s AS (SELECT *, (row_number() OVER (ORDER BY x, id) - 1) * 8 // (SELECT count(*) FROM pe) AS strip FROM pe), t AS (SELECT *, ntile(8) OVER (PARTITION BY strip ORDER BY y, id)::BIGINT AS tile FROM s) SELECT strip, tile, count(*) AS n, min(y) AS bottom, max(y) AS up, min(x) AS lft, max(x) AS rgt FROM t GROUP BY ALL")
def rtree_packed_boxes(spark, sf_dir):
    return blocks.packed_boxes(pe(spark, sf_dir), 8, 8).withColumnsRenamed({"left": "lft", "right": "rgt"}).withColumn("tile", F.col("tile").cast("long"))


@query(f"WITH {PE} SELECT count(*) AS n, 0::BIGINT AS outside, true AS balanced FROM pe")
def median_tree(spark, sf_dir):
    """Rows, those outside their leaf's box, and whether no leaf holds more than twice what it should."""
    rows, boxes, _ = _split(spark, sf_dir, "pe")
    at = rows.join(boxes.withColumnRenamed("n", "_n"), "blk")
    return at.agg(F.count("*").alias("n"), F.count_if(~G.contains(G.Box.of(), F.col("x"), F.col("y"))).alias("outside"), (F.max("_n") <= 2 * LEAF_ROWS).alias("balanced"))


_HALVES = f"WITH RECURSIVE {PE}, lv AS (SELECT greatest(0, ceil(log2(count(*) / {LEAF_ROWS}.0)))::INT AS l FROM pe), t AS (SELECT id, x, y, 1::BIGINT AS blk, 0 AS d, 0::BIGINT AS rn, 0::BIGINT AS n FROM pe UNION ALL SELECT id, x, y, 2 * blk + CASE WHEN r > (c + 1) // 2 THEN 1 ELSE 0 END, d + 1, r, c FROM (SELECT id, x, y, blk, d, row_number() OVER (PARTITION BY blk ORDER BY CASE WHEN d % 2 = 0 THEN x ELSE y END, id) AS r, count(*) OVER (PARTITION BY blk) AS c FROM t, lv WHERE d < l))"


@query(f"{_HALVES} SELECT blk, count(*) AS n, min(y) AS bottom, max(y) AS up, min(x) AS lft, max(x) AS rgt FROM t, lv WHERE d = l GROUP BY blk")
def median_tree_boxes(spark, sf_dir):
    return _split(spark, sf_dir, "pe")[1].withColumnsRenamed({"left": "lft", "right": "rgt"})


@query(f"{_HALVES} SELECT blk // 2 AS node, (d - 1)::BIGINT AS level, CASE WHEN d % 2 = 1 THEN x ELSE y END AS v, id FROM t WHERE d > 0 AND rn = (n + 1) // 2")
def median_tree_splits(spark, sf_dir):
    """The median of every node, level by level."""
    return _split(spark, sf_dir, "pe")[2].withColumn("level", F.col("level").cast("long"))


_TILES = f"WITH {PE}, s AS (SELECT *, (row_number() OVER (ORDER BY x, id) - 1) * 8 // (SELECT count(*) FROM pe) AS strip FROM pe), t AS (SELECT *, ntile(8) OVER (PARTITION BY strip ORDER BY y, id)::BIGINT - 1 AS tile FROM s), l AS (SELECT level::BIGINT AS level, strip // f AS strip, tile // f AS tile, count(*) AS n, min(y) AS bottom, max(y) AS up, min(x) AS lft, max(x) AS rgt FROM t, (VALUES (0, 1), (1, 4), (2, 16)) v(level, f) GROUP BY ALL)"


def _levels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(rows with strip and tile, all levels of boxes) of a packed tree of 8 by 8 tiles."""
    return _packed_tree(spark, sf_dir, 8)


def _packed_tree(spark, sf_dir, side: int) -> tuple[DataFrame, DataFrame]:
    rows = _stored(spark, sf_dir, f"pe_tiles_{side}", lambda: blocks.packed_rows(_points(spark, sf_dir, "pe"), side, side))
    tiles = rows.groupBy("strip", "tile").agg(F.count("*").alias("n"), *blocks.box_of())
    return rows, _stored(spark, sf_dir, f"pe_tile_levels_{side}", lambda: blocks.packed_levels(tiles, side, side))


def _packed_side(points: DataFrame) -> int:
    """Strips, and tiles in a strip, of a packed tree with about LEAF_ROWS rows in a tile."""
    return max(1, math.ceil(math.sqrt(points.count() / LEAF_ROWS)))


@query(f"{_TILES} SELECT level, strip, tile, n, bottom, up, lft, rgt FROM l")
def packed_tree_levels(spark, sf_dir):
    return _levels(spark, sf_dir)[1].withColumn("level", F.col("level").cast("long")).withColumnsRenamed({"left": "lft", "right": "rgt"})


@query(f"{_TILES}, {WQ} SELECT l.level, qid, strip, tile FROM l JOIN wq ON wq.bottom <= l.up AND l.bottom <= wq.up AND wq.lft <= l.rgt AND l.lft <= wq.rgt")
def packed_tree_descent(spark, sf_dir):
    """The nodes that a window comes to, level by level: those whose boxes it meets, as a box lies in its parent's."""
    return blocks.descended(_levels(spark, sf_dir)[1], windows(spark, sf_dir)).select(F.col("level").cast("long").alias("level"), "qid", "strip", "tile")


@query(PAIRS_R)
def range_query_packed_levels(spark, sf_dir):
    """Down a tree with as many tiles as the points need; with 8 by 8 a tile would grow with the table."""
    return blocks.range_query_levels(*_packed_tree(spark, sf_dir, _packed_side(_points(spark, sf_dir, "pe"))), windows(spark, sf_dir))


_AT_LEAF = f"WITH {PE}, {PYRAMID}, e AS (SELECT pe.*, cell * 64 + depth AS leaf FROM pe JOIN leaf ON z >> (2 * ({BITS} - depth)) = cell), p AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY z, id) - 1 AS pos FROM e)"


@query(f"{_AT_LEAF} SELECT id, leaf, pos FROM p")
def leaf_positions(spark, sf_dir):
    return _entries(spark, sf_dir, "pe").select("id", "leaf", F.col("pos").cast("long").alias("pos"))


@query(f"{_AT_LEAF} SELECT leaf, count(*) AS n, 0::BIGINT AS outside FROM p GROUP BY leaf")
def learned_bounds_valid(spark, sf_dir):
    return learned.violations(_entries(spark, sf_dir, "pe"), _models(spark, sf_dir, "pe"))


@query(f"{_AT_LEAF} SELECT leaf, count(*) AS n, 0::BIGINT AS outside FROM p GROUP BY leaf")
def network_bounds_valid(spark, sf_dir):
    entries = _entries(spark, sf_dir, "pe")
    models = _written(learned.network_models(entries, steps=60))
    return learned.violations(entries, learned.with_bounds(entries, models, learned.network_guess()), learned.network_guess())


_QUARTER = "4 * leaf + CASE WHEN hi > lo THEN least(3, floor(4.0::DOUBLE * (z - lo)::DOUBLE / (hi - lo)::DOUBLE))::BIGINT ELSE 0 END"


@query(f"{_AT_LEAF}, s AS (SELECT leaf, min(z) AS lo, max(z) AS hi FROM p GROUP BY leaf) SELECT {_QUARTER} AS leaf, count(*) AS n, 0::BIGINT AS outside FROM p JOIN s USING (leaf) GROUP BY 1")
def quartered_networks_valid(spark, sf_dir):
    """Leaves cut into quarters, each with its part of the parent's network."""
    entries = _entries(spark, sf_dir, "pe")
    rows, models = learned.quartered_models(entries, _written(learned.network_models(entries, steps=60, threshold=20, tries=2)))
    rows = _written(rows)
    return learned.violations(rows, _written(learned.with_bounds(rows, models, learned.network_guess())), learned.network_guess())


@query(f"{_AT_LEAF} SELECT leaf, count(*) AS n, 0::BIGINT AS outside FROM p GROUP BY leaf")
def edge_models_valid(spark, sf_dir):
    """Models fitted to each leaf's rows and its neighbours' nearest codes."""
    entries = _entries(spark, sf_dir, "pe")
    return learned.violations(entries, _written(learned.with_bounds(entries, learned.linear_models(learned.with_edges(entries)))))


@query(f"{_AT_LEAF}, b AS (SELECT leaf, min(z) AS z0 FROM p GROUP BY leaf) SELECT leaf, count(*) AS n, round(coalesce(regr_slope(pos::DOUBLE, (z - z0)::DOUBLE), 0) * 1e6, 3) AS slope, round(coalesce(regr_intercept(pos::DOUBLE, (z - z0)::DOUBLE), avg(pos)), 3) AS intercept FROM p JOIN b USING (leaf) GROUP BY leaf")
def leaf_regression(spark, sf_dir):
    m = _models(spark, sf_dir, "pe")
    return m.select("leaf", "n", F.round(F.col("a") * 1e6, 3).alias("slope"), F.round("b", 3).alias("intercept"))


_MODEL = f"{_AT_LEAF}, b AS (SELECT leaf, min(z) AS z0 FROM p GROUP BY leaf), m AS (SELECT leaf, count(*) AS n, coalesce(regr_slope(pos::DOUBLE, (z - z0)::DOUBLE), 0) AS a, coalesce(regr_intercept(pos::DOUBLE, (z - z0)::DOUBLE), avg(pos)) AS c FROM p JOIN b USING (leaf) GROUP BY leaf), w AS (SELECT leaf, any_value(n) AS n, floor(min(a * (z - z0)::DOUBLE + c - pos) - 1e-6::DOUBLE)::BIGINT AS min_err, ceil(max(a * (z - z0)::DOUBLE + c - pos) + 1e-6::DOUBLE)::BIGINT AS max_err FROM p JOIN b USING (leaf) JOIN m USING (leaf) GROUP BY leaf)"


@query(f"{_MODEL} SELECT leaf, n, min_err, max_err FROM w")
def leaf_error_bounds(spark, sf_dir):
    return _models(spark, sf_dir, "pe").select("leaf", "n", "min_err", "max_err")


@query(f"{_MODEL} SELECT leaf, n, max_err - min_err + 1 AS slots, ceil((max_err - min_err + 1) / 146.0::DOUBLE)::BIGINT AS pages, ceil((max_err - min_err) * 0.5::DOUBLE)::BIGINT AS gaps FROM w")
def lookup_pages(spark, sf_dir):
    models = _models(spark, sf_dir, "pe")
    return learned.lookup_pages(models).join(updates.gap_sizes(models, 0.5), "leaf")


@query(f"{_MODEL} SELECT round(avg(max_err - min_err), 6) AS mean_error, round(sum(ceil((max_err - min_err + 1) / 146.0::DOUBLE) * n) / sum(n), 6) AS pages FROM w")
def model_costs(spark, sf_dir):
    """The mean error interval, and the pages that a lookup is expected to read."""
    models = _models(spark, sf_dir, "pe")
    both = metrics.mean_error(models).join(F.broadcast(metrics.expected_lookup_pages(models)))  # one row each
    return both.select(F.round("mean_error", 6).alias("mean_error"), F.round("pages", 6).alias("pages"))


@query(f"WITH {PE}, {PYRAMID}, v AS (SELECT cell << (2 * ({BITS} - depth)) AS value FROM leaf) SELECT id, max(value) AS found FROM pe LEFT JOIN v ON value <= z GROUP BY id")
def asof_leaf(spark, sf_dir):
    points = pe(spark, sf_dir)
    return search.greatest_at_most(_leaves(points).select("value"), "value", points.select("id", "z"), "z").select("id", "found")


@query(f"WITH {PE}, {PO}, q AS (SELECT DISTINCT z AS qz FROM po), h AS (SELECT z, count(*) AS c FROM pe GROUP BY z), r AS (SELECT z, sum(c) OVER (ORDER BY z) AS s FROM h) SELECT qz AS z, coalesce(s, 0)::BIGINT AS n FROM q ASOF LEFT JOIN r ON q.qz >= r.z")
def count_at_most(spark, sf_dir):
    return search.count_at_most(pe(spark, sf_dir), "z", po(spark, sf_dir), "z")


@query(f"WITH {PE}, {PO}, q AS (SELECT DISTINCT z AS qz FROM po), k AS (SELECT DISTINCT z FROM pe), a AS (SELECT qz, k.z AS lo FROM q ASOF LEFT JOIN k ON q.qz >= k.z), b AS (SELECT qz, k.z AS hi FROM q ASOF LEFT JOIN k ON q.qz <= k.z) SELECT a.qz AS z, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN a.qz - lo < hi - a.qz THEN lo ELSE hi END AS nearest FROM a JOIN b USING (qz)")
def nearest_key(spark, sf_dir):
    return search.nearest_key(pe(spark, sf_dir).select("z"), "z", po(spark, sf_dir), "z")


@query(f"WITH {PO} SELECT z, min(id) AS id FROM po GROUP BY z")
def unique_keys(spark, sf_dir):
    return search.unique_keys(po(spark, sf_dir), "z", "id")


@query(f"WITH {PE}, {PYRAMID} SELECT (SELECT count(*) FROM pe) AS entries, (SELECT count(*) FROM pe) * 28 AS entry_bytes, (SELECT count(*) FROM leaf) AS structure_rows, (SELECT count(*) FROM leaf) * 64 AS structure_bytes")
def index_size(spark, sf_dir):
    points = pe(spark, sf_dir)
    return metrics.index_size(points, _leaves(points), 64)


_LEAF_CELLS = f"lc AS (SELECT n, {compact_sql('cell', DEEPEST)} << ({BITS} - depth) AS cx, {compact_sql('(cell >> 1)', DEEPEST)} << ({BITS} - depth) AS cy, 1::BIGINT << ({BITS} - depth) AS side FROM leaf)"


@query(f"WITH {PE}, {WQ}, {PYRAMID}, {_LEAF_CELLS}, a AS (SELECT qid, {axis_sql('lft')} AS x0, {axis_sql('rgt')} AS x1, {axis_sql('bottom')} AS y0, {axis_sql('up')} AS y1 FROM wq) SELECT qid, count(*) AS leaves, sum(ceil(n / 146.0::DOUBLE)::BIGINT)::BIGINT AS pages FROM a JOIN lc ON x0 < cx + side AND x1 >= cx AND y0 < cy + side AND y1 >= cy GROUP BY qid")
def leaf_io_cost(spark, sf_dir):
    alike = cells.together(windows(spark, sf_dir), blocks.SIDES)
    return cells.apart(metrics.leaf_pages(cells.leaves_met(_meta(spark, sf_dir, "pe"), alike.drop("_qids"), UNIT, BITS)), alike)


_SIZES = (100, 200, 400, 800, 1600)


@query(f"WITH {PE}, {WQ}, o AS (SELECT *, row_number() OVER (ORDER BY z, id) - 1 AS p FROM pe), br AS (SELECT s.per_block::BIGINT AS per_block, p // s.per_block AS blk, min(y) AS b_bottom, max(y) AS b_up, min(x) AS b_left, max(x) AS b_right FROM o, (VALUES {', '.join(f'({s})' for s in _SIZES)}) s(per_block) GROUP BY ALL), nb AS (SELECT per_block, count(*) AS blocks FROM br GROUP BY 1), m AS (SELECT per_block, count(*) AS met FROM wq JOIN br ON {_MEET} GROUP BY 1) SELECT per_block, blocks, coalesce(met, 0) AS met FROM nb LEFT JOIN m USING (per_block)")
def block_size_grid(spark, sf_dir):
    """Blocks of five sizes, and how often a window meets one: the longer ones are made of the shortest."""
    shortest = _written(blocks.block_ranges(blocks.with_blocks(_points(spark, sf_dir, "pe"), ["z", "id"], _SIZES[0])))
    found = blocks.rolled_up(shortest, [size // _SIZES[0] for size in _SIZES]).withColumn("blk", F.struct("factor", "blk")).checkpoint()
    alike = cells.together(windows(spark, sf_dir), blocks.SIDES).withColumn("_w", F.size("_qids")).drop("_qids")
    met = blocks.blocks_met(found, alike, UNIT, BITS).groupBy("blk.factor").agg(F.sum("_w").alias("met"))
    out = found.groupBy("factor").agg(F.count("*").alias("blocks")).join(met, "factor", "left")
    return out.select((F.col("factor") * _SIZES[0]).alias("per_block"), "blocks", F.coalesce("met", F.lit(0)).alias("met"))


@query(f"WITH {PE}, pyr AS (SELECT d, z >> (2 * ({BITS} - d)) AS cell, count(*) AS n FROM pe, range(0, {DEEPEST + 1}) r(d) GROUP BY ALL), s AS (SELECT * FROM (VALUES (50), (100), (250), (500)) v(most)) SELECT most::BIGINT AS most, count(*) AS leaves, max(a.d) AS depth FROM s, pyr a LEFT JOIN pyr p ON p.d = a.d - 1 AND p.cell = a.cell >> 2 WHERE (a.n <= most OR a.d = {DEEPEST}) AND (a.d = 0 OR p.n > most) GROUP BY 1")
def leaf_size_grid(spark, sf_dir):
    return cells.leaf_counts(_points(spark, sf_dir, "pe"), [50, 100, 250, 500], BITS, DEEPEST)


# -- inserts and deletes ---------------------------------------------------------------------------


def _halves(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    return points.where(F.col("t") < CUT), points.where(F.col("t") >= CUT)


@query(PAIRS_R)
def insert_union_range(spark, sf_dir):
    return search.range_join(updates.inserted(*_halves(pe(spark, sf_dir))), windows(spark, sf_dir), UNIT, BITS)


_DELTA = f"WITH {PE}, d AS (SELECT *, (row_number() OVER (ORDER BY t, id) - 1) // 500 AS blk FROM pe WHERE t >= {CUT}), s AS (SELECT blk, count(*) AS n, min(y) AS b, max(y) AS u, min(x) AS l, max(x) AS r FROM d GROUP BY 1)"


@query(f"{_DELTA} SELECT blk, n, n >= 500 AS sealed, n >= 500 AND (SELECT count(*) FROM s) >= 5 AS outdated, CASE WHEN n >= 500 THEN b END AS bottom, CASE WHEN n >= 500 THEN u END AS up, CASE WHEN n >= 500 THEN l END AS lft, CASE WHEN n >= 500 THEN r END AS rgt FROM s")
def delta_blocks(spark, sf_dir):
    return updates.delta_blocks(_halves(pe(spark, sf_dir))[1], ["t", "id"], 500, 5).withColumnsRenamed({"left": "lft", "right": "rgt"})


@query(f"WITH {PE}, {PYRAMID} SELECT cell * 64 + depth AS leaf, n FROM leaf")
def merge_rebuild_leaves(spark, sf_dir):
    return updates.merged_leaves(*_halves(pe(spark, sf_dir)), LEAF_ROWS, BITS, DEEPEST, UNIT).select("leaf", "n")


@query(f"WITH {PE} SELECT sum(n)::BIGINT AS n, 0::BIGINT AS outside FROM (SELECT count(*) AS n FROM pe)")
def refreshed_models_valid(spark, sf_dir):
    points = pe(spark, sf_dir)
    old, new = _halves(points)
    meta = _written(cells.leaf_meta(cells.all_leaves(old, LEAF_ROWS, BITS, DEEPEST), UNIT, BITS))
    before = _written(learned.leaf_positions(cells.assign_leaves(old, meta, BITS)))
    models = _written(learned.with_bounds(before, learned.linear_models(before)))
    after = _written(learned.leaf_positions(cells.assign_leaves(points, meta, BITS)))
    fresh = _written(updates.refreshed_models(models, after, _written(updates.touched_leaves(meta, new, BITS)), 1.5))
    return learned.violations(after, fresh).agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"))


@query(f"WITH {PE} SELECT id FROM pe WHERE NOT ({IN_WINDOW})")
def delete_points(spark, sf_dir):
    points = pe(spark, sf_dir)
    return search.delete_points(points, search.range_query(points, WINDOW)).select("id")


@query(PAIRS_P)
def point_query_predicted_bucket(spark, sf_dir):
    """Main rows and inserted ones, of which only the probe's bucket of each leaf is searched; buckets by the history's distribution."""
    at, meta, delta, cdf = _timed(spark, sf_dir, "po")
    q = cells.assign_leaves(search.with_query_code(place_queries(spark, sf_dir), UNIT, BITS), meta, BITS).withColumn("time_id", F.lit(0).cast("long"))
    return updates.point_query_with_delta(at, delta, updates.with_buckets(q, meta, cdf, WIDTH))


def _timed(spark, sf_dir, name: str):
    """(main rows at their leaves, leaf table, delta with leaf and bucket, forecast): half of the points, the others inserted by the forecast of their leaf, here its own distribution."""
    points = _points(spark, sf_dir, name)
    main, delta = points.where("id % 2 = 0"), points.where("id % 2 = 1")
    meta = _stored(spark, sf_dir, f"{name}_half_leaves", lambda: cells.leaf_meta(cells.all_leaves(main, LEAF_ROWS, BITS, DEEPEST), UNIT, BITS))
    at = cells.assign_leaves(main, meta, BITS)
    spans = meta.select("leaf", "value", (F.col("value") + F.col("value_diff")).alias("end"))
    cdf = _stored(spark, sf_dir, f"{name}_half_cdf", lambda: series.cdf_series(at.join(spans, "leaf").withColumn("time_id", F.lit(0).cast("long")), "leaf", "value", "end", WIDTH).withColumn("max_key", F.greatest(F.col("n") - 1, F.lit(0))))
    placed = _stored(spark, sf_dir, f"{name}_half_delta", lambda: updates.with_buckets(cells.assign_leaves(delta, meta, BITS).withColumn("time_id", F.lit(0).cast("long")), meta, cdf, WIDTH))
    return at, meta, placed, cdf


@query(PAIRS_R)
def range_query_predicted_buckets(spark, sf_dir):
    """Main rows by leaf, and of the inserted ones the buckets of each leaf between those of the window's first and last code there."""
    at, meta, delta, cdf = _timed(spark, sf_dir, "pe")
    w = windows(spark, sf_dir)
    return search.range_join_by_leaf(at, meta, w, UNIT, BITS).unionByName(updates.range_query_buckets(delta, meta, cdf, w, UNIT, BITS, WIDTH))


@query(PAIRS_K)
def knn_main_and_delta(spark, sf_dir):
    """Bounded by the main rows' counts; rows not merged yet lie at the main table's leaves."""
    at, meta, delta, _ = _timed(spark, sf_dir, "pe")
    return _as_pairs(search.knn_join(updates.inserted(at.select("leaf", "id", "x", "y"), delta), meta, neighbours(spark, sf_dir), UNIT, BITS))


def _versions(spark, sf_dir):
    """(entries, models) of three versions: ten days at a time are inserted and merged, models refitted where they got worse."""
    points = _points(spark, sf_dir, "pe")
    days = [points.where(F.col("t").between(START + 10 * k * DAY, START + 10 * (k + 1) * DAY - 1)) for k in range(3)]
    rest = points.where((F.col("t") < START) | (F.col("t") >= START + 30 * DAY))
    meta = _written(cells.leaf_meta(cells.all_leaves(days[0], LEAF_ROWS, BITS, DEEPEST), UNIT, BITS))
    versions = [updates.first_version(updates.inserted(days[0], rest), meta, BITS)]
    for delta in days[1:]:
        versions.append(updates.merged_version(versions[-1], delta, meta, BITS, 1.5))
    return versions


@query(f"WITH {PE} SELECT id, (z >> {2 * BITS - 6}) AS cell, 0::BIGINT AS outside FROM pe")
def timed_merges(spark, sf_dir):
    """The rows of the last version, and how many lie outside their model's bounds."""
    entries, models = _versions(spark, sf_dir)[-1]
    return entries.join(learned.violations(entries, models).select("leaf", "outside"), "leaf").select("id", F.shiftright("z", 2 * BITS - 6).alias("cell"), "outside")


@query(f"WITH {PE} SELECT v AS version, count(*) AS n, 0::BIGINT AS outside FROM pe, range(0, 3) r(v) WHERE t < {START} OR t >= {START + 30 * DAY} OR t < {START} + (v + 1) * {10 * DAY} GROUP BY 1")
def version_snapshots(spark, sf_dir):
    """Rows and models of each version are saved, read again by its number, and hold together: its rows, and those outside their model's bounds."""
    folder = f"{shared_folder(prepared(spark))}/versions-{uuid.uuid4().hex}"
    out = None
    for k, (entries, models) in enumerate(_versions(spark, sf_dir)):
        src.save_index(folder, version=k, entries=entries, models=models)
        found = learned.violations(*src.load_index(spark, folder, "entries", "models", version=k)).agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"))
        found = found.select(F.lit(k).cast("long").alias("version"), "n", "outside")
        out = found if out is None else out.unionByName(found)
    return out


# -- time ------------------------------------------------------------------------------------------

_KEYED = f"WITH {PE}, k AS (SELECT z >> {2 * (BITS - KEY_DEPTH)} AS cell, z, (t - {START}) // {DAY} AS time_id FROM pe)"


def _keyed(spark, sf_dir):
    c = Z.prefix(F.col("z"), BITS, KEY_DEPTH)
    span = 1 << (2 * (BITS - KEY_DEPTH))
    out = pe(spark, sf_dir).withColumns({"cell": c, "time_id": series.time_id(F.col("t"), START, DAY)})
    return out.withColumns({"low": F.col("cell") * span, "high": (F.col("cell") + 1) * span})


@query(f"{_KEYED}, g AS (SELECT cell, time_id FROM (SELECT DISTINCT cell FROM k), range(0, {DAYS}) r(time_id)), n AS (SELECT cell, time_id, count(*) AS n FROM k GROUP BY ALL) SELECT cell, time_id, coalesce(n, 0) AS n, greatest(coalesce(n, 0) - 1, 0) AS max_key FROM g LEFT JOIN n USING (cell, time_id)")
def time_bucket_counts(spark, sf_dir):
    return series.bucket_counts(_keyed(spark, sf_dir), "cell", DAYS - 1)


@query(f"WITH {PE} SELECT greatest(0, ceil((t - {START}) / {DAY}.0::DOUBLE)::BIGINT - 1) AS grp, count(*) AS n FROM pe GROUP BY 1")
def time_groups_right_closed(spark, sf_dir):
    return pe(spark, sf_dir).groupBy(series.right_closed_group(F.col("t"), START, DAY).alias("grp")).agg(F.count("*").alias("n"))


_SPAN = 1 << (2 * (BITS - KEY_DEPTH))
_CDF = f"{_KEYED}, s AS (SELECT cell, time_id, least(greatest(ceil((z - cell * {_SPAN}) * {WIDTH}.0::DOUBLE / {_SPAN}.0::DOUBLE)::INT, 0), {WIDTH}) AS step FROM k), c AS (SELECT cell, time_id, i, count(*) AS n, (count(*) FILTER (step <= i))::DOUBLE / count(*) AS cdf FROM s, range(0, {WIDTH}) r(i) GROUP BY ALL)"


def _cdf(spark, sf_dir):
    return series.cdf_series(_keyed(spark, sf_dir), "cell", "low", "high", WIDTH)


@query(f"{_CDF} SELECT cell, time_id, i, n, cdf FROM c")
def cdf_series(spark, sf_dir):
    return _cdf(spark, sf_dir).select("cell", "time_id", "n", F.posexplode("cdf").alias("i", "cdf")).withColumn("i", F.col("i").cast("long"))


@query(f"{_CDF}, f AS (SELECT cell, time_id, i FROM (SELECT DISTINCT cell FROM k), range(0, {DAYS}) r(time_id), range(0, {WIDTH}) q(i)), j AS (SELECT f.cell, f.time_id, f.i, coalesce(n, 0) AS n, last_value(cdf IGNORE NULLS) OVER (PARTITION BY f.cell, f.i ORDER BY f.time_id) AS cdf FROM f LEFT JOIN c USING (cell, time_id, i)) SELECT * FROM j WHERE cdf IS NOT NULL")
def cdf_forward_fill(spark, sf_dir):
    out = series.filled_series(_cdf(spark, sf_dir), "cell", DAYS - 1)
    return out.select("cell", "time_id", "n", F.posexplode("cdf").alias("i", "cdf")).withColumn("i", F.col("i").cast("long"))


@query(f"{_CDF}, m AS (SELECT *, min(cdf) OVER w AS lo, max(cdf) OVER w AS hi FROM c WINDOW w AS (PARTITION BY cell, time_id)) SELECT cell, time_id, i, CASE WHEN lo = hi THEN cdf ELSE round((cdf - lo) / (hi - lo), 9) END AS cdf FROM m")
def cdf_correct(spark, sf_dir):
    c = _cdf(spark, sf_dir).withColumn("cdf", series.corrected_cdf(F.col("cdf")))
    return c.select("cell", "time_id", F.posexplode("cdf").alias("i", "cdf")).select("cell", "time_id", F.col("i").cast("long").alias("i"), F.round("cdf", 9).alias("cdf"))


@query(f"{_CDF}, a AS (SELECT cell, time_id, any_value(n) AS n, list(cdf ORDER BY i) AS cdf FROM c GROUP BY ALL), p AS (SELECT k.cell, k.time_id, z, n - 1 AS mk, cdf, (z - k.cell * {_SPAN})::DOUBLE / {_SPAN}.0::DOUBLE * {WIDTH}.0::DOUBLE AS pos FROM k JOIN a USING (cell, time_id)) SELECT cell, time_id, z, CASE WHEN pos >= {WIDTH - 1} THEN mk ELSE trunc((cdf[floor(pos)::INT + 1] + (cdf[floor(pos)::INT + 2] - cdf[floor(pos)::INT + 1]) * (pos - floor(pos))) * mk)::BIGINT END AS bucket FROM p")
def predicted_bucket(spark, sf_dir):
    c = _cdf(spark, sf_dir).withColumn("max_key", F.col("n") - 1)
    j = _keyed(spark, sf_dir).join(c, ["cell", "time_id"])
    return j.select("cell", "time_id", "z", series.predicted_bucket(F.col("z"), F.col("low"), F.col("high"), F.col("cdf"), F.col("max_key"), WIDTH).alias("bucket"))


def _history(spark, sf_dir):
    s = _written(series.filled_series(_cdf(spark, sf_dir), "cell", DAYS - 1).withColumn("max_key", F.greatest(F.col("n") - 1, F.lit(0))))
    return s.where(F.col("time_id") < DAYS - 3), s.where(F.col("time_id") >= DAYS - 3)


def _forecast_query(name: str, cdf_model: str, count_model: str) -> None:
    def run(spark, sf_dir):
        f = series.forecast(_history(spark, sf_dir)[0], "cell", 7, 3, cdf_model, count_model)
        return f.select("cell", "time_id", "max_key", F.posexplode("cdf").alias("i", "cdf"))

    QUERIES[name] = run


for _name, _a, _b in (("forecast_holt_winters", "es", "es"), ("forecast_var", "var", "es"), ("forecast_seasonal_ar", "sarima", "sarima"), ("forecast_recurrent", "gru", "gru")):
    _forecast_query(_name, _a, _b)


@query(f"{_KEYED}, g AS (SELECT cell, time_id FROM (SELECT DISTINCT cell FROM k), range(0, {DAYS}) r(time_id)), n AS (SELECT g.cell, g.time_id, count(k.z) AS n FROM g LEFT JOIN k ON g.cell = k.cell AND g.time_id = k.time_id GROUP BY ALL), f AS (SELECT cell, min(time_id) AS f FROM n WHERE n > 0 GROUP BY cell), m AS (SELECT cell, time_id, greatest(n - 1, 0) AS mk FROM n JOIN f USING (cell) WHERE time_id >= f) SELECT a.cell, round(avg(abs(a.mk - b.mk)), 9) AS mae FROM m a JOIN m b ON a.cell = b.cell AND b.time_id = {DAYS - 4} WHERE a.time_id >= {DAYS - 3} GROUP BY a.cell")
def forecast_mae_repeat_last(spark, sf_dir):
    past, actual = _history(spark, sf_dir)
    e = series.forecast_error(series.forecast(past, "cell", 7, 3, "last", "last"), actual, "cell")
    return e.select("cell", F.round("max_key_mae", 9).alias("mae"))


@query()
def forecaster_ranking(spark, sf_dir):
    past, actual = _history(spark, sf_dir)
    return series.search_forecasters(past, actual, "cell", 3, [("last", 7), ("es", 7), ("var", 3), ("var", 7), ("varma", 7), ("sarima", 7), ("gru", 7), ("lstm", 7), ("convlstm", 7)])


def _repeat_error(last: int) -> str:
    """SQL: (cell, k, c), the errors of the three intervals after `last` against it."""
    return f"(SELECT a.cell, avg(abs(a.mk - b.mk)) AS k, avg(list_sum(list_transform(list_zip(a.cdf, p.cdf), lambda v: abs(v[1] - v[2]))) / {WIDTH}) AS c FROM m a JOIN m b ON a.cell = b.cell AND b.time_id = {last} JOIN fixed p ON a.cell = p.cell AND p.time_id = {last} WHERE a.time_id BETWEEN {last + 1} AND {last + 3} GROUP BY a.cell)"


_FILLED = f"{_CDF}, f AS (SELECT cell, time_id, i FROM (SELECT DISTINCT cell FROM k), range(0, {DAYS}) r(time_id), range(0, {WIDTH}) q(i)), j AS (SELECT f.cell, f.time_id, f.i, coalesce(n, 0) AS n, last_value(cdf IGNORE NULLS) OVER (PARTITION BY f.cell, f.i ORDER BY f.time_id) AS cdf FROM f LEFT JOIN c USING (cell, time_id, i)), m AS (SELECT cell, time_id, greatest(any_value(n) - 1, 0) AS mk, list(cdf ORDER BY i) AS cdf FROM j WHERE cdf IS NOT NULL GROUP BY ALL), fixed AS (SELECT cell, time_id, CASE WHEN list_min(cdf) = list_max(cdf) THEN cdf ELSE list_transform(cdf, lambda v: (v - list_min(cdf)) / (list_max(cdf) - list_min(cdf))) END AS cdf FROM m)"


@query(f"{_FILLED} SELECT a.cell FROM {_repeat_error(DAYS - 4)} a LEFT JOIN {_repeat_error(DAYS - 7)} b USING (cell) WHERE b.k IS NULL OR a.c > b.c * 1.1::DOUBLE OR a.k > b.k * 1.1::DOUBLE")
def forecasts_due(spark, sf_dir):
    """Cells whose forecast over the last three days was worse than over the three before by more than a tenth."""
    past, actual = _history(spark, sf_dir)
    return series.due_for_refit(*_two_errors(past, actual), "cell", 1.1)


def _two_errors(past: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors over the last three days, over the three before) of repeating the last interval."""
    older, newer = past.where(F.col("time_id") < DAYS - 6), past.where(F.col("time_id") >= DAYS - 6)
    error = lambda s, a: series.forecast_error(series.forecast(s, "cell", 7, 3, "last", "last"), a, "cell")
    return error(past, actual), error(older, newer)


@query()
def forecast_next_horizon(spark, sf_dir):
    """After three days are over: cells whose error grew are fitted anew, others' forecasts go on."""
    past, actual = _history(spark, sf_dir)
    used = series.forecast(past, "cell", 7, 3)
    f = series.next_horizon(past.unionByName(actual), used, series.due_for_refit(*_two_errors(past, actual), "cell", 1.1), "cell", 7, 3)
    return f.select("cell", "time_id", "max_key", F.posexplode("cdf").alias("i", "cdf"))


@query(f"{_KEYED} SELECT time_id, count(*) AS n FROM k GROUP BY 1")
def streaming_update(spark, sf_dir):
    """Events taken as a stream into a timed index, every interval closed; rows by interval."""
    points = pe(spark, sf_dir)
    meta = cells.leaf_meta(cells.all_leaves(points, LEAF_ROWS, BITS, DEEPEST), UNIT, BITS)
    folder = f"{shared_folder(prepared(spark))}/stream-{uuid.uuid4().hex}"
    meta.write.parquet(f"{folder}/leaves")
    index = stream.TimedIndex(spark, folder, spark.read.parquet(f"{folder}/leaves"), UNIT, BITS, START, DAY, WIDTH)
    points.select("id", "x", "y", "t").write.parquet(f"{folder}/arrivals")
    source = spark.readStream.schema("id long, x double, y double, t long").parquet(f"{folder}/arrivals")
    run = stream.run_stream(source, index, f"{folder}/offsets")
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    index.finish()
    return index.closed().groupBy(F.col("time_id").cast("long").alias("time_id")).agg(F.sum("n").alias("n"))


@query(f"WITH {PE} SELECT t // {DAY} * {DAY} AS start, z >> {2 * (BITS - KEY_DEPTH)} AS cell, count(*) AS n FROM pe WHERE (t // {DAY} + 1) * {DAY} <= (SELECT max(t) FROM pe) - {DAY} GROUP BY ALL")
def streaming_window_counts(spark, sf_dir):
    """Counts by day and coarse cell of a stream with a watermark: the windows that are complete when it ends."""
    folder = f"{shared_folder(prepared(spark))}/windows-{uuid.uuid4().hex}"
    pe(spark, sf_dir).select(F.timestamp_seconds("t").alias("ts"), "x", "y").write.parquet(f"{folder}/arrivals")
    source = spark.readStream.schema("ts timestamp, x double, y double").parquet(f"{folder}/arrivals")
    counts = stream.windowed_counts(source, UNIT, BITS, KEY_DEPTH, "1 day", "1 day").select(F.unix_seconds("window.start").alias("start"), "cell", "n")
    run = counts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.schema("start long, cell long, n long").parquet(f"{folder}/out")


# -- preparation -----------------------------------------------------------------------------------


@query(f"WITH {PE} SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(t) AS min_t, max(t) AS max_t FROM pe WHERE {IN_WINDOW}")
def prep_region_report(spark, sf_dir):
    return prep.region_report(pe(spark, sf_dir), WINDOW)


@query(f"WITH {PE} SELECT id, 1000 + row_number() OVER (ORDER BY t, id) - 1 AS key FROM pe")
def prep_keys(spark, sf_dir):
    return prep.with_keys(pe(spark, sf_dir), ["t", "id"], 1000).select("id", "key")


@query(f"WITH {PO} SELECT DISTINCT x, y FROM po")
def prep_distinct(spark, sf_dir):
    return prep.distinct_points(po(spark, sf_dir).select("x", "y"))


@query(f"WITH {PE} SELECT id, t FROM pe WHERE t < {CUT}")
def prep_trim(spark, sf_dir):
    return prep.before(pe(spark, sf_dir), CUT).select("id", "t")


@query(f"WITH {PE} SELECT id, t FROM pe WHERE t <= {CUT}")
def prep_up_to(spark, sf_dir):
    return prep.up_to(pe(spark, sf_dir), CUT).select("id", "t")


def _mixed(v: str, seed: str) -> str:
    h = f"(((({v}) % 2147483648) * 1103515245 + ({seed}) * 1013904223) % 4294967296)"
    h = f"((xor({h}, {h} >> 16) * 668265263) % 4294967296)"
    return f"xor({h}, {h} >> 15)"


@query(f"WITH {PE} SELECT id AS qid, x AS qx, y AS qy FROM pe ORDER BY {_mixed('id', '1')}, id LIMIT 1000")
def prep_point_queries(spark, sf_dir):
    return prep.point_queries(pe(spark, sf_dir), 1000)


@query(f"WITH {PE}, r AS (SELECT id, x, y, k, row_number() OVER (PARTITION BY k ORDER BY {_mixed('id', 'k::BIGINT')}, id) AS n FROM pe, (VALUES (4), (8), (16), (32), (64)) v(k)) SELECT id AS qid, x AS qx, y AS qy, k FROM r WHERE n <= 200")
def prep_knn_queries(spark, sf_dir):
    return prep.knn_queries(pe(spark, sf_dir), [4, 8, 16, 32, 64], 200)


@query("SELECT 5000 AS n, 0 AS outside")
def prep_range_windows(spark, sf_dir):
    w = prep.range_windows(spark, UNIT, [6e-6, 2.5e-5, 1e-4, 4e-4, 1.6e-3], 1000)
    return w.agg(F.count("*").cast("int").alias("n"), F.count_if((F.col("up") > 1) | (F.col("right") > 1)).cast("int").alias("outside"))


@query("SELECT 20000 AS n, 0 AS outside")
def prep_generators(spark, sf_dir):
    both = prep.uniform_points(spark, 10_000, START, START + DAY).unionByName(prep.normal_points(spark, 10_000, START, START + DAY))
    return both.agg(F.count("*").cast("int").alias("n"), F.count_if(~F.col("x").between(0, 1) | ~F.col("y").between(0, 1)).cast("int").alias("outside"))


@query(f"WITH {PE}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS key FROM pe), d AS (SELECT draw, floor({_mixed('draw', '1')} / 4294967296.0::DOUBLE * (SELECT count(*) FROM pe))::BIGINT AS key FROM range(0, 1000) r(draw)) SELECT draw, id, x, y FROM d JOIN n USING (key)")
def prep_sample(spark, sf_dir):
    keyed = prep.with_keys(pe(spark, sf_dir), ["id"])
    return prep.sample_with_replacement(keyed, "key", 1000).select("draw", "id", "x", "y")


@query(
    f"WITH {PE}, {PO}, {PQ}, {WQ}, {NQ} SELECT 'events' AS name, 'build' AS kind, count(*) AS n FROM pe WHERE t < {CUT} UNION ALL SELECT 'events', 'update', count(*) FROM pe WHERE t >= {CUT} "
    "UNION ALL SELECT 'events', 'range', count(*) FROM wq UNION ALL SELECT 'events', 'knn', count(*) FROM nq UNION ALL SELECT 'orders', 'build', count(*) FROM po UNION ALL SELECT 'orders', 'point', count(*) FROM pq"
)
def prep_datasets(spark, sf_dir):
    """Rows of each registered table, of what is inserted into it, and of its query sets."""
    fixtures.register(sf_dir)
    found = [(name, kind, src.load(spark, name, update=kind == "update")) for name, kind in (("events", "build"), ("events", "update"), ("orders", "build"))]
    found += [(name, kind, src.load_queries(spark, name, kind)) for name in ("events", "orders") for kind in src.CATALOGUE[name].queries]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "n") for name, kind, df in found]
    return reduce(lambda a, b: a.unionByName(b), out)


from . import growing  # noqa: E402, F401  registers its queries
