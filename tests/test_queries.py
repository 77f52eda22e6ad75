"""Each registered query against its SQL, and access paths against brute force."""

import bisect

import duckdb
import pytest
from pyspark.sql import functions as F

from terrazzo.functions.region import UNIT, Region
from terrazzo.operators import blocks, cells, learned, order, prep, search, series, updates
from terrazzo.plans import catalogue, experiments
from terrazzo.plans.fixtures import BITS
from terrazzo.sources import points as src
from terrazzo.sources import sql
from terrazzo.streaming import updates as stream

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "orders", "events")
#: A sample of the catalogue, one per kind; the whole of it is compared at the larger scale by the driver.
NAMES = (
    "z_encode", "z_neighbours", "geohash_base32", "region_contains", "point_query_brin", "point_query_learned", "range_query_leaves", "range_query_cells",
    "window_cover_merged", "knn_join", "quadtree_leaves_with_empty", "leaf_table", "asof_leaf", "nearest_key", "delta_blocks", "delete_points",
    "cdf_forward_fill", "predicted_bucket", "streaming_update", "prep_keys", "rect_relation", "point_query_packed_tree", "point_query_median_tree", "point_query_asof_leaf",
    "point_query_rmi", "range_query_zbounds", "range_query_packed_tree", "range_query_median_tree", "range_query_predicted_buckets", "range_query_moved", "knn_median_tree", "knn_packed_tree",
    "knn_brin", "knn_code_neighbours", "knn_main_and_delta", "code_neighbours", "median_tree", "timed_merges", "leaf_error_bounds", "leaf_io_cost",
    "prep_knn_queries", "prep_sample", "forecasts_due", "point_query_staged", "edge_models_valid", "sql_range_function", "sql_nearest_function",
    "block_size_grid", "leaf_size_grid", "geohash_digits", "quartered_networks_valid", "version_snapshots", "streaming_window_counts", "prep_datasets",
    "median_tree_boxes", "median_tree_splits", "packed_tree_levels", "packed_tree_descent", "range_query_packed_levels", "knn_by_density", "tree_shrinkage", "tree_networks_valid", "tree_source_range", "window_cells_function",
)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = sorted(map(repr, duck.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want and want


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 60


@pytest.fixture(scope="module")
def points(spark):
    """Points with many at one place and on cell borders."""
    rows = [(i, ((i * 37) % 101) / 101, ((i * 53) % 97) / 97, i) for i in range(800)] + [(800 + i, 0.25, 0.75, i) for i in range(60)] + [(900, 0.0, 0.0, 1), (901, 1.0, 1.0, 1)]
    return prep.coded(spark.createDataFrame(rows, "id long, x double, y double, t long"), UNIT, BITS).checkpoint()


WINDOWS = [(0, 0.2, 0.5, 0.1, 0.4), (1, 0.0, 1.0, 0.0, 1.0), (2, 0.75, 0.75, 0.25, 0.25), (3, 0.9, 1.5, 0.9, 1.5), (4, -2.0, -1.0, 0.0, 1.0), (5, 0.499, 0.501, 0.499, 0.501), (6, 0.6, 0.5, 0.1, 0.2)]


def test_range_paths(spark, points):
    w = spark.createDataFrame(WINDOWS, "qid long, bottom double, up double, left double, right double")
    rows = points.collect()
    want = sorted((q, r.id) for q, b, u, lo, hi in WINDOWS for r in rows if b <= r.y <= u and lo <= r.x <= hi)
    got = lambda df: sorted(map(tuple, df.select("qid", "id").collect()))
    meta = cells.leaf_meta(cells.leaves(points, 40, BITS, 6), UNIT, BITS).checkpoint()
    assert got(search.range_join(points, w, UNIT, BITS)) == want
    assert got(search.range_join_by_leaf(cells.assign_leaves(points, meta, BITS), meta, w, UNIT, BITS)) == want
    by = blocks.with_blocks(points, ["z", "id"], 50)
    assert got(blocks.range_query_blocks(by, blocks.block_ranges(by), w, UNIT, BITS)) == want
    one = Region(0.2, 0.5, 0.1, 0.4)
    assert search.range_query_z(points, one, UNIT, BITS).count() == search.range_query(points, one).count() == sum(q == 0 for q, _ in want)


def test_bounds_reach_the_scan(spark, points, tmp_path):
    prep.sorted_by_code(points).write.parquet(str(tmp_path / "p"))
    plan = search.range_query_z(spark.read.parquet(str(tmp_path / "p")), Region(0.2, 0.5, 0.1, 0.4), UNIT, BITS).select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "IsNotNull(x), GreaterThanOrEqual(z" in pushed and "t:bigint" not in pushed


def test_registered_range_query_pushes_its_bounds(spark):
    plan = catalogue.QUERIES["range_query_zbounds"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(z" in plan[plan.index("PushedFilters") :]


def test_no_nested_loops(spark):
    """Blocks grow with the table, so they meet windows and probes by keys."""
    for name in ("range_query_brin", "point_query_brin", "brin_io_cost", "rect_relation", "point_query_rmi", "range_query_packed_tree"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_merges_touch_only_the_leaves_that_take_rows(spark, points):
    meta = cells.leaf_meta(cells.all_leaves(points, 40, BITS, 6), UNIT, BITS).checkpoint()
    first = updates.first_version(points.where("id % 3 != 0"), meta, BITS)
    delta = points.where("id % 3 = 0 and x < 0.4")
    entries, models = updates.merged_version(first, delta, meta, BITS, 1.5)
    assert entries.count() == points.where("id % 3 != 0").count() + delta.count()
    assert learned.violations(entries, models).agg(F.sum("outside")).first()[0] == 0
    touched = {r.leaf for r in cells.assign_leaves(delta, meta, BITS).select("leaf").distinct().collect()}
    old, new = ({r.leaf: r for r in m.collect()} for m in (first[1], models))
    assert all(new[k] == old[k] for k in old if k not in touched) and any(new[k] != old[k] for k in old if k in touched)


def test_leaves_partition_the_rows(points):
    meta = cells.leaf_meta(cells.all_leaves(points, 40, BITS, 6), UNIT, BITS).collect()
    assert sum(m.n for m in meta) == points.count() and all(m.n <= 40 or m.depth == 6 for m in meta)
    meta.sort(key=lambda m: m.value)
    assert meta[0].value == 0 and all(a.value + a.value_diff == b.value for a, b in zip(meta, meta[1:], strict=False))


def test_nearest_neighbours(spark, points):
    queries = [(0, 0.25, 0.75, 64), (1, 0.5, 0.5, 4), (2, 0.0, 0.0, 8), (3, 1.3, -0.4, 5), (4, 0.1, 0.9, 5000), (5, 1.0, 1.0, 1)]
    q = spark.createDataFrame(queries, "qid long, qx double, qy double, k int")
    rows = points.collect()
    want = []
    for i, x, y, k in queries:
        near = sorted(((r.x - x) * (r.x - x) + (r.y - y) * (r.y - y), r.id) for r in rows)[:k]
        want += [(i, p, n + 1) for n, (_, p) in enumerate(near)]
    meta = cells.leaf_meta(cells.leaves(points, 40, BITS, 6), UNIT, BITS).checkpoint()
    got = search.knn_join(cells.assign_leaves(points, meta, BITS), meta, q, UNIT, BITS)
    assert sorted(tuple(r) for r in got.select("qid", "id", "rank").collect()) == sorted(want)


def test_as_of_edges(spark):
    keys = spark.createDataFrame([(10,), (20,), (30,)], "k long")
    probes = spark.createDataFrame([(i, v) for i, v in enumerate((5, 10, 15, 30, 99))], "i long, v long")
    assert {r.v: r.found for r in search.greatest_at_most(keys, "k", probes, "v").collect()} == {5: None, 10: 10, 15: 10, 30: 30, 99: 30}
    assert {r.v: r.n for r in search.count_at_most(keys, "k", probes, "v").collect()} == {5: 0, 10: 1, 15: 1, 30: 3, 99: 3}
    assert {r.v: r.nearest for r in search.nearest_key(keys, "k", probes, "v").collect()} == {5: 10, 10: 10, 15: 20, 30: 30, 99: 30}


def test_numbering_and_sampling(spark, points):
    keyed = prep.with_keys(points, ["t", "id"], 7).orderBy("t", "id").collect()
    assert [r.key for r in keyed] == list(range(7, 7 + len(keyed)))
    s = prep.sample_with_replacement(prep.with_keys(points, ["id"]), "key", 500).collect()
    assert len(s) == 500 and len({r.id for r in s}) < 500
    assert prep.point_queries(points, 50).exceptAll(prep.point_queries(points, 50)).isEmpty()
    w = prep.range_windows(spark, UNIT, [0.01, 0.04], 100).collect()
    assert len(w) == 200 and all(0 <= r.bottom and r.up <= 1 and abs((r.up - r.bottom) * (r.right - r.left) - r.ratio) < 1e-9 for r in w)


def test_empty_tables(spark):
    none = prep.coded(spark.createDataFrame([], "id long, x double, y double, t long"), UNIT, BITS)
    w = spark.createDataFrame(WINDOWS, "qid long, bottom double, up double, left double, right double")
    assert search.range_join(none, w, UNIT, BITS).isEmpty() and cells.leaves(none, 5, BITS, 4).isEmpty()
    assert blocks.block_ranges(blocks.with_blocks(none, ["z"], 5)).isEmpty()
    assert search.range_join(none, w.where("qid < 0"), UNIT, BITS).isEmpty()


def test_stream_equals_batch(spark, points, tmp_path):
    meta = cells.leaf_meta(cells.all_leaves(points, 100, BITS, 4), UNIT, BITS).checkpoint()
    index = stream.TimedIndex(spark, str(tmp_path), meta, UNIT, BITS, 0, 100, 5)
    for n, (a, b) in enumerate([(0, 250), (250, 251), (500, 900), (100, 130)]):  # an empty interval, and late rows
        index.insert(points.where(F.col("t").between(a, b - 1)).select("id", "x", "y", "t"), n)
    index.insert(points.where("t between 100 and 129").select("id", "x", "y", "t"), 3)  # again: replaces itself
    index.finish()
    got = {r.time_id: r.n for r in index.closed().groupBy("time_id").agg(F.sum("n").alias("n")).collect()}
    t = [r.t for r in points.collect()]
    taken = [v for a, b in ((0, 251), (500, 900), (100, 130)) for v in t if a <= v < b]
    assert got == {k: sum(v // 100 == k for v in taken) for k in {v // 100 for v in taken}}
    ahead = index.predict(3, 2).checkpoint()
    assert {r.time_id for r in ahead.collect()} == {max(got) + 1, max(got) + 2} and ahead.count() == 2 * meta.count()
    assert index.bucketed_delta(ahead).count() == len(taken)


def test_forecast_short_series_repeats(spark):
    s = spark.createDataFrame([(1, i, [0.1, 1.0], 5) for i in range(4)], "leaf long, time_id long, cdf array<double>, max_key long")
    got = series.forecast(s, "leaf", 7, 2).orderBy("time_id").collect()
    assert [r.time_id for r in got] == [4, 5] and {r.max_key for r in got} == {5}
    assert series.empty_forecast(s, "leaf", 0, 2, 3).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,when\n1.5,2.5,2013-01-01 00:00:10\n3.5,4.5,2013-01-01 00:00:05\n")
    got = src.csv_points(spark, str(tmp_path / "a.csv"), "x double, y double, when string", "x", "y", "when").collect()
    assert [tuple(r) for r in got] == [(3.5, 4.5, 1356998405), (1.5, 2.5, 1356998410)] and src.count_lines(spark, str(tmp_path / "a.csv")) == 3
    df = spark.range(3)
    src.save_index(str(tmp_path / "i"), version=2, main=df)
    assert src.load_index(spark, str(tmp_path / "i"), "main", version=2)[0].count() == 3
    src.register("demo", src.Dataset(lambda s: s.range(5), None, UNIT, 5))
    assert src.load(spark, "demo").count() == 5 and src.CATALOGUE["demo"].bits == 20
    src.register("asked", src.Dataset(lambda s: s.range(5), None, UNIT, 5, {"knn": lambda s: s.range(2)}))
    assert src.load_queries(spark, "asked", "knn").count() == 2
    src.save_points(spark.createDataFrame([("1", 2, 0.5, "x")], "id string, x int, y double, other string"), str(tmp_path / "typed"))
    assert spark.read.parquet(str(tmp_path / "typed")).dtypes == [("x", "double"), ("y", "double"), ("id", "bigint")]
    src.save_results(spark.createDataFrame([(1, 3), (1, 2)], "qid long, id long"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).collect()[0].ids == "2 3"


def test_delta_blocks_and_gaps(spark, points):
    d = {r.blk: r for r in updates.delta_blocks(points, ["t", "id"], 100, 3).collect()}
    assert d[0].sealed and d[0].outdated and not d[max(d)].sealed and d[max(d)].bottom is None


@pytest.fixture
def all_ranges(spark):
    """Small ranges aren't joined."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_places_split_hot_values_and_groups(spark, all_ranges):
    """One value and one group hold most rows: their ranges are split, and places are those of a plain sort."""
    rows = [(i, 0 if i % 10 else i % 7, 5 if i % 8 else i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, leaf long, z long").repartition(3)
    laid = order.laid_out(df, ["leaf", "z", "id"])
    assert laid.where("leaf = 0").select("_part").distinct().count() > 1
    by_z = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r.id: r.pos for r in order.numbered(df, ["z", "id"], 10).collect()} == {i: p + 10 for i, p in by_z.items()}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        groups.setdefault(r[1], []).append(r[0])
    assert {r.id: r.pos for r in learned.leaf_positions(df).collect()} == {i: p for g in groups.values() for p, i in enumerate(g)}
    assert order.numbered(df.limit(0), ["z"]).count() == learned.leaf_positions(df.limit(0)).count() == 0


def test_lookups_of_hot_keys(spark, all_ranges):
    """Ties between keys and probes that are spread over many ranges."""
    keys = spark.range(2000).selectExpr("CASE WHEN id % 4 = 0 THEN id ELSE 900 END AS k")
    probes = spark.range(2000).selectExpr("id AS row", "CASE WHEN id % 2 = 0 THEN 900 ELSE id END AS v")
    have = sorted(r.k for r in keys.collect())
    at = lambda v: bisect.bisect_right(have, v)
    for r in search.greatest_at_most(keys, "k", probes, "v").collect():
        assert r.found == (have[at(r.v) - 1] if at(r.v) else None)
    assert all(r.n == at(r.v) for r in search.count_at_most(keys, "k", probes, "v").collect())


def test_next_horizon_fits_only_keys_that_are_due(spark):
    past = spark.createDataFrame([(k, t, [0.0, 0.5, 1.0], 10 * k + t) for k in (1, 2) for t in range(20)], "cell long, time_id long, cdf array<double>, max_key long")
    used = spark.createDataFrame([(k, t, [0.0, 0.1, 1.0], 77) for k in (1, 2) for t in (17, 18, 19)], past.schema)
    due = spark.createDataFrame([(2,)], "cell long")
    got = {(r.cell, r.time_id): (r.cdf, r.max_key) for r in series.next_horizon(past, used, due, "cell", 4, 3, "last", "last").collect()}
    assert got == {(k, t): ([0.0, 0.1, 1.0], 77) if k == 1 else ([0.0, 0.5, 1.0], 39) for k in (1, 2) for t in (20, 21, 22)}
    old = spark.createDataFrame([(1, 0.1, 2.0), (2, 0.1, 2.0)], "cell long, cdf_mae double, max_key_mae double")
    new = spark.createDataFrame([(1, 0.1, 2.1), (2, 0.1, 2.5), (3, 0.0, 0.0)], old.schema)
    assert {r.cell for r in series.due_for_refit(new, old, "cell", 1.1).collect()} == {2, 3}


def test_grid_is_ranked(spark):
    rows = [(k, t, [0.0, 0.5, 1.0], 10 + 5 * (t % 4)) for k in (1, 2) for t in range(43)]
    df = spark.createDataFrame(rows, "cell long, time_id long, cdf array<double>, max_key long")
    got = series.search_forecasters(df.where("time_id < 40"), df.where("time_id >= 40"), "cell", 3, [("last", 4), ("es", 4), ("es", 3)]).collect()
    assert {(r.name, r.lag) for r in got} == {("last", 4), ("es", 4), ("es", 3)} and {(r.name, r.lag): r.max_key_mae for r in got}["es", 4] < 1


def test_sql_functions(spark, points):
    sql.register(spark, "spots", points, UNIT, BITS, k=3)
    assert spark.sql("SELECT count_if(spots_code(x, y) = z) AS n FROM spots").first().n == points.count()
    assert spark.sql("SELECT * FROM spots_at(0.25, 0.75)").count() == points.where("x = 0.25 AND y = 0.75").count() >= 60
    assert [r.id for r in spark.sql("SELECT * FROM spots_nearest(1.0, 1.0)").collect()][0] == 901 and spark.sql("SELECT * FROM spots_nearest(1.0, NULL)").count() == 0
    assert spark.sql("SELECT spots_code(NULL, 0.5) AS c").first().c is None and spark.sql("SELECT * FROM spots_range(0.0, 1.0, NULL, 1.0)").count() == 0
    with pytest.raises(ValueError):
        sql.register(spark, "no name", points, UNIT, BITS)


def test_stages_send_all_rows_and_have_no_gaps(spark, points):
    stages = [1, 16, 40]
    models, n = learned.stage_models(points, stages)
    assert n == points.count() and [m.count() for m in models] == stages[:-1] and all(m.where("a IS NULL OR b IS NULL").isEmpty() for m in models)
    sent = learned.sent_through(points, models, stages, n)
    assert sent.count() == n and sent.where("leaf NOT BETWEEN 0 AND 39").isEmpty() and sent.select("leaf").distinct().count() > 5
    with pytest.raises(ValueError):
        learned.stage_models(points, [2, 4])


def test_edges_are_the_neighbours_codes(spark):
    rows = spark.createDataFrame([(5, 10, 0), (5, 20, 1), (7, 30, 0), (9, 41, 0), (9, 43, 1)], "leaf long, z long, pos long")
    extra = learned.with_edges(rows).exceptAll(rows)
    assert sorted(map(tuple, extra.collect())) == [(5, 30, 2), (7, 20, -1), (7, 41, 1), (9, 30, -1)]


#: One entry of each experiment.
ENTRIES = {
    "block_ranges": {"by_code": True, "per_block": 200}, "median_tree": {"leaf_rows": 250}, "packed_tree": {"side": 3}, "quartered_leaves": {"leaf_rows": 250}, "recursive_models": {"leaves": 8, "edges": True},
    "networks": {"hidden": 4, "steps": 5}, "merges": {"chunks": 1, "factor": 1.5}, "forecasts": {"width": 10, "model": "var", "hours": 24}, "build_partitions": {"partitions": 2}, "codecs": {"codec": "base32_decode"}, "updating": {"method": "tree", "chunks": 1, "factor": 1.5}, "paths": {"path": "point_query_exact"},
}


@pytest.mark.parametrize("name", ENTRIES)
def test_experiments(spark, name):
    assert set(ENTRIES) == set(experiments.EXPERIMENTS)
    got = {r.metric: r.value for r in experiments.run(spark, SF, name, entries=[ENTRIES[name]]).collect()}
    assert got.pop("seconds") > 0 and got and all(v >= 0 for v in got.values())
    if name == "block_ranges":
        assert got["blocks"] == 5 and 1 <= got["met_each"] <= 5
    if name in ("merges", "updating"):
        assert got["outside"] == 0
    if name == "updating":
        other = {m: {r.metric: r.value for r in experiments.run(spark, SF, name, entries=[{"method": m, "chunks": 1, "factor": 1.5}]).collect()} for m in ("rebuild", "models")}
        assert other["rebuild"]["outside"] == other["models"]["outside"] == 0 and got["leaves"] == other["rebuild"]["leaves"]
        assert other["models"]["fitted"] <= other["rebuild"]["fitted"]


def test_windows_meet_leaves_by_the_cells_of_their_codes(spark):
    """A window that begins where a leaf ends isn't met by it; one whose edge rounds into it is."""
    side = 1 << 8
    meta = cells.leaf_meta(spark.createDataFrame([(1, 0, 5), (1, 1, 7), (1, 3, 9)], "depth int, cell long, n long"), UNIT, 8).checkpoint()
    rows = [(0, 0.0, 0.25, 0.5, 0.75), (1, 0.0, 0.25, 0.5 - 0.6 / side, 0.75), (2, 0.0, 0.25, 0.5 - 0.4 / side, 0.75), (3, 0.5, 0.9, 0.5, 0.9), (4, 0.2, 0.6, 0.2, 0.6), (5, None, 1.0, 0.0, 1.0)]
    w = spark.createDataFrame(rows, "qid long, bottom double, up double, left double, right double")
    got = sorted((r.qid, r.n) for r in cells.leaves_met(meta, w, UNIT, 8).collect())
    assert got == [(0, 7), (1, 5), (1, 7), (2, 7), (3, 9), (4, 5), (4, 7), (4, 9)]


def test_queries_that_are_alike_are_answered_together(spark, monkeypatch):
    """Each of many equal windows has its rows, and its count; joins see the box once for TOGETHER of them or so."""
    monkeypatch.setattr(cells, "TOGETHER", 8)
    points = prep.coded(spark.range(200).select("id", (F.col("id") % 17 / 17.0).alias("x"), (F.col("id") % 13 / 13.0).alias("y")), UNIT, BITS).checkpoint()
    k = F.col("id") % 3
    w = spark.range(60).select(F.col("id").alias("qid"), (k * 0.1).alias("bottom"), (k * 0.1 + 0.4).alias("up"), (k * 0.2).alias("left"), (k * 0.2 + 0.3).alias("right"))
    groups = cells.together(w, blocks.SIDES).collect()
    assert len(groups) < 30 and sorted(q for g in groups for q in g._qids) == list(range(60)) and all(g.qid == min(g._qids) for g in groups)
    want = sorted((q.qid, r.id) for q in w.collect() for r in points.collect() if q.bottom <= r.y <= q.up and q.left <= r.x <= q.right)
    assert sorted(map(tuple, search.range_join(points, w, UNIT, BITS).collect())) == want
    assert {r.qid: r.n for r in search.range_counts(points, w, UNIT, BITS).collect()} == {q: sum(1 for a, _ in want if a == q) for q in range(60)}
    by = blocks.with_blocks(points, ["z", "id"], 9)
    assert sorted(map(tuple, blocks.range_query_blocks(by, blocks.block_ranges(by), w, UNIT, BITS).collect())) == want
    met = blocks.pairs_met(blocks.block_ranges(by), w, UNIT, BITS).collect()
    boxes = blocks.block_ranges(by).collect()
    assert sorted((r.qid, r.blk) for r in met) == sorted((q.qid, b.blk) for q in w.collect() for b in boxes if q.bottom <= b.up and b.bottom <= q.up and q.left <= b.right and b.left <= q.right)
