"""The timezone engine against closed forms, fixed vectors and brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian import __main__ as command
from meridian import api
from meridian.functions import geo
from meridian.operators import lookup as lookups
from meridian.operators import quality, stats
from meridian.operators.index import ZoneIndex
from meridian.operators.lookup import MODES, Finder, geometry, lookup
from meridian.operators.pip import Rings, contained, crossed, in_any_hole
from meridian.plans import catalog, world
from meridian.sources import csvio, names, registry
from meridian.sources.geojson import flatten
from meridian.streaming.lookup import local_hours


def pts(spark, n=1500, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(-360, 361) / 2, rng.randrange(-180, 181) / 2) for _ in range(n)]
    return spark.createDataFrame(rows + [(200.0, 1.0), (None, 2.0), (float("nan"), 0.0), (0.0, -91.0)], "lng double, lat double")


def edges_of(ring):
    out = []
    for (x1, y1), (x2, y2) in zip([ring[-1], *ring[:-1]], ring):
        (yl, xl), (yh, xh) = sorted([(y1, x1), (y2, x2)])
        if yl != yh:
            out.append((xl, yl, xh, yh))
    return np.array(out, dtype=np.int64)


@pytest.fixture(scope="module")
def tiled(spark):
    return catalog.index_of(spark, "tiled")


@pytest.mark.parametrize("strategy", ["relational", "arrow"])
@pytest.mark.parametrize("mode", MODES)
def test_lookup_against_brute_force(spark, tiled, mode, strategy):
    zones = world.tiled()
    rows = lookup(pts(spark), tiled, mode, strategy).collect()
    assert len(rows) == 1504 and sum(r.error is not None for r in rows) == 4
    for r in rows:
        if r.x is None:
            assert r.tz_name is None and r.error
            continue
        want = world.brute_force(zones, r.x, r.y)
        if mode in ("full", "certain") and want:
            assert [r.tz_name] == want
        if mode == "certain" and not want:
            assert r.tz_name is None
        if mode == "land":
            assert r.tz_name == next((w for w in want if not w.startswith("Etc/")), None)
        if mode == "unique" and r.tz_name is not None and want:
            assert [r.tz_name] == want


@pytest.mark.parametrize("name", ["gappy", "overlapping"])
def test_worlds_with_gaps_and_overlaps(spark, name):
    index, zones = catalog.index_of(spark, name), getattr(world, name)()
    both = {s: {(r.x, r.y): r.tz_name for r in lookup(pts(spark), index, "certain", s).collect()} for s in ("relational", "arrow")}
    assert both["relational"] == both["arrow"]
    for (x, y), got in both["arrow"].items():
        if x is not None:
            want = world.brute_force(zones, x, y)
            assert (got in want) if want else got is None
            if len(want) == 2:
                assert got == "Land/Small"
    full = {s: {(r.x, r.y): r.tz_name for r in lookup(pts(spark), index, "full", s).collect()} for s in ("relational", "arrow")}
    assert full["relational"] == full["arrow"]


def test_kernel_on_a_complex_ring():
    # A ring that touches itself and points known to lie inside or outside.
    ring = [(x * 10_000, y * 10_000) for x, y in zip([1, 5, 7, 8, 7, 6, 1, 1, 5], [1, 4, 1, 3, 3, 6, 6, 2, 5])]
    at = lambda x, y: bool(crossed(np.array([round(x * 10_000)]), np.array([round(y * 10_000)]), edges_of(ring))[0])
    assert all(at(7, y) for y in (1.0001, 1.1, 1.5, 2.9, 2.999))
    assert not any(at(x, y) for x, y in ((0, 0), (0, 3), (9, 2), (7, 0.9), (2, 2.3), (8.5, 3)))


def test_no_overflow_over_the_whole_globe():
    ring = [(-geo.X_MAX, -geo.Y_MAX), (geo.X_MAX, -geo.Y_MAX), (geo.X_MAX, geo.Y_MAX)]
    assert crossed(np.array([geo.X_MAX - 1]), np.array([geo.Y_MAX - 10_000_000]), edges_of(ring))[0]
    assert not crossed(np.array([-geo.X_MAX + 1]), np.array([geo.Y_MAX - 1]), edges_of(ring))[0]


def test_scaling_truncates(spark):
    rows = spark.createDataFrame([(-1.99999999,), (1.99999999,), (0.0,)], "d double").select(geo.scaled(F.col("d")).alias("v")).collect()
    assert [r.v for r in rows] == [-19999999, 19999999, 0]


@pytest.mark.parametrize("ids, want", [([], 0), ([1], 0), ([1, 1], 0), ([1, 2], 1), ([1, 3, 3], 1), ([1, 3, 3, 0, 0, 0], 3)])
def test_last_change(spark, ids, want):
    assert spark.createDataFrame([(ids,)], "v array<int>").select(geo.last_change(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("tag, want", [("2026c", "1.2026.3"), ("2026z", "1.2026.26"), ("2026aa", "1.2026.27"), ("26c", None)])
def test_release_versions(spark, tag, want):
    assert spark.createDataFrame([(tag,)], "t string").select(geo.release_version(F.col("t"))).first()[0] == want


def test_ring_key_ignores_start_and_direction(spark):
    ring = [(0, 0), (4, 0), (4, 3), (0, 3)]
    turns = [ring[k:] + ring[:k] for k in range(4)] + [ring[::-1], [(0, 0), (4, 0), (4, 3), (0, 2)]]
    df = spark.createDataFrame([([p[0] for p in r], [p[1] for p in r]) for r in turns], "xs array<int>, ys array<int>")
    keys = [r[0] for r in df.select(geo.ring_key(F.col("xs"), F.col("ys"))).collect()]
    assert len(set(keys[:5])) == 1 and keys[5] != keys[0]


def test_holes_refer_to_boundaries(spark, tiled):
    refs = {r.hole_id: r.ref_poly_id for r in tiled.holes.collect()}
    assert sum(v is None for v in refs.values()) == 2  # the strait's clipped holes
    twice = geometry(tiled, "Land/Host").orderBy("poly_id").collect()
    assert [len(r.rings) for r in twice] == [2, 1]
    by_id = geometry(tiled, 1).orderBy("poly_id").collect()
    assert by_id == twice
    with pytest.raises(ValueError):
        geometry(tiled, "Nowhere")
    with pytest.raises(ValueError):
        geometry(tiled, -1)


def test_integrity(spark, tiled):
    for check in (quality.uncovered_vertices, quality.unused_polygons, quality.incoherent_candidates, quality.wrong_references, quality.zones_without_polygons):
        assert check(tiled).count() == 0
    rings = flatten(spark.createDataFrame([(world.geojson([("Land/Bad", [[[(0, 0), (10, 10)]]]), ("Land/None", [])]),)], "value string"))
    assert [r.problem for r in quality.bad_rings(rings).collect()] == ["under three vertices"]


def test_dedup_ratio(spark):
    holes = spark.createDataFrame([(0, 1), (1, None), (2, 3), (2, 3)], "hole_id int, ref_poly_id int")
    assert quality.dedup_ratio(holes).first() == (4, 0.75)
    assert quality.dedup_ratio(holes.where("false")).first() == (0, None)


def test_save_load_and_format_guard(spark, tmp_path):
    index = ZoneIndex.compile(catalog.rings_of(spark, world.overlapping()), catalog.CELL, "2026c")
    index.save(str(tmp_path / "i"))
    with ZoneIndex.load(spark, str(tmp_path / "i"), in_memory=True) as loaded:
        assert loaded.data_version == "2026c" and loaded.cells.count() == index.cells.count()
    spark.createDataFrame([("x", 99, 1)], "data_version string, format_version int, cell long").write.mode("overwrite").parquet(str(tmp_path / "i/meta"))
    with pytest.raises(ValueError):
        ZoneIndex.load(spark, str(tmp_path / "i"))


def test_invalid_policies(spark, tiled):
    assert {r.error for r in lookup(pts(spark), tiled, "light", on_invalid="null").collect()} == {None}
    with pytest.raises(Exception, match="longitude|missing|latitude"):
        lookup(pts(spark), tiled, "light", on_invalid="raise").collect()
    with pytest.raises(ValueError):
        lookup(pts(spark), tiled, "nearest")


def test_finder_keeps_columns(spark, tiled):
    df = spark.createDataFrame([(1, 11.0, 11.0, "old")], "id int, lng double, lat double, tz_name string")
    assert Finder(tiled).timezone_at(df).first().asDict() == {"id": 1, "lng": 11.0, "lat": 11.0, "x": 110000000, "y": 110000000, "tz_id": 1, "tz_name": "Land/Host", "error": None}


def test_csv_keeps_every_row_whole_and_in_order(spark, tiled, tmp_path):
    lines = ["name,lat,lng", "A,11,11", "B,100,200", "C,nan,nan", "D,,", "E", "F,x,y", 'G,"11","11",more,"and, more"', "H,inf,0"] + [f"P{i},{i % 80},{i % 170}" for i in range(200)]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    out = csvio.annotate_csv(spark, str(tmp_path / "in.csv"), tiled)
    rows = out.orderBy("at").collect()
    assert [r.line for r in rows] == lines[1:]
    assert [(r.fields[0], r.tz_name) for r in rows[:8]] == [("A", "Land/Host")] + [(n, None) for n in "BCDEF"] + [("G", "Land/Host"), ("H", None)]
    assert rows[6].fields[3:] == ["more", "and, more"] + [None] * (len(rows[6].fields) - 5)
    csvio.write_csv(out, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).collect()
    assert [r.value for r in back][:3] == ["A,11,11,Land/Host", "B,100,200,", "C,nan,nan,"] and len(back) == len(lines) - 1


def test_csv_columns(spark, tiled, tmp_path):
    cols = lambda first, named=True, width=None: csvio.Columns(",".join(first), tuple(first), named, width or len(first))
    assert cols(["\ufeffLat", " LON ", "x"]).coordinates(lng=None, lat=None) == {"lng": 1, "lat": 0}
    assert cols(["a", "b", "c"]).coordinates(lng="C", lat="1") == {"lng": 2, "lat": 0}
    assert cols(["1.5", "2"], False).coordinates(lng="2", lat="1") == {"lng": 1, "lat": 0}
    for bad in (lambda: cols(["1.5", "2"], False).coordinates(lng=None, lat=None), lambda: cols(["lat", "b"]).coordinates(lng="3", lat=None), lambda: cols(["lat", "b"]).coordinates(lng="lat", lat="lat"), lambda: cols(["lat", "b"]).coordinates(lng="z", lat=None), lambda: csvio.separator("ab"), lambda: csvio.separator("")):
        with pytest.raises(ValueError):
            bad()
    assert csvio.separator("\\t") == "\t"
    (tmp_path / "plain.tsv").write_text("11\t11\ta\n12.5\t13\n")
    found = csvio.annotate_csv(spark, str(tmp_path / "plain.tsv"), tiled, sep="\\t", lng="1", lat="2").orderBy("at").collect()
    assert [r.tz_name for r in found] == ["Land/Host", "Land/Enclave"]
    with pytest.raises(ValueError):
        csvio.annotate_csv(spark, str(tmp_path / "plain.tsv"), tiled, sep="\t")
    (tmp_path / "none.csv").write_text("")
    assert csvio.annotate_csv(spark, str(tmp_path / "none.csv"), tiled).count() == 0


def test_zone_names_round_trip(spark, tiled, tmp_path):
    names.write_zone_names(tiled.zones, str(tmp_path / "n"))
    back = names.read_zone_names(spark, str(tmp_path / "n"))
    assert {tuple(r) for r in back.collect()} == {(r.zone_id, r.tz_name) for r in tiled.zones.collect()}


def test_benchmark_statistics(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("b", 10.0)], "name string, value double")
    noise = {r.name: r for r in stats.noise(runs).collect()}
    assert noise["a"].spread_pct == 200 and noise["a"].deviation == 0.5 and noise["b"].variation_pct == 0
    assert stats.alert_threshold(stats.noise(runs)).first()[0] == 220
    both = stats.compare_runs(runs, runs.where("name = 'a'")).collect()
    assert [(r.name, r.ratio) for r in both] == [("a", 1.0), ("b", None)]
    assert [r[0] for r in spark.createDataFrame([(2.5e-7,), (0.0123,), (3.0,)], "s double").select(stats.format_duration(F.col("s"))).collect()] == ["250 ns", "12.3 ms", "3.00 s"]


def test_local_hours_of_a_table(spark, tiled):
    df = spark.createDataFrame([("2024-01-01 00:30:00", 90.0, 0.0)], "t string, lng double, lat double").select(F.to_timestamp("t").alias("ts"), "lng", "lat")
    assert local_hours(df, tiled, "ts").first().local_hour == 6


def test_overlapping_holes_both_count(spark):
    shape = [("Land/Two", [[world.box(0, 0, 20, 20), world.box(2, 2, 10, 10), world.box(6, 6, 14, 14)]])]
    index = ZoneIndex.compile(catalog.rings_of(spark, shape), catalog.CELL)
    pairs = spark.createDataFrame([(x * 10_000_000, y * 10_000_000, 0) for x, y in ((1, 1), (5, 5), (8, 8), (12, 12), (19, 3))], "x long, y long, poly_id int")
    assert sorted(r.x // 10_000_000 for r in in_any_hole(pairs, index.bands).collect()) == [5, 8, 12]
    assert sorted(r.x // 10_000_000 for r in contained(pairs, index.bands).collect()) == [1, 19]
    points = spark.createDataFrame([(float(x), float(y)) for x, y in ((1, 1), (5, 5), (8, 8), (12, 12), (19, 3))], "lng double, lat double")
    assert [r.tz_name for r in lookup(points, index, "certain", "arrow").orderBy("lng").collect()] == ["Land/Two", None, None, None, "Land/Two"]


def test_flat_rings_against_each_edge():
    rng = random.Random(2)
    for n in [rng.randrange(3, 12) for _ in range(30)] + [400, 1000]:
        ring = [(rng.randrange(-60_000_000, 60_000_000), rng.randrange(-60_000_000, 60_000_000)) for _ in range(n)]
        edges = edges_of(ring)
        x, y = (np.array([rng.randrange(-70_000_000, 70_000_000) for _ in range(200)] + [p[k] for p in ring]) for k in (0, 1))
        want = [sum(yl < b <= yh and (xh - xl) * (b - yl) >= (a - xl) * (yh - yl) for xl, yl, xh, yh in edges.tolist()) % 2 == 1 for a, b in zip(x.tolist(), y.tolist())]
        assert crossed(x, y, edges).tolist() == want


def test_rings_keep_their_own_bands():
    """Several rings of unlike height, one without edges, side by side."""
    rng = random.Random(3)
    rings = [[(rng.randrange(-h, h), rng.randrange(-h, h)) for _ in range(n)] for n, h in ((3, 2), (200, 800_000_000), (0, 1), (50, 1000))]
    edges = [edges_of(r) if r else np.zeros((0, 4), np.int64) for r in rings]
    both = Rings(np.repeat(np.arange(4), [len(e) for e in edges]), list(np.concatenate(edges).T), 4)
    assert len(both.x_low) <= 3 * sum(map(len, edges))
    x, y = (np.array([rng.randrange(-1000, 1000) for _ in range(300)]) for _ in range(2))
    for k, e in enumerate(edges):
        assert both.odd(x, y, np.full(300, k)).tolist() == crossed(x, y, e).tolist()


def test_too_large_an_index_is_not_broadcast(spark, monkeypatch):
    index = ZoneIndex.compile(catalog.rings_of(spark, world.overlapping()), catalog.CELL)
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 10)
    with pytest.raises(ValueError):
        lookup(pts(spark), index, strategy="arrow")
    assert lookup(pts(spark, 50), index).count() == 54 and index.sent is None


@pytest.mark.parametrize("xs, ys, north, south, want", [([5, 9], [1, 4], False, False, (5, 9, 1, 4, False)), ([-geo.X_MAX + 5, geo.X_MAX - 9], [1, 4], False, False, (-geo.X_MAX, geo.X_MAX, 1, 4, True)), ([5, 9], [1, 4], True, False, (-geo.X_MAX, geo.X_MAX, 1, geo.Y_MAX, False)), ([5, 9], [1, 4], False, True, (-geo.X_MAX, geo.X_MAX, -geo.Y_MAX, 4, False)), ([5, 9], [0, geo.Y_MAX], False, False, None)])
def test_boxes_on_the_globe(spark, xs, ys, north, south, want):
    df = spark.createDataFrame([(xs, ys, north, south)], "xs array<long>, ys array<long>, n boolean, s boolean")
    got = df.select(geo.globe_box(F.col("xs"), F.col("ys"), F.col("n"), F.col("s"))).first()[0]
    assert (got and tuple(got)) == want


def test_cells_and_random_points(spark):
    assert geo.cell_count(catalog.CELL) == 648
    with pytest.raises(ValueError):
        geo.cell_children(F.lit(0), 100, 3)
    lng, lat = geo.random_point(5)
    got = spark.range(4000).select(lng.alias("lng"), lat.alias("lat")).agg(F.min("lng"), F.max("lng"), F.min("lat"), F.max("lat"), F.avg((F.abs("lat") < 30).cast("int"))).first()
    assert -180 <= got[0] < -178 and 178 < got[1] <= 180 and -90 <= got[2] and got[3] <= 90 and abs(got[4] - 0.5) < 0.03
    flat = geo.random_point(5, by_area=False)[1]
    assert abs(spark.range(4000).select(flat.alias("lat")).agg(F.avg((F.abs("lat") < 30).cast("int"))).first()[0] - 1 / 3) < 0.03


def test_formats_and_names(spark):
    show = lambda f, *values: [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(f(F.col("v"))).collect()]
    assert show(stats.format_rate, 3573050, 54800, 12.34) == ["3.57M/s", "54.8k/s", "12.3/s"]
    assert show(stats.format_bytes, 12, 2048, 5 << 20, 0) == ["12.0 B", "2.00 KiB", "5.00 MiB", "0.00 B"]
    assert show(stats.format_ratio, 2) == ["2.00x"]
    assert spark.range(1).select(stats.percent_faster(F.lit(4.0), F.lit(3.0))).first()[0] == 25.0
    got = spark.createDataFrame([("test_at[ambiguous_cell-in_memory]",), ("test_plain",)], "n string").select(stats.benchmark_parts(F.col("n")).alias("b")).collect()
    assert [tuple(r.b) for r in got] == [("at", ["ambiguous cell", "in memory"]), ("plain", [])]


def test_registry_and_vectors(spark, tiled, tmp_path):
    registry.write_registry(tiled.holes, str(tmp_path / "r"))
    text = spark.read.text(str(tmp_path / "r")).first()[0]
    assert list(json.loads(text)) == sorted(json.loads(text))
    assert {tuple(r) for r in registry.read_registry(spark, str(tmp_path / "r")).collect()} == {tuple(r) for r in registry.registry_of(tiled.holes).collect()}
    np.save(tmp_path / "zone_ids.npy", np.array([0, 0, 3, 1], dtype=np.uint16))
    rows = registry.read_vectors(spark, str(tmp_path / "*.npy")).orderBy("place").collect()
    assert [r.value for r in rows] == [0, 0, 3, 1] and rows[0].file.endswith("zone_ids.npy")


def test_stored_sizes(spark, tmp_path):
    ZoneIndex.compile(catalog.rings_of(spark, world.overlapping()), catalog.CELL).save(str(tmp_path / "i"))
    shares = stats.size_shares(stats.stored_sizes(spark, str(tmp_path / "i"))).collect()
    assert {r.name for r in shares} == {"zones", "polygons", "holes", "edges", "bands", "cells", "meta"} and abs(sum(r.pct for r in shares) - 100) < 0.1
    assert [r.bytes for r in shares] == sorted((r.bytes for r in shares), reverse=True)


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"benchmarks": [{"fullname": "a::b", "stats": {"min": 1.0, "max": 2.0, "mean": 1.5, "median": 1.4, "stddev": 0.1, "rounds": 5}}]}))
    (row,) = stats.read_benchmarks(spark, str(tmp_path)).collect()
    assert (row.fullname, row["min"], row.rounds) == ("a::b", 1.0, 5)


def test_origin_of_points():
    wanted = {"data_version": "2026c", "fixture_version": 2, "sampler": "area"}
    assert quality.provenance_problems(dict(wanted), wanted) == []
    assert len(quality.provenance_problems(wanted | {"sampler": "flat", "debug": True}, wanted)) == 2


def test_module_functions(spark, tiled, tmp_path):
    api._finders.clear()
    with pytest.raises(ValueError):
        api.finder(spark)
    tiled.save(str(tmp_path / "i"))
    api.use(str(tmp_path / "i"), spark)
    df = spark.createDataFrame([(11.0, 11.0)], "lng double, lat double")
    assert {f(df).first().tz_name for f in (api.timezone_at, api.timezone_at_land, api.certain_timezone_at)} == {"Land/Host"}
    assert api.get_geometry("Land/Host").count() == 2 and api.unique_timezone_at(df).count() == 1
    api.register(spark, tiled)
    got = spark.sql("SELECT timezone_at(11.0D, 11.0D), certain_timezone_at(200.0D, 0.0D), light_timezone_at(CAST(NULL AS DOUBLE), 1.0D)").first()
    assert tuple(got) == ("Land/Host", None, None)


def test_command_line(spark, tiled, tmp_path, capsys):
    tiled.save(str(tmp_path / "i"))
    ask = lambda *args: command.run(spark, command.parser().parse_args(["--index", str(tmp_path / "i"), *args]))
    assert ask("--lng", "11", "--lat", "11") == 0 and capsys.readouterr().out.strip() == "Land/Host"
    assert ask("--lng", "200", "--lat", "11") == 1 and "longitude" in capsys.readouterr().err
    assert ask("--lng", "1") == 2 and ask("--csv", "x") == 2
    (tmp_path / "a.csv").write_text("n,lat,lng\na,11,11\n")
    (tmp_path / "b.csv").write_text("n,lat,lng\na,11,11\nb,,\n")
    (tmp_path / "c.csv").write_text("1,11,11\n")
    assert ask("--csv", str(tmp_path / "a.csv"), "--out", str(tmp_path / "oa")) == 0
    assert ask("--csv", str(tmp_path / "b.csv"), "--out", str(tmp_path / "ob")) == 1
    assert ask("--csv", str(tmp_path / "c.csv"), "--out", str(tmp_path / "oc")) == 2
    with pytest.raises(SystemExit) as wrong:
        command.parser().parse_args([])
    assert wrong.value.code == 2


def test_registered_queries_have_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
