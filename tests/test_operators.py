"""Golden cases and properties of the operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import aggregates, pentad
from tidegrid.operators import chains, eof, fields, grids, series
from tidegrid.plans import catalogue
from tidegrid.sources import tiers


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_pentad_calendar(spark):
    days = rows(spark, [("2024-12-30",), ("2024-12-31",), ("2023-12-31",), ("2022-12-23",)], "s string").select(F.to_date("s").alias("d"))
    got = {str(r.d): r.p for r in days.select("d", pentad.pentad_of(F.col("d")).alias("p")).collect()}
    assert got == {"2024-12-30": 72, "2024-12-31": None, "2023-12-31": 72, "2022-12-23": 71}
    assert pentad.parse_label("2024P-5") == 147747
    text = rows(spark, [("2024P-5",)], "s string").select(pentad.label_of(pentad.parse(F.col("s")))).first()[0]
    assert text == "2023P68"


@pytest.mark.parametrize("inclusive,want", [("left", [71, 72, 0]), ("right", [72, 0, 1]), ("both", [71, 72, 0, 1]), ("neither", [72, 0])])
def test_pentad_range(spark, inclusive, want):
    got = pentad.pentad_range(spark, "2023P71", "2024P01", inclusive).orderBy("pentadstamp").collect()
    assert [r.pentadstamp % 73 for r in got] == want


def test_empty_and_reversed_ranges(spark):
    assert pentad.pentad_range(spark, "2023P71", "2023P71", "neither").count() == 0
    with pytest.raises(ValueError):
        pentad.pentad_range(spark, "2023P71", "2023P70")


def test_strict_mean_and_longitudes(spark):
    members = [("a", 0, 0, 0, 1.0), ("b", 0, 0, 0, 2.0), ("a", 0, 0, 1, 1.0), ("b", 0, 0, 1, 3.0), ("c", 0, 0, 1, 5.0)]
    got = fields.ensemble_mean(rows(spark, members, "ds string, pentadstamp int, lat_i int, lon_i int, v double"), ["a", "b", "c"])
    assert {r.lon_i: r.v for r in got.collect()} == {0: None, 1: 3.0}
    lon = rows(spark, [(-1.0,), (-180.0,), (359.0,), (360.0,)], "x double").select(aggregates.wrap_longitude(F.col("x")))
    assert [r[0] for r in lon.collect()] == [359.0, 180.0, 359.0, 0.0]


def test_regions(spark):
    cells = [(0, 0, 30.0, 150.0, 1.0), (1, 0, 0.0, 150.0, 1.0), (2, 0, 30.1, 180.0, 1.0), (3, 0, 30.1, 180.1, 1.0), (4, 0, 30.1, 180.1, None)]
    masks = fields.region_masks(rows(spark, cells, "lat_i int, lon_i int, lat double, lon double, v double")).where("mask = 1").collect()
    held = {i: {r.region.removeprefix("NPAC_") for r in masks if r.lat_i == i} for i in range(5)}
    assert held == {0: {"ALL", "SOUTH", "WEST"}, 1: set(), 2: {"ALL", "NORTH", "WEST", "WWRF"}, 3: {"ALL", "NORTH", "EAST", "WWRF"}, 4: set()}


def test_pairs():
    assert fields.pairs(["a", "b", "c"], "ref") == [(0, 1), (0, 2)]
    assert fields.pairs(["a", "b", "c"], "all") == [(0, 1), (0, 2), (1, 2)]
    assert len(fields.pairs(["a", "b", "c"], "grid")) == 9


def test_distance(spark):
    data = [("a", 0, 0, i, 0.0) for i in range(3)] + [("b", 0, 0, i, float(i + 1)) for i in range(3)]
    got = {(r.ds1, r.ds2): r.dist2 for r in fields.distances(rows(spark, data, "ds string, pentadstamp int, lat_i int, lon_i int, v double"), ["a", "b"]).collect()}
    assert got["a", "a"] == 0.0 and got["a", "b"] == got["b", "a"] == pytest.approx(98 / 9)


def test_series(spark):
    line = rows(spark, [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.5)], "t int, x int, v double")
    got = [r.v_minus_intercept for r in series.detrend(line).orderBy("x").collect()]
    assert got == pytest.approx([1 - 0.9166667, 3 - 0.9166667, 5.5 - 0.9166667], abs=1e-6)
    assert [(r.x_mid, r.g) for r in series.gradient(line).orderBy("x_mid").collect()] == [(0.5, 2.0), (1.5, 2.5)]
    gaps = rows(spark, [(0, i, v) for i, v in enumerate([None, 2.0, None, 5.0, None])], "t int, x int, v double")
    assert [r.v for r in series.fill_ends(gaps).orderBy("x").collect()] == [2.0, 2.0, None, 5.0, 5.0]


def test_dft_is_numpy(spark):
    x = np.random.default_rng(1).standard_normal((3, 8))
    data = [(t, i, float(x[t, i])) for t in range(3) for i in range(8)]
    got = series.dft(rows(spark, data, "t int, x int, v double"), "v", 8, 0.5).collect()
    want = np.fft.fft(x) / 8
    for r in got:
        assert complex(r.re, r.im) == pytest.approx(want[r.t, r.k], abs=1e-12)
        assert r.wvlen == (None if r.k == 0 else pytest.approx(4.0 / r.k))


def test_regrid_is_exact_for_planes(spark):
    data = [(i, j, i + 10.0 * j) for i in range(5) for j in range(5)]
    field = rows(spark, data, "lat_i int, lon_i int, v double").withColumn("ds", F.lit("a"))
    source, target = [float(i) for i in range(5)], grids.axis(-0.5, 4.6, 0.5)
    got = grids.regrid(field, ["ds"], grids.axis_weights(spark, source, target, "lat"), grids.axis_weights(spark, source, target, "lon")).collect()
    assert len(got) == 81
    assert all(r.v == pytest.approx(target[r.lat_i] + 10 * target[r.lon_i]) for r in got)
    assert len(grids.axis(0.0, 1.0, 0.1)) == 10


def test_filters_and_fills(spark):
    line = rows(spark, [("a", 0, i, v) for i, v in enumerate([1.0, None, 3.0])], "ds string, lat_i int, lon_i int, v double")
    assert [r.v for r in grids.box_filter(line, ["ds"], 1).orderBy("lon_i").collect()] == [1.0, 2.0, 3.0]
    assert [r.v for r in grids.box_filter(line, ["ds"], 0).orderBy("lon_i").collect()] == [1.0, None, 3.0]
    columns = [(0, k, v) for k, v in enumerate([1.0, 2.0, None, 9.0])] + [(1, k, v) for k, v in enumerate([None, 1.0, None])]
    filled = grids.fill_down(rows(spark, columns, "c int, k int, v double"), ["c"]).orderBy("c", "k").collect()
    assert [r.v for r in filled] == [1.0, 2.0, 2.0, 2.0, None, 1.0, None]
    square = [("a", i // 3, i % 3, None if i == 4 else float(i + 1)) for i in range(9)]
    flooded = grids.flood_fill(rows(spark, square, "ds string, lat_i int, lon_i int, v double"), ["ds"], 3, 3, 1)
    assert flooded.where("lat_i = 1 AND lon_i = 1").first().v == 5.0


def test_eof(spark):
    x = np.random.default_rng(2).standard_normal((6, 40))
    data = [(c, s, float(x[s, c])) for s in range(6) for c in range(40)]
    cells = eof.anomalies(rows(spark, data, "cell int, sample int, v double"), 6)
    maps, pcs, variance = (d.toPandas() for d in eof.modes(cells, 5))
    a = x - x.mean(axis=0)
    assert variance.sort_values("mode").variance.to_numpy() == pytest.approx(np.linalg.svd(a, compute_uv=False)[:5] ** 2 / 5)
    e = maps.pivot(index="mode", columns="cell", values="v").to_numpy()
    p = pcs.pivot(index="mode", columns="sample", values="pc").to_numpy()
    assert e @ e.T == pytest.approx(np.eye(5), abs=1e-9)
    assert p.T @ e == pytest.approx(a, abs=1e-9)


def test_tiers(spark, tmp_path):
    path = tiers.tier_path(str(tmp_path), "cropped", "sst", "box")
    with pytest.raises(ValueError):
        tiers.tier_path(str(tmp_path), "cropped", "sst")
    field = rows(spark, [("a", 147747 + i, 0, 0, float(i)) for i in range(4)], "dataset string, pentadstamp int, lat_i int, lon_i int, v double")
    tiers.write_tier(field, path)
    assert tiers.read_range(spark, path, "2023P68", "2023P71", "both", ["a"]).count() == 4
    with pytest.raises(FileNotFoundError):
        tiers.read_range(spark, path, "2023P68", "2024P01", "both", ["a"])
    tiers.write_tier(field.where("pentadstamp = 147747").withColumn("v", F.lit(9.0)), path, overwrite=True)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 3.0, 9.0]
    tiers.write_binary(field, str(tmp_path / "bin"), ["pentadstamp"])
    pieces = spark.read.parquet(str(tmp_path / "bin")).orderBy("part", "seq").collect()
    assert list(np.frombuffer(b"".join(r.packed for r in pieces), ">f4")) == [0.0, 1.0, 2.0, 3.0]


def test_spectrum_of_differences_has_no_trend(spark):
    """Missing ends filled and the line removed from every difference before its transform, against numpy."""
    sf = "/root/testdata/sf0.001"
    vec = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 12").collect()}
    x, want = np.arange(64), {}
    gappy = {t: np.where((x >= t % 5) & (x < 64 - t % 3), v, np.nan) for t, v in vec.items()}
    for t in sorted(set(gappy) & {t + 1 for t in gappy}):
        d = gappy[t] - gappy[t - 1]
        at = np.flatnonzero(~np.isnan(d))
        d[: at[0]], d[at[-1] + 1 :] = d[at[0]], d[at[-1]]
        want[t] = np.abs(np.fft.fft(d - np.polyval(np.polyfit(x, d, 1), x))[:32]) / 64
    got = catalogue.queries()["spectrum_diff_detrended"](spark, sf).where(f"t <= {max(want)}").toPandas()
    assert want and len(got) == 32 * len(want) and got.where(got.k == 0).radius.max() < 1e-6
    for t, rows in got.groupby("t"):
        assert rows.sort_values("k").radius.to_numpy() == pytest.approx(want[t], abs=2e-6)


def test_points_and_spans(spark):
    row = rows(spark, [(2024, None, None, -5)], "y int, p int, dy int, dp int").select(
        pentad.stamp_from(F.col("y"), F.col("p")).alias("a"), pentad.delta_from(F.col("dy"), F.col("dp")).alias("span")
    ).first()
    assert (row.a, row.span, row.a + row.span) == (147752, -5, 147747)


def test_axis_operators(spark):
    flat = rows(spark, [(0, 1.0), (1, 1.0)], "lon_i int, lon double")
    with pytest.raises(Exception, match="does not rise strictly"):
        fields.index_range(flat, "lon", "lon_i", 0.0, 2.0).collect()
    rising = rows(spark, [(i, float(i)) for i in range(5)], "lon_i int, lon double")
    assert tuple(fields.index_range(rising, "lon", "lon_i", 1.0, 3.5).first()) == (1, 3)
    assert tuple(fields.index_range(rising, "lon", "lon_i", 7.0, 9.0).first()) == (None, None)
    lon = {"a": [0.0, 90.0, 180.0, 270.0], "b": [45.0 * i - 135.0 for i in range(8)], "c": [0.0, 200.0, 10.0, 250.0]}
    axes = rows(spark, [(d, i, x) for d, v in lon.items() for i, x in enumerate(v)], "ds string, lon_i int, lon double")
    got = {r.ds: r.start for r in fields.longitude_start(axes.where("ds < 'c'")).collect()}
    assert got == {"a": 0, "b": 3}
    with pytest.raises(Exception, match="more than one break"):
        fields.longitude_start(axes).collect()
    turn = rows(spark, [(3,)], "i int").select(fields.rotated_index(F.col("i"), F.lit(2), 4, 1)).first()[0]
    assert turn == (2 + 1 + 3) % 4
    field = rows(spark, [("n", i, 0, 10.0 - i) for i in range(3)] + [("s", i, 0, float(i)) for i in range(3)], "ds string, lat_i int, lon_i int, lat double")
    assert [(r.ds, r.lat) for r in fields.ascending_latitude(field).orderBy("ds", "lat_i").collect()] == [("n", 8.0), ("n", 9.0), ("n", 10.0), ("s", 0.0), ("s", 1.0), ("s", 2.0)]
    with pytest.raises(KeyError):
        fields.select_stamps(field.withColumn("pentadstamp", F.col("lat_i")), [1, 7])
    with pytest.raises(Exception, match="no span holds"):
        spans = rows(spark, [(0, "x", "2020-01-01", "2020-12-31")], "ord int, name string, beg string, end string")
        days = rows(spark, [("2021-05-05",)], "s string").select(F.to_date("s").alias("d"))
        fields.first_interval(days, spans.withColumns({"beg": F.to_date("beg"), "end": F.to_date("end")})).collect()
    assert fields.first_interval(days, spans.withColumns({"beg": F.to_date("beg"), "end": F.to_date("end")}), strict=False).first().name is None


def test_compress_and_scatter(spark):
    cells = rows(spark, [(0, i, float(i)) for i in range(10)], "lat_i int, lon_i int, v double")
    mask = cells.select("lat_i", "lon_i", (~F.col("lon_i").isin(2, 5, 7)).cast("int").alias("mask"))
    kept = fields.compress(cells, mask).withColumn("mode", F.lit(0))
    assert sorted(r.v for r in kept.collect()) == [0, 1, 3, 4, 6, 8, 9]
    back = [r.v for r in fields.scatter(kept, cells, ["mode"]).orderBy("lon_i").collect()]
    assert back == [0, 1, None, 3, 4, None, 6, None, 8, 9]


def test_separable_filter_is_the_kernel(spark):
    rng = np.random.default_rng(3)
    data = [("a", i, j, None if rng.random() < 0.2 else float(rng.random())) for i in range(7) for j in range(6)]
    field = rows(spark, data, "ds string, lat_i int, lon_i int, v double")
    one = grids.kernel_filter(field, ["ds"], grids.gauss_kernel(2, 1.3)).orderBy("lat_i", "lon_i").collect()
    two = grids.separable_filter(field, ["ds"], grids.gauss_weights(2, 1.3)).orderBy("lat_i", "lon_i").collect()
    assert [r.v for r in one] == pytest.approx([r.v for r in two])


def test_flood_fill_by_layers_tiles_and_joins(spark):
    rng = np.random.default_rng(5)
    data = [(d, i, j, float(rng.random()) if rng.random() < 0.1 else None) for d in "ab" for i in range(8) for j in range(9)]
    field = rows(spark, data, "ds string, lat_i int, lon_i int, v double")
    ocean = (F.col("lat_i") + F.col("lon_i")) % 7 != 0
    value = lambda df: [r.v for r in df.orderBy("ds", "lat_i", "lon_i").collect()]
    fill = lambda sweeps, **more: value(grids.flood_fill(field, ["ds"], 8, 9, sweeps, ocean, **more))
    layered = fill(10)
    assert None not in [v for v, (_, i, j, _) in zip(layered, sorted(data)) if (i + j) % 7]
    for tile, reach in ((4, 3), (3, 2), (2, 1), (100, 4)):
        assert fill(10, layer_cells=0, tile=tile, reach=reach) == pytest.approx(layered, nan_ok=True)
    joined = field
    for _ in range(2):
        joined = grids.flood_sweep(joined, ["ds"], 8, 9, ocean)
    assert value(joined) == pytest.approx(fill(2), nan_ok=True) and value(joined) == pytest.approx(fill(2, layer_cells=0, tile=3, reach=1), nan_ok=True)


def test_high_pass_mirrors_edges(spark):
    x = np.random.default_rng(6).random((9, 8))
    data = [("a", i, j, float(x[i, j]) if (i, j) != (4, 4) else None) for i in range(9) for j in range(8)]
    got = grids.high_pass(rows(spark, data, "ds string, lat_i int, lon_i int, v double"), ["ds"], 9, 8, 2, 3).collect()
    x[4, 4] = 0.0
    wide = np.pad(x, ((2, 2), (3, 3)), mode="symmetric")
    want = {(i, j): x[i, j] - wide[i : i + 5, j : j + 7].mean() for i in range(9) for j in range(8)}
    assert len(got) == 72
    assert all(r.v is None if (r.lat_i, r.lon_i) == (4, 4) else r.v == pytest.approx(want[r.lat_i, r.lon_i]) for r in got)


def test_staggered_regrid_is_exact_for_planes(spark):
    source = {"z": [0.0, -10.0, -30.0], "lat": [0.0, 1.0, 2.0], "lon": [0.0, 1.0, 2.0, 3.0]}
    target = {"z": [-5.0, -20.0], "lat": [0.5, 2.5], "lon": [0.25, 1.5, 9.0]}
    data = [(k, i, j, z + y + 10 * x) for k, z in enumerate(source["z"]) for i, y in enumerate(source["lat"]) for j, x in enumerate(source["lon"])]
    field = rows(spark, data, "k int, lat_i int, lon_i int, v double").withColumn("ds", F.lit("a"))
    land = rows(spark, [(0, 0, 0)], "k int, lat_i int, lon_i int")
    got = {(r.k, r.lat_i, r.lon_i): (r.v, r.outside) for r in grids.regrid_staggered(field, ["ds"], source, target, land, 2, valid=(-30.0, 20.0)).collect()}
    assert len(got) == 12 and got[0, 0, 0] == (None, False)
    for (k, i, j), (v, outside) in got.items():
        want = target["z"][k] + min(target["lat"][i], 2.0) + 10 * min(target["lon"][j], 3.0)
        assert (k, i, j) == (0, 0, 0) or (v == pytest.approx(want) and outside == (not -30 <= want <= 20))
    with pytest.raises(ValueError):
        grids.regrid_staggered(field, ["ds"], source, {**target, "z": [-40.0]}, land, 2)


def test_long_series_use_the_fast_transform(spark):
    x = np.random.default_rng(8).standard_normal((2, 300))
    data = [(t, i, float(x[t, i])) for t in range(2) for i in range(300)]
    want = np.fft.fft(x) / 300
    got = series.dft(rows(spark, data, "t int, x int, v double"), "v", 300).collect()
    assert len(got) == 300 and all(complex(r.re, r.im) == pytest.approx(want[r.t, r.k], abs=1e-12) for r in got)


def test_eof_of_empty_and_single_samples(spark):
    one = rows(spark, [(c, 0, float(c)) for c in range(4)], "cell int, sample int, v double")
    for cells in (eof.anomalies(one, 1), eof.anomalies(one.where("false"), 3)):
        assert [d.count() for d in eof.modes(cells, 3)] == [0, 0, 0]


def test_eof_of_product_differences(spark):
    """Pairs, box, stacking, mask, modes and scattering against numpy."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3, 5, 6, 4))
    data = [("pqr"[d], t, i, j, float(x[d, t, i, j])) for d in range(3) for t in range(5) for i in range(6) for j in range(4) if (i, j) != (5, 3)]
    field = rows(spark, data, "ds string, pentadstamp int, lat_i int, lon_i int, v double")
    mask = field.select("lat_i", "lon_i").distinct().withColumn("mask", (F.col("lat_i") > 0).cast("int"))
    maps, pcs, variance, stats = eof.of_differences(field, ["p", "q", "r"], field, 4, "all", 0, mask)
    full = np.concatenate([x[b] - x[a] for a, b in ((0, 1), (0, 2), (1, 2))])
    cells = [(i, j) for i in range(1, 6) for j in range(4) if (i, j) != (5, 3)]
    a = np.array([[full[s, i, j] for i, j in cells] for s in range(15)])
    a -= a.mean(axis=0)
    want = np.linalg.svd(a, compute_uv=False) ** 2 / 14
    assert variance.orderBy("mode").toPandas().variance.to_numpy() == pytest.approx(want[:4])
    first = {(r.lat_i, r.lon_i): r.v for r in maps.where("mode = 0").collect()}
    assert len(first) == 23 and all((first[c] is None) == (c not in cells) for c in first)
    v = np.array([first[c] for c in cells])
    assert np.linalg.norm(a @ v) ** 2 / 14 == pytest.approx(want[0]) and (v >= 0).sum() * 2 >= len(v)
    mean = {(r.lat_i, r.lon_i): (r["mean"], r["std"]) for r in stats.collect()}
    assert mean[0, 0] == pytest.approx((full[:, 0, 0].mean(), full[:, 0, 0].std()))


def test_tier_reruns_and_order(spark, tmp_path):
    path = str(tmp_path / "tier")
    field = rows(spark, [("a", 147747 + i, 0, 0, float(i)) for i in range(4)], "dataset string, pentadstamp int, lat_i int, lon_i int, v double")
    for _ in range(2):
        tiers.write_tier(field, path)
        assert spark.read.parquet(path).count() == 4
    planned = rows(spark, [("a", 147747 + i) for i in range(6)], "dataset string, pentadstamp int")
    work = lambda todo: todo.where("pentadstamp < 147752").select("dataset", "pentadstamp", F.lit(0).alias("lat_i"), F.lit(0).alias("lon_i"), F.lit(7.0).alias("v"))
    status = {r.pentadstamp - 147747: r.status for r in tiers.fill_tier(planned, path, work).collect()}
    assert status == {0: "skipped", 1: "skipped", 2: "skipped", 3: "skipped", 4: "made", 5: "failed"}
    assert spark.read.parquet(path).count() == 5
    tiers.write_whole(field, str(tmp_path / "whole"))
    tiers.write_whole(field.limit(1), str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 4
    assert tiers.read_many(spark, [path, str(tmp_path / "whole")]).count() == 9
    with pytest.raises(FileNotFoundError):
        tiers.read_year(spark, path, 2023, ["a"])
    many = spark.range(5000).select((F.lit(4999) - F.col("id")).cast("int").alias("x"), (F.lit(4999.0) - F.col("id")).alias("v"))
    tiers.write_binary(many, str(tmp_path / "bin"), ["x"])
    got = [r.v for r in tiers.read_binary(spark, str(tmp_path / "bin")).orderBy("at").collect()]
    assert got == [float(i) for i in range(5000)]


def test_random_range_meets_the_gram_way(spark):
    """40 samples of 600 cells: leading variances within 1e-6, maps and amplitudes alike."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 6)) @ (rng.standard_normal((6, 40)) * np.array([30, 20, 12, 8, 5, 3])[:, None]) + 0.1 * rng.standard_normal((600, 40))
    rows = spark.createDataFrame([(c, s, float(x[c, s])) for c in range(600) for s in range(40)], "cell int, sample int, v double").repartition(5)
    cells = eof.anomalies(rows, 40)
    whole, few = eof.modes(cells, 3), eof.modes(cells, 3, most_samples=10)
    for got, want, key, value in zip(few, whole, (["mode", "cell"], ["mode", "sample"], ["mode"]), ("v", "pc", "share")):
        a, b = (d.toPandas().sort_values(key)[value].to_numpy() for d in (got, want))
        assert a == pytest.approx(b, rel=1e-6, abs=1e-6)
    assert eof.modes(cells.where("cell < 0"), 3, most_samples=0)[2].count() == 0


def test_first_interval_is_brute_force(spark):
    rng = np.random.default_rng(4)
    day = lambda n: datetime.date(1960, 1, 1) + datetime.timedelta(int(n))
    spans = [(int(o), f"s{o}", day(b), day(b + n)) for o, b, n in zip(rng.permutation(400), rng.integers(0, 9000, 400), rng.choice([0, 1, 5, 40, 3000], 400))]
    points = [day(n) for n in rng.integers(-200, 13000, 500)]
    got = fields.first_interval(spark.createDataFrame([(p,) for p in points], "d date"), spark.createDataFrame(spans, "ord int, name string, beg date, end date"), strict=False)
    want = {p: min(((o, n) for o, n, b, e in spans if b <= p <= e), default=(0, None))[1] for p in points}
    assert {r.d: r.name for r in got.collect()} == want


def test_match_axes_tells_findings_apart(spark):
    ours = [("x", i, c) for i, c in enumerate([0.0, 1.0, 2.0, 3.0, 4.0])]
    theirs = [("x", i, c) for i, c in enumerate([0.0, 1.004, 3.0, 3.005, 9.0])]
    table = lambda rows: spark.createDataFrame(rows, "axis string, i int, c double")
    found = {(r.ours_i, r.theirs_i, r.finding) for r in fields.match_axes(table(ours), table(theirs), ["axis"], 0.01).collect()}
    assert found == {(0, 0, "same"), (1, 1, "moved"), (2, None, "gap"), (3, 2, "shifted"), (4, None, "gap"), (None, 3, "extra"), (None, 4, "extra")}
    assert {r.finding for r in fields.match_axes(table(ours), table(ours), ["axis"]).collect()} == {"same"}


def test_autocorrelation_of_gappy_series(spark):
    rng = np.random.default_rng(6)
    t = np.sort(rng.choice(200, 120, replace=False))
    v = rng.standard_normal(120)
    rows = spark.createDataFrame([("a", int(x), float(y)) for x, y in zip(t, v)] + [("z", 0, 0.0), ("z", 3, 0.0), ("n", 1, None)], "s string, t int, v double")
    got = {(r.s, r.lag): r.c for r in series.autocorrelation(rows, 150).collect()}
    unit = dict(zip(t.tolist(), v / np.sqrt(v @ v)))
    want = {("a", k): sum(unit[x] * unit[x + k] for x in unit if x + k in unit) for k in range(151) if any(x + k in unit for x in unit)}
    assert {k: c for k, c in got.items() if k[0] == "a"} == pytest.approx(want)
    assert {k: c for k, c in got.items() if k[0] != "a"} == {("z", 0): None, ("z", 3): None}


def test_chains_at_the_edges_of_their_axes(spark):
    """Targets beyond the last point inside have no rows; an empty box gives nothing; a gap under a target is missing."""
    axes = {"lat": [0.0, 1.0, 2.0, 3.0], "lon": [0.0, 2.0, 4.0]}
    field = rows(spark, [("a", y, x, None if (y, x) == (3, 2) else 10.0 * y + x) for y in range(4) for x in range(3)], "ds string, lat_i int, lon_i int, v double")
    got = {(r.lat, r.lon): r.v for r in chains.crop_regrid(field, ["ds"], axes, (0.5, 3.6), (0.0, 4.1), 0.5).collect()}
    assert {y for y, _ in got} == {1.0, 1.5, 2.0, 2.5, 3.0} and {x for _, x in got} == {0.5 * k for k in range(9)}
    assert got[1.5, 1.0] == pytest.approx(15.5) and got[3.0, 4.0] is None and got[2.5, 3.5] is None and got[3.0, 2.0] == pytest.approx(31.0)
    assert chains.crop_regrid(field, ["ds"], axes, (7.0, 9.0), (0.0, 4.1), 0.5).count() == 0
    line = {r.x: r.v for r in chains.crop_profile(field, ["ds"], axes, (0.0, 3.0), (1.0, 5.0), "lat", 0.5).collect()}
    assert line == pytest.approx({0.5 * k: 5.0 * k + 1.5 if k < 5 else None for k in range(6)} | {2.5: 26.25})
    waves = chains.spectrum(field, ["ds"], axes, (0.0, 3.0), (0.0, 2.0), "lat").orderBy("k").collect()
    assert [r.k for r in waves] == [0, 1] and waves[1].radius == pytest.approx(0.0, abs=1e-9) and waves[1].wvlen == 4.0
