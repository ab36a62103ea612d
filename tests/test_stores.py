"""Files, tiers, units and streams: what is read, what a failed job leaves, what is late."""

import datetime
import os
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import pentad
from tidegrid.sources import clustered, matfile, netcdf, rawgrid, shared, slabs, tiers, units
from tidegrid.streaming import strict

LAT, LON = [0.0, 1.0, 2.0, 3.0], [10.0, 12.0, 14.0]


def field(spark, files=("a", "b"), times=(5, 9)):
    return spark.createDataFrame(
        [(f, t, y, x, 100.0 * t + 10 * y + x if (y, x) != (1, 1) else None) for f in files for t in times for y in range(4) for x in range(3)],
        "file string, time int, lat_i int, lon_i int, v double",
    )


def test_netcdf_round_trip_and_bytes(spark, tmp_path):
    path = str(tmp_path / "nc")
    netcdf.write_netcdf(field(spark), path, {"lat": LAT, "lon": LON}, "sst")
    assert sorted(os.listdir(path)) == ["a.nc", "b.nc"]
    back = netcdf.read_netcdf(spark, path, "sst")
    got = {(r.file, r.time, r.lat, r.lon, r.v) for r in back.collect()}
    assert got == {(f"{f}.nc", float(t), LAT[y], LON[x], None if (y, x) == (1, 1) else 100.0 * t + 10 * y + x) for f in "ab" for t in (5, 9) for y in range(4) for x in range(3)}
    some = back.where("lat >= 1 AND lat_i < 3 AND lon = 12 AND time > 5 AND file = 'b.nc'")
    assert {(r.lat_i, r.lon_i, r.v) for r in some.collect()} == {(1, 1, None), (2, 1, 921.0)}
    size = lambda box: netcdf.read_box_report(spark, path, "sst", box, gap=0).agg(F.sum("bytes")).first()[0]
    assert size({}) == 2 * 2 * 12 * 8 and size({"lat": (1, 2), "lon": (12, 12)}) == 2 * 2 * 2 * 8 and size({"lat": (7, 8)}) is None
    whole = netcdf.read_box_report(spark, path, "sst", {"lat": (1, 2), "lon": (12, 12)}).agg(F.sum("bytes")).first()[0]
    assert whole > 2 * 2 * 2 * 8  # short gaps are read over


def test_pushed_filters_reach_the_plan(tmp_path, spark):
    path = str(tmp_path / "nc")
    netcdf.write_netcdf(field(spark), path, {"lat": LAT, "lon": LON}, "sst")
    reader = netcdf.NetcdfReader({"path": path, "variable": "sst", "piecebytes": "24"}, None, ".nc")
    slab = reader.open_slab(f"{path}/a.nc")
    assert len(reader.planned(slab)) == 8  # a row of three values a piece
    reader.pushFilters([slabs.GreaterThan(("lat",), 1.5), slabs.In(("lon_i",), (0, 2)), slabs.EqualTo(("time",), 9)])
    assert sorted(p.ranges for p in reader.planned(slab)) == [((1, 2), (2, 4), (0, 1)), ((1, 2), (2, 4), (2, 3))]
    assert reader.planned(slab)[0].slab.axes["lon"].tolist() == LON
    reader.pushFilters([slabs.EqualTo(("file",), "b.nc")])
    assert reader.planned(slab) == []


def test_classic_file_with_packed_values(spark, tmp_path):
    """A CDF-1 file made by hand: a fixed axis, a record axis, scaled shorts with a fill value, odd sizes padded."""
    text = lambda s: struct.pack(">i", len(s)) + s + b"\0" * (-len(s) % 4)
    short = lambda name, v: text(name) + struct.pack(">iihxx", 3, 1, v)
    double = lambda name, v: text(name) + struct.pack(">iid", 6, 1, v)
    attributes = struct.pack(">ii", 12, 3) + short(b"_FillValue", -99) + double(b"scale_factor", 0.5) + double(b"add_offset", 100.0)
    none = struct.pack(">ii", 0, 0)

    def header(begins):
        return (
            b"CDF\x01" + struct.pack(">i", 2) + struct.pack(">ii", 10, 2) + text(b"t") + struct.pack(">i", 0) + text(b"x") + struct.pack(">i", 3)
            + none + struct.pack(">ii", 11, 3)
            + text(b"x") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 5, 12, begins[0])
            + text(b"t") + struct.pack(">ii", 1, 0) + none + struct.pack(">iii", 4, 4, begins[1])
            + text(b"q") + struct.pack(">iii", 2, 0, 1) + attributes + struct.pack(">iii", 3, 8, begins[2])
        )

    at = len(header([0, 0, 0]))
    content = header([at, at + 12, at + 16]) + struct.pack(">fff", 1.5, 2.5, 3.5)
    content += struct.pack(">ihhhxx", 7, 1, -99, 3) + struct.pack(">ihhhxx", 8, 4, 5, 6)
    (tmp_path / "old.nc").write_bytes(content)
    rows = netcdf.read_netcdf(spark, str(tmp_path), "q").orderBy("t_i", "x_i").collect()
    assert [(r.t, r.x, r.v) for r in rows] == [(7, 1.5, 100.5), (7, 2.5, None), (7, 3.5, 101.5), (8, 1.5, 102.0), (8, 2.5, 102.5), (8, 3.5, 103.0)]
    (tmp_path / "old.nc").write_bytes(b"HDF5" + content)
    with pytest.raises(Exception, match="classic"):
        netcdf.read_netcdf(spark, str(tmp_path), "q").collect()


def test_a_failed_or_killed_write_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = field(spark, times=(5,)).select(F.col("file").alias("variable"), F.col("time").alias("step"), "lat_i", "lon_i", "v")
    shape = {"lat_i": 4, "lon_i": 3}
    twice = rows.unionByName(rows.where("variable = 'b' AND lat_i = 3"))
    with pytest.raises(Exception, match="twice"):
        rawgrid.write_raw(twice, path, shape)
    assert os.listdir(path) == []
    # a task that is killed in the middle of a file never tells what it wrote
    writer = rawgrid.RawWriter({"path": path, "shape": "[4, 3]"}, False)
    batch = spark.createDataFrame([("c.0000000005", 5.0, 0, 1.0)], "file string, record double, cell long, v double").toArrow().to_batches()

    def killed():
        yield batch[0]
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    assert [n for n in os.listdir(path) if n != "_temporary"] == [] and slabs.list_files(path, ".data") == []
    writer.commit([None])
    assert os.listdir(path) == []
    rawgrid.write_raw(rows, path, shape)
    assert sorted(os.listdir(path)) == ["a.0000000005.data", "a.0000000005.meta", "b.0000000005.data", "b.0000000005.meta"]
    assert np.fromfile(f"{path}/a.0000000005.data", dtype=">f4").tolist() == [0.0 if (y, x) == (1, 1) else 500.0 + 10 * y + x for y in range(4) for x in range(3)]
    with pytest.raises(Exception, match="there already"):
        rawgrid.write_raw(rows, path, shape)
    rawgrid.write_raw(rows.withColumn("v", -F.col("v")), path, shape, overwrite=True)
    assert rawgrid.read_raw(spark, path).agg(F.sum("v")).first()[0] == -2 * sum(500.0 + 10 * y + x for y in range(4) for x in range(3) if (y, x) != (1, 1))


def test_raw_metadata_of_a_tile(spark, tmp_path):
    (tmp_path / "T.001.meta").write_text(
        " nDims = [   2 ];\n dimList = [\n    8,    5,    8,\n    6,    1,    3\n ];\n dataprec = [ 'float64' ];\n nrecords = [     2 ];\n timeStepNumber = [         12 ];\n"
    )
    np.arange(24, dtype=">f8").tofile(tmp_path / "T.001.data")
    rows = rawgrid.read_raw(spark, str(tmp_path)).where("record_i = 1 AND lon BETWEEN 5 AND 6").orderBy("lat", "lon").collect()
    assert [(r.lat, r.lon, r.lon_i, r.v) for r in rows] == [(y, x, x - 4, 12.0 + 4 * y + x - 4) for y in range(3) for x in (5, 6)]
    (tmp_path / "T.001.data").write_bytes(b"\0" * 100)
    with pytest.raises(Exception, match="bytes"):
        rawgrid.read_raw(spark, str(tmp_path)).collect()


def test_units_fail_alone_and_half_written_ones_are_done_again(spark, tmp_path):
    path = str(tmp_path / "tier")
    rows = spark.createDataFrame([("A", s, p, y, float(s)) for s in range(146000, 146006) for p in (0, 1) for y in range(3)], "dataset string, pentadstamp int, part int, lat_i int, v double")
    planned = rows.groupBy("dataset", "pentadstamp").agg(F.count("*").alias("cells"))

    def work(pdf):
        stamp, part = pdf["pentadstamp"].iloc[0], pdf["part"].iloc[0]
        if stamp == 146001 and part == 1:
            raise RuntimeError("no such day")
        if stamp == 146002:
            return pdf[pdf["lat_i"] > 0]
        return pdf if stamp != 146003 else pdf[:0]

    tiers.write_tier(rows.where("pentadstamp = 146004 AND part = 0").select("dataset", "pentadstamp", "lat_i", "v"), path)
    assert [r.pentadstamp for r in units.half_written(spark, path).collect()] == [146004]
    told = lambda: {r.pentadstamp: (r.status, r.reason) for r in units.fill_units(planned, rows, path, work, "lat_i int, v double").collect()}
    lasting = {146001: ("failed", "RuntimeError: no such day"), 146002: ("partial", "4 of 6 cells"), 146003: ("failed", "no cells")}
    assert told() == {**{s: ("made", None) for s in (146000, 146004, 146005)}, **lasting}
    assert units.half_written(spark, path).count() == 0
    held = units.read_units(spark, path).groupBy("pentadstamp").count().collect()
    assert {r.pentadstamp: r["count"] for r in held} == {s: 6 for s in (146000, 146004, 146005)}
    assert told() == {**{s: ("skipped", None) for s in (146000, 146004, 146005)}, **lasting}


def test_strict_stream_gives_out_once_and_drops_late(spark, tmp_path):
    path, schema = str(tmp_path), "ds string, d date, lat_i int, lon_i int, v double"
    day = lambda n: datetime.date(2021, 1, 1) + datetime.timedelta(n)
    runs = [
        [("A", day(n), 0, x, n + x) for n in (0, 4, 2) for x in (0, 1)],
        [("A", day(n), 0, 0, 7.0) for n in (1, 3)] + [("A", day(n), 0, 0, 1.0) for n in (5, 6)],  # completes the first pentad
        [("A", day(0), 0, 0, 1e6), ("A", day(30), 0, 0, 1.0)],  # the first day again: it is out already
        [("A", day(7), 0, 0, 1.0), ("A", day(8), 0, 0, 1.0), ("A", day(9), 0, 0, 1.0)],  # too late for the second
    ]
    for n, rows in enumerate(runs):
        spark.createDataFrame([(a, b, c, d, float(e)) for a, b, c, d, e in rows], schema).write.mode("append").parquet(f"{path}/in")
        strict.run(spark.readStream.schema(schema).parquet(f"{path}/in"), path, "10 days", blocks=3)
        got = [tuple(r) for r in spark.read.schema(strict.OUT).parquet(f"{path}/pentads").collect()]
        assert len([r for r in got if r[2] == "complete"]) == (0 if n == 0 else 2)
    stamp = pentad.parse_label("2021P00")
    assert sorted(got, key=repr) == sorted(
        [("A", stamp, "complete", 0, 0, 4.0, 5, 5), ("A", stamp, "complete", 0, 1, 3.0, 3, 5), ("A", stamp + 1, "dropped", None, None, None, None, 2)], key=repr
    )


def test_a_task_sends_a_row_for_a_day_and_block_however_many_rows_it_has():
    rng, blocks = np.random.default_rng(3), 3
    ds, d = rng.choice(["A", "B", None], 4000), rng.integers(-3, 4, 4000)
    lat, lon, v = rng.integers(0, 4, 4000), rng.integers(-2, 3, 4000), rng.random(4000)
    v[(d == 3) | (rng.random(4000) < 0.1)] = np.nan  # a day without any value is heard of as well
    cell = (lat << 32) | (lon & 0xFFFFFFFF)
    rows = pa.table([pa.array(ds, pa.string()), pa.array(d, pa.int32()).cast(pa.date32()), pa.array(cell), pa.array(v, from_pandas=True)], ["ds", "d", "cell", "v"])
    frame = pd.DataFrame({"ds": ds, "d": d, "cell": cell, "v": v}).dropna(subset="v")
    want = {(a or None, b, c): (g["v"].sum(), len(g)) for (a, b, c), g in frame.fillna({"ds": ""}).groupby(["ds", "d", "cell"])}
    for most, sends in ((4000, 1), (500, 8)):  # the sums of 420 cells are more than half of 500
        got, out = {}, pa.Table.from_batches(strict._combine(blocks, most)(iter(rows.to_batches(max_chunksize=40)))).to_pylist()
        assert (sends - 1) * 3 * 7 * blocks < len(out) <= sends * 3 * 7 * blocks
        assert {(r["ds"], (r["d"] - datetime.date(1970, 1, 1)).days, r["block"]) for r in out} == {(a, b, c) for a in ("A", "B", None) for b in range(-3, 4) for c in range(blocks)}
        block_of = {}
        for r in out:
            for c, s, n in zip(*(np.frombuffer(r[k], t) for k, t in (("cells", np.int64), ("sums", np.float64), ("counts", np.int64)))):
                key = (r["ds"], (r["d"] - datetime.date(1970, 1, 1)).days, int(c))
                assert block_of.setdefault(int(c), r["block"]) == r["block"]
                got[key] = tuple(np.add(got.get(key, (0.0, 0)), (s, n)))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_strict_stream_of_odd_names_and_places(spark, tmp_path):
    path, schema = str(tmp_path), "ds string, d date, lat_i int, lon_i int, v double"
    places = [(2, -1), (-3, 4), (None, 1), (2, None), (0, 0)]
    rows = [(ds, datetime.date(2021, 1, 1 + n), y, x, float("nan") if (y, n) == (0, 1) else float(n)) for ds in ("A", None) for n in range(5) for y, x in places]
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/in")
    strict.run(spark.readStream.schema(schema).parquet(f"{path}/in"), path, "10 days", blocks=2)
    got = [tuple(r) for r in spark.read.schema(strict.OUT).parquet(f"{path}/pentads").collect()]
    stamp = pentad.parse_label("2021P00")
    want = [(ds, stamp, "complete", y, x, 2.25 if y == 0 else 2.0, 4 if y == 0 else 5, 5) for ds in ("A", None) for y, x in places]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_clustered_tier_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "tier")
    rows = spark.range(64 * 64).select(F.lit("A").alias("dataset"), F.lit(146000).alias("pentadstamp"), F.floor(F.col("id") / 64).cast("int").alias("lat_i"), (F.col("id") % 64).cast("int").alias("lon_i"), F.col("id").cast("double").alias("v"))
    clustered.write_clustered(rows, path, level=3)
    clustered.write_clustered(rows.withColumn("v", F.lit(0.0)), path, level=3)  # there already: left alone
    assert clustered.files_of(spark, path).count() == 64
    box = clustered.read_box(spark, path, (8, 20), (30, 33), 3)
    assert {(r.lat_i, r.lon_i, r.v) for r in box.collect()} == {(y, x, 64.0 * y + x) for y in range(8, 21) for x in range(30, 34)}
    assert box.select(F.input_file_name()).distinct().count() == 4
    assert "PartitionFilters" in box._jdf.queryExecution().toString() and clustered.curve(5, 3) == 0b100111
    assert clustered.tile_ranges((0, 63), (0, 63), 3) == [(0, 63)]
    clustered.write_clustered(rows.withColumn("v", F.lit(1.0)), path, level=3, overwrite=True)
    assert clustered.read_box(spark, path, (0, 63), (0, 63), 3).agg(F.sum("v")).first()[0] == 4096.0


def test_work_on_a_pandas_error_names_the_unit():
    run = units.isolated(lambda rows: 1 / 0, ["lat_i", "v"])
    out = run(("A", 5), pd.DataFrame({"x": [1]}))
    assert out.iloc[0].to_dict() == {"dataset": "A", "pentadstamp": 5, "lat_i": None, "v": None, "error": "ZeroDivisionError: division by zero"}


def test_work_folders_are_deleted_in_the_end(spark, tmp_path):
    kept, path = shared.materialize(spark.range(3).toDF("n"))
    assert kept.count() == 3 and path in shared.made
    others = {p: s for p, s in shared.made.items() if p != path}
    shared.made.clear()
    shared.made[path] = spark
    shared.delete_all()
    assert not os.path.exists(path.removeprefix("file:")) and not shared.made
    shared.made.update(others)


def mat_rows(spark, variables=("t", "s")):
    return spark.createDataFrame([("D", 7, v, k, y, x, None if (k, y, x) == (1, 0, 0) else float(100 * k + 10 * y + x) + (0.5 if v == "s" else 0.0)) for v in variables for k in range(2) for y in range(2) for x in range(3)], "name string, date long, variable string, k int, lat_i int, lon_i int, v double")


def test_mat_file_is_a_struct_of_doubles(spark, tmp_path):
    path, axes = str(tmp_path / "mat"), {"depth": [0.0, -5.0], "lat": [1.0, 2.0], "lon": [10.0, 20.0, 30.0]}
    matfile.write_mat(mat_rows(spark), path, axes, ["t", "s"])
    data = (tmp_path / "mat" / "D.7.mat").read_bytes()
    assert data[124:128] == b"\x01\x00MI" and struct.unpack(">II", data[128:136]) == (14, len(data) - 136)
    back = {(r.depth, r.lat, r.lon): r.v for r in matfile.read_mat(spark, path, "s").collect()}
    want = {(d, 1.0 + y, 10.0 * (x + 1)): 0.0 if (k, y, x) == (1, 0, 0) else 100 * k + 10 * y + x + 0.5 for k, d in ((0, 0.0), (1, -5.0), (1, matfile.BOTTOM)) for y in range(2) for x in range(3)}
    assert back == want
    assert [r.v for r in matfile.read_mat(spark, path, "t").where("depth < -5 AND lat = 2 AND lon >= 20").orderBy("lon").collect()] == [111.0, 112.0]
    with slabs.Bytes(f"{path}/D.7.mat") as source:
        assert matfile.find_field(source, "Date")[0] == [1, 1] and source.at(matfile.find_field(source, "Date")[1], 8) == struct.pack(">d", 7.0)
        assert matfile.find_field(source, "t")[0] == [3, 2, 3]
        with pytest.raises(ValueError, match="no field"):
            matfile.find_field(source, "u")
    with pytest.raises(FileExistsError):
        matfile.write_mat(mat_rows(spark), path, axes, ["t", "s"])
    with pytest.raises(Exception, match="lacks"):
        matfile.write_mat(mat_rows(spark, ("t",)), str(tmp_path / "other"), axes, ["t", "s"])
    assert os.listdir(tmp_path / "other") == []


def test_paths_as_spark_spells_them():
    for scheme in ("s3a", "s3n", "s3"):
        store, inner = slabs.store_of(f"{scheme}://key:secret@bucket/a/b?region=us-east-1")
        assert inner == "bucket/a/b" and "S3" in type(store).__name__
    assert slabs.store_of("file:///a/b")[1] == slabs.store_of("/a/b")[1] == "/a/b"
