"""Registered queries over the driver tables; their oracle SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import aggregates, pentad
from tidegrid.operators import eof, fields, grids, series
from tidegrid.plans import adapters as a
from tidegrid.plans import chains, oracles, stores
from tidegrid.sources import rawgrid, tiers
from tidegrid.sources.shared import work_folder
from tidegrid.streaming import pentads

FIRST_YEAR, LAST_YEAR = 1996, 2000
REGRID_LAT, REGRID_LON = grids.axis(0.0, 72.5, 1.5), grids.axis(0.5, 69.5, 0.7)
# A staggered target: levels between the source's, latitudes and longitudes that reach beyond its edges.
SOURCE_GRID = {"z": [float(i) for i in range(7)], "lat": [float(i) for i in range(10)], "lon": [float(i) for i in range(7)]}
TARGET_GRID = {"z": [0.5, 2.25, 5.5, 6.0], "lat": grids.axis(-0.75, 10.0, 0.7), "lon": grids.axis(-0.4, 6.9, 0.6)}
SWEEPS = 10


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals without negative zero; the nudge keeps exact halves from hanging on the order of a sum."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(oracles.NUDGE), 6) + F.lit(0.0) for c in columns})


def _pen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.pentad_mean(a.obs(spark, sf_dir))


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dft(series.detrend(a.vectors(spark, sf_dir)), "v_detrended", a.WIDTH)


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose values of at most 0.05 in size count as gaps."""
    return a.vectors(spark, sf_dir).withColumn("v", F.when(F.abs("v") > 0.05, F.col("v")))


def _as_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of a vector are the samples, the vectors are the cells."""
    return eof.anomalies(a.vectors(spark, sf_dir).select(F.col("t").alias("cell"), F.col("x").alias("sample"), "v"), a.WIDTH)


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ds, pentadstamp, lat_i, k, v: seven levels with gaps."""
    pen = _pen(spark, sf_dir)
    keys = pen.select("ds", "pentadstamp", "lat_i").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    held = pen.select("ds", "pentadstamp", "lat_i", (F.col("lon_i") - 1).alias("k"), "v")
    return keys.join(held, ["ds", "pentadstamp", "lat_i", "k"], "left")


def pentad_assign(spark, sf_dir):
    stamp = pentad.stamp_of(F.col("d"))
    rows = a.obs(spark, sf_dir).select("d").distinct().withColumn("pentadstamp", stamp).where("pentadstamp IS NOT NULL")
    s = F.col("pentadstamp")
    return rows.select("d", s, pentad.label_of(s).alias("label"), pentad.begin_of(s).alias("time_beg"), pentad.end_of(s).alias("time_end"))


def pentad_parse(spark, sf_dir):
    """Labels with pentads out of range, read from every order date's year and a shift."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate").alias("y"), (F.pmod("o_orderkey", F.lit(200)) - 100).cast("int").alias("p")).distinct()
    text = F.concat(F.lpad(F.col("y").cast("string"), 4, "0"), F.lit("P"), F.col("p").cast("string"))
    rows = orders.select(text.alias("text")).withColumn("pentadstamp", pentad.parse(F.col("text")))
    return rows.withColumn("label", pentad.label_of(F.col("pentadstamp")))


def _range(inclusive: str):
    """Ranges from six pentads before every order's pentad, over a year's end too, of up to twelve pentads."""

    def query(spark, sf_dir):
        key = F.col("o_orderkey")
        begin = pentad.parse(F.concat(F.year("o_orderdate").cast("string"), F.lit("P"), (F.pmod(key, F.lit(73)) - 6).cast("string")))
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(begin.alias("a"), (begin + F.pmod(key, F.lit(13))).cast("int").alias("b")).distinct()
        return pentad.ranges(rows, "a", "b", inclusive)

    return query


def daily_mean_6h(spark, sf_dir):
    return _r(fields.daily_mean(a.events(spark, sf_dir)), "v")


def hours_epoch(spark, sf_dir):
    rows = a.events(spark, sf_dir).select(F.date_trunc("HOUR", "ts").alias("t")).distinct()
    rows = rows.select(pentad.hours_since(F.col("t")).alias("hours"))
    back = pentad.from_hours(F.col("hours"))
    return rows.select("hours", F.to_date(back).alias("day"), F.hour(back).alias("hour"))


def month_filter(spark, sf_dir):
    rows = a.obs(spark, sf_dir).where(F.month("d").isin(10, 11, 12, 1, 2, 3, 4))
    return rows.groupBy("ds", F.month("d").alias("month")).agg(F.count("*").alias("n"))


def season_select(spark, sf_dir):
    rows = fields.season(_pen(spark, sf_dir), -6, 11, FIRST_YEAR, LAST_YEAR)
    return _r(rows.select("season_year", "ds", "pentadstamp", "lat_i", "lon_i", "v"), "v")


def crop_box(spark, sf_dir):
    return _r(fields.crop(a.places(a.clim(spark, sf_dir)), (10.0, 40.0), (150.0, 220.0)).select("ds", "lat", "lon", "v"), "v")


def lon_wrap_roll(spark, sf_dir):
    return fields.roll_longitude(a.clim(spark, sf_dir).select((F.col("lon_i") * 5.0 - 175.0).alias("lon")).distinct())


def unit_convert(spark, sf_dir):
    rows = a.clim(spark, sf_dir).withColumn("varname", F.when(F.col("ds") == "A", "sst").otherwise("ssta"))
    return _r(rows.select("varname", "ds", "lat_i", "lon_i", fields.to_kelvin(F.col("v"), F.col("varname")).alias("v")), "v")


def _masks(spark, sf_dir):
    return fields.region_masks(a.places(a.dense(spark, sf_dir)).where("ds = 'A'"))


def region_mean(spark, sf_dir):
    return _r(fields.region_mean(a.clim(spark, sf_dir).withColumn("pentadstamp", F.col("lat_i")), _masks(spark, sf_dir)), "v")


def mean_axis(keep: str):
    return lambda spark, sf_dir: _r(fields.axis_mean(_pen(spark, sf_dir), keep), "v")


def chunk_mean(spark, sf_dir):
    pen = _pen(spark, sf_dir)
    rows = pen.join(fields.chunks(pen, 6), "pentadstamp").groupBy("ds", "chunk", "lat_i", "lon_i").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    return _r(rows, "v")


def interval_lookup(spark, sf_dir):
    """The order catalogue: spans of years that overlap, the first one wins."""
    spans = spark.createDataFrame(
        [(0, "early", "1995-01-01", "1997-06-30"), (1, "middle", "1997-01-01", "1999-12-31"), (2, "late", "1999-06-01", "2002-12-31")],
        "ord int, name string, beg string, end string",
    ).select("ord", "name", F.to_date("beg").alias("beg"), F.to_date("end").alias("end"))
    return fields.first_interval(a.obs(spark, sf_dir).select("d").distinct(), spans)


def index_range(spark, sf_dir):
    axis = a.places(a.clim(spark, sf_dir)).select("lon_i", "lon").distinct()
    return fields.index_range(axis, "lon", "lon_i", 150.0, 201.0)


def _boxes(spark, sf_dir):
    """The span of the places that have values, in 4 x 5 boxes."""
    span = a.places(a.clim(spark, sf_dir)).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    return fields.boxes(spark, (span[0], span[1]), (span[2], span[3]), 4, 5)


def strict_stats(spark, sf_dir):
    """Mean and deviation of each cell over the datasets, missing where one is."""
    rows = a.dense(spark, sf_dir).groupBy("lat_i", "lon_i").agg(
        aggregates.avg_strict(F.col("v")).alias("mean"), aggregates.std_pop_strict(F.col("v")).alias("std")
    )
    return _r(rows, "mean", "std")


def pretty_places(spark, sf_dir):
    rows = a.places(a.clim(spark, sf_dir)).select("lat", "lon").distinct()
    return rows.select(
        "lat", "lon",
        aggregates.pretty_latitude(F.col("lat")).alias("lat_text"),
        aggregates.pretty_latitude(F.col("lat"), zero="E").alias("lat_zero_text"),
        aggregates.pretty_longitude(F.col("lon") + 20.0).alias("lon_text"),
    )


def spectrum_diff(spark, sf_dir):
    """Spectra of the difference of each vector to the one before it."""
    rows = a.vectors(spark, sf_dir)
    other = rows.select((F.col("t") + 1).alias("t"), "x", F.col("v").alias("w"))
    diff = rows.join(other, ["t", "x"]).select("t", "x", (F.col("v") - F.col("w")).alias("v"))
    return _r(series.dft(series.fill_ends(diff), "v", a.WIDTH).select("t", "k", "radius"), "radius")


def spectrum_diff_detrended(spark, sf_dir):
    """SURVEY N16: differences to the vector before, each with missing ends; ends filled, line removed, spectrum."""
    inside = (F.col("x") >= F.col("t") % 5) & (F.col("x") < a.WIDTH - F.col("t") % 3)
    rows = a.vectors(spark, sf_dir).withColumn("v", F.when(inside, F.col("v")))
    other = rows.select((F.col("t") + 1).alias("t"), "x", F.col("v").alias("w"))
    diff = rows.join(other, ["t", "x"]).select("t", "x", (F.col("v") - F.col("w")).alias("v"))
    return _r(series.dft(series.detrend(series.fill_ends(diff)), "v_detrended", a.WIDTH).select("t", "k", "radius"), "radius")


def gradient_hist(spark, sf_dir):
    return series.histogram(series.gradient(a.vectors(spark, sf_dir)), "g", 0.1)


def regrid_bilinear(spark, sf_dir):
    lat = grids.axis_weights(spark, [float(i) for i in range(a.N_LAT)], REGRID_LAT, "lat")
    lon = grids.axis_weights(spark, [float(i) for i in range(a.N_LON)], REGRID_LON, "lon")
    return _r(grids.regrid(a.dense(spark, sf_dir), ["ds"], lat, lon), "v")


def interp_1d(spark, sf_dir):
    weights = grids.axis_weights(spark, [float(i) for i in range(a.N_LON)], REGRID_LON, "x")
    rows = fields.axis_mean(a.clim(spark, sf_dir).withColumn("pentadstamp", F.lit(0)), "lon_i")
    return _r(grids.interpolate(rows, ["ds"], weights), "v")


def eof_gram(spark, sf_dir):
    return _r(eof.gram(_as_cells(spark, sf_dir)), "g")


def eof_variance_total(spark, sf_dir):
    total = F.sum(F.when(F.col("s") == F.col("t"), F.col("g"))) / (a.WIDTH - 1)
    return _r(eof.gram(_as_cells(spark, sf_dir)).agg(total.alias("variance")), "variance")


def eof_modes(spark, sf_dir):
    return eof.normalised(eof.modes(_as_cells(spark, sf_dir), 5)[0])


def eof_pcs(spark, sf_dir):
    return eof.modes(_as_cells(spark, sf_dir), 5)[1]


def eof_variance(spark, sf_dir):
    return eof.modes(_as_cells(spark, sf_dir), 5)[2]


def eof_signs(spark, sf_dir):
    """The sign rule of modes, over the vectors as they are."""
    return a.vectors(spark, sf_dir).groupBy("t").agg(aggregates.sign_of_mode(F.col("v")).cast("int").alias("sign"))


def autocorr(spark, sf_dir):
    """Daily counts of each event type; lags up to ten days."""
    days = a.events(spark, sf_dir).groupBy(F.col("ds").alias("s"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t")).agg(
        F.count("*").cast("double").alias("v")
    )
    return _r(series.autocorrelation(days, 10), "c")


def boundary_faces(spark, sf_dir):
    """Faces of the 10 x 7 grid; levels are the years."""
    pen = _pen(spark, sf_dir).groupBy(pentad.year_of(F.col("pentadstamp")).alias("k"), "lat_i", (F.col("lon_i") - 1).alias("lon_i")).agg(F.avg("v").alias("v"))
    return _r(fields.faces(pen, 10, 7), "v")


def detect_work(spark, sf_dir):
    """Pentads of the strict tier that are still to be made."""
    planned = _pen(spark, sf_dir).select("ds", "pentadstamp").distinct()
    done = fields.pentad_mean(a.obs(spark, sf_dir), strict_days=True).select("ds", "pentadstamp")
    return tiers.missing_work(planned, done, ["ds", "pentadstamp"])


def pentad_stream(spark, sf_dir):
    """The pentad means by the incremental path: a file stream into partial aggregates."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    path = work_folder(spark)
    pentads.ingest(source, a.daily_of, path)
    return _r(pentads.means(spark, path), "v")


def pentad_arithmetic(spark, sf_dir):
    """Points and spans made from parts, moved by each other and compared."""
    key = F.col("o_orderkey")
    year, part = F.year("o_orderdate"), (F.pmod(key, F.lit(200)) - 100).cast("int")
    years = F.when(F.pmod(key, F.lit(5)) > 0, (F.pmod(key, F.lit(7)) - 3).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        pentad.stamp_from(year, part).alias("a"),
        pentad.stamp_from(F.lit(1998), F.when(part > 0, part)).alias("b"),
        pentad.delta_from(years, part).alias("span"),
    ).distinct()
    a_, b, span = F.col("a"), F.col("b"), F.col("span")
    return rows.select(
        "a", "b", "span", (a_ + span).alias("later"), (a_ - span).alias("earlier"), (a_ - b).alias("apart"), (span + span).alias("twice"),
        (a_ < b).alias("lt"), (a_ <= b).alias("le"), (a_ == b).alias("eq"), (a_ != b).alias("ne"), (a_ >= b).alias("ge"), (a_ > b).alias("gt"),
        (span < F.lit(pentad.PENTADS)).alias("short"),
    )


def flip_latitude(spark, sf_dir):
    """Dataset A has its latitudes from north to south."""
    rows = a.places(a.clim(spark, sf_dir))
    rows = rows.withColumn("lat", F.when(F.col("ds") == "A", F.lit(a.LAT0 + (a.N_LAT - 1) * a.D_LAT) - F.col("lat")).otherwise(F.col("lat")))
    return _r(fields.ascending_latitude(rows).select("ds", "lat_i", "lon_i", "lat", "v"), "v")


def index_box(spark, sf_dir):
    return fields.index_box(a.places(a.dense(spark, sf_dir)), (10.0, 40.0), (150.0, 201.0))


def _stored_axes(spark, sf_dir):
    """ds, lon_i, lon: the axis of N runs from -180, that of R starts in the middle of an ocean."""
    step = 360.0 / a.N_LON
    start = F.when(F.col("ds") == "A", 0.0).when(F.col("ds") == "N", 180.0).otherwise(30 * step)
    rows = a.clim(spark, sf_dir).select("ds", "lon_i").distinct()
    lon = F.pmod(F.col("lon_i") * F.lit(step) + start, F.lit(360.0))
    return rows.select("ds", "lon_i", F.when((F.col("ds") == "N") & (lon >= 180.0), lon - 360.0).otherwise(lon).alias("lon"))


def rotated_axis(spark, sf_dir):
    """The first ten positions east of the start of each dataset's own axis."""
    axes = _stored_axes(spark, sf_dir)
    at = fields.longitude_start(axes).select("ds", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"), "start")
    at = at.select("ds", "i", "start", fields.rotated_index(F.col("i"), F.col("start"), a.N_LON, 3).alias("lon_i"))
    return _r(at.join(axes, ["ds", "lon_i"]).select("ds", "i", "start", "lon_i", "lon"), "lon")


def multi_select(spark, sf_dir):
    return _r(fields.select_stamps(_pen(spark, sf_dir), [145640, 145700, 145801, 146000]), "v")


def stack_seasons(spark, sf_dir):
    """Two spans of seasons, one after the other; only the second has counts, the first gets 0."""
    pen = _pen(spark, sf_dir)
    early = fields.season(pen, -6, 11, 1996, 1997).select("season_year", "ds", "pentadstamp", "lat_i", "lon_i", "v")
    late = fields.season(pen, 30, 40, 1999, 2000).select("season_year", "ds", "pentadstamp", "lat_i", "lon_i", "v", "n")
    return _r(fields.stack([early, late]).withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), "v")


def compress_scatter(spark, sf_dir):
    """The cells of one region's mask taken out and put back on the whole grid."""
    mask = _masks(spark, sf_dir).where("region = 'NPAC_NORTH'")
    kept = fields.compress(a.clim(spark, sf_dir), mask)
    return _r(fields.scatter(kept, a.dense(spark, sf_dir), ["ds"]), "v")


def _snapshot(spark, sf_dir):
    """Mean amplitudes of chunks of ten vectors; an incomplete last chunk is left out."""
    t, n = F.col("t"), F.lit(10)
    last = a.vectors(spark, sf_dir).agg(F.floor((F.max("t") + 1) / 10).alias("whole"))
    spectrum = _spectrum(spark, sf_dir).join(F.broadcast(last), F.floor(t / n) < F.col("whole"))  # one number
    return series.chunk_amplitudes(spectrum, F.floor(t / n).cast("int"))


def spectrum_snapshot(spark, sf_dir):
    """Share of variance and log amplitude of the chunks' mean spectra, without the lowest harmonics."""
    return _r(series.variance_fraction(_snapshot(spark, sf_dir), 3), "frac", "log_amp")


def _chunk_differences(spark, sf_dir):
    """t (chunk * 100 + label), x, v: a label's mean over a chunk of fifty vectors less that of label 0."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).cast("int").alias("chunk"), "label", F.posexplode("embedding").alias("x", "v"))
    means = raw.groupBy("chunk", "x", "label").agg(F.avg(F.col("v").cast("double")).alias("v"))
    base = means.where("label = 0").select("chunk", "x", F.col("v").alias("w"))
    diff = means.where("label > 0").join(base, ["chunk", "x"])
    return diff.select((F.col("chunk") * 100 + F.col("label")).cast("int").alias("t"), "x", (F.col("v") - F.col("w")).alias("v"))


def snapshot_diff(spark, sf_dir):
    """Chunk means, differences to the first product, ends filled, line removed, spectrum, shares."""
    rows = series.detrend(series.fill_ends(_chunk_differences(spark, sf_dir)))
    return _r(series.variance_fraction(series.dft(rows, "v_detrended", a.WIDTH), 3), "frac", "log_amp")


def snapshot_gradient(spark, sf_dir):
    return _r(series.gradient(_chunk_differences(spark, sf_dir)), "x_mid", "g")


def distance_text(spark, sf_dir):
    stats = fields.distance_stats(fields.distances(_pen(spark, sf_dir), a.DATASETS))
    return fields.distance_text(stats.withColumns({"mean": F.col("mean") / 1e6, "std": F.col("std") / 1e6}))


def required_files(spark, sf_dir):
    products = spark.createDataFrame(tiers.PRODUCTS, "dataset string, timestr string, suffix string")
    return tiers.required_files(_pen(spark, sf_dir).select("pentadstamp"), products)


def fill_tier(spark, sf_dir):
    """A tier that holds the years up to 1998 is filled up; work is possible in strict pentads only."""
    pen = _pen(spark, sf_dir).withColumnRenamed("ds", "dataset")
    path = work_folder(spark)
    strict = fields.pentad_mean(a.obs(spark, sf_dir), strict_days=True).withColumnRenamed("ds", "dataset")
    tiers.write_tier(strict.where(F.col("pentadstamp") < 1999 * pentad.PENTADS), path)
    return tiers.fill_tier(pen, path, lambda todo: strict.join(todo, ["dataset", "pentadstamp"], "left_semi"))


def catalogue_json(spark, sf_dir):
    """A catalogue of datasets with their spans, through JSON and back."""
    rows = a.obs(spark, sf_dir).groupBy("ds").agg(F.min("d").alias("beg"), F.max("d").alias("end"), F.sort_array(F.collect_set("lon_i")).alias("lon_i"))
    path = work_folder(spark)
    tiers.write_catalogue(rows, path)
    back = tiers.read_catalogue(spark, path, "ds string, beg date, end date, lon_i array<int>")
    return back.select("ds", "beg", "end", F.size("lon_i").alias("n"), F.element_at("lon_i", -1).alias("last_i"))


def binary_roundtrip(spark, sf_dir):
    """A packed field read back: every value at its place."""
    path = work_folder(spark)
    tiers.write_binary(a.dense(spark, sf_dir), path, ["ds", "lat_i", "lon_i"])
    return tiers.read_binary(spark, path).select("at", F.round("v", 1).cast("double").alias("v"))


def _levels(spark, sf_dir):
    """ds, k (year), lat_i, lon_i, v: a row for every cell; low values count as gaps."""
    held = a.obs(spark, sf_dir).where(F.year("d").between(1995, 2001)).groupBy("ds", (F.year("d") - 1995).alias("k"), "lat_i", (F.col("lon_i") - 1).alias("lon_i"))
    held = held.agg(F.avg("v").alias("v")).withColumn("v", F.when(F.col("v") >= 36000.0, F.col("v")))
    names = spark.createDataFrame([(d,) for d in a.DATASETS], "ds string")
    cells = spark.range(490).select(
        F.floor(F.col("id") / 70).cast("int").alias("k"), F.floor(F.pmod("id", F.lit(70)) / 7).cast("int").alias("lat_i"), F.pmod("id", F.lit(7)).cast("int").alias("lon_i")
    )
    return cells.crossJoin(F.broadcast(names)).join(held, ["ds", "k", "lat_i", "lon_i"], "left")  # three names


def interp_vertical(spark, sf_dir):
    """Columns carried down to the last level, then interpolated to other levels; missing where a level with weight is."""
    rows = grids.fill_down(_levels(spark, sf_dir), ["ds", "lat_i", "lon_i"]).withColumnRenamed("k", "axis_i")
    weights = grids.axis_weights(spark, SOURCE_GRID["z"], TARGET_GRID["z"], "x")
    return _r(grids.interpolate(rows, ["ds", "lat_i", "lon_i"], weights), "v")


def regrid_clamped(spark, sf_dir):
    """Targets beyond the source's edges take the edge's values."""
    lat, lon = (grids.axis_weights(spark, SOURCE_GRID[c], TARGET_GRID[c], c, clamp=True) for c in ("lat", "lon"))
    return _r(grids.regrid(_levels(spark, sf_dir), ["ds", "k"], lat, lon), "v")


def _target_cells(spark):
    n_lat, n_lon = len(TARGET_GRID["lat"]), len(TARGET_GRID["lon"])
    return spark.range(len(TARGET_GRID["z"]) * n_lat * n_lon).select(
        F.floor(F.col("id") / (n_lat * n_lon)).cast("int").alias("k"),
        F.floor(F.pmod("id", F.lit(n_lat * n_lon)) / n_lon).cast("int").alias("lat_i"),
        F.pmod("id", F.lit(n_lon)).cast("int").alias("lon_i"),
    )


LAND = "(k + lat_i + lon_i) % 5 = 0"


def _staggered(spark, sf_dir, land):
    out = grids.regrid_staggered(_levels(spark, sf_dir), ["ds"], SOURCE_GRID, TARGET_GRID, land, 3, fill_value=-1.0, valid=(37000.0, 39000.0))
    return _r(out, "v")


def regrid_staggered(spark, sf_dir):
    """A field with levels and gaps on a staggered grid whose land cells follow a rule."""
    return _staggered(spark, sf_dir, _target_cells(spark).where(LAND))


def regrid_raw_land(spark, sf_dir):
    """The same with the land read from the model's grid file: where the open part of a cell is 0."""
    path = work_folder(spark)
    open_part = _target_cells(spark).where(f"NOT {LAND}").select(F.lit("hFacW").alias("variable"), F.lit(0).alias("step"), "k", "lat_i", "lon_i", F.lit(1.0).alias("v"))
    rawgrid.write_raw(open_part, path, {"k": len(TARGET_GRID["z"]), "lat_i": len(TARGET_GRID["lat"]), "lon_i": len(TARGET_GRID["lon"])})
    land = rawgrid.read_raw(spark, path).where("v = 0").select(F.col("k_i").alias("k"), "lat_i", "lon_i")
    return _staggered(spark, sf_dir, land)


def high_pass(spark, sf_dir):
    return _r(grids.high_pass(a.dense(spark, sf_dir), ["ds"], a.N_LAT, a.N_LON, 12, 6), "v")


def spectral_density(spark, sf_dir):
    """Densities of the vectors' rows, a layer a label, for wavelengths below twenty steps."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = raw.select("label", F.col("vec_id").alias("lat_i"), F.posexplode("embedding").alias("lon_i", "v")).withColumn("v", F.col("v").cast("double"))
    return _r(series.spectral_density(rows, ["label"], a.WIDTH, 1.0, 20.0), "wvlen", "density", "log_density")


def _yearly(spark, sf_dir):
    """ds, pentadstamp (the year), lat_i, lon_i, v: coarse enough that few cells have gaps."""
    rows = a.obs(spark, sf_dir).groupBy("ds", F.year("d").alias("pentadstamp"), "lat_i", "lon_i")
    return rows.agg(F.avg("v").alias("v"))


def _pairs_stacked(spark, sf_dir):
    rows = _yearly(spark, sf_dir)
    return eof.stacked_differences(rows, a.DATASETS, rows, "all", 1)


def _half_mask(spark, sf_dir):
    """A mask that leaves out the last two columns of cells."""
    return _yearly(spark, sf_dir).select("lat_i", "lon_i").distinct().withColumn("mask", (F.col("lon_i") <= 5).cast("int"))


def eof_pairs_gram(spark, sf_dir):
    stacked, samples = _pairs_stacked(spark, sf_dir)
    products = eof.gram(eof.as_cells(stacked, samples, _half_mask(spark, sf_dir)))
    return _r(products.withColumn("g", F.col("g") / 1e6), "g")


def eof_mean_std(spark, sf_dir):
    return _r(eof.cell_stats(*_pairs_stacked(spark, sf_dir)), "mean", "std")


def eof_first_mode(spark, sf_dir):
    """The first mode of the pairs' differences on the whole grid, with its share of the variance."""
    rows = _yearly(spark, sf_dir)
    maps, _, variance, _ = eof.of_differences(rows, a.DATASETS, rows, 5, "all", 1, _half_mask(spark, sf_dir))
    first = maps.where("mode = 0").join(variance, "mode").select("lat_i", "lon_i", "v", "share", "share_of_kept")
    return _r(first.drop("share_of_kept"), "v", "share")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pentad_assign": pentad_assign,
    "pentad_parse": pentad_parse,
    **{f"pentad_range_{k}": _range(k) for k in ("left", "right", "both", "neither")},
    "pentad_mean": lambda s, d: _r(_pen(s, d), "v"),
    "pentad_mean_strict_days": lambda s, d: _r(fields.pentad_mean(a.obs(s, d), strict_days=True), "v"),
    "pentad_stream": pentad_stream,
    "daily_mean_6h": daily_mean_6h,
    "hours_epoch": hours_epoch,
    "month_filter": month_filter,
    "season_select": season_select,
    "ensemble_mean": lambda s, d: _r(fields.ensemble_mean(_pen(s, d), a.DATASETS), "v"),
    "crop_box": crop_box,
    "lon_wrap_roll": lon_wrap_roll,
    "stride": lambda s, d: _r(fields.stride(a.clim(s, d), 4), "v"),
    "unit_convert": unit_convert,
    "region_mask": _masks,
    "region_mean": region_mean,
    "pair_diff_ref": lambda s, d: _r(fields.differences(_pen(s, d), a.DATASETS, "ref"), "diff"),
    "pair_diff_all": lambda s, d: _r(fields.differences(_pen(s, d), a.DATASETS, "all"), "diff"),
    "diff_stats": lambda s, d: _r(fields.difference_stats(fields.differences(_pen(s, d), a.DATASETS, "all")), "mean", "std"),
    "dist2_matrix": lambda s, d: _r(fields.distances(a.clim(s, d).withColumn("pentadstamp", F.lit(0)), a.DATASETS).withColumns({"dist2": F.col("dist2") / 1e12, "msd": F.col("msd") / 1e6}), "dist2", "msd"),
    "dist_stats": lambda s, d: _r(fields.distance_stats(fields.distances(_pen(s, d), a.DATASETS)).withColumns({"mean": F.col("mean") / 1e6, "std": F.col("std") / 1e6}), "mean", "std"),
    "zonal_mean": mean_axis("lat_i"),
    "meridional_mean": mean_axis("lon_i"),
    "chunk_mean": chunk_mean,
    "calendar_gaps": lambda s, d: fields.missing_days(a.obs(s, d).where("ds = 'A' AND lon_i = 7").select("d")),
    "interval_lookup": interval_lookup,
    "index_range": index_range,
    "range_check": lambda s, d: fields.out_of_range(a.dense(s, d), 20000.0, 60000.0),
    "range_check_ocean": lambda s, d: fields.out_of_range(a.dense(s, d), 20000.0, 60000.0, (F.col("lat_i") * 7 + F.col("lon_i")) % 11 != 0),
    "strict_stats": strict_stats,
    "pretty_places": pretty_places,
    "box_division": lambda s, d: _r(_boxes(s, d), "south", "north", "west", "east", "lat_mid", "lon_mid"),
    "detrend": lambda s, d: _r(series.detrend(a.vectors(s, d)), "v_detrended", "v_minus_intercept"),
    "dft": lambda s, d: _r(_spectrum(s, d), "re", "im", "radius", "phase", "wvlen"),
    "variance_fraction": lambda s, d: _r(series.variance_fraction(_spectrum(s, d), 3), "frac", "log_amp"),
    "band_variance": lambda s, d: _r(series.band_variance(_spectrum(s, d)), "frac"),
    "spectrum_diff": spectrum_diff,
    "spectrum_diff_detrended": spectrum_diff_detrended,
    "gradient": lambda s, d: _r(series.gradient(a.vectors(s, d)), "x_mid", "g"),
    "gradient_hist": gradient_hist,
    "faketail": lambda s, d: _r(series.fill_ends(_gappy(s, d)), "v"),
    "regrid_bilinear": regrid_bilinear,
    "interp_1d": interp_1d,
    "box_filter": lambda s, d: _r(grids.box_filter(a.dense(s, d), ["ds"], 2), "v"),
    "gauss_filter": lambda s, d: _r(grids.separable_filter(a.dense(s, d), ["ds"], grids.gauss_weights(2, 1.0)), "v"),
    "eof_gram": eof_gram,
    "eof_variance_total": eof_variance_total,
    "eof_modes": eof_modes,
    "eof_pcs": eof_pcs,
    "eof_variance": eof_variance,
    "eof_signs": eof_signs,
    "down_fill": lambda s, d: _r(grids.fill_down(_columns(s, d), ["ds", "pentadstamp", "lat_i"]), "v"),
    "flood_fill": lambda s, d: _r(grids.flood_fill(a.dense(s, d), ["ds"], a.N_LAT, a.N_LON, SWEEPS, (F.col("lat_i") * 7 + F.col("lon_i")) % 11 != 0), "v"),
    "flood_fill_tiles": lambda s, d: _r(grids.flood_fill(a.dense(s, d), ["ds"], a.N_LAT, a.N_LON, SWEEPS, (F.col("lat_i") * 7 + F.col("lon_i")) % 11 != 0, layer_cells=0, tile=24, reach=4), "v"),
    "autocorr": autocorr,
    "boundary_faces": boundary_faces,
    "detect_work": detect_work,
    "pentad_arithmetic": pentad_arithmetic,
    "flip_latitude": flip_latitude,
    "index_box": index_box,
    "rotated_axis": rotated_axis,
    "surface_level": lambda s, d: _r(fields.surface(_columns(s, d), "sst"), "sst"),
    "multi_select": multi_select,
    "merge_outer": lambda s, d: _r(fields.merge_variables(_pen(s, d), a.DATASETS, ["pentadstamp", "lat_i", "lon_i"]), *a.DATASETS),
    "stack_seasons": stack_seasons,
    "compress_scatter": compress_scatter,
    "spectrum_snapshot": spectrum_snapshot,
    "snapshot_diff": snapshot_diff,
    "snapshot_gradient": snapshot_gradient,
    "distance_text": distance_text,
    "required_files": required_files,
    "fill_tier": fill_tier,
    "catalogue_json": catalogue_json,
    "binary_roundtrip": binary_roundtrip,
    "interp_vertical": interp_vertical,
    "regrid_clamped": regrid_clamped,
    "regrid_staggered": regrid_staggered,
    "regrid_raw_land": regrid_raw_land,
    "high_pass": high_pass,
    "spectral_density": spectral_density,
    "eof_pairs_gram": eof_pairs_gram,
    "eof_mean_std": eof_mean_std,
    "eof_first_mode": eof_first_mode,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | stores.QUERIES | chains.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES | stores.ORACLES | chains.ORACLES
