"""Operators on tidy fields: one row a cell, with integer grid indices as keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions import pentad
from tidegrid.functions.aggregates import mean_of_all, wrap_longitude

# Region boxes as (name, south, north, west, east); a cell lies in (south, north] and (west, east].
REGIONS = [
    ("NPAC_ALL", 0.0, 60.0, 120.0, 250.0),
    ("NPAC_SOUTH", 0.0, 30.0, 120.0, 250.0),
    ("NPAC_NORTH", 30.0, 60.0, 120.0, 250.0),
    ("NPAC_EAST", 0.0, 60.0, 180.0, 250.0),
    ("NPAC_WEST", 0.0, 60.0, 120.0, 180.0),
    ("WWRF", 5.0, 62.0, 160.0, 250.0),
]
REGION_SCHEMA = "region string, south double, north double, west double, east double"
CELL = ["lat_i", "lon_i"]


def pentad_mean(daily: DataFrame, strict_days: bool = False) -> DataFrame:
    """ds, pentadstamp, lat_i, lon_i, v, n: means over five days, skipping missing values.

    With ``strict_days`` a dataset's pentad is left out unless rows of all five days are there: days
    are bits that are combined where the rows are read, so few rows are shuffled for the rule.
    """
    rows = daily.withColumn("pentadstamp", pentad.stamp_of(F.col("d"))).where("pentadstamp IS NOT NULL")
    means = rows.groupBy("ds", "pentadstamp", *CELL).agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    if strict_days:
        day = F.expr(f"shiftleft(1, (dayofyear(d) - 1) % {pentad.DAYS})")
        whole = rows.groupBy("ds", "pentadstamp").agg(F.bit_count(F.bit_or(day)).alias("days")).where(F.col("days") == pentad.DAYS)
        means = means.join(whole.select("ds", "pentadstamp"), ["ds", "pentadstamp"], "left_semi")
    return means


def daily_mean(rows: DataFrame, hours: int = 6) -> DataFrame:
    """ds, day, v, n_slots: daily means of sub-daily values where every slot of ``hours`` has one."""
    slot = F.floor(F.hour("ts") / hours)
    days = rows.groupBy("ds", F.to_date("ts").alias("day")).agg(F.avg("v").alias("v"), F.count_distinct(slot).alias("n_slots"))
    return days.where(F.col("n_slots") == 24 // hours)


def ensemble_mean(fields: DataFrame, members: list[str]) -> DataFrame:
    """Mean over all members of each cell and pentad; missing if a member is. One aggregation, no join."""
    rows = fields.where(F.col("ds").isin(members))
    return rows.groupBy("pentadstamp", *CELL).agg(mean_of_all(F.col("v"), len(members)).alias("v"), F.count("v").alias("n"))


def season(fields: DataFrame, first: int, last: int, first_year: int, last_year: int) -> DataFrame:
    """Rows of pentads ``first``..``last`` of every year; a negative first reaches into the year before."""
    spark = fields.sparkSession
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("season_year"))
    base = F.col("season_year") * pentad.PENTADS
    wanted = years.select("season_year", F.explode(F.sequence(base + first, base + last)).alias("pentadstamp"))
    return fields.join(F.broadcast(wanted), "pentadstamp")  # a row a pentad of the window


def crop(fields: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells inside the box, both ends included."""
    return fields.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def stride(fields: DataFrame, n: int) -> DataFrame:
    return fields.where((F.pmod("lat_i", F.lit(n)) == 0) & (F.pmod("lon_i", F.lit(n)) == 0))


def to_kelvin(v: Column, varname: Column) -> Column:
    """Celsius to kelvin for temperatures, not for anomalies."""
    return F.when(varname == "sst", v + 273.15).otherwise(v)


def roll_longitude(axis: DataFrame) -> DataFrame:
    """lon, lon_wrapped, lon_i of an axis table: indices ascend with the wrapped longitude."""
    wrapped = axis.withColumn("lon_wrapped", wrap_longitude(F.col("lon")))
    at = F.row_number().over(Window.orderBy("lon_wrapped")) - 1  # an axis is as long as the grid is wide
    return wrapped.withColumn("lon_i", at.cast("int"))


def region_masks(cells: DataFrame, regions: list[tuple] = REGIONS) -> DataFrame:
    """region, lat_i, lon_i, mask: 1 where the cell lies in the box and has a value."""
    table = cells.sparkSession.createDataFrame(regions, REGION_SCHEMA)
    c = {k: F.round(k, 6) for k in ("lat", "lon")}
    inside = (c["lat"] > F.col("south")) & (c["lat"] <= F.col("north")) & (c["lon"] > F.col("west")) & (c["lon"] <= F.col("east"))
    rows = cells.crossJoin(F.broadcast(table))  # a handful of named boxes
    return rows.select("region", *CELL, (inside & F.col("v").isNotNull()).cast("int").alias("mask"))


def region_mean(fields: DataFrame, masks: DataFrame) -> DataFrame:
    """region, ds, pentadstamp, v, n over the cells whose mask is 1."""
    rows = fields.join(masks.where("mask = 1").select("region", *CELL), CELL)
    return rows.groupBy("region", "ds", "pentadstamp").agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def pairs(names: list[str], mode: str = "all") -> list[tuple[int, int]]:
    """Ordinals compared: ``ref`` the first with the rest, ``all`` i < j, ``grid`` every ordered pair."""
    n = len(names)
    return [
        (i, j)
        for i in range(n)
        for j in range(n)
        if (mode == "grid") or (i < j and (mode == "all" or i == 0))
    ]


def differences(fields: DataFrame, names: list[str], mode: str = "all") -> DataFrame:
    """i, j, pentadstamp, lat_i, lon_i, diff = v(j) - v(i) where both are there.

    One aggregation lines the members up in an array; pairs are read from it without a join.
    """
    lined = fields.where(F.col("ds").isin(names)).groupBy("pentadstamp", *CELL).agg(
        *[F.max(F.when(F.col("ds") == d, F.col("v"))).alias(f"_v{i}") for i, d in enumerate(names)]
    )
    made = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"_v{j}") - F.col(f"_v{i}")).alias("diff"))
        for i, j in pairs(names, mode)
    ]
    return lined.select("pentadstamp", *CELL, F.inline(F.array(*made))).where("diff IS NOT NULL")


def difference_stats(diff: DataFrame) -> DataFrame:
    return diff.groupBy("i", "j", *CELL).agg(F.avg("diff").alias("mean"), F.stddev_pop("diff").alias("std"))


def distances(fields: DataFrame, names: list[str]) -> DataFrame:
    """pentadstamp, ds1, ds2, dist2, msd: population variance and mean of squared differences over cells."""
    named = F.array(*[F.lit(n) for n in names])
    rows = differences(fields, names, "grid").withColumn("sq", F.col("diff") * F.col("diff"))
    return rows.groupBy("pentadstamp", named[F.col("i")].alias("ds1"), named[F.col("j")].alias("ds2")).agg(
        F.var_pop("sq").alias("dist2"), F.avg("sq").alias("msd")
    )


def distance_stats(dist: DataFrame) -> DataFrame:
    root = F.sqrt("dist2")
    return dist.groupBy("ds1", "ds2").agg(F.avg(root).alias("mean"), F.stddev_pop(root).alias("std"))


def axis_mean(fields: DataFrame, keep: str) -> DataFrame:
    """Unweighted mean over the other axis; ``keep`` is lat_i or lon_i."""
    return fields.groupBy("ds", "pentadstamp", F.col(keep).alias("axis_i")).agg(F.avg("v").alias("v"))


def chunks(stamps: DataFrame, size: int) -> DataFrame:
    """pentadstamp, chunk: runs of ``size`` from the first stamp on; an incomplete last run is left out."""
    ends = stamps.agg(F.min("pentadstamp").alias("a"), F.max("pentadstamp").alias("b"))
    rows = stamps.select("pentadstamp").distinct().crossJoin(F.broadcast(ends))  # one row
    chunk = F.floor((F.col("pentadstamp") - F.col("a")) / size)
    return rows.where(chunk < F.floor((F.col("b") - F.col("a") + 1) / size)).select("pentadstamp", chunk.cast("int").alias("chunk"))


def missing_days(days: DataFrame) -> DataFrame:
    """Days between the first and the last that are not there."""
    ends = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a IS NOT NULL")
    calendar = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d"))
    return calendar.join(days.select("d").distinct(), "d", "left_anti")


def aligned_pieces(begin: Column, end: Column, levels: int) -> Column:
    """The few aligned runs of 2 ** level numbers, as (level, place), that together are [begin, end)."""
    up = lambda x, k: F.ceil(x / F.pow(F.lit(2.0), k))
    down = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k))
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    run = lambda k, at, used: F.when(used, F.struct(k.alias("level"), at.cast("long").alias("place")))

    def of(k):
        low, high = up(begin, k), down(end, k)
        return F.array(run(k, low, odd(low) & (low < high)), run(k, high - 1, odd(high) & (low < high)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of)), lambda e: e.isNotNull())


def first_interval(points: DataFrame, spans: DataFrame, strict: bool = True) -> DataFrame:
    """Every point (d) with the first span (ord, name, beg, end) that holds it, days of both ends included.

    A span is cut into aligned runs of days, of which there are at most two of each length; of the
    spans with the same run only the first one counts.  A point looks its run of each length up by
    equality, so any number of spans, and of spans that hold a point, is joined by sorted keys and
    nothing is broadcast.  A point outside all spans is an error, or without ``strict`` has no name.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    longest = spans.agg(F.max(F.datediff("end", "beg")).alias("n")).first().n
    levels = max(int(longest or 0) + 1, 1).bit_length()
    cut = spans.select("ord", "name", F.explode(aligned_pieces(day(F.col("beg")), day(F.col("end")) + 1, levels)).alias("run"))
    first = cut.groupBy("run.level", "run.place").agg(F.min(F.struct("ord", "name")).alias("best"))
    wanted = points.select("d").distinct()
    runs = wanted.select("d", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("place", F.floor(day(F.col("d")) / F.pow(F.lit(2.0), "level")).cast("long"))
    found = runs.join(first, ["level", "place"]).groupBy("d").agg(F.min("best").alias("best"))
    found = wanted.join(found, "d", "left").select("d", F.col("best.name").alias("name"))
    if not strict:
        return found
    lost = F.raise_error(F.concat(F.lit("no span holds "), F.col("d").cast("string")))
    return found.withColumn("name", F.when(F.col("name").isNull(), lost.cast("string")).otherwise(F.col("name")))


def match_axes(ours: DataFrame, theirs: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """keys, ours_i, theirs_i, ours, theirs, finding: the coordinates of two sources' axes, compared.

    Both have keys (which axis), i and c.  Axes are sorted together and each coordinate looks at its
    neighbours; two that are each other's nearest, at most ``tolerance`` apart, are one coordinate.
    finding is ``same``, ``moved`` (not exactly equal), ``shifted`` (at another index), ``gap`` (ours
    alone) or ``extra`` (theirs alone).  Exact agreement is when every finding is ``same``.
    """
    tag = lambda df, own: df.select(*keys, F.col("i").cast("int").alias("i"), F.col("c").cast("double").alias("c"), F.lit(own).alias("own"))
    both = tag(ours, True).unionByName(tag(theirs, False))
    line = Window.partitionBy(*keys).orderBy("c", "i")  # an axis is as long as a grid is wide
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    here = F.struct("c", "i")
    other = lambda own: F.when(F.col("own") != F.lit(own), here)
    near = both.withColumns({
        "_low": F.when(F.col("own"), F.last(other(True), ignorenulls=True).over(before)).otherwise(F.last(other(False), ignorenulls=True).over(before)),
        "_high": F.when(F.col("own"), F.first(other(True), ignorenulls=True).over(after)).otherwise(F.first(other(False), ignorenulls=True).over(after)),
    })
    apart = lambda side: F.abs(F.col("c") - F.col(f"{side}.c"))
    nearest = F.when(F.col("_high").isNull() | (apart("_low") <= apart("_high")), F.col("_low")).otherwise(F.col("_high"))
    near = near.select(*keys, "i", "c", "own", nearest.alias("n")).withColumn("n", F.when(F.abs(F.col("c") - F.col("n.c")) <= tolerance, F.col("n")))
    a = near.where("own").select(*keys, F.col("i").alias("ours_i"), F.col("c").alias("ours"), F.col("n.i").alias("_to"))
    b = near.where("NOT own").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("theirs_i"), F.col("c").alias("theirs"), F.col("n.i").alias("_back"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_to") == F.col("theirs_i"), F.col("ours_i") == F.col("_back")]
    joined = a.join(b, on, "full")
    finding = (
        F.when(F.col("theirs_i").isNull(), "gap").when(F.col("ours_i").isNull(), "extra").when(F.col("ours_i") != F.col("theirs_i"), "shifted")
        .when(F.col("ours") != F.col("theirs"), "moved").otherwise("same")
    )
    return joined.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], "ours_i", "theirs_i", "ours", "theirs", finding.alias("finding"))


def index_range(axis: DataFrame, coordinate: str, index: str, low: float, high: float) -> DataFrame:
    """First and last index whose coordinate lies in [low, high]; null where none does.

    An axis whose coordinates do not rise strictly with the index is an error.
    """
    before = F.lag(coordinate).over(Window.orderBy(index))  # an axis is as long as the grid is wide
    falls = F.count_if(F.col("_before") >= F.col(coordinate)) > 0
    inside = F.when(F.col(coordinate).between(low, high), F.col(index))
    found = axis.withColumn("_before", before).agg(falls.alias("_falls"), F.min(inside).alias("first_i"), F.max(inside).alias("last_i"))
    wrong = F.raise_error(F.lit(f"{coordinate} does not rise strictly"))
    checked = lambda c: F.when(F.col("_falls"), wrong.cast("int")).otherwise(F.col(c)).alias(c)
    return found.select(checked("first_i"), checked("last_i"))


def index_box(cells: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """lat_first, lat_last, lon_first, lon_last: the index ranges of a box on both axes of ``cells``."""
    rows = index_range(cells.select("lat_i", "lat").distinct(), "lat", "lat_i", *lat).toDF("lat_first", "lat_last")
    columns = index_range(cells.select("lon_i", "lon").distinct(), "lon", "lon_i", *lon).toDF("lon_first", "lon_last")
    return rows.crossJoin(columns)  # one row each


def longitude_start(axes: DataFrame) -> DataFrame:
    """ds, start: index of the first longitude after the one break of each dataset's axis (ds, lon_i, lon).

    Longitudes are taken modulo 360; a step of more than 90 degrees to the next one (the last one's
    next is the first) is the break.  0 without a break; more than one is an error.
    """
    order = Window.partitionBy("ds").orderBy("lon_i")
    whole = Window.partitionBy("ds")
    wrapped = axes.withColumn("_lon", wrap_longitude(F.col("lon")))
    following = F.coalesce(F.lead("_lon").over(order), F.min_by("_lon", "lon_i").over(whole))
    rows = wrapped.withColumns({"_break": F.abs(following - F.col("_lon")) > 90, "_n": F.count("*").over(whole)})
    found = rows.groupBy("ds").agg(F.count_if("_break").alias("_breaks"), F.min(F.when(F.col("_break"), F.col("lon_i"))).alias("_at"), F.first("_n").alias("_n"))
    wrong = F.raise_error(F.concat(F.lit("more than one break of longitude in "), F.col("ds"))).cast("int")
    start = F.coalesce(F.pmod(F.col("_at") + 1, F.col("_n")), F.lit(0)).cast("int")
    return found.select("ds", F.when(F.col("_breaks") > 1, wrong).otherwise(start).alias("start"))


def rotated_index(i: Column, start: Column, n: int, offset: int = 0) -> Column:
    """Index on the stored axis of position ``i`` of an axis that starts ``start`` (and ``offset``) later."""
    return F.pmod(start + F.lit(offset) + i, F.lit(n)).cast("int")


def ascending_latitude(fields: DataFrame) -> DataFrame:
    """Datasets whose latitude falls with its index get the index turned round."""
    ends = fields.groupBy("ds").agg(
        F.min("lat_i").alias("_low"), F.max("lat_i").alias("_high"), F.min_by("lat", "lat_i").alias("_first"), F.max_by("lat", "lat_i").alias("_last")
    )
    turned = F.when(F.col("_first") > F.col("_last"), F.col("_low") + F.col("_high") - F.col("lat_i")).otherwise(F.col("lat_i"))
    rows = fields.join(ends, "ds")  # a row a dataset
    return rows.select(*[turned.alias(c) if c == "lat_i" else F.col(c) for c in fields.columns])


def surface(columns: DataFrame, varname: str) -> DataFrame:
    """The top level (k = 0) of a field with levels, its value named ``varname``."""
    return columns.where("k = 0").drop("k").withColumnRenamed("v", varname)


def select_stamps(fields: DataFrame, stamps: list[int]) -> DataFrame:
    """Rows of exactly these pentads; a pentad that no row has is an error."""
    wanted = fields.sparkSession.createDataFrame([(s,) for s in stamps], "pentadstamp int")
    rows = fields.join(F.broadcast(wanted), "pentadstamp", "left_semi")  # the caller's list
    lost = wanted.join(rows.select("pentadstamp").distinct(), "pentadstamp", "left_anti").take(5)
    if lost:
        raise KeyError(f"missing pentads: {sorted(r.pentadstamp for r in lost)}")
    return rows


def merge_variables(fields: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """keys and a column for each of ``names`` (values of ds): a full outer merge by one aggregation."""
    rows = fields.where(F.col("ds").isin(names))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("ds") == n, F.col("v"))).alias(n) for n in names])


def stack(slices: list[DataFrame]) -> DataFrame:
    """Rows of all slices one after the other, with ``part`` telling the slice; columns by name, absent ones null."""
    parts = [s.withColumn("part", F.lit(i)) for i, s in enumerate(slices)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def compress(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """``cells`` (lat_i, lon_i, ...) whose mask (lat_i, lon_i, mask) is 1."""
    return cells.join(mask.where("mask = 1").select(*CELL).distinct(), CELL, "left_semi")


def scatter(values: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lat_i, lon_i, v for every cell of ``grid`` and every combination of ``keys`` in ``values``; missing where there is none."""
    full = grid.select(*CELL).distinct().crossJoin(values.select(*keys).distinct())  # modes or the like: a short list beside the grid
    return full.join(values, [*keys, *CELL], "left").select(*keys, *CELL, "v")


def distance_text(stats: DataFrame) -> DataFrame:
    """ds1, ds2, text: ``mean ± deviation`` with two decimals."""
    return stats.select("ds1", "ds2", F.format_string("%.2f ± %.2f", "mean", "std").alias("text"))


def out_of_range(fields: DataFrame, low: float, high: float, ocean: Column | None = None) -> DataFrame:
    """ds, outside, finite, missing: counts over the ocean cells, or all cells without ``ocean``."""
    rows = fields if ocean is None else fields.where(ocean)
    return rows.groupBy("ds").agg(
        F.count_if((F.col("v") < low) | (F.col("v") > high)).alias("outside"),
        F.count("v").alias("finite"),
        F.count_if(F.col("v").isNull()).alias("missing"),
    )


def boxes(spark: SparkSession, lat: tuple[float, float], lon: tuple[float, float], n_lat: int, n_lon: int) -> DataFrame:
    """n, j, i, bounds and middles of equal boxes, numbered along longitude first."""
    d_lat, d_lon = (lat[1] - lat[0]) / n_lat, (lon[1] - lon[0]) / n_lon
    rows = spark.range(n_lat * n_lon).select(F.col("id").cast("int").alias("n"))
    rows = rows.select("n", F.floor(F.col("n") / n_lon).cast("int").alias("j"), F.pmod("n", F.lit(n_lon)).alias("i"))
    south, west = F.lit(lat[0]) + F.col("j") * d_lat, F.lit(lon[0]) + F.col("i") * d_lon
    return rows.select(
        "n", "j", "i", south.alias("south"), (south + d_lat).alias("north"), west.alias("west"), (west + d_lon).alias("east"),
        (south + d_lat / 2).alias("lat_mid"), wrap_longitude(west + d_lon / 2).alias("lon_mid"),
    )


def faces(field: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """side, k, at, v: the first and last rows and columns of each level as N, S, W and E faces."""
    sides = F.array_compact(
        F.array(
            F.when(F.col("lat_i") == 0, F.struct(F.lit("S").alias("side"), F.col("lon_i").alias("at"))),
            F.when(F.col("lat_i") == n_lat - 1, F.struct(F.lit("N").alias("side"), F.col("lon_i").alias("at"))),
            F.when(F.col("lon_i") == 0, F.struct(F.lit("W").alias("side"), F.col("lat_i").alias("at"))),
            F.when(F.col("lon_i") == n_lon - 1, F.struct(F.lit("E").alias("side"), F.col("lat_i").alias("at"))),
        )
    )
    return field.select("k", "v", F.inline(sides)).select("side", "k", "at", F.coalesce("v", F.lit(0.0)).alias("v"))
