"""DuckDB SQL of the registered queries, written from the operators' definitions."""

from __future__ import annotations

from tidegrid.operators.fields import REGIONS
from tidegrid.operators.grids import axis, gauss_kernel
from tidegrid.sources.tiers import PRODUCTS

NUDGE = 1.3e-8  # see catalogue._r

_CTES = {
    "obs": "SELECT l_returnflag AS ds, CAST(l_shipdate AS DATE) AS d, CAST(l_suppkey % 10 AS INTEGER) AS lat_i, CAST(l_linenumber AS INTEGER) AS lon_i, l_extendedprice::DOUBLE AS v FROM lineitem",
    "inyear": "SELECT *, CAST((dayofyear(d) - 1) // 5 AS INTEGER) AS p FROM obs WHERE dayofyear(d) <= 365",
    "pen": "SELECT ds, CAST(year(d) * 73 + p AS INTEGER) AS pentadstamp, lat_i, lon_i, avg(v) AS v, count(v) AS n FROM inyear GROUP BY ALL",
    "strict": "SELECT ds, CAST(year(d) * 73 + p AS INTEGER) AS pentadstamp FROM inyear GROUP BY ALL HAVING count(DISTINCT d) = 5",
    "clim": "SELECT ds, p AS lat_i, CAST(lat_i * 7 + lon_i - 1 AS INTEGER) AS lon_i, avg(v) AS v FROM inyear GROUP BY ds, p, lat_i * 7 + lon_i - 1",
    "dense": "SELECT n.ds AS ds, CAST(y.i AS INTEGER) AS lat_i, CAST(x.i AS INTEGER) AS lon_i, v FROM (VALUES ('A'), ('N'), ('R')) n(ds), range(73) y(i), range(70) x(i) LEFT JOIN clim c ON c.ds = n.ds AND c.lat_i = y.i AND c.lon_i = x.i",
    "ev": "SELECT event_type AS ds, ts, value::DOUBLE AS v FROM events",
    "vec": "SELECT vec_id AS t, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "det": "SELECT t, x, v - (regr_slope(v, x) OVER (PARTITION BY t) * x + regr_intercept(v, x) OVER (PARTITION BY t)) AS v_detrended, v - regr_intercept(v, x) OVER (PARTITION BY t) AS v_minus_intercept FROM vec",
    "spec": "SELECT t, CAST(k AS INTEGER) AS k, sum(v_detrended * cos(2 * pi() * ((k * x) % 64) / 64)) / 64 AS re, -sum(v_detrended * sin(2 * pi() * ((k * x) % 64) / 64)) / 64 AS im FROM det, range(32) r(k) GROUP BY ALL",
    "amp": "SELECT *, sqrt(re * re + im * im) AS radius FROM spec",
    "levels": "SELECT n.ds AS ds, CAST(z.i AS INTEGER) AS k, CAST(y.i AS INTEGER) AS lat_i, CAST(x.i AS INTEGER) AS lon_i, CASE WHEN m.v >= 36000 THEN m.v END AS v FROM (VALUES ('A'), ('N'), ('R')) n(ds), range(7) z(i), range(10) y(i), range(7) x(i) "
    "LEFT JOIN (SELECT ds, year(d) - 1995 AS k, lat_i, lon_i - 1 AS lon_i, avg(v) AS v FROM obs GROUP BY ALL) m ON m.ds = n.ds AND m.k = z.i AND m.lat_i = y.i AND m.lon_i = x.i",
    "snap": "SELECT CAST(t // 10 AS INTEGER) AS t, k, avg(radius) AS radius FROM amp WHERE t // 10 < ((SELECT max(t) FROM amp) + 1) // 10 GROUP BY ALL",
    "lab": "SELECT CAST(vec_id // 50 AS INTEGER) AS chunk, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "cmean": "SELECT chunk, label, x, avg(v) AS v FROM lab GROUP BY ALL",
    "cdiff": "SELECT CAST(a.chunk * 100 + a.label AS INTEGER) AS t, a.x, a.v - b.v AS v FROM cmean a JOIN cmean b ON b.chunk = a.chunk AND b.x = a.x AND b.label = 0 WHERE a.label > 0",
    "yearly": "SELECT ds, CAST(year(d) AS INTEGER) AS yr, lat_i, lon_i, avg(v) AS v FROM obs GROUP BY ALL",
    "stamps": "SELECT yr, row_number() OVER (ORDER BY yr) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT yr FROM yearly) q",
    "pdiff": "SELECT CAST(CASE WHEN a.ds = 'A' AND b.ds = 'N' THEN 0 WHEN a.ds = 'A' THEN 1 ELSE 2 END * n + rank AS INTEGER) AS sample, a.lat_i, a.lon_i, b.v - a.v AS v "
    "FROM yearly a JOIN yearly b ON b.yr = a.yr AND b.lat_i = a.lat_i AND b.lon_i = a.lon_i AND b.ds > a.ds JOIN stamps s ON s.yr = a.yr",
    "stacked": "SELECT s.sample, c.lat_i, c.lon_i, avg(d.v) AS v FROM (SELECT DISTINCT sample FROM pdiff) s, (SELECT DISTINCT lat_i, lon_i FROM yearly) c "
    "JOIN pdiff d ON d.sample = s.sample AND abs(d.lat_i - c.lat_i) <= 1 AND abs(d.lon_i - c.lon_i) <= 1 GROUP BY ALL",
    "whole": "SELECT lat_i, lon_i, avg(v) AS mean, stddev_pop(v) AS std FROM stacked GROUP BY ALL HAVING count(v) = (SELECT 3 * max(n) FROM stamps)",
    "panom": "SELECT sample, s.lat_i, s.lon_i, v - mean AS v FROM stacked s JOIN whole w ON w.lat_i = s.lat_i AND w.lon_i = s.lon_i WHERE s.lon_i <= 5",
    "pgram": "SELECT a.sample AS s, b.sample AS t, sum(a.v * b.v) AS g FROM panom a JOIN panom b ON b.lat_i = a.lat_i AND b.lon_i = a.lon_i GROUP BY ALL",
    "anom": "SELECT t AS cell, x AS sample, v - avg(v) OVER (PARTITION BY t) AS v FROM vec",
}
_NEEDS = {"inyear": ["obs"], "pen": ["inyear"], "strict": ["inyear"], "clim": ["inyear"], "dense": ["clim"], "det": ["vec"], "spec": ["det"], "amp": ["spec"], "anom": ["vec"], "levels": ["obs"], "snap": ["amp"], "cmean": ["lab"], "cdiff": ["cmean"], "yearly": ["obs"], "stamps": ["yearly"], "pdiff": ["yearly", "stamps"], "stacked": ["pdiff"], "whole": ["stacked", "stamps"], "panom": ["whole"], "pgram": ["panom"]}


def _with(*names: str, body: str, more: str = "") -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({_CTES[n]})" for n in order] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _r(expression: str, name: str = "") -> str:
    return f"round({expression} + {NUDGE!r}::DOUBLE, 6) + 0.0 AS {name or expression}"


_LABEL = "printf('%04dP%02d', CAST(floor({0} / 73.0) AS INTEGER), CAST((({0} % 73) + 73) % 73 AS INTEGER))"
_BEGIN = "make_date(CAST(floor({0} / 73.0) AS INTEGER), 1, 1) + CAST(5 * ({0} % 73) AS INTEGER)"


def _range(after: int, before: int) -> str:
    return (
        "WITH o AS (SELECT DISTINCT CAST(year(o_orderdate) * 73 + o_orderkey % 73 - 6 AS INTEGER) AS a, CAST(year(o_orderdate) * 73 + o_orderkey % 73 - 6 + o_orderkey % 13 AS INTEGER) AS b FROM orders) "
        f"SELECT a, b, CAST(s AS INTEGER) AS pentadstamp, {_LABEL.format('s')} AS label FROM o, LATERAL (SELECT unnest(range(a + {after}, b - {before} + 1)) AS s) q"
    )


_SIDES = "a.lat_i = b.lat_i AND a.lon_i = b.lon_i AND a.pentadstamp = b.pentadstamp"
_RANKED = "named(ord, ds) AS (VALUES (0, 'A'), (1, 'N'), (2, 'R'))"


def _diff(condition: str, tier: str = "pen", stamp: str = "a.pentadstamp") -> str:
    sides = _SIDES if tier == "pen" else "a.lat_i = b.lat_i AND a.lon_i = b.lon_i"
    return (
        f"{_RANKED}, diff AS (SELECT na.ord AS i, nb.ord AS j, na.ds AS ds1, nb.ds AS ds2, {stamp} AS pentadstamp, a.lat_i, a.lon_i, b.v - a.v AS diff "
        f"FROM {tier} a JOIN named na ON na.ds = a.ds JOIN {tier} b ON {sides} JOIN named nb ON nb.ds = b.ds WHERE {condition})"
    )


_DIST = "dist AS (SELECT pentadstamp, ds1, ds2, var_pop(diff * diff) AS dist2, avg(diff * diff) AS msd FROM diff GROUP BY ALL)"
_REGIONS = "regions(region, south, north, west, east) AS (VALUES " + ", ".join(str(r) for r in REGIONS) + ")"
_MASKS = (
    _REGIONS + ", masks AS (SELECT region, lat_i, lon_i, CAST(lat_i > south AND lat_i <= north AND 120 + 2 * lon_i > west "
    "AND 120 + 2 * lon_i <= east AND v IS NOT NULL AS INTEGER) AS mask FROM dense, regions WHERE ds = 'A')"
)


def _axis(name: str, target: list[float], size: int) -> str:
    points = ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(target))
    return (
        f"{name}_p(t, x) AS (VALUES {points}), {name}_w AS (SELECT t, s, w FROM (SELECT CAST(t AS INTEGER) AS t, CAST(s AS INTEGER) AS s, 1 - abs(x - s) AS w "
        f"FROM {name}_p, range({size}) r(s) WHERE x BETWEEN 0 AND {size - 1}) WHERE w > 1e-9)"
    )


_LATS, _LONS = axis(0.0, 72.5, 1.5), axis(0.5, 69.5, 0.7)


def _sweep(source: str, name: str, ocean: str = "TRUE", keys: str = "ds", n_lat: int = 73, n_lon: int = 70) -> str:
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return (
        f"{name} AS MATERIALIZED (SELECT {own}, a.lat_i, a.lon_i, CASE WHEN a.v IS NULL AND {ocean} THEN avg(b.v) ELSE a.v END AS v FROM {source} a LEFT JOIN (VALUES (1, 0), ({n_lat - 1}, 0), (0, 1), (0, {n_lon - 1})) o(di, dj) ON TRUE "
        f"LEFT JOIN {source} b ON {same} AND b.lat_i = (a.lat_i + di) % {n_lat} AND b.lon_i = (a.lon_i + dj) % {n_lon} GROUP BY {own}, a.lat_i, a.lon_i, a.v)"
    )


_OCEAN = "(a.lat_i * 7 + a.lon_i) % 11 <> 0"
_FLOOD = ", ".join(_sweep("dense" if i == 0 else f"f{i}", f"f{i + 1}", _OCEAN) for i in range(10))
_LEVEL_FLOOD = ", ".join(_sweep("levels" if i == 0 else f"g{i}", f"g{i + 1}", "TRUE", "ds, k", 10, 7) for i in range(3))


def _down(source: str) -> str:
    """Columns of ``source`` (ds, k, lat_i, lon_i) carried down from the level above the first gap."""
    return (
        f"gaps AS (SELECT ds, lat_i, lon_i, min(k) AS g FROM {source} WHERE v IS NULL GROUP BY ALL), "
        f"down AS MATERIALIZED (SELECT c.ds, c.k, c.lat_i, c.lon_i, CASE WHEN g > 0 AND c.k >= g THEN u.v ELSE c.v END AS v FROM {source} c "
        "LEFT JOIN gaps q ON q.ds = c.ds AND q.lat_i = c.lat_i AND q.lon_i = c.lon_i "
        f"LEFT JOIN {source} u ON u.ds = c.ds AND u.lat_i = c.lat_i AND u.lon_i = c.lon_i AND u.k = q.g - 1)"
    )


def _weights(name: str, target: list[float], size: int) -> str:
    """Weights of clamped targets on an axis 0, 1, .. size - 1."""
    points = ", ".join(f"({i}, {min(max(x, 0.0), size - 1.0)!r}::DOUBLE)" for i, x in enumerate(target))
    return (
        f"{name}_p(t, x) AS (VALUES {points}), {name}_w AS (SELECT t, s, w FROM (SELECT CAST(t AS INTEGER) AS t, CAST(s AS INTEGER) AS s, 1 - abs(x - s) AS w "
        f"FROM {name}_p, range({size}) r(s)) WHERE w > 1e-9)"
    )


_Z_TARGET, _Y_TARGET, _X_TARGET = [0.5, 2.25, 5.5, 6.0], axis(-0.75, 10.0, 0.7), axis(-0.4, 6.9, 0.6)
_ZYX = ", ".join((_weights("z", _Z_TARGET, 7), _weights("y", _Y_TARGET, 10), _weights("x", _X_TARGET, 7)))
_UPRIGHT = "upright AS MATERIALIZED (SELECT ds, t AS k, lat_i, lon_i, CASE WHEN count(v) = count(*) THEN sum(w * v) END AS v FROM down JOIN z_w ON s = k GROUP BY ALL)"
_LEVEL_SQL = "SELECT ds, k, y.t AS lat_i, x.t AS lon_i, CASE WHEN count(v) = count(*) THEN sum(y.w * x.w * v) END AS v FROM {0} JOIN y_w y ON y.s = lat_i JOIN x_w x ON x.s = lon_i GROUP BY ALL"
_DFT = "SELECT t, CAST(k AS INTEGER) AS k, sum(v * cos(2 * pi() * ((k * x) % 64) / 64)) / 64 AS re, sum(v * sin(2 * pi() * ((k * x) % 64) / 64)) / 64 AS im FROM {0}, range(32) r(k) GROUP BY ALL"
_LINE_OFF = "SELECT t, x, v - (regr_slope(v, x) OVER (PARTITION BY t) * x + regr_intercept(v, x) OVER (PARTITION BY t)) AS v FROM {0}"
_SHARES = f"{_r('radius * radius / sum(radius * radius) OVER (PARTITION BY t)', 'frac')}, {_r('CASE WHEN radius > 0 THEN ln(radius) END', 'log_amp')}"
_PRODUCTS = "products(dataset, timestr, suffix) AS (VALUES " + ", ".join(str(p) for p in PRODUCTS) + ")"
_STORED_LON = "(CASE WHEN ds = 'N' AND lon >= 180 THEN lon - 360 ELSE lon END)"


_KERNEL = ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for (i, j), w in gauss_kernel(2, 1.0).items())
_PEN_OUT = f"SELECT ds, pentadstamp, lat_i, lon_i, {_r('v')}, n FROM pen"

ORACLES = {
    "pentad_assign": _with("inyear", more="days AS (SELECT DISTINCT d, CAST(year(d) * 73 + p AS INTEGER) AS pentadstamp FROM inyear)",
        body=f"SELECT d, pentadstamp, {_LABEL.format('pentadstamp')} AS label, CAST({_BEGIN.format('pentadstamp')} AS DATE) AS time_beg, CAST({_BEGIN.format('pentadstamp')} + 5 AS DATE) AS time_end FROM days"),
    "pentad_parse": "WITH t AS (SELECT DISTINCT year(o_orderdate) AS y, CAST(o_orderkey % 200 - 100 AS INTEGER) AS p FROM orders), s AS (SELECT y || 'P' || p AS text, CAST(y * 73 + p AS INTEGER) AS pentadstamp FROM t) "
        f"SELECT text, pentadstamp, {_LABEL.format('pentadstamp')} AS label FROM s",
    "pentad_range_left": _range(0, 1),
    "pentad_range_right": _range(1, 0),
    "pentad_range_both": _range(0, 0),
    "pentad_range_neither": _range(1, 1),
    "pentad_mean": _with("pen", body=_PEN_OUT),
    "pentad_mean_strict_days": _with("pen", "strict", body=_PEN_OUT + " SEMI JOIN strict USING (ds, pentadstamp)"),
    "pentad_stream": _with("pen", body=_PEN_OUT),
    "daily_mean_6h": _with("ev", body=f"SELECT ds, CAST(ts AS DATE) AS day, {_r('avg(v)', 'v')}, count(DISTINCT hour(ts) // 6) AS n_slots FROM ev GROUP BY ALL HAVING n_slots = 4"),
    "hours_epoch": "WITH t AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events) SELECT date_diff('hour', TIMESTAMP '2000-01-01', t) AS hours, CAST(t AS DATE) AS day, CAST(hour(t) AS INTEGER) AS hour FROM t",
    "month_filter": _with("obs", body="SELECT ds, CAST(month(d) AS INTEGER) AS month, count(*) AS n FROM obs WHERE month(d) IN (10, 11, 12, 1, 2, 3, 4) GROUP BY ALL"),
    "season_select": _with("pen", body=f"SELECT CAST(y AS INTEGER) AS season_year, ds, pentadstamp, lat_i, lon_i, {_r('v')} FROM pen, range(1996, 2001) r(y) WHERE pentadstamp BETWEEN y * 73 - 6 AND y * 73 + 11"),
    "ensemble_mean": _with("pen", body=f"SELECT pentadstamp, lat_i, lon_i, {_r('CASE WHEN count(v) = 3 THEN sum(v) / 3 END', 'v')}, count(v) AS n FROM pen GROUP BY ALL"),
    "crop_box": _with("clim", body=f"SELECT ds, lat_i::DOUBLE AS lat, 120.0::DOUBLE + 2 * lon_i AS lon, {_r('v')} FROM clim WHERE lat_i BETWEEN 10 AND 40 AND 120 + 2 * lon_i BETWEEN 150 AND 220"),
    "lon_wrap_roll": _with("clim", more="a AS (SELECT DISTINCT (lon_i * 5.0 - 175.0)::DOUBLE AS lon FROM clim), w AS (SELECT lon, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon_wrapped FROM a)", body="SELECT lon, lon_wrapped, CAST(row_number() OVER (ORDER BY lon_wrapped) - 1 AS INTEGER) AS lon_i FROM w"),
    "stride": _with("clim", body=f"SELECT ds, lat_i, lon_i, {_r('v')} FROM clim WHERE lat_i % 4 = 0 AND lon_i % 4 = 0"),
    "unit_convert": _with("clim", body="SELECT CASE WHEN ds = 'A' THEN 'sst' ELSE 'ssta' END AS varname, ds, lat_i, lon_i, " + _r("CASE WHEN ds = 'A' THEN v + 273.15 ELSE v END", "v") + " FROM clim"),
    "region_mask": _with("dense", more=_MASKS, body="SELECT region, lat_i, lon_i, mask FROM masks"),
    "region_mean": _with("dense", more=_MASKS, body=f"SELECT region, ds, c.lat_i AS pentadstamp, {_r('avg(v)', 'v')}, count(v) AS n FROM clim c JOIN masks m ON m.lat_i = c.lat_i AND m.lon_i = c.lon_i WHERE mask = 1 GROUP BY ALL"),
    "pair_diff_ref": _with("pen", more=_diff("na.ord = 0 AND nb.ord > 0"), body=f"SELECT i, j, pentadstamp, lat_i, lon_i, {_r('diff')} FROM diff"),
    "pair_diff_all": _with("pen", more=_diff("na.ord < nb.ord"), body=f"SELECT i, j, pentadstamp, lat_i, lon_i, {_r('diff')} FROM diff"),
    "diff_stats": _with("pen", more=_diff("na.ord < nb.ord"), body=f"SELECT i, j, lat_i, lon_i, {_r('avg(diff)', 'mean')}, {_r('stddev_pop(diff)', 'std')} FROM diff GROUP BY ALL"),
    "dist2_matrix": _with("clim", more=_diff("TRUE", "clim", "0") + ", " + _DIST, body=f"SELECT pentadstamp, ds1, ds2, {_r('dist2 / 1e12', 'dist2')}, {_r('msd / 1e6', 'msd')} FROM dist"),
    "dist_stats": _with("pen", more=_diff("TRUE") + ", " + _DIST, body=f"SELECT ds1, ds2, {_r('avg(sqrt(dist2)) / 1e6', 'mean')}, {_r('stddev_pop(sqrt(dist2)) / 1e6', 'std')} FROM dist GROUP BY ALL"),
    "zonal_mean": _with("pen", body=f"SELECT ds, pentadstamp, lat_i AS axis_i, {_r('avg(v)', 'v')} FROM pen GROUP BY ALL"),
    "meridional_mean": _with("pen", body=f"SELECT ds, pentadstamp, lon_i AS axis_i, {_r('avg(v)', 'v')} FROM pen GROUP BY ALL"),
    "chunk_mean": _with("pen", more="e AS (SELECT min(pentadstamp) AS a, max(pentadstamp) AS b FROM pen)",
        body=f"SELECT ds, CAST((pentadstamp - a) // 6 AS INTEGER) AS chunk, lat_i, lon_i, {_r('avg(v)', 'v')}, count(v) AS n FROM pen, e WHERE (pentadstamp - a) // 6 < (b - a + 1) // 6 GROUP BY ALL"),
    "calendar_gaps": _with("obs", more="own AS (SELECT d FROM obs WHERE ds = 'A' AND lon_i = 7)", body="SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM own) c WHERE CAST(d AS DATE) NOT IN (SELECT d FROM own)"),
    "interval_lookup": _with("obs", body="SELECT DISTINCT d, CASE WHEN d BETWEEN DATE '1995-01-01' AND DATE '1997-06-30' THEN 'early' WHEN d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' THEN 'middle' ELSE 'late' END AS name FROM obs WHERE d BETWEEN DATE '1995-01-01' AND DATE '2002-12-31'"),
    "index_range": _with("clim", body="SELECT min(lon_i) AS first_i, max(lon_i) AS last_i FROM clim WHERE 120 + 2 * lon_i BETWEEN 150 AND 201"),
    "range_check": _with("dense", body="SELECT ds, count(*) FILTER (v < 20000 OR v > 60000) AS outside, count(v) AS finite, count(*) FILTER (v IS NULL) AS missing FROM dense GROUP BY ds"),
    "strict_stats": _with("dense", body=f"SELECT lat_i, lon_i, {_r('CASE WHEN count(v) = count(*) THEN avg(v) END', 'mean')}, {_r('CASE WHEN count(v) = count(*) THEN stddev_pop(v) END', 'std')} FROM dense GROUP BY ALL"),
    "pretty_places": _with("clim", more="p AS (SELECT DISTINCT lat_i, lon_i, (140 + 2 * lon_i) % 360 AS e FROM clim)",
        body="SELECT lat_i::DOUBLE AS lat, 120.0::DOUBLE + 2 * lon_i AS lon, lat_i || CASE WHEN lat_i > 0 THEN 'N' ELSE '' END AS lat_text, lat_i || CASE WHEN lat_i > 0 THEN 'N' ELSE 'E' END AS lat_zero_text, CASE WHEN e > 180 THEN (360 - e) || 'W' WHEN e IN (0, 180) THEN '' || e ELSE e || 'E' END AS lon_text FROM p"),
    "box_division": _with("clim", more="e AS (SELECT min(lat_i)::DOUBLE AS s, (max(lat_i) - min(lat_i)) / 4.0::DOUBLE AS dy, 120 + 2.0::DOUBLE * min(lon_i) AS w, (max(lon_i) - min(lon_i)) * 2.0::DOUBLE / 5 AS dx FROM clim), b AS (SELECT CAST(n AS INTEGER) AS n, CAST(n // 5 AS INTEGER) AS j, CAST(n % 5 AS INTEGER) AS i FROM range(20) r(n))",
        body=f"SELECT n, j, i, {_r('s + j * dy', 'south')}, {_r('s + j * dy + dy', 'north')}, {_r('w + i * dx', 'west')}, {_r('w + i * dx + dx', 'east')}, {_r('s + j * dy + dy / 2', 'lat_mid')}, {_r('w + i * dx + dx / 2', 'lon_mid')} FROM b, e"),
    "detrend": _with("det", body=f"SELECT t, x, {_r('v_detrended')}, {_r('v_minus_intercept')} FROM det"),
    "dft": _with("amp", body=f"SELECT t, k, {_r('re')}, {_r('im')}, {_r('radius')}, {_r('CASE WHEN radius > 1e-9 THEN atan2(im, re) END', 'phase')}, {_r('CASE WHEN k > 0 THEN 64.0::DOUBLE / k END', 'wvlen')} FROM amp"),
    "variance_fraction": _with("amp", body=f"SELECT t, k, {_r('radius * radius / sum(radius * radius) OVER (PARTITION BY t)', 'frac')}, {_r('CASE WHEN radius > 0 THEN ln(radius) END', 'log_amp')} FROM amp WHERE k > 3"),
    "band_variance": _with("amp", more="g AS (SELECT t, CASE WHEN 64.0 / k < 2 THEN '0-2' WHEN 64.0 / k < 5 THEN '2-5' WHEN 64.0 / k < 360 THEN '5-360' ELSE 'no_group' END AS band, sum(radius * radius) AS p FROM amp WHERE k > 0 GROUP BY ALL)",
        body=f"SELECT t, band, {_r('p / sum(p) OVER (PARTITION BY t)', 'frac')} FROM g"),
    "spectrum_diff": _with("vec", more="d AS (SELECT a.t, a.x, a.v - b.v AS v FROM vec a JOIN vec b ON a.t = b.t + 1 AND a.x = b.x), f AS (SELECT t, CAST(k AS INTEGER) AS k, sum(v * cos(2 * pi() * ((k * x) % 64) / 64)) / 64 AS re, sum(v * sin(2 * pi() * ((k * x) % 64) / 64)) / 64 AS im FROM d, range(32) r(k) GROUP BY ALL)",
        body=f"SELECT t, k, {_r('sqrt(re * re + im * im)', 'radius')} FROM f"),
    "spectrum_diff_detrended": _with("vec", more="g AS (SELECT t, x, CASE WHEN x >= t % 5 AND x < 64 - t % 3 THEN v END AS v FROM vec), d AS (SELECT a.t, a.x, a.v - b.v AS v FROM g a JOIN g b ON a.t = b.t + 1 AND a.x = b.x), e AS (SELECT t, min(x) AS lo, max(x) AS hi, arg_min(v, x) AS v_lo, arg_max(v, x) AS v_hi FROM d WHERE v IS NOT NULL GROUP BY t), w AS (SELECT t, x, CASE WHEN x < lo THEN v_lo WHEN x > hi THEN v_hi ELSE v END AS v FROM d JOIN e USING (t)), l AS (SELECT t, x, v - (regr_slope(v, x) OVER (PARTITION BY t) * x + regr_intercept(v, x) OVER (PARTITION BY t)) AS v FROM w), f AS (SELECT t, CAST(k AS INTEGER) AS k, sum(v * cos(2 * pi() * ((k * x) % 64) / 64)) / 64 AS re, sum(v * sin(2 * pi() * ((k * x) % 64) / 64)) / 64 AS im FROM l, range(32) r(k) GROUP BY ALL)",
        body=f"SELECT t, k, {_r('sqrt(re * re + im * im)', 'radius')} FROM f"),
    "gradient": _with("vec", body=f"SELECT a.t, {_r('a.x + 0.5::DOUBLE', 'x_mid')}, {_r('b.v - a.v', 'g')} FROM vec a JOIN vec b ON b.t = a.t AND b.x = a.x + 1"),
    "gradient_hist": _with("vec", body="SELECT CAST(floor((b.v - a.v) / 0.1::DOUBLE) AS INTEGER) AS bin, count(*) AS n FROM vec a JOIN vec b ON b.t = a.t AND b.x = a.x + 1 GROUP BY ALL"),
    "faketail": _with("vec", more="m AS (SELECT t, x, CASE WHEN abs(v) > 0.05::DOUBLE THEN v END AS v FROM vec), e AS (SELECT t, min(x) AS a, max(x) AS b, arg_min(v, x) AS va, arg_max(v, x) AS vb FROM m WHERE v IS NOT NULL GROUP BY t)",
        body=f"SELECT m.t, m.x, {_r('CASE WHEN m.x < a THEN va WHEN m.x > b THEN vb ELSE m.v END', 'v')} FROM m LEFT JOIN e ON e.t = m.t"),
    "regrid_bilinear": _with("dense", more=_axis("lat", _LATS, 73) + ", " + _axis("lon", _LONS, 70),
        body=f"SELECT ds, y.t AS lat_i, x.t AS lon_i, {_r('CASE WHEN count(v) = count(*) THEN sum(y.w * x.w * v) END', 'v')} FROM dense JOIN lat_w y ON y.s = lat_i JOIN lon_w x ON x.s = lon_i GROUP BY ALL"),
    "interp_1d": _with("clim", more=_axis("x", _LONS, 70) + ", m AS (SELECT ds, lon_i, avg(v) AS v FROM clim GROUP BY ALL)",
        body=f"SELECT ds, t AS axis_i, {_r('CASE WHEN sum(w) > 1 - 1e-6 THEN sum(w * v) END', 'v')} FROM m JOIN x_w ON s = lon_i GROUP BY ALL"),
    "box_filter": _with("dense", body=f"SELECT a.ds, a.lat_i, a.lon_i, {_r('avg(b.v)', 'v')} FROM dense a, range(-2, 3) i(di), range(-2, 3) j(dj) LEFT JOIN dense b ON b.ds = a.ds AND b.lat_i = a.lat_i + di AND b.lon_i = a.lon_i + dj GROUP BY ALL"),
    "gauss_filter": _with("dense", more=f"kernel(di, dj, w) AS (VALUES {_KERNEL})",
        body=f"SELECT a.ds, a.lat_i, a.lon_i, {_r('sum(w * b.v) / sum(w) FILTER (b.v IS NOT NULL)', 'v')} FROM dense a, kernel LEFT JOIN dense b ON b.ds = a.ds AND b.lat_i = a.lat_i + di AND b.lon_i = a.lon_i + dj GROUP BY ALL"),
    "eof_gram": _with("anom", body=f"SELECT a.sample AS s, b.sample AS t, {_r('sum(a.v * b.v)', 'g')} FROM anom a JOIN anom b ON b.cell = a.cell AND b.sample >= a.sample GROUP BY ALL"),
    "eof_variance_total": _with("anom", body=f"SELECT {_r('sum(v * v) / 63', 'variance')} FROM anom"),
    "eof_signs": _with("vec", body="SELECT t, CAST(CASE WHEN count(*) FILTER (v < 0) > count(*) FILTER (v >= 0) THEN -1 ELSE 1 END AS INTEGER) AS sign FROM vec GROUP BY t"),
    "down_fill": _with("pen", more="keys AS (SELECT DISTINCT ds, pentadstamp, lat_i FROM pen), col AS (SELECT y.ds, y.pentadstamp, y.lat_i, CAST(l AS INTEGER) AS k, v FROM keys y, range(7) r(l) LEFT JOIN pen p ON p.ds = y.ds AND p.pentadstamp = y.pentadstamp AND p.lat_i = y.lat_i AND p.lon_i = l + 1), "
        "gap AS (SELECT ds, pentadstamp, lat_i, min(k) AS g FROM col WHERE v IS NULL GROUP BY ALL)",
        body=f"SELECT c.ds, c.pentadstamp, c.lat_i, c.k, {_r('CASE WHEN g > 0 AND c.k >= g THEN u.v ELSE c.v END', 'v')} FROM col c LEFT JOIN gap ON gap.ds = c.ds AND gap.pentadstamp = c.pentadstamp AND gap.lat_i = c.lat_i LEFT JOIN col u ON u.ds = c.ds AND u.pentadstamp = c.pentadstamp AND u.lat_i = c.lat_i AND u.k = g - 1"),
    "flood_fill": _with("dense", more=_FLOOD, body=f"SELECT ds, lat_i, lon_i, {_r('v')} FROM f10"),
    "flood_fill_tiles": _with("dense", more=_FLOOD, body=f"SELECT ds, lat_i, lon_i, {_r('v')} FROM f10"),
    "autocorr": _with("ev", more="n AS (SELECT ds, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, count(*)::DOUBLE AS v FROM ev GROUP BY ALL), u AS (SELECT ds, t, v / sqrt(sum(v * v) OVER (PARTITION BY ds)) AS u FROM n)",
        body=f"SELECT a.ds AS s, CAST(b.t - a.t AS INTEGER) AS lag, {_r('sum(a.u * b.u)', 'c')} FROM u a JOIN u b ON a.ds = b.ds AND b.t - a.t BETWEEN 0 AND 10 GROUP BY ALL"),
    "boundary_faces": _with("pen", more="y AS (SELECT CAST(floor(pentadstamp / 73.0) AS INTEGER) AS k, lat_i, lon_i - 1 AS lon_i, avg(v) AS v FROM pen GROUP BY ALL)",
        body=" UNION ALL ".join(f"SELECT '{s}' AS side, k, {at} AS at, {_r('v')} FROM y WHERE {c}" for s, at, c in (("S", "lon_i", "lat_i = 0"), ("N", "lon_i", "lat_i = 9"), ("W", "lat_i", "lon_i = 0"), ("E", "lat_i", "lon_i = 6")))),
    "detect_work": _with("pen", "strict", body="SELECT DISTINCT ds, pentadstamp FROM pen ANTI JOIN strict USING (ds, pentadstamp)"),
    "pentad_arithmetic": "WITH o AS (SELECT o_orderkey AS key, year(o_orderdate) AS y, CAST(o_orderkey % 200 - 100 AS INTEGER) AS p FROM orders), "
        "t AS (SELECT DISTINCT CAST(y * 73 + p AS INTEGER) AS a, CAST(1998 * 73 + CASE WHEN p > 0 THEN p ELSE 0 END AS INTEGER) AS b, CAST(CASE WHEN key % 5 > 0 THEN key % 7 - 3 ELSE 0 END * 73 + p AS INTEGER) AS span FROM o) "
        "SELECT a, b, span, a + span AS later, a - span AS earlier, a - b AS apart, span + span AS twice, a < b AS lt, a <= b AS le, a = b AS eq, a <> b AS ne, a >= b AS ge, a > b AS gt, span < 73 AS short FROM t",
    "flip_latitude": _with("clim", body=f"SELECT ds, CAST(CASE WHEN ds = 'A' THEN lo + hi - lat_i ELSE lat_i END AS INTEGER) AS lat_i, lon_i, CASE WHEN ds = 'A' THEN 72 - lat_i ELSE lat_i END::DOUBLE AS lat, {_r('v')} FROM (SELECT *, min(lat_i) OVER (PARTITION BY ds) AS lo, max(lat_i) OVER (PARTITION BY ds) AS hi FROM clim)"),
    "index_box": "SELECT CAST(10 AS INTEGER) AS lat_first, CAST(40 AS INTEGER) AS lat_last, CAST(min(i) AS INTEGER) AS lon_first, CAST(max(i) AS INTEGER) AS lon_last FROM range(70) r(i) WHERE 120 + 2 * i BETWEEN 150 AND 201",
    "rotated_axis": _with("clim", more="ax AS (SELECT DISTINCT ds, lon_i, fmod(lon_i * (360.0::DOUBLE / 70) + CASE ds WHEN 'A' THEN 0.0::DOUBLE WHEN 'N' THEN 180.0 ELSE 30 * (360.0::DOUBLE / 70) END, 360.0::DOUBLE) AS lon FROM clim), "
        "nx AS (SELECT a.ds, a.lon_i FROM ax a JOIN ax b ON b.ds = a.ds AND b.lon_i = (a.lon_i + 1) % 70 WHERE abs(b.lon - a.lon) > 90), "
        "st AS (SELECT n.ds, CAST(coalesce((x.lon_i + 1) % 70, 0) AS INTEGER) AS start FROM (SELECT DISTINCT ds FROM ax) n LEFT JOIN nx x ON x.ds = n.ds), "
        "spots AS (SELECT ds, CAST(i AS INTEGER) AS i, start, CAST((start + 3 + i) % 70 AS INTEGER) AS lon_i FROM st, range(10) r(i))",
        body=f"SELECT ds, i, start, lon_i, {_r(_STORED_LON, 'lon')} FROM spots JOIN ax USING (ds, lon_i)"),
    "surface_level": _with("pen", more="keys AS (SELECT DISTINCT ds, pentadstamp, lat_i FROM pen)", body=f"SELECT y.ds, y.pentadstamp, y.lat_i, {_r('v', 'sst')} FROM keys y LEFT JOIN pen p ON p.ds = y.ds AND p.pentadstamp = y.pentadstamp AND p.lat_i = y.lat_i AND p.lon_i = 1"),
    "multi_select": _with("pen", body=_PEN_OUT + " WHERE pentadstamp IN (145640, 145700, 145801, 146000)"),
    "merge_outer": _with("pen", more="a AS (SELECT * FROM pen WHERE ds = 'A'), n AS (SELECT * FROM pen WHERE ds = 'N'), r AS (SELECT * FROM pen WHERE ds = 'R'), "
        "an AS (SELECT coalesce(a.pentadstamp, n.pentadstamp) AS p, coalesce(a.lat_i, n.lat_i) AS y, coalesce(a.lon_i, n.lon_i) AS x, a.v AS va, n.v AS vn FROM a FULL JOIN n ON n.pentadstamp = a.pentadstamp AND n.lat_i = a.lat_i AND n.lon_i = a.lon_i)",
        body=f"SELECT coalesce(p, pentadstamp) AS pentadstamp, coalesce(y, lat_i) AS lat_i, coalesce(x, lon_i) AS lon_i, {_r('va', 'A')}, {_r('vn', 'N')}, {_r('r.v', 'R')} FROM an FULL JOIN r ON r.pentadstamp = p AND r.lat_i = y AND r.lon_i = x"),
    "stack_seasons": _with("pen", body=f"SELECT CAST(y AS INTEGER) AS season_year, ds, pentadstamp, lat_i, lon_i, {_r('v')}, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS part FROM pen, range(1996, 1998) r(y) WHERE pentadstamp BETWEEN y * 73 - 6 AND y * 73 + 11 "
        f"UNION ALL SELECT CAST(y AS INTEGER), ds, pentadstamp, lat_i, lon_i, {_r('v')}, n, CAST(1 AS INTEGER) FROM pen, range(1999, 2001) r(y) WHERE pentadstamp BETWEEN y * 73 + 30 AND y * 73 + 40"),
    "compress_scatter": _with("dense", more=_MASKS + ", m AS (SELECT lat_i, lon_i FROM masks WHERE region = 'NPAC_NORTH' AND mask = 1), k AS (SELECT c.* FROM clim c SEMI JOIN m USING (lat_i, lon_i))",
        body=f"SELECT g.ds, g.lat_i, g.lon_i, {_r('k.v', 'v')} FROM (SELECT DISTINCT d.ds, e.lat_i, e.lon_i FROM k d, dense e) g LEFT JOIN k ON k.ds = g.ds AND k.lat_i = g.lat_i AND k.lon_i = g.lon_i"),
    "spectrum_snapshot": _with("snap", body=f"SELECT t, k, {_SHARES} FROM snap WHERE k > 3"),
    "snapshot_diff": _with("cdiff", more=f"l AS ({_LINE_OFF.format('cdiff')}), f AS ({_DFT.format('l')}), h AS (SELECT t, k, sqrt(re * re + im * im) AS radius FROM f)", body=f"SELECT t, k, {_SHARES} FROM h WHERE k > 3"),
    "snapshot_gradient": _with("cdiff", body=f"SELECT a.t, {_r('a.x + 0.5::DOUBLE', 'x_mid')}, {_r('b.v - a.v', 'g')} FROM cdiff a JOIN cdiff b ON b.t = a.t AND b.x = a.x + 1"),
    "distance_text": _with("pen", more=_diff("TRUE") + ", " + _DIST, body="SELECT ds1, ds2, printf('%.2f ± %.2f', avg(sqrt(dist2)) / 1e6, stddev_pop(sqrt(dist2)) / 1e6) AS text FROM dist GROUP BY ALL"),
    "required_files": _with("pen", more=_PRODUCTS + f", days AS (SELECT DISTINCT pentadstamp, CAST({_BEGIN.format('pentadstamp')} + CAST(i AS INTEGER) AS DATE) AS d FROM pen, range(5) r(i))",
        body="SELECT dataset, pentadstamp, d, strftime(d, '%Y%m%d') || timestr || '-' || suffix || '.nc' AS file FROM days, products"),
    "fill_tier": _with("pen", "strict", more="u AS (SELECT DISTINCT ds, pentadstamp FROM pen)",
        body="SELECT u.ds AS dataset, u.pentadstamp, CASE WHEN s.ds IS NULL THEN 'failed' WHEN u.pentadstamp < 1999 * 73 THEN 'skipped' ELSE 'made' END AS status FROM u LEFT JOIN strict s ON s.ds = u.ds AND s.pentadstamp = u.pentadstamp"),
    "catalogue_json": _with("obs", body='SELECT ds, min(d) AS beg, max(d) AS "end", CAST(count(DISTINCT lon_i) AS INTEGER) AS n, max(lon_i) AS last_i FROM obs GROUP BY ds'),
    "binary_roundtrip": _with("dense", body="SELECT row_number() OVER (ORDER BY ds, lat_i, lon_i) - 1 AS at, round(coalesce(v, 0)::FLOAT, 1)::DOUBLE AS v FROM dense"),
    "interp_vertical": _with("levels", more=_down("levels") + ", " + _weights("z", _Z_TARGET, 7), body=f"SELECT ds, lat_i, lon_i, t AS axis_i, {_r('CASE WHEN count(v) = count(*) THEN sum(w * v) END', 'v')} FROM down JOIN z_w ON s = k GROUP BY ALL"),
    "regrid_clamped": _with("levels", more=_ZYX + ", o AS (" + _LEVEL_SQL.format("levels") + ")", body=f"SELECT ds, k, lat_i, lon_i, {_r('v')} FROM o"),
    "regrid_staggered": _with("levels", more=_LEVEL_FLOOD + ", " + _down("g3") + ", " + _ZYX + ", " + _UPRIGHT + ", o AS (" + _LEVEL_SQL.format("upright") + ")",
        body=f"SELECT ds, k, lat_i, lon_i, {_r('CASE WHEN (k + lat_i + lon_i) % 5 <> 0 THEN coalesce(v, -1) END', 'v')}, coalesce((k + lat_i + lon_i) % 5 <> 0 AND (v < 37000 OR v > 39000), FALSE) AS outside FROM o"),
    "regrid_raw_land": _with("levels", more=_LEVEL_FLOOD + ", " + _down("g3") + ", " + _ZYX + ", " + _UPRIGHT + ", o AS (" + _LEVEL_SQL.format("upright") + ")",
        body=f"SELECT ds, k, lat_i, lon_i, {_r('CASE WHEN (k + lat_i + lon_i) % 5 <> 0 THEN coalesce(v, -1) END', 'v')}, coalesce((k + lat_i + lon_i) % 5 <> 0 AND (v < 37000 OR v > 39000), FALSE) AS outside FROM o"),
    "high_pass": _with("dense", more="n AS (SELECT i AS y, CASE WHEN j < 0 THEN -j - 1 WHEN j > 72 THEN 145 - j ELSE j END AS sy FROM (SELECT i, i + d AS j FROM range(73) a(i), range(-12, 13) b(d))), "
        "e AS (SELECT i AS x, CASE WHEN j < 0 THEN -j - 1 WHEN j > 69 THEN 139 - j ELSE j END AS sx FROM (SELECT i, i + d AS j FROM range(70) a(i), range(-6, 7) b(d))), "
        "r AS MATERIALIZED (SELECT ds, lat_i, x, sum(coalesce(v, 0)) / 13 AS m FROM dense JOIN e ON sx = lon_i GROUP BY ALL), q AS (SELECT ds, y, x, sum(m) / 25 AS m FROM r JOIN n ON sy = lat_i GROUP BY ALL)",
        body=f"SELECT d.ds, d.lat_i, d.lon_i, {_r('v - m', 'v')} FROM dense d JOIN q ON q.ds = d.ds AND q.y = d.lat_i AND q.x = d.lon_i"),
    "spectral_density": "WITH raw AS (SELECT label, vec_id AS t, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings), "
        "z AS (SELECT label, t, x, v - avg(v) OVER (PARTITION BY label, t) AS v FROM raw), f AS (SELECT label, t, CAST(k AS INTEGER) AS k, sum(v * cos(2 * pi() * ((k * x) % 64) / 64)) AS re, sum(v * sin(2 * pi() * ((k * x) % 64) / 64)) AS im FROM z, range(32) r(k) WHERE k > 0 AND 64.0 / k < 20 GROUP BY ALL) "
        f"SELECT label, k, {_r('64.0::DOUBLE / k', 'wvlen')}, {_r('avg(re * re + im * im)', 'density')}, {_r('CASE WHEN avg(re * re + im * im) > 0 THEN log10(avg(re * re + im * im)) END', 'log_density')} FROM f GROUP BY label, k",
    "range_check_ocean": _with("dense", body="SELECT ds, count(*) FILTER (v < 20000 OR v > 60000) AS outside, count(v) AS finite, count(*) FILTER (v IS NULL) AS missing FROM dense WHERE (lat_i * 7 + lon_i) % 11 <> 0 GROUP BY ds"),
    "eof_pairs_gram": _with("pgram", body=f"SELECT s, t, {_r('g / 1e6', 'g')} FROM pgram WHERE s <= t"),
    "eof_mean_std": _with("stacked", "whole", body=f"SELECT c.lat_i, c.lon_i, {_r('mean')}, {_r('std')} FROM (SELECT DISTINCT lat_i, lon_i FROM stacked) c LEFT JOIN whole w ON w.lat_i = c.lat_i AND w.lon_i = c.lon_i"),
    # the first mode by power iteration on the Gram matrix
    "eof_first_mode": "WITH RECURSIVE " + _with("yearly", "panom", "pgram", more="rows_(s, r) AS MATERIALIZED (SELECT s, list(g / 1e6 ORDER BY t) FROM pgram GROUP BY s), m(r, trace) AS MATERIALIZED (SELECT list(r ORDER BY s), sum(r[s + 1]) FROM rows_ WHERE len(r) = (SELECT count(*) FROM rows_)), "
        "it(n, x, size) AS (SELECT 0, list_transform(range(CAST(len(r) AS BIGINT)), lambda i: 1.0::DOUBLE + i % 3), 0.0::DOUBLE FROM m UNION ALL SELECT n + 1, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))), sqrt(list_dot_product(y, y)) FROM (SELECT n, list_transform(r, lambda g: list_dot_product(g, x)) AS y FROM it, m WHERE n < 3000)), "
        "u AS (SELECT x, size, size / trace AS share FROM it, m WHERE n = 3000), p AS (SELECT lat_i, lon_i, sum(v * x[sample + 1]) / sqrt(any_value(size) * 1e6) AS v, any_value(share) AS share FROM panom, u GROUP BY ALL), "
        "f AS (SELECT lat_i, lon_i, v * CASE WHEN count(*) FILTER (v < 0) OVER () > count(*) FILTER (v >= 0) OVER () THEN -1 ELSE 1 END AS v FROM p)",
        body=f"SELECT g.lat_i, g.lon_i, {_r('f.v', 'v')}, {_r('(SELECT any_value(share) FROM p)', 'share')} FROM (SELECT DISTINCT lat_i, lon_i FROM yearly) g LEFT JOIN f ON f.lat_i = g.lat_i AND f.lon_i = g.lon_i WHERE EXISTS (FROM p)").removeprefix("WITH "),
}
