"""The five-day calendar: 73 pentads a year, restarting on 1 January.

A pentad's stamp is ``year * 73 + pentad`` and is the time axis everywhere; differences of stamps
are plain integers.  The last day of a leap year belongs to no pentad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PENTADS = 73
DAYS = 5


def pentad_of(day: Column) -> Column:
    """Pentad 0..72 of a date; null for day 366."""
    p = F.floor((F.dayofyear(day) - 1) / DAYS).cast("int")
    return F.when(p < PENTADS, p)


def stamp_of(day: Column) -> Column:
    return (F.year(day) * PENTADS + pentad_of(day)).cast("int")


def year_of(stamp: Column) -> Column:
    return F.floor(stamp / F.lit(float(PENTADS))).cast("int")


def pentad_in_year(stamp: Column) -> Column:
    return F.pmod(stamp, F.lit(PENTADS)).cast("int")


def label_of(stamp: Column) -> Column:
    """``2023P68``."""
    return F.format_string("%04dP%02d", year_of(stamp), pentad_in_year(stamp))


def parse(label: Column) -> Column:
    """Stamp of ``YYYYPpp``; pp may be negative or above 72 and carries over into other years."""
    parts = F.split(label, "P")
    return (parts[0].cast("int") * PENTADS + parts[1].cast("int")).cast("int")


def stamp_from(year: Column, pentad: Column) -> Column:
    """Stamp of a year and a pentad, which may carry over; a missing part counts as 0."""
    return delta_from(year, pentad)


def delta_from(years: Column, pentads: Column) -> Column:
    """A span of years and pentads as a number of pentads; a missing part counts as 0.

    Points and spans are plain integers: a point plus or minus a span is a point, the difference of
    two points is a span, and both compare as numbers do.
    """
    none = F.lit(0)
    return (F.coalesce(years, none) * PENTADS + F.coalesce(pentads, none)).cast("int")


def begin_of(stamp: Column) -> Column:
    return F.date_add(F.make_date(year_of(stamp), F.lit(1), F.lit(1)), pentad_in_year(stamp) * DAYS)


def end_of(stamp: Column) -> Column:
    return F.date_add(begin_of(stamp), DAYS)


def parse_label(label: str) -> int:
    year, _, pentad = label.partition("P")
    return int(year) * PENTADS + int(pentad)


def pentad_range(spark: SparkSession, begin: str, end: str, inclusive: str = "left") -> DataFrame:
    """Stamps from ``begin`` to ``end``; inclusive is left, right, both or neither."""
    if inclusive not in ("left", "right", "both", "neither"):
        raise ValueError(f"inclusive: {inclusive}")
    first, last = parse_label(begin), parse_label(end)
    if last < first:
        raise ValueError("the range ends before it begins")
    first += inclusive in ("right", "neither")
    last -= inclusive in ("left", "neither")
    stamps = spark.range(first, max(first, last + 1)).select(F.col("id").cast("int").alias("pentadstamp"))
    return stamps.withColumn("label", label_of(F.col("pentadstamp")))


def ranges(rows: DataFrame, begin: str, end: str, inclusive: str = "left") -> DataFrame:
    """``rows`` once for every pentad of the range from column ``begin`` to ``end`` (stamps), as pentadstamp and label.

    A range without a pentad has no rows; one that ends before it begins is an error.
    """
    if inclusive not in ("left", "right", "both", "neither"):
        raise ValueError(f"inclusive: {inclusive}")
    first = F.col(begin) + int(inclusive in ("right", "neither"))
    last = F.col(end) - int(inclusive in ("left", "neither"))
    wrong = F.raise_error(F.lit("the range ends before it begins")).cast("array<int>")
    stamps = F.when(F.col(end) < F.col(begin), wrong).when(first <= last, F.sequence(first, last))
    return rows.withColumn("pentadstamp", F.explode(stamps)).withColumn("label", label_of(F.col("pentadstamp")))


def hours_since(moment: Column, epoch: str = "2000-01-01") -> Column:
    """Whole hours from the epoch to a timestamp."""
    return F.timestamp_diff("HOUR", F.to_timestamp(F.lit(epoch)), moment).cast("long")


def from_hours(hours: Column, epoch: str = "2000-01-01") -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), F.to_timestamp(F.lit(epoch)))
