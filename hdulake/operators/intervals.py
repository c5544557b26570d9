"""Good time intervals: from a table's columns to dates, and the events that lie within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hdulake.functions.time import relative_to_mjd


def gti_intervals(table: DataFrame, reference_mjd: float, unit: str = "s", offset: float = 0.0, start: str = "START", stop: str = "STOP") -> DataFrame:
    """start_mjd and stop_mjd of each row."""
    return table.select(*(relative_to_mjd(F.col(c), reference_mjd, unit, offset).alias(n) for c, n in ((start, "start_mjd"), (stop, "stop_mjd"))))


def _level(length: Column) -> Column:
    """The power of 2 that an interval isn't longer than."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1e-12)))).cast("int")


def within_intervals(events: DataFrame, time: str, intervals: DataFrame, start: str = "start_mjd", stop: str = "stop_mjd") -> DataFrame:
    """Each event with each interval that holds it (start <= time < stop): a range join as an equality join.

    An interval lies in at most two bins as wide as the power of 2 above its length. An event looks into one bin of
    each of the widths that occur (few, and at most as many as a double has exponents), so neither side is
    multiplied by how long or how many the intervals are. Rows with a null or NaN, and empty intervals, meet nothing.
    """
    fine = intervals.filter(F.col(stop) > F.col(start)).filter(~F.isnan(F.col(stop).cast("double")) & ~F.isnan(F.col(start).cast("double")))
    levelled = fine.withColumn("_level", _level((F.col(stop) - F.col(start)).cast("double")))
    levels = sorted(r[0] for r in levelled.select("_level").distinct().collect())
    bin_of = lambda t, level: F.floor(t.cast("double") / F.pow(F.lit(2.0), level)).cast("long")
    low, high = bin_of(F.col(start), F.col("_level")), bin_of(F.col(stop), F.col("_level"))
    binned = levelled.withColumn("_bin", F.explode(F.array_distinct(F.array(low, high))))
    asked = events.withColumn("_event_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_event_bin", bin_of(F.col(time), F.col("_event_level")))
    inside = (F.col("_event_level") == F.col("_level")) & (F.col("_event_bin") == F.col("_bin")) & (F.col(time) >= F.col(start)) & (F.col(time) < F.col(stop))
    return asked.join(binned, inside).drop("_event_level", "_event_bin", "_level", "_bin")
