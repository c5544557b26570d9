"""What the time keywords of a header say, one row for each HDU, from the rows of ``hdu_cards``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hdulake.functions.time import MJD0, SCALES, UNITS, epoch_to_jd, iso_to_mjd

_REAL = ("MJDREF", "MJDREFI", "MJDREFF", "JDREF", "JDREFI", "JDREFF", "TIMEOFFS", "MJD-OBS", "JEPOCH", "BEPOCH")
_TEXT = ("TIMESYS", "TIMEUNIT", "TREFPOS", "DATEREF", "DATE-OBS")
_BOUNDS = ("BEG", "END", "AVG")
_DURATIONS = ("XPOSURE", "TELAPSE", "TIMEDEL", "TIMEPIXR", "TIMSYER", "TIMRDER")


def _wide(cards: DataFrame, reals: Sequence[str] = _REAL, texts: Sequence[str] = _TEXT) -> DataFrame:
    """path, hdu and a column for each keyword: its first card's value, null where that is of another kind."""
    value = {**{k: F.coalesce("r", F.col("i").cast("double")) for k in reals}, **{k: F.col("s") for k in texts}}
    first = lambda k: F.min_by(value[k], F.when(F.col("keyword") == k, F.col("card_index"))).alias(k)
    # HDUs without any of the keywords have a row too, so nothing is filtered; one aggregation, combined map-side
    return cards.groupBy("path", "hdu").agg(*map(first, value))


def _reference(single: str) -> Column:
    """A whole and a fractional part together, else the single value, else the one part there is."""
    whole, part = F.col(f"{single}I"), F.col(f"{single}F")
    return F.coalesce(whole + part, F.col(single), whole, part)


def time_frames(cards: DataFrame) -> DataFrame:
    """path, hdu, scale, mjdref, unit, unit_seconds, offset, position, obs_mjd, epoch_mjd, epoch_scale.

    The reference date is 0 if none is given; an unknown unit counts as seconds, an unknown scale as Local.
    obs_mjd is MJD-OBS, else DATE-OBS, else the epoch; a Julian epoch goes before a Besselian one.
    """
    name = F.upper(F.trim(F.substring_index("TIMESYS", "(", 1)))
    scale = F.when(F.col("TIMESYS").isNull(), "UTC")
    for other, scale_name in SCALES.items():
        scale = scale.when(name == other, scale_name)
    unit = F.coalesce("TIMEUNIT", F.lit("s"))
    seconds = F.when(F.lit(False), 1.0)
    for u, n in UNITS.items():
        seconds = seconds.when(F.trim(unit) == u, n)
    year = lambda tag, k: epoch_to_jd(F.concat(F.lit(tag), F.format_string("%.12f", F.col(k)))) - MJD0
    epoch = F.coalesce(F.when(F.col("JEPOCH").isNotNull(), year("J", "JEPOCH")), F.when(F.col("BEPOCH").isNotNull(), year("B", "BEPOCH")))
    return _wide(cards).select(
        "path",
        "hdu",
        scale.otherwise("Local").alias("scale"),
        F.coalesce(_reference("MJDREF"), _reference("JDREF") - MJD0, iso_to_mjd(F.col("DATEREF")), F.lit(0.0)).alias("mjdref"),
        unit.alias("unit"),
        seconds.otherwise(1.0).alias("unit_seconds"),
        F.coalesce("TIMEOFFS", F.lit(0.0)).alias("offset"),
        F.col("TREFPOS").alias("position"),
        F.coalesce(F.col("`MJD-OBS`"), iso_to_mjd(F.col("`DATE-OBS`")), epoch).alias("obs_mjd"),
        epoch.alias("epoch_mjd"),
        F.when(F.col("JEPOCH").isNotNull(), "TDB").when(F.col("BEPOCH").isNotNull(), "TT").alias("epoch_scale"),
    )


def time_bounds(cards: DataFrame) -> DataFrame:
    """path, hdu, begin_mjd, end_mjd, average_mjd, and durations and errors as stored.

    A bound is that of its MJD keyword, else of its DATE keyword. The place within a bin is 0.5 if not given.
    """
    wide = _wide(cards, [*(f"MJD-{b}" for b in _BOUNDS), *_DURATIONS], [f"DATE-{b}" for b in _BOUNDS])
    bounds = [F.coalesce(F.col(f"`MJD-{b}`"), iso_to_mjd(F.col(f"`DATE-{b}`"))).alias(n) for b, n in zip(_BOUNDS, ("begin_mjd", "end_mjd", "average_mjd"), strict=True)]
    stored = [(F.coalesce(F.col(k), F.lit(0.5)) if k == "TIMEPIXR" else F.col(k)).alias(k.lower()) for k in _DURATIONS]
    return wide.select("path", "hdu", *bounds, *stored)
