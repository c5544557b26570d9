"""Dates, epochs and time scales, as column expressions on Julian dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hdulake.sources.header import Header

MJD0 = 2400000.5
#: Fixed constants of the time scales (days, seconds, rates).
TT_TAI, TAI_GPS = 32.184, 19.0
L_G, L_B, TDB0, T77 = 6.969290134e-10, 1.550519768e-8, -6.55e-5, 2443144.5
#: Fixed: first day (UTC, as MJD) and TAI - UTC in seconds of each leap-second step.
LEAP_SECONDS = [
    (41317, 10), (41499, 11), (41683, 12), (42048, 13), (42413, 14), (42778, 15), (43144, 16), (43509, 17), (43874, 18), (44239, 19),
    (44786, 20), (45151, 21), (45516, 22), (46247, 23), (47161, 24), (47892, 25), (48257, 26), (48804, 27), (49169, 28), (49534, 29),
    (50083, 30), (50630, 31), (51179, 32), (53736, 33), (54832, 34), (56109, 35), (57204, 36), (57754, 37),
]
#: Fixed: other names of the scales.
SCALES = {"UTC": "UTC", "GMT": "UTC", "UT1": "UT1", "UT": "UT1", "TAI": "TAI", "IAT": "TAI", "TT": "TT", "TDT": "TT", "ET": "TT", "TCG": "TCG", "TDB": "TDB", "TCB": "TCB", "GPS": "GPS"}
#: Fixed: seconds of the time units.
UNITS = {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "day": 86400.0, "a": 31557600.0, "yr": 31557600.0, "y": 31557600.0, "cy": 3155760000.0, "ta": 365.24219 * 86400.0, "Ba": 365.2421988 * 86400.0}

_ISO = r"^([+-]?\d{4,})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2}(?:\.\d*)?))?)?$"


def scale_of(name: str) -> str:
    """The scale of a name, without what stands in brackets; Local for others."""
    return SCALES.get(name.partition("(")[0].strip().upper(), "Local")


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Julian day number of a Gregorian date, in whole numbers."""
    a = F.floor((14 - month) / 12)
    y, m = year + 4800 - a, month + 12 * a - 3
    return day + F.floor((153 * m + 2) / 5) + 365 * y + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) - 32045


def iso_to_jd(text: Column) -> Column:
    """Julian date of an ISO date or date-time; null if it isn't one that the calendar has."""

    def read(p: Column) -> Column:
        part = lambda k, kind: F.nullif(F.get(p, F.lit(k)), F.lit("")).try_cast(kind)
        year, month, day = part(0, "long"), part(1, "int"), part(2, "int")
        hour, minute, second = (F.coalesce(part(k, kind), F.lit(0)) for k, kind in ((3, "int"), (4, "int"), (5, "double")))
        leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
        days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        fine = (month.between(1, 12)) & (day >= 1) & (day <= days) & (hour < 24) & (minute < 60) & (second < 61) & (F.abs(year) <= 1_000_000)
        return F.when(fine, day_number(year, month, day) - 0.5 + (hour * 3600 + minute * 60 + second) / 86400.0)

    # one match: its groups, joined by bars, are split and bound once; a text that isn't a date gives one part
    parts = F.split(F.regexp_replace(F.trim(text), _ISO, "$1|$2|$3|$4|$5|$6"), r"\|", -1)
    return F.get(F.transform(F.filter(F.array(parts), lambda p: F.size(p) == 6), read), F.lit(0))


def iso_to_mjd(text: Column) -> Column:
    return iso_to_jd(text) - F.lit(MJD0)


def jd_to_date(jd: Column) -> Column:
    """A struct of year, month, day and second of the day."""
    n = F.floor(jd + 0.5)
    a = n + 32044
    b = F.floor((4 * a + 3) / 146097)
    c = a - F.floor(146097 * b / 4)
    d = F.floor((4 * c + 3) / 1461)
    e = c - F.floor(1461 * d / 4)
    m = F.floor((5 * e + 2) / 153)
    return F.struct(
        (100 * b + d - 4800 + F.floor(m / 10)).cast("long").alias("year"),
        (m + 3 - 12 * F.floor(m / 10)).cast("int").alias("month"),
        (e - F.floor((153 * m + 2) / 5) + 1).cast("int").alias("day"),
        ((jd + 0.5 - n) * 86400.0).alias("second"),
    )


def epoch_to_jd(epoch: Column) -> Column:
    """Julian date of J2000.0, B1950.0 and the like; null for others."""
    year = F.nullif(F.regexp_extract(F.trim(epoch), r"^[JBjb](-?\d+(?:\.\d*)?)$", 1), F.lit("")).cast("double")
    julian = 2451545.0 + (year - 2000.0) * 365.25
    besselian = 2415020.31352 + (year - 1900.0) * 365.242198781
    return F.when(F.upper(F.trim(epoch)).startswith("J"), julian).otherwise(besselian)


def leap_seconds(mjd: Column) -> Column:
    """TAI - UTC at a UTC date; the first and last steps hold before and after the table.

    The date is bound by a lambda, so it stands in the expression once and nested look-ups stay small.
    """

    def step(m: Column) -> Column:
        out = F.lit(float(LEAP_SECONDS[0][1]))
        for start, seconds in LEAP_SECONDS[1:]:
            out = F.when(m >= start, float(seconds)).otherwise(out)
        return out

    return F.transform(F.array(mjd.cast("double")), step)[0]


def _tdb_tt(jd: Column) -> Column:
    g = F.radians(F.lit(357.53) + F.lit(0.9856003) * (jd - 2451545.0))
    return 0.001658 * F.sin(g) + 0.000014 * F.sin(2 * g)


def to_tt(jd: Column, scale: str, dut1: float = 0.0) -> Column:
    if scale == "UT1":
        return to_tt(jd - dut1 / 86400, "UTC")
    if scale == "UTC":
        return jd + (leap_seconds(jd - MJD0) + TT_TAI) / 86400
    if scale == "TCB":
        tdb = jd - F.lit(L_B) * (jd - T77) + TDB0 / 86400
        return tdb - _tdb_tt(jd) / 86400
    return {
        "TT": lambda: jd,
        "TAI": lambda: jd + TT_TAI / 86400,
        "GPS": lambda: jd + (TT_TAI + TAI_GPS) / 86400,
        "TCG": lambda: jd - F.lit(L_G) * (jd - T77),
        "TDB": lambda: jd - _tdb_tt(jd) / 86400,
    }[scale]()


def from_tt(jd: Column, scale: str, dut1: float = 0.0) -> Column:
    if scale in ("UTC", "UT1"):
        tai = jd - TT_TAI / 86400
        utc = tai - leap_seconds(tai - MJD0) / 86400  # the step is looked up at the TAI date
        return utc + dut1 / 86400 if scale == "UT1" else utc
    tdb = jd + _tdb_tt(jd) / 86400
    return {
        "TT": lambda: jd,
        "TAI": lambda: jd - TT_TAI / 86400,
        "GPS": lambda: jd - (TT_TAI + TAI_GPS) / 86400,
        "TCG": lambda: jd + F.lit(L_G) * (jd - T77),
        "TDB": lambda: tdb,
        "TCB": lambda: tdb + F.lit(L_B) * (tdb - T77) - TDB0 / 86400,
    }[scale]()


def convert(jd: Column, source: str, target: str, dut1: float = 0.0) -> Column:
    """A Julian date from one scale to another, by way of TT. Equal or local scales change nothing."""
    a, b = scale_of(source), scale_of(target)
    if a == b or "Local" in (a, b):
        return jd
    return from_tt(to_tt(jd, a, dut1), b, dut1)


def relative_to_mjd(value: Column, reference_mjd: float, unit: str = "s", offset: float = 0.0) -> Column:
    return F.lit(float(reference_mjd)) + (value + F.lit(float(offset))) * (UNITS.get(unit, 1.0) / 86400.0)


def fold_phase(t: Column, zero: float, period: float) -> Column:
    """The phase in [0, 1); 0 for a period of 0."""
    if not period or math.isnan(period):
        return F.lit(0.0)
    x = (t - F.lit(float(zero))) / F.lit(float(period))
    return x - F.floor(x)


def axis_kind(ctype: str) -> str | None:
    """TIME (also for the name of a scale), PHASE, TIMELAG or FREQUENCY; None for axes that aren't of time."""
    head = ctype.partition("-")[0].strip()
    if head in ("TIME", "PHASE", "TIMELAG", "FREQUENCY"):
        return head
    return "TIME" if scale_of(head) != "Local" else None


def time_axis_mjd(header: Header, axis: int, pixel: Column, reference_mjd: float, unit: str = "s", offset: float = 0.0) -> Column | None:
    """MJD of 1-based pixels along a time axis; None if it isn't one."""
    if axis_kind(header.text(f"CTYPE{axis}") or "") != "TIME":
        return None
    place = pixel - F.lit(header.real(f"CRPIX{axis}", 0.0))
    return relative_to_mjd(F.lit(header.real(f"CRVAL{axis}", 0.0)) + F.lit(header.real(f"CDELT{axis}", 1.0)) * place, reference_mjd, unit, offset)


def phase_axis(header: Header, axis: int) -> tuple[float, float] | None:
    """The zero phase and the period of a phase axis (what ``fold_phase`` takes); None if it isn't one."""
    if axis_kind(header.text(f"CTYPE{axis}") or "") != "PHASE":
        return None
    return header.real(f"CZPHS{axis}", 0.0), header.real(f"CPERI{axis}", 0.0)
