"""The engine's own queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.functions import scaling, time, wcs
from hdulake.functions.checksum import fold
from hdulake.operators.intervals import within_intervals
from hdulake.sources import readers, writers
from hdulake.sources.header import Header

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 100 = 7 THEN NULL ELSE 10.0 + 2.5 * (l_partkey % 100) END AS value FROM lineitem")
def physical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (F.col("l_partkey") % 100).cast("int")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scaling.physical(raw, 2.5, 10.0, 7, as_null=True).alias("value"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey % 65536 - 32768) + 32768 AS value FROM lineitem")
def unsigned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (F.col("l_partkey") % 65536 - 32768).cast("short")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scaling.unsigned(raw, "short").cast("long").alias("value"))


@query("SELECT o_orderstatus, CAST(((sum(o_orderkey * 65537) - 1) % 4294967295) + 1 AS BIGINT) AS checksum, count(*) AS n FROM orders GROUP BY o_orderstatus")
def folded_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(fold(F.sum(F.col("o_orderkey") * 65537)).alias("checksum"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 64 AS x, (l_partkey // 64) % 48 AS y FROM lineitem")
def pixel_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.col("l_partkey")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scaling.axis_of(flat, [64, 48], 0).alias("x"), scaling.axis_of(flat, [64, 48], 1).alias("y"))


@query("SELECT o_orderkey, round(epoch_us(o_orderdate) / 86400000000.0 + 40587.0, 6) AS mjd FROM orders")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.round(time.iso_to_mjd(text), 6).alias("mjd"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d FROM orders")
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = time.jd_to_date(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400000000.0 + 2440587.5)
    return _table(spark, sf_dir, "orders").select("o_orderkey", day["year"].alias("y"), day["month"].alias("m"), day["day"].alias("d"))


_LEAP_SQL = "CASE " + " ".join(f"WHEN mjd >= {d} THEN {s}" for d, s in reversed(time.LEAP_SECONDS)) + f" ELSE {time.LEAP_SECONDS[0][1]} END"


@query(f"SELECT o_orderkey, {_LEAP_SQL} AS tai_utc, round(({_LEAP_SQL} + 32.184), 3) AS tt_utc FROM (SELECT o_orderkey, epoch_us(o_orderdate) / 86400000000.0 + 40587.0 AS mjd FROM orders)")
def time_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    mjd = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400000000.0 + 40587.0
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", mjd.alias("mjd"))
    leap = time.leap_seconds(F.col("mjd"))
    return rows.select("o_orderkey", leap.cast("int").alias("tai_utc"), F.round(leap + time.TT_TAI, 3).alias("tt_utc"))


@query("SELECT event_id, round((event_id % 1000) / 7.0 - floor((event_id % 1000) / 7.0), 9) AS phase FROM events")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.round(time.fold_phase((F.col("event_id") % 1000).cast("double"), 0.0, 7.0), 9).alias("phase"))


@query("SELECT n_regionkey AS interval_id, count(*) AS n FROM events JOIN (SELECT n_nationkey, n_regionkey, n_nationkey * 400 AS start, n_nationkey * 400 + 200 AS stop FROM nation) ON event_id >= start AND event_id < stop GROUP BY n_regionkey")
def good_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside good time intervals."""
    nation = _table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") * 400).alias("start"), (F.col("n_nationkey") * 400 + 200).alias("stop"))
    inside = within_intervals(_table(spark, sf_dir, "events").select("event_id"), "event_id", nation, "start", "stop")
    return inside.groupBy(F.col("n_regionkey").alias("interval_id")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice + 2.0 * o_custkey AS total FROM orders")
def named_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("DATE", "UU", "DATE")))
    values = F.array(F.col("o_totalprice"), F.lit(-1.0), 2.0 * F.col("o_custkey"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", scaling.named_parameter(names, values, "DATE").alias("total"))


#: Native longitude and latitude for the projections, from a table's ids.
_PHI, _THETA = "((l_partkey % 340) - 170.0)", "((l_suppkey % 70) + 10.0)"
_T, _P, _Z = f"radians({_THETA})", f"radians({_PHI})", f"radians(90.0 - {_THETA})"
_PLANE = {
    **{k: (f"degrees(1) * {r} * sin({_P})", f"-degrees(1) * {r} * cos({_P})") for k, r in {"TAN": f"tan({_Z})", "SIN": f"sin({_Z})", "ARC": _Z, "ZEA": f"2 * sin({_Z} / 2)", "STG": f"2 * tan({_Z} / 2)"}.items()},
    "CAR": (_PHI, _THETA),
    "CEA": (_PHI, f"degrees(1) * sin({_T})"),
    "MER": (_PHI, f"degrees(1) * ln(tan(pi() / 4 + {_T} / 2))"),
    "SFL": (f"{_PHI} * cos({_T})", _THETA),
    "PAR": (f"{_PHI} * (2 * cos(2 * {_T} / 3) - 1)", f"180 * sin({_T} / 3)"),
    "AIT": tuple(f"degrees(1) * sqrt(2 / (1 + cos({_T}) * cos({_P} / 2))) * {v}" for v in (f"2 * cos({_T}) * sin({_P} / 2)", f"sin({_T})")),
    "PCO": (f"degrees(1) / tan({_T}) * sin({_P} * sin({_T}))", f"{_THETA} + degrees(1) / tan({_T}) * (1 - cos({_P} * sin({_T})))"),
}


def _projection(code: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        phi, theta = F.expr(_PHI).cast("double"), F.expr(_THETA).cast("double")
        x, y = wcs.project(code, phi, theta, [])
        return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))

    run.__name__ = f"project_{code.lower()}"
    return run


for _code, (_x, _y) in _PLANE.items():
    query(f"SELECT l_orderkey, l_linenumber, round({_x}, 6) AS x, round({_y}, 6) AS y FROM lineitem")(_projection(_code))


def _round_trip(code: str, pv: list[float]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        phi, theta = F.expr("((l_partkey % 90) - 45.0)"), F.expr("((l_suppkey % 50) + 20.0)")
        back = wcs.deproject(code, *wcs.project(code, phi, theta, pv), pv)
        return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(back[0], 5).alias("phi"), F.round(back[1], 5).alias("theta"))

    run.__name__ = f"round_trip_{code.lower()}"
    return run


_ROUND_TRIPS: dict[str, list[float]] = {
    "ZPN": [0.0, 1.0, 0.0, -0.05], "AIR": [0.0, 45.0], "AZP": [0.0, 2.0, 20.0], "SZP": [0.0, 2.0, 30.0, 60.0], "COP": [0.0, 45.0, 20.0], "COE": [0.0, 45.0, 20.0],
    "COD": [0.0, 45.0, 20.0], "COO": [0.0, 45.0, 20.0], "CYP": [0.0, 1.0, 0.7], "MOL": [], "BON": [0.0, 45.0],
}
for _code, _pv in _ROUND_TRIPS.items():
    query("SELECT l_orderkey, l_linenumber, CAST((l_partkey % 90) - 45.0 AS DOUBLE) AS phi, CAST((l_suppkey % 50) + 20.0 AS DOUBLE) AS theta FROM lineitem")(_round_trip(_code, _pv))


def tan_header() -> Header:
    h = Header()
    for i, (kind, crval, cdelt) in enumerate((("RA---TAN", 150.0, -0.01), ("DEC--TAN", 2.5, 0.01)), 1):
        h.set(f"CTYPE{i}", kind).set(f"CRPIX{i}", 256.0).set(f"CRVAL{i}", crval).set(f"CDELT{i}", cdelt)
    return h.set("NAXIS", 2)


_U, _V = "radians(-0.01 * (l_partkey % 512 - 256.0))", "radians(0.01 * (l_suppkey % 512 - 256.0))"
_D0 = math.radians(2.5)


@query(
    "SELECT l_orderkey, l_linenumber, "
    f"round(150.0 + degrees(atan2({_U}, cos({_D0}) - {_V} * sin({_D0}))), 6) AS ra, "
    f"round(degrees(atan((sin({_D0}) + {_V} * cos({_D0})) / sqrt({_U} * {_U} + pow(cos({_D0}) - {_V} * sin({_D0}), 2)))), 6) AS dec FROM lineitem"
)
def sky_of_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = wcs.Wcs.from_header(tan_header()).pixel_to_world((F.col("l_partkey") % 512).cast("double"), (F.col("l_suppkey") % 512).cast("double"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


#: The same native coordinates for the projections with parameters, and their planes.
_PHI2, _THETA2 = "((l_partkey % 90) - 45.0)", "((l_suppkey % 50) + 20.0)"
_P2, _T2, _Z2, _DEG = f"radians({_PHI2})", f"radians({_THETA2})", f"radians(90.0 - {_THETA2})", "degrees(1)"
_A, _ETA = "radians(45.0)", "radians(20.0)"


def _polar(r: str, c: str = "1.0", y0: str | None = None) -> tuple[str, str]:
    x, y = f"({r}) * sin({c} * {_P2})", f"({r}) * cos({c} * {_P2})"
    return x, f"-{y}" if y0 is None else f"({y0}) - {y}"


_AZP_R = f"{_DEG} * 3.0 * cos({_T2}) / (2.0 + sin({_T2}) + cos({_T2}) * cos({_P2}) * tan(radians(20.0)))"
_AIR_K = "ln(cos(radians(22.5))) / pow(tan(radians(22.5)), 2)"
_COE_C = f"((sin({_A} - {_ETA}) + sin({_A} + {_ETA})) / 2)"
_COE_P = f"(1 + sin({_A} - {_ETA}) * sin({_A} + {_ETA}))"
_COD_C, _COD_Y = f"(sin({_A}) * sin({_ETA}) / {_ETA})", f"({_DEG} * {_ETA} / tan({_ETA}) / tan({_A}))"
_COO_C = f"(ln(cos({_A} + {_ETA}) / cos({_A} - {_ETA})) / ln(tan(pi() / 4 - ({_A} + {_ETA}) / 2) / tan(pi() / 4 - ({_A} - {_ETA}) / 2)))"
_COO_PSI = f"({_DEG} * cos({_A} - {_ETA}) / ({_COO_C} * pow(tan(pi() / 4 - ({_A} - {_ETA}) / 2), {_COO_C})))"
#: Centre of the slanted zenithal projection: mu = 2, its point of view at (30, 60).
_SX, _SY, _SZ = "(-2.0 * cos(radians(60.0)) * sin(radians(30.0)))", "(2.0 * cos(radians(60.0)) * cos(radians(30.0)))", "(2.0 * sin(radians(60.0)) + 1)"
_S1 = f"(1 - sin({_T2}))"
_BON_Y = f"({_A} + 1 / tan({_A}))"
_BON_R = f"({_BON_Y} - {_T2})"
_WITH_PV: dict[str, tuple[str, str]] = {
    "ZPN": _polar(f"{_DEG} * ({_Z2} - 0.05 * pow({_Z2}, 3))"),
    "AIR": _polar(f"-2 * {_DEG} * (ln(cos({_Z2} / 2)) / tan({_Z2} / 2) + {_AIR_K} * tan({_Z2} / 2))"),
    "AZP": (f"{_AZP_R} * sin({_P2})", f"-{_AZP_R} * cos({_P2}) / cos(radians(20.0))"),
    "SZP": (f"{_DEG} * ({_SZ} * cos({_T2}) * sin({_P2}) - {_SX} * {_S1}) / ({_SZ} - {_S1})", f"-{_DEG} * ({_SZ} * cos({_T2}) * cos({_P2}) + {_SY} * {_S1}) / ({_SZ} - {_S1})"),
    "COP": _polar(f"{_DEG} * cos({_ETA}) * (1 / tan({_A}) - tan({_T2} - {_A}))", f"sin({_A})", f"{_DEG} * cos({_ETA}) / tan({_A})"),
    "COE": _polar(f"{_DEG} / {_COE_C} * sqrt({_COE_P} - 2 * {_COE_C} * sin({_T2}))", _COE_C, f"{_DEG} / {_COE_C} * sqrt({_COE_P} - 2 * {_COE_C} * sin({_A}))"),
    "COD": _polar(f"{_COD_Y} + 45.0 - {_THETA2}", _COD_C, _COD_Y),
    "COO": _polar(f"{_COO_PSI} * pow(tan(pi() / 4 - {_T2} / 2), {_COO_C})", _COO_C, f"{_COO_PSI} * pow(tan(pi() / 4 - {_A} / 2), {_COO_C})"),
    "CYP": (f"0.7 * {_PHI2}", f"{_DEG} * 1.7 * sin({_T2}) / (1 + cos({_T2}))"),
    "BON": (f"{_DEG} * {_BON_R} * sin({_P2} * cos({_T2}) / {_BON_R})", f"{_DEG} * ({_BON_Y} - {_BON_R} * cos({_P2} * cos({_T2}) / {_BON_R}))"),
}


def _forward(code: str, pv: list[float]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, y = wcs.project(code, F.expr(_PHI2).cast("double"), F.expr(_THETA2).cast("double"), pv)
        return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))

    run.__name__ = f"project_{code.lower()}"
    return run


for _code, (_x, _y) in _WITH_PV.items():
    query(f"SELECT l_orderkey, l_linenumber, round({_x}, 6) AS x, round({_y}, 6) AS y FROM lineitem")(_forward(_code, _ROUND_TRIPS[_code]))

_MX, _MY = "((l_partkey % 80) - 40.0)", "((l_suppkey % 120) - 60.0)"
_G = f"asin({_MY} / (sqrt(2) * {_DEG}))"


@query(f"SELECT l_orderkey, l_linenumber, round(pi() * {_MX} / (2 * sqrt(2) * cos({_G})), 6) AS phi, round(degrees(asin((2 * {_G} + sin(2 * {_G})) / pi())), 6) AS theta FROM lineitem")
def deproject_mol(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi, theta = wcs.deproject("MOL", F.expr(_MX).cast("double"), F.expr(_MY).cast("double"), [])
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(phi, 6).alias("phi"), F.round(theta, 6).alias("theta"))


_RA, _DEC = "(148.0 + (l_partkey % 400) / 100.0)", "(0.5 + (l_suppkey % 400) / 100.0)"
_DA, _RD = f"radians({_RA} - 150.0)", f"radians({_DEC})"
_COSC = f"(sin({_D0}) * sin({_RD}) + cos({_D0}) * cos({_RD}) * cos({_DA}))"


@query(
    "SELECT l_orderkey, l_linenumber, "
    f"round(256.0 - 100.0 * degrees(cos({_RD}) * sin({_DA}) / {_COSC}), 5) AS x, "
    f"round(256.0 + 100.0 * degrees((cos({_D0}) * sin({_RD}) - sin({_D0}) * cos({_RD}) * cos({_DA})) / {_COSC}), 5) AS y FROM lineitem"
)
def pixels_of_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same header read from the keywords of a pixel list, from the sky to pixels."""
    h = Header()
    for column, (kind, crval, cdelt) in zip((3, 7), (("RA---TAN", 150.0, -0.01), ("DEC--TAN", 2.5, 0.01)), strict=True):
        h.set(f"TCTYP{column}", kind).set(f"TCRPX{column}", 256.0).set(f"TCRVL{column}", crval).set(f"TCDLT{column}", cdelt)
    ra, dec = F.expr(_RA).cast("double"), F.expr(_DEC).cast("double")
    x, y = wcs.Wcs.from_pixel_list(h, [3, 7]).world_to_pixel(ra, dec)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


_JD = "(epoch_us(o_orderdate) / 86400000000.0 + 2440587.5)"
_SINE = "0.001658 * sin(radians(357.53 + 0.9856003 * (jd - 2451545.0))) + 0.000014 * sin(2 * radians(357.53 + 0.9856003 * (jd - 2451545.0)))"


@query(
    "SELECT o_orderkey, round(32.184, 4) AS tai_to_tt, round(51.184, 4) AS gps_to_tt, "
    f"round({_SINE}, 4) AS tt_to_tdb, round(6.969290134e-10 * (jd - 2443144.5) * 86400, 4) AS tt_to_tcg FROM (SELECT o_orderkey, {_JD} AS jd FROM orders)"
)
def scale_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that conversions add to a date. A Julian date resolves 40 microseconds, so they are sought near the day 0."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400000000.0 + 2440587.5).alias("jd"))
    jd = F.col("jd")
    seconds = lambda a, b, x: F.round((time.convert(x, a, b) - x) * 86400.0, 4)
    small = F.lit(0.0)
    tdb = F.round(time._tdb_tt(jd), 4)
    tcg = F.round(F.lit(time.L_G) * (jd - time.T77) * 86400.0, 4)
    return rows.select("o_orderkey", seconds("TAI", "TT", small).alias("tai_to_tt"), seconds("GPS", "TT", small).alias("gps_to_tt"), tdb.alias("tt_to_tdb"), tcg.alias("tt_to_tcg"))


@query("SELECT event_id, 51544.5 + (100.0 + 0.5 * (event_id % 1000 - 8) + 30.0) * 60.0 / 86400.0 AS mjd, (event_id % 1000 - 3.0) / 7.0 - floor((event_id % 1000 - 3.0) / 7.0) AS phase FROM events")
def time_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time axis and a phase axis of a header."""
    h = Header().set("CTYPE1", "TIME").set("CRPIX1", 8.0).set("CRVAL1", 100.0).set("CDELT1", 0.5).set("CTYPE2", "PHASE").set("CZPHS2", 3.0).set("CPERI2", 7.0)
    pixel = (F.col("event_id") % 1000).cast("double")
    mjd = time.time_axis_mjd(h, 1, pixel, 51544.5, "min", 30.0)
    return _table(spark, sf_dir, "events").select("event_id", mjd.alias("mjd"), time.fold_phase(pixel, *time.phase_axis(h, 2)).alias("phase"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors see: below the cluster's checkpoint folder, or one of our own where there is none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{(shared or tempfile.mkdtemp(prefix='hdulake-')).removeprefix('file://')}/{name}-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder if shared else folder.rpartition("/")[0], ignore_errors=True)
    return folder


def _through_files(df: DataFrame, name: str, sink: str = "hdu_table_sink", source: str = "hdu_table", written: dict | None = None, read: dict | None = None) -> DataFrame:
    spark = df.sparkSession
    readers.register(spark)
    writers.register(spark)
    folder = _folder(spark, name)
    df.write.format(sink).options(**(written or {})).mode("append").save(folder)
    return spark.read.format(source).options(**(read or {})).load(folder)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as binary tables and read again."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return _through_files(rows, "tables", written={"checksum": "true"})


def _compressed_table(codec: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_totalprice", "o_orderpriority", (F.col("o_custkey") % 1000).cast("short").alias("small"))
        back = _through_files(rows, "compressed", written={"codec": codec})
        return back.select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_totalprice", "o_orderpriority", F.col("small").cast("long").alias("small"))

    run.__name__ = f"compressed_table_{codec.lower()}"
    return run


for _codec in ("GZIP_1", "GZIP_2", "RICE_1"):
    query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice, o_orderpriority, CAST(o_custkey % 1000 AS BIGINT) AS small FROM orders")(_compressed_table(_codec))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 10 = 3 THEN NULL ELSE 1.5 + 0.25 * (o_custkey % 100) END AS value FROM orders")
def ascii_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII tables with a scaled column whose null is a word."""
    value = F.when(F.col("o_custkey") % 10 != 3, (F.col("o_custkey") % 100).cast("int"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", value.alias("value", metadata={"tnull": "none", "tscal": 0.25, "tzero": 1.5}))
    back = _through_files(rows, "ascii", written={"ascii": "true"}, read={"physical": "true"})
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 50 = 7 THEN NULL ELSE 10.0 + 2.5 * (o_custkey % 50) END AS value, CAST((o_custkey % 1000) * 60 AS BIGINT) AS unsigned_value FROM orders")
def scaled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scaled column with a null, and an unsigned one, in their physical and exact values."""
    small = scaling.stored_unsigned((F.col("o_custkey") % 1000) * 60, "short")
    rows = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 50).cast("short").alias("value", metadata={"tscal": 2.5, "tzero": 10.0, "tnull": 7}),
        small.alias("unsigned_value", metadata={"tzero": 32768.0}),
    )
    back = _through_files(rows, "scaled", read={"physical": "true", "unsigned": "true"})
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.nanvl("value", F.lit(None).cast("double")).alias("value"), F.col("unsigned_value").cast("long").alias("unsigned_value"))


@query(
    "SELECT o_orderkey, CAST(o_custkey % 5 AS BIGINT) AS n, CAST(o_custkey % 5 * 3 AS BIGINT) AS total, o_custkey % 3 = 0 AS first_flag, "
    "CAST((o_custkey % 2) + ((o_custkey // 2) % 2) + ((o_custkey // 4) % 2) AS BIGINT) AS bits, 2.0 * o_totalprice AS im FROM orders"
)
def array_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable lengths, logicals, bits and complex numbers."""
    k = F.col("o_custkey")
    rows = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array_repeat(F.lit(3), (k % 5).cast("int")).alias("items"),
        F.array(k % 3 == 0, k % 2 == 0).alias("flags"),
        F.array(*((F.expr(f"o_custkey div {1 << i}") % 2 == 1) for i in range(3))).alias("mask", metadata={"bits": 3}),
        F.struct(F.col("o_totalprice").alias("re"), (2 * F.col("o_totalprice")).alias("im")).alias("z"),
    )
    back = _through_files(rows, "arrays")
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select("o_orderkey", F.size("items").cast("long").alias("n"), total.alias("total"), F.col("flags")[0].alias("first_flag"), F.size(F.filter("mask", lambda b: b)).cast("long").alias("bits"), F.col("z.im").alias("im"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the pixels of 64 by 64 images: image, flat and raw, with -1 where no order has the pixel's key."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 1000).cast("int").alias("v"))
    places = orders.select(F.expr("k div 4096").alias("image")).distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("flat"))
    known = orders.select(F.expr("k div 4096").alias("i"), (F.col("k") % 4096).alias("f"), "v")
    filled = places.join(known, (F.col("image") == F.col("i")) & (F.col("flat") == F.col("f")), "left")
    return filled.select("image", F.col("flat").cast("long").alias("flat"), F.coalesce("v", F.lit(-1)).alias("raw")).repartition("image").sortWithinPartitions("image")


@query("SELECT CAST(o_orderkey % 4096 AS BIGINT) AS flat, 10.0 + 2.5 * (o_custkey % 1000) AS value FROM orders")
def scaled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a scale and a blank value, in physical values."""
    back = _through_files(_pixels(spark, sf_dir), "images", "hdu_image_sink", "hdu_image", {"axes": "64,64", "scale": "2.5", "zero": "10", "blank": "-1"}, {"physical": "true"})
    return back.filter("not isnan(value)").select("flat", "value")


def _compressed_images(codec: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pixels = _pixels(spark, sf_dir)
        if codec == "PLIO_1":  # no negative values
            pixels = pixels.withColumn("raw", F.col("raw") + 1)
        back = _through_files(pixels, "images", "hdu_image_sink", "hdu_image", {"axes": "64,64", "codec": codec, "tile": "40,25"})
        raw = F.col("raw") - (1 if codec == "PLIO_1" else 0)
        return back.select("flat", raw.cast("long").alias("raw")).filter("raw >= 0")

    run.__name__ = f"images_{codec.lower()}"
    return run


for _codec in ("GZIP_1", "GZIP_2", "RICE_1", "PLIO_1", "HCOMPRESS_1", "NOCOMPRESS"):
    query("SELECT CAST(o_orderkey % 4096 AS BIGINT) AS flat, CAST(o_custkey % 1000 AS BIGINT) AS raw FROM orders")(_compressed_images(_codec))


@query("SELECT count(*) AS files_rows, true AS datasums, true AS checksums, CAST(1 AS BIGINT) AS kinds FROM orders")
def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of written files and what their checksums say."""
    readers.register(spark)
    writers.register(spark)
    folder = _folder(spark, "checked")
    _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").write.format("hdu_table_sink").options(checksum="true", rows_per_file="5000").mode("append").save(folder)
    tables = spark.read.format("hdu_catalog").load(folder).filter("hdu = 1").agg(F.sum(F.col("axes")[1]).alias("files_rows"), F.count_distinct("kind").alias("kinds"))
    sums = spark.read.format("hdu_checksums").load(folder).agg(F.bool_and("datasum_ok").alias("datasums"), F.bool_and("checksum_ok").alias("checksums"))
    return tables.crossJoin(sums)  # one row each


@query("SELECT * FROM (VALUES ('TTYPE1', 'o_orderkey'), ('TFORM1', '1K'), ('TTYPE2', 'o_totalprice'), ('TFORM2', '1D'), ('TUNIT2', 'USD'), ('XTENSION', 'BINTABLE'), ('EXTNAME', 'ORDERS')) AS t(keyword, s)")
def header_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text cards of written files, each once."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("o_totalprice", metadata={"tunit": "USD"}))
    return _through_files(rows, "cards", source="hdu_cards", written={"extname": "ORDERS"}).filter("hdu = 1 and type = 'text'").select("keyword", "s").distinct()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sky_of_pixels(spark, sf_dir)
