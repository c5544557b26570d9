from hdulake.operators.time_keywords import time_bounds, time_frames
from hdulake.sources.readers import CARDS


def cards(path, *values):
    for k, (keyword, v) in enumerate(values):
        yield path, 0, k, keyword, "", None, v if type(v) is int else None, v if type(v) is float else None, v if type(v) is str else None, None, None, ""


def test_time_frames(spark):
    given = [
        *cards("a", ("TIMESYS", "TT(TAI)"), ("MJDREFI", 50000), ("MJDREFF", 0.25), ("MJDREF", 1.0), ("TIMEUNIT", "d"), ("TIMEUNIT", "s"), ("MJD-OBS", 51544.5), ("JEPOCH", 2000.0)),
        *cards("b", ("JDREF", 2400001.5), ("DATE-OBS", "2000-01-01T12:00:00"), ("TIMEUNIT", "odd"), ("TIMESYS", "mine")),
        *cards("c", ("DATEREF", "2000-01-01"), ("BEPOCH", 1950.0), ("TIMEUNIT", "ta")),
        *cards("d", ("SIMPLE", 1)),
    ]
    r = {x["path"]: x for x in time_frames(spark.createDataFrame(given, CARDS)).collect()}
    assert (r["a"]["scale"], r["a"]["mjdref"], r["a"]["unit_seconds"], r["a"]["obs_mjd"], r["a"]["epoch_mjd"], r["a"]["epoch_scale"]) == ("TT", 50000.25, 86400.0, 51544.5, 51544.5, "TDB")
    assert (r["b"]["scale"], r["b"]["mjdref"], r["b"]["unit_seconds"], r["b"]["obs_mjd"]) == ("Local", 1.0, 1.0, 51544.5)
    assert r["c"]["mjdref"] == 51544.0 and abs(r["c"]["obs_mjd"] - 33281.92345905) < 1e-6 and r["c"]["epoch_scale"] == "TT" and abs(r["c"]["unit_seconds"] - 365.24219 * 86400) < 1e-6
    assert (r["d"]["scale"], r["d"]["mjdref"], r["d"]["unit"], r["d"]["offset"], r["d"]["obs_mjd"]) == ("UTC", 0.0, "s", 0.0, None)


def test_time_bounds(spark):
    given = [*cards("a", ("MJD-BEG", 5.5), ("DATE-BEG", "2000-01-01"), ("DATE-END", "2000-01-01"), ("XPOSURE", 7), ("TIMEPIXR", 0.0)), *cards("b", ("SIMPLE", 1))]
    r = {x["path"]: x for x in time_bounds(spark.createDataFrame(given, CARDS)).collect()}
    assert (r["a"]["begin_mjd"], r["a"]["end_mjd"], r["a"]["average_mjd"], r["a"]["xposure"], r["a"]["timepixr"]) == (5.5, 51544.0, None, 7.0, 0.0)
    assert (r["b"]["begin_mjd"], r["b"]["timepixr"], r["b"]["telapse"]) == (None, 0.5, None)
