import io

import numpy as np
import pytest
from pyspark.sql import types as T

from hdulake.errors import HduError
from hdulake.functions import codecs
from hdulake.functions.checksum import encode, ones_sum
from hdulake.sources import readers, writers
from hdulake.sources.header import UNDEFINED, Card, Header, parse_card, render_card
from hdulake.sources.layout import bin_columns, data_bytes, kind_of, parse_display, parse_form, scan


def line(text: str) -> bytes:
    return text.ljust(80).encode()


def test_cards():
    assert parse_card(line("A       =                    T / yes")) == Card("A", True, "yes")
    assert parse_card(line("A       = 'it''s / so' / c")) == Card("A", "it's / so", "c")
    assert parse_card(line("A       = 1.5D3")).value == 1500.0
    assert parse_card(line("A       = 99999999999999999999")).value == 1e20
    assert parse_card(line("A       = (1, 2.5)")).value == 1 + 2.5j
    assert parse_card(line("A       =")).value is UNDEFINED
    assert parse_card(line("A       = ''")).value == "" and parse_card(line("A       = '  '")).value == " "
    assert parse_card(line("HIERARCH ESO TEL = 4 / m")) == Card("ESO TEL", 4, "m")
    with pytest.raises(HduError):
        parse_card(line("A       = 1..5"))


def test_header_round_trip():
    long = "x" * 150 + "'quoted'" + "y" * 60
    h = Header().set("SIMPLE", True).set("LONG", long, "a comment").set("R", 1.5e-300).set("N", -7).add_comment("hello")
    again = Header.parse(h.render())
    assert again.get("LONG") == long and again.get("R") == 1.5e-300 and again.integer("N") == -7
    assert len(h.render()) % 2880 == 0 and len(render_card(Card("LONG", long))) > 1


def test_layout():
    h = Header().set("SIMPLE", True).set("BITPIX", 16).set("NAXIS", 2).set("NAXIS1", 512).set("NAXIS2", 512)
    assert data_bytes(h) == 524288 and kind_of(h, True) == "Primary"
    assert parse_form("12J") == (12, "J", "") and parse_form("QD(77)") == (1, "Q", "D")
    assert parse_display("ES14.6E3") == ("ES", 14, 6, 3) and parse_display("7F") is None
    for bad in ("W", "4", "-1J", "3QB(2)", "PQ(1)", "P"):
        with pytest.raises(HduError):
            parse_form(bad)
    t = Header().set("TFIELDS", 2).set("TFORM1", "1J").set("TFORM2", "8A").set("NAXIS1", 12)
    assert [c.offset for c in bin_columns(t)] == [0, 4]
    with pytest.raises(HduError):
        bin_columns(t.set("NAXIS1", 13))
    with pytest.raises(HduError):
        scan(io.BytesIO(b"junk"), 4)


def test_checksum():
    data = bytes(range(256)) * 45
    h = Header().set("SIMPLE", True).set("BITPIX", 8).set("NAXIS", 1).set("NAXIS1", len(data))
    unit = writers.fill(data)
    assert ones_sum(writers.with_checksums(h, unit) + unit) == 0xFFFFFFFF
    assert len(encode(0)) == 16 and encode(0).isalnum()


@pytest.mark.parametrize("width", [1, 2, 4])
def test_rice(width):
    rng = np.random.default_rng(width)
    top = 1 << 8 * width - 1
    for v in (np.cumsum(rng.integers(-5, 6, 500)) % (top // 2), rng.integers(-top, top, 200), np.zeros(70, int), np.array([3])):
        assert np.array_equal(codecs.rice_decode(codecs.rice_encode(v, width), len(v), width), v)


def test_other_codecs():
    mask = np.repeat([0, 3, 0, 70000, 2], [5000, 10, 1, 4, 6])
    assert np.array_equal(codecs.plio_decode(codecs.plio_encode(mask), len(mask)), mask)
    x = np.arange(50, dtype=np.int16)
    assert codecs.unshuffle_bytes(codecs.gunzip(codecs.gzip_tile(x, planes=True), 100), 2) == x.astype(">i2").tobytes()
    with pytest.raises(HduError):
        codecs.gunzip(codecs.gzip_tile(x), 99)
    seed = 1
    for _ in range(codecs.N_RANDOM):
        seed = codecs.MULTIPLIER * seed % codecs.MODULUS
    assert seed == 1043618065
    field = 100 + np.add.outer(np.arange(24) * 3.0, np.arange(16) * -2.0) + np.random.default_rng(1).uniform(-1, 1, (24, 16))
    q, scale, zero = codecs.quantize(field, "SUBTRACTIVE_DITHER_1", 1)
    assert np.abs(codecs.dequantize(q, scale, zero, "SUBTRACTIVE_DITHER_1", 1) - field.ravel()).max() < 0.3


def test_sources(spark, tmp_path):
    readers.register(spark)
    writers.register(spark)
    pixels = np.arange(24 * 16, dtype=np.int16).reshape(16, 24) - 100
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType())])
    columns = [[1, 2, 3], [[1.5], [], [2.0, float("inf")]], ["ab", "", "c"], [True, None, False]]
    path = str(tmp_path / "a.fits")
    with open(path, "wb") as f:
        f.write(writers.image_bytes(pixels, checksums=True) + writers.table_bytes(schema, columns, name="T"))
    assert [r["kind"] for r in spark.read.format("hdu_catalog").load(path).orderBy("hdu").collect()] == ["Primary", "BinTable"]
    assert spark.read.format("hdu_cards").load(path).filter("keyword = 'EXTNAME' and s = 'T'").count() == 1
    got = spark.read.format("hdu_image").option("rows", "100").load(path).orderBy("flat").collect()
    assert [r["raw"] for r in got] == pixels.ravel().tolist()
    rows = spark.read.format("hdu_table").option("extname", "t").load(path).orderBy("n").collect()
    assert [tuple(r) for r in rows] == list(zip(*columns, strict=True))
    frame = spark.createDataFrame([(i, [float(i)] * (i % 3), f"r{i}", i % 2 == 0) for i in range(50)], schema)
    frame.write.format("hdu_table_sink").mode("append").save(str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.format("hdu_table").load(str(tmp_path / "out")).collect())) == sorted(map(tuple, frame.collect()))
