"""Scalar functions on small tables."""

import math
import struct

from pyspark.sql import functions as F

from busfleet.functions import bits, ids, numeric, text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_ids(spark):
    rows = spark.createDataFrame([("18FEF100x",), ("1G",), ("7FF",), (None,)], "ID string")
    got = [tuple(r) for r in rows.select(ids.hex_to_int("ID").alias("i")).select("i", ids.pgn_of("i")).collect()]
    assert got == [(0x18FEF100, 0xFEF1), (None, None), (0x7FF, None), (None, None)]
    assert one(spark, a=ids.id_of_pgn(0xFECA, 3, 5))["a"] == 0x0CFECA05


def test_bits_against_a_bit_loop(spark):
    payloads = [bytes((i * 37 + k * 91) % 256 for k in range(8)) for i in range(40)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(payloads)], "i int, " + ", ".join(f"D{k} int" for k in range(8)))
    fields = [(0, 16), (3, 9), (17, 30), (8, 56)]
    got = rows.select("i", *(bits.raw_le(bits.packed_le(), s, n).alias(f"l{s}_{n}") for s, n in fields), *(bits.raw_be(bits.packed_be(), 8 * (s // 8) + 7, n).alias(f"b{s}_{n}") for s, n in fields)).collect()
    for r in got:
        le, be = int.from_bytes(payloads[r["i"]], "little"), int.from_bytes(payloads[r["i"]], "big")
        for s, n in fields:
            assert r[f"l{s}_{n}"] == le >> s & (1 << n) - 1
            assert r[f"b{s}_{n}"] == be >> (64 - 8 * (s // 8) - n) & (1 << n) - 1


def test_typed_reads(spark):
    data = bytes(range(1, 10)) + struct.pack("<f", -2.5) + struct.pack(">d", 1e-3) + b"\xff" * 8
    rows = spark.createDataFrame([(bytearray(data),)], "data binary")
    read = lambda at, k: rows.select(bits.typed_read("data", at, k).alias("x")).first()["x"]
    assert read(0, "u16_le") == 0x0201 and read(1, "u32_be") == 0x02030405 and read(21, "i64_le") == -1
    assert int(read(21, "u64_be")) == 2**64 - 1 and read(9, "f32_le") == -2.5 and math.isclose(read(13, "f64_be"), 1e-3)
    assert read(25, "u64_le") is None


def test_lenient_bytes(spark):
    rows = spark.createDataFrame([("ABC",), ("zz",), (None,), ("01",)], "t string")
    assert [bytes(r[0]) for r in rows.select(bits.lenient_bytes("t")).collect()] == [b"\xab\xc0", b"", b"", b"\x01"]


def test_float_rules(spark):
    r = one(spark, a=numeric.divide(F.lit(1.0), F.lit(0.0)), b=numeric.divide(F.lit(0.0), F.lit(0.0)), c=numeric.MATH["ln"](F.lit(0.0)), d=numeric.MATH["log10"](F.lit(-1.0)), e=numeric.round_even(F.lit(0.125), 2), f=numeric.truncate(F.lit(-1.29), 1))
    assert r["a"] == math.inf and math.isnan(r["b"]) and r["c"] == -math.inf and math.isnan(r["d"]) and r["e"] == 0.12 and math.isclose(r["f"], -1.2)


def test_texts(spark):
    r = one(spark, a=text.value_text(F.lit(2.5)), b=text.bit_groups(F.lit("0aF0")), c=text.first_number(F.lit("speed 12,5 km")), d=text.time_text(F.lit(3661.0), "UTC"), e=text.time_text(F.lit(float("nan"))), f=text.clean_text(F.lit("Â°C ")), g=text.date_bound(F.lit("2024-01-02"), "UTC", True), h=text.date_bound(F.lit("2024-01-02 03:04"), "Europe/Berlin"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == ("2.5", "00001010 11110000", 12.5, "01:01:01", "", "°C")
    assert math.isclose(r["g"], 1704240000 - 1e-6, abs_tol=1e-5) and r["h"] == 1704161040.0
