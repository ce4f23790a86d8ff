"""Logs and dictionaries from files."""

import pytest
from pyspark.sql import functions as F

from busfleet.sources import dictionaries, logs, readings, sinks

CANDUMP = "(1234.567890) can0 18FEF100#0102030405060708\nnot a candump line\n(1235.5) can0 123#ABC\n"
SPACED = "(1.0) can1 123 [3] 11 22 33\n"
MEMORATOR = "Memorator Binary logfile created at: 2024-01-01 00:00:00\nTrigger 1 2\n   0.001000  1  18FEF100x  R  8  01 02 03 04 05 06 07 08\n"


def test_mixed_folder(spark, tmp_path):
    for name, body in (("a.log", CANDUMP), ("b.log", SPACED), ("c.log", MEMORATOR)):
        (tmp_path / name).write_text(body)
    rows = {(r["log_id"][-5:], r["TS"]): r for r in logs.read_logs(spark, str(tmp_path), utc_offset_hours=0).collect()}
    assert len(rows) == 4
    first = rows["a.log", 1234.56789]
    assert (first["LEN"], first["D7"], first["id_int"]) == (8, 8, 0x18FEF100)
    odd = rows["a.log", 1235.5]
    assert (odd["LEN"], odd["D0"], odd["D1"], odd["DATA"]) == (1, 0xAB, 0xC0, "ABC")
    assert rows["b.log", 1.0]["LEN"] == 3 and rows["b.log", 1.0]["D3"] == 0
    assert rows["c.log", 1704067200.001]["ID"] == "18FEF100"


def test_candump_round_trip(spark, tmp_path):
    frames = logs.frames_from_records(spark.createDataFrame([(i, i / 3, "can0", 256 + i, bytearray([i, 255])) for i in range(20)], "seq long, ts double, bus string, id long, data binary"))
    logs.write_candump(frames, str(tmp_path / "out"))
    back = logs.read_candump(spark, str(tmp_path / "out"), normalize=True)
    assert [(r["ID"], r["DATA"], r["TS"]) for r in back.sort("TS").collect()] == [(f"{256 + i:X}", f"{i:02X}FF", round(round(i / 3, 6), 6)) for i in range(20)]


def test_dbc(spark, tmp_path):
    (tmp_path / "x.dbc").write_text(
        'BO_ 2565866496 Normal: 8 V\n SG_ Sel M : 8|4@1+ (1,0) [0|0] "" V\n SG_ A m3 : 16|16@1- (0.5,1) [0|0] "rpm" V\n SG_ B : 7|8@0+ (0,0) [0|0] "" V\n'
        'BO_ 291 Empty: 0 V\n SG_ C : 0|32@1- (1,0) [0|0] "" V\nSIG_VALTYPE_ 291 C : 1;\nCM_ SG_ 291 C "note";\n'
    )
    rows = {r["signal_name"]: r for r in dictionaries.read_dbc(spark, str(tmp_path)).collect()}
    a, b, c = rows["A"], rows["B"], rows["C"]
    assert (a["mux_start"], a["mux_bytes"], a["mux_value"], a["type"], a["scale"], a["frame_id"]) == (1, 1, 3, "int", 0.5, 2565866496 & 0x1FFFFFFF)
    assert (b["le"], b["scale"], b["mux_value"]) == (False, 1.0, None)
    assert (c["type"], c["message_len"], c["description"]) == ("float32", 4, "note")


def test_dbc_encodings(spark, tmp_path):
    body = 'BO_ 5 M: 8 V\r\n SG_ A : 0|8@1+ (1,0) [0|0] "°C €" V\r\n'
    (tmp_path / "new.dbc").write_bytes(body.encode())
    (tmp_path / "old.dbc").write_bytes(body.encode("cp1252"))
    got = {r["dict_name"][-7:]: r["unit"] for r in dictionaries.read_dbc(spark, str(tmp_path)).collect()}
    assert got == {"new.dbc": "°C €", "old.dbc": "°C €"}


def test_dictionary_csvs(spark, tmp_path):
    (tmp_path / "g.csv").write_text("PGN,PGN Priority,PGN Max Size,PGN Byte Offset,Parameter Length (Bytes),Description,Scale/Resolution,Offset,Unit\n61444,3,8,3,2,Engine RPM,0.125,0,rpm\n61444,3,8,1,1,Engine RPM,0,0,%\n")
    g = dictionaries.read_dictionary_csv(spark, str(tmp_path / "g.csv")).sort("start_bit").collect()
    assert [(r["signal_name"], r["start_bit"], r["scale"], r["pgn"]) for r in g] == [("Engine_RPM_2", 8, 1.0, 61444), ("Engine_RPM", 24, 0.125, 61444)]
    (tmp_path / "s.csv").write_text("CAN ID,Message,Parameter,Unit,Start Bit,Length (bits),Byte Order,Value Type,Scale,Offset,MUX Start,MUX bytes,MUX value\n123,M,X,u,16,8,big_endian,int,2,0,1,1,7\n")
    s = {r["signal_name"]: r for r in dictionaries.read_dictionary_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert set(s) == {"X", "MUX_1"} and (s["X"]["mux_value"], s["X"]["le"], s["MUX_1"]["start_bit"]) == (7, False, 8)
    with pytest.raises(ValueError):
        dictionaries.csv_schema(spark.createDataFrame([(1,)], "x int"))


def test_readings(spark, tmp_path):
    rows = [(float(i), i, "v", 10.0 if i != 5 else 100.0, "u", 0.9, "r", "m", "") for i in range(8)] + [(9.0, 9, "v", None, "u", 0.9, "r", "m", "")]
    table = spark.createDataFrame(rows, readings.SCHEMA)
    got = {r["frame"]: r["confidence"] for r in readings.penalised(table).collect()}
    assert got[4] == 0.9 and abs(got[5] - 0.9 * 0.08) < 1e-12 and got[6] == 0.9
    assert readings.to_series(readings.penalised(table)).count() == 7
    readings.write_readings(table, str(tmp_path / "r"))
    assert readings.read_readings(spark, str(tmp_path / "r")).count() == 9


def test_series_columns(spark):
    s = spark.createDataFrame([("l", "a", 0.0, 0, 1.0), ("l", "a", 1.0, 1, 2.0), ("l", "b", 0.5, 0, 3.0)], "log_id string, series_id string, TS double, seq long, value double")
    rows = sinks.series_columns(s, ["a", "b"]).sort("row").collect()
    assert rows[0]["b Value"] == 3.0 and rows[1]["b Value"] is None and rows[1]["a Timestamp"] == 1.0


def test_each_pattern_of_a_line_is_matched_once(spark):
    lines = spark.createDataFrame([("a", 0, "(1.500000) can0 1A [2] 0A FF"), ("a", 1, "(1.x) can0 1A [2] 0A FF"), ("a", 2, "noise")], "log_id string, seq long, line string")
    out = logs.normalize_frames(logs.parse_lines(lines.select("log_id", "seq", F.concat("line", F.lit("")).alias("value")), "spaced"))
    assert [(r["seq"], r["TS"], r["ID"], r["DATA"], r["LEN"], r["D1"]) for r in out.collect()] == [(0, 1.5, "1A", "0AFF", 2, 255)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(line") <= 1 and plan.count("RLIKE(") <= 2  # of the line and of its id


def test_penalty_passes_regions_in_batches(spark):
    """a region's readings pass the worker batch by batch; the history goes on across batches."""
    values = [10.0, 10.0, 10.0, 100.0, None, 11.0, 22.0, float("nan"), 23.0, 23.0, 23.0, 24.0, 10.0]
    rows = [(float(i), i, v, x, "km", 1.0 if i != 5 else None, "r", "ocr", "") for v in ("b", "a") for i, x in enumerate(values)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        out = readings.penalised(spark.createDataFrame(rows[::-1], readings.SCHEMA))
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["variable"], r["frame"]): r["confidence"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # the history stays 10, 10, 10: 6 are allowed, jumps of 12 to 14 lie between 1.8 and 2.5 times that
    want = [1.0, 1.0, 1.0, 0.08, 1.0, None, 0.18, 1.0, 0.18, 0.18, 0.18, 0.18, 1.0]
    assert [got["a", i] for i in range(13)] == want == [got["b", i] for i in range(13)]
