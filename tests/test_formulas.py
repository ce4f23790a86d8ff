"""Formulas over series, raw frames and transport messages; names made unique; signals beyond eight bytes."""

import random

import numpy as np
import pandas as pd
import pytest

from busfleet.functions.bits import BYTES
from busfleet.operators import derive
from busfleet.sources import dictionaries

FRAMES = "log_id string, TS double, seq long, id_int long, LEN int, " + ", ".join(f"{c} int" for c in BYTES)


def inputs(spark, n=300):
    series = spark.createDataFrame([("a" if k % 2 else "b", "s", k * 1.0, k, float(k)) for k in range(n)], "log_id string, series_id string, TS double, seq long, value double")
    frames = spark.createDataFrame([("a", k * 0.5, k, 0x18FE0000 + (k % 2) * 256, 8, *[k % 256] * 8) for k in range(2 * n)], FRAMES)
    messages = spark.createDataFrame([("a", k * 7.0, k % 3, 0xFE00, bytes([k % 256] * 9)) for k in range(n // 7)], "log_id string, TS double, sa int, pgn long, data binary")
    return series, frames, messages


def looks_back(given):
    """At each message, the frames of a group in the ten seconds before and the series' newest value in them."""
    ts, data = given.messages(0xFE00)
    at, payload, _ = given.raw_frames(pgn=0xFE00)
    own, values = given.get("s", (np.zeros(0), np.zeros(0)))
    last = np.searchsorted(own, ts, "right") - 1
    fresh = (last >= 0) & (np.append(own, np.nan)[last] >= ts - 10)
    return ts, np.array([d[8] for d in data], float) + np.searchsorted(at, ts, "right") - np.searchsorted(at, ts - 10) + np.where(fresh, np.append(values, 0)[last], 0)


def test_stretches_give_what_whole_logs_give(spark):
    series, frames, messages = inputs(spark)
    run = lambda **k: sorted((r.log_id, r.TS, r.value) for r in derive.formula_grouped(series, looks_back, frames=frames, messages=messages, **k).collect())
    whole = run()
    assert len(whole) == 42 and whole == run(stretch=25.0, lead=10.0) == run(stretch=1000.0, lead=10.0)


def test_formula_gets_what_it_reads(spark):
    """only what a formula says it reads goes to its task, payloads stay in the Arrow column, and results are the same."""
    series, frames, messages = inputs(spark)
    series = series.unionByName(series.selectExpr("log_id", "'other' as series_id", "TS", "seq", "value"))
    frames = frames.unionByName(frames.selectExpr("log_id", "TS", "seq", "id_int + 65536 * 2 as id_int", "LEN", *BYTES))
    run = lambda f=looks_back, **k: sorted((r.log_id, r.TS, r.value) for r in derive.formula_grouped(series, f, frames=frames, messages=messages, stretch=25.0, lead=10.0, **k).collect())
    assert run() == run(reads={"series": ["s"], "groups": [0xFE00], "messages": [0xFE00]}) != []

    def sizes(given):
        ts, payloads = given.messages(0xFE00)
        return ts, np.array([len(given._frames) + 1000 * len(given) + isinstance(payloads, list)] * len(ts), float)

    assert max(v for *_, v in run(sizes)) > 2000 > 1070 > max(v for *_, v in run(sizes, reads={"series": ["s"], "groups": [0xFE00], "messages": [0xFE00]})) > 1000
    with pytest.raises(Exception, match="is not among the groups"):
        run(reads={"series": ["s"], "ids": [5], "messages": [0xFE00]})
    with pytest.raises(Exception, match="is not among the series"):
        run(reads={"groups": [0xFE00], "messages": [0xFE00]})


def test_formula_errors(spark):
    series, *_ = inputs(spark, 6)
    with pytest.raises(Exception, match="two arrays of one length"):
        derive.formula_grouped(series, lambda g: (g["s"][0], g["s"][1][1:])).collect()
    with pytest.raises(Exception, match="no series 'other' here"):
        derive.formula_grouped(series, lambda g: g.signal("other")).collect()
    assert derive.formula_grouped(series, lambda g: g.messages(1)[0:1] * 2).collect() == []


def test_fields_of_messages(spark):
    data = bytes(range(1, 31))
    messages = spark.createDataFrame([("a", 1.0, 3, 0xFE00, data), ("a", 2.0, 4, 0xFE00, data[:5])], "log_id string, TS double, sa int, pgn long, data binary")
    read = lambda **field: [r.value for r in derive.source({"kind": "bam", "pgn": 0xFE00, **field}, "x", messages=messages).orderBy("TS").collect()]
    assert read(start_bit=7, length=16, le=False) == [258.0, 258.0]
    assert read(start_bit=0, length=16) == [513.0, 513.0]
    assert read(start_bit=64, length=64, type="int") == [float(int.from_bytes(data[8:16], "little"))]
    assert read(start_bit=39, length=24, le=False, scale=0.5) == [int.from_bytes(data[4:7], "big") / 2]
    assert read(start_bit=0, length=8, mux_start=1, mux_bytes=2, mux_value=0x0203) == [1.0, 1.0]
    assert read(start_bit=0, length=8, mux_start=4, mux_bytes=2, mux_value=0x0500) == [1.0]  # a byte beyond the end is 0
    assert read(start_bit=0, length=8, source=4) == [1.0]


def test_unique_names(spark):
    rng = random.Random(7)
    names = ["a", "a", "a_2", "a_2", "a_2_2", "_2", "", "", "_2"] + [f"{rng.choice('ab')}{rng.choice(['', '_2', '_3', '_2_2'])}" for _ in range(150)]
    rows = [("d", k, n) for k, n in enumerate(names)] + [("e", 0, "a"), ("e", 1, "a")]
    taken, want = set(), []
    for scope, k, base in rows:
        found, i = base, 2
        while (scope, found) in taken:
            found, i = f"{base}_{i}", i + 1
        taken.add((scope, found))
        want.append((scope, k, found))
    got = dictionaries.unique_names(spark.createDataFrame(rows, "dict_name string, line long, name string"), "name", ["line"])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_formula_frames_are_not_copied_whole():
    """Frames come as they are, one word for their bytes; those asked for are put in order and taken apart."""
    raw = pd.DataFrame({"TS": [2.0, 1.0, 1.0], "seq": [2, 1, 0], "id_int": [5, 5, 6], "pgn": [None, None, 1.0], "LEN": [8, 2, 8], "w": [-2, 0x0201, 0]})
    given = derive.Inputs(pd.DataFrame({"series_id": ["s", "s"], "TS": [3.0, 1.0], "seq": [0, 1], "value": [7.0, 8.0]}), raw)
    ts, data, sizes = given.raw_frames(id=5)
    assert given._frames is raw and ts.tolist() == [1.0, 2.0] and sizes.tolist() == [2, 8]
    assert data.tolist() == [[1, 2, 0, 0, 0, 0, 0, 0], [254, *[255] * 7]] and data.dtype == np.int32
    assert given["s"][0].tolist() == [1.0, 3.0] and given["s"][1].tolist() == [8.0, 7.0]
