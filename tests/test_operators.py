"""Operators on small frames, against values worked out by hand or in numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from busfleet.operators import candidates, decode, derive, diff, muxfind, series, summary, transport
from busfleet.sources.logs import frames_from_records

RECORD = "seq long, ts double, bus string, id long, data binary"


def frames(spark, rows):
    return frames_from_records(spark.createDataFrame([(i, float(t), "can0", id, bytearray(d)) for i, (t, id, d) in enumerate(rows)], RECORD), "log")


def signal(**changes):
    base = dict(dict_name="d", mode="exact", active=True, priority=1, message_name="M", message_len=8, frame_id=291, pgn=None, signal_name="S", start_bit=0, length=16, le=True, scale=1.0, offset=0.0, type="uint", mux_start=0, mux_bytes=0, mux_value=None, unit="", description="")
    return {**base, **changes}


def test_decode(spark):
    f = frames(spark, [(0, 291, b"\x34\x12"), (1, 291, b"\xff")])
    assert [r["value"] for r in decode.decode_signal(f, signal()).sort("seq").collect()] == [4660.0, 255.0]
    assert decode.decode_signal(f, signal(scale=0.5, offset=10.0)).sort("seq").first()["value"] == 2340.0
    table = spark.createDataFrame([tuple(signal(**c).values()) for c in ({}, {"signal_name": "T", "mux_bytes": 1, "mux_value": 0x34, "start_bit": 8, "length": 8}, {"signal_name": "U", "active": False})], decode.DDL)
    got = {(r["seq"], r["signal_name"]): r["value"] for r in decode.decode_all(f, table).collect()}
    assert got == {(0, "S"): 4660.0, (1, "S"): 255.0, (0, "T"): 18.0}
    assert decode.decode_columns(f, [signal(), signal(signal_name="B", length=8)]).sort("seq").first()["B"] == 0x34


def test_summary_order_is_time(spark):
    f = frames(spark, [(2, 1, b"\x02"), (0, 1, b"\x00"), (1, 1, b"\x01"), (1, 1, b"\x01")])
    r = summary.frame_summary(f).first()
    assert (r["frames"], r["distinct_payloads"], r["payload_changes"], r["period_min"], r["period_max"]) == (4, 3, 2, 0.0, 1.0)
    assert summary.select_ids(f, []).count() == 0 and summary.time_range(f, (0.5, None), (None, 1.5)).count() == 2
    assert {(r["ID"], r["kind"]) for r in summary.changed_set_delta(f.select("ID"), frames(spark, [(0, 1, b""), (0, 2, b"")])).collect()} == {("2", "added")}
    assert {(r["ID"], r["kind"]) for r in summary.changed_set_delta(f.select("ID"), frames(spark, [(0, 2, b"")])).collect()} == {("2", "reset")}


def test_observation_and_rank_test(spark):
    a, b = [5, 5, 5, 7, 7], [9, 9, 1, 7]
    f = frames(spark, [(i, 1, bytes([v])) for i, v in enumerate(a)] + [(10 + i, 1, bytes([v])) for i, v in enumerate(b)])
    tagged = diff.sides(f, (0, 9), (10, 20))
    o = {r["side"]: r for r in diff.byte_observations(tagged).collect()}
    assert (o["a"]["mean"], o["a"]["change_ratio"], o["a"]["first"], o["a"]["last"]) == (5.8, 0.25, 5, 7)
    r = diff.with_p(diff.byte_diff(tagged)).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u"] == u and r["class"] == "new_territory" and 0 < r["p_value"] <= 1


def test_exact_p():
    for n1, n2 in ((2, 3), (4, 4), (3, 6)):
        us = [sum(x > y for x in c for y in set(range(n1 + n2)) - set(c)) for c in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            low = min(u, n1 * n2 - u)
            assert math.isclose(diff.exact_p(u, n1, n2), min(1.0, 2 * sum(x <= low for x in us) / len(us)))


def bam(pgn, data, at=0.0, sa=0):
    n = -(-len(data) // 7)
    out = [(at, 0x18ECFF00 + sa, bytes([0x20, len(data) % 256, len(data) // 256, n, 255, pgn & 255, pgn >> 8 & 255, pgn >> 16]))]
    return out + [(at + 0.1 * (i + 1), 0x18EBFF00 + sa, bytes([i + 1]) + data[7 * i : 7 * i + 7].ljust(7, b"\xff")) for i in range(n)]


def test_transport(spark):
    data = bytes.fromhex("112233445566778899")
    rows = bam(0xFECA, data)
    cut = bam(0xFECB, bytes(range(20)), 1.0)[:-1]  # closed by the next announcement
    f = frames(spark, rows + cut + bam(0xFECA, data[::-1], 2.0) + [(3.0, 0x18EBFF00, bytes([1] + [0] * 7))])
    got = [(r["pgn"], round(r["TS"], 3), bytes(r["data"])) for r in transport.bam_messages(f).sort("TS").collect()]
    assert got == [(0xFECA, 0.2, data), (0xFECA, 2.2, data[::-1])]
    m = transport.bam_messages(f)
    assert m.sort("TS").select(transport.long_bits("data", 4, 12)).first()[0] == int.from_bytes(data, "little") >> 4 & 0xFFF
    assert transport.read_field(transport.chunks(m, 4), 0, "u8_le", "record").count() == 4


def values(rows):
    return [r["value"] for r in rows.sort("TS", "seq").collect()]


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60).round(3)
    return x, spark.createDataFrame([("l", "s", float(i), i, float(v)) for i, v in enumerate(x)], "log_id string, series_id string, TS double, seq long, value double")


def test_filters(wave):
    x, s = wave
    padded = np.r_[np.full(40, x[0]), x]
    last = lambda w: np.stack([padded[40 + i - w + 1 : 40 + i + 1] for i in range(len(x))])
    assert np.allclose(values(series.moving_average(s, 4)), last(4).mean(1))
    assert np.allclose(values(series.median_filter(s, 6)), np.median(last(6), 1))
    assert np.allclose(values(series.gaussian_filter(s, 1.5)), last(11) @ series.gaussian_weights(1.5))
    fit = [np.polyval(np.polyfit(np.arange(-6, 1), w, 2), 0) for w in last(7)]
    assert np.allclose(values(series.savgol_filter(s, 7, 2)), fit)
    assert values(series.savgol_filter(s, 2, 2)) == list(x)
    e = [x[0]]
    for v in x[1:]:
        e.append(e[-1] + 0.1 * (v - e[-1]))
    assert np.allclose(values(series.ema(s, 0.1)), e) and np.allclose(values(series.ema(s, 0.1, most_rows=7)), e)


def test_alignment_and_probes(spark):
    s = spark.createDataFrame([("l", "a", 0.0, 0, 0.0), ("l", "a", 2.0, 1, 4.0), ("l", "b", 1.0, 0, 7.0), ("l", "b", 1.0, 1, 8.0)], "log_id string, series_id string, TS double, seq long, value double")
    assert [(r["a"], r["b"]) for r in series.align(s, ["a", "b"]).sort("TS").collect()] == [(0.0, None), (0.0, 8.0), (4.0, 8.0)]
    p = spark.createDataFrame([(-1.0,), (1.0,), (5.0,)], "probe double")
    assert [r["value"] for r in series.value_at(s.where("series_id = 'a'"), p).sort("probe").collect()] == [0.0, 2.0, 4.0]
    assert [r["TS"] for r in series.nearest(s.where("series_id = 'a'"), p).sort("probe").collect()] == [0.0, 0.0, 2.0]
    w = {r["series_id"]: r for r in series.window_statistics(s, 0.0, 2.0).collect()}
    assert (w["a"]["n"], w["a"]["average"], w["a"]["delta"]) == (2, 2.0, 4.0)


def test_spectrum(spark):
    t = np.arange(0, 10, 0.05)
    s = spark.createDataFrame([("l", "s", float(a), i, float(2 * np.sin(2 * np.pi * 1.5 * a))) for i, a in enumerate(t)], "log_id string, series_id string, TS double, seq long, value double")
    peak = series.spectrum(s, 1024).sort("amplitude", ascending=False).first()
    assert abs(peak["frequency"] - 1.5) < 0.06 and abs(peak["amplitude"] - 2) < 0.35


def test_candidates(spark):
    f = frames(spark, [(i, 1, bytes([i % 256, 7, (i * 13) % 256, i % 2, 0, 0, 0, 0])) for i in range(60)])
    got = {(r["start_bit"], r["length"], r["le"], r["type"]): r for r in candidates.scan(f, candidates.specs(spark, shortest=8, longest=16)).collect()}
    assert got[0, 8, True, "uint"]["category"] == "counter" and got[8, 8, True, "uint"]["category"] == "constant" and got[24, 8, True, "uint"]["category"] == "binary"
    assert math.isclose(got[0, 8, True, "uint"]["autocorr"], 1.0, abs_tol=1e-9) and got[0, 8, True, "uint"]["first_values"] == [0, 1, 2, 3, 4, 5]
    best = candidates.clusters(candidates.kept(candidates.scan(f, candidates.specs(spark, shortest=8, longest=8, orders=("le",), types=("uint",))))).where("rank = 1")
    assert {r["start_bit"] for r in best.collect()} == {0, 16, 24}


def test_alignment_passes_over_nulls_at_equal_times(spark):
    """of rows with equal times the last one with a value counts, as in the SQL of ``formula``."""
    s = spark.createDataFrame([("l", "a", 1.0, 0, 2.0), ("l", "a", 1.0, 1, None), ("l", "b", 1.0, 2, 3.0), ("l", "a", 2.0, 3, None)], "log_id string, series_id string, TS double, seq long, value double")
    assert [(r["TS"], r["a"], r["b"]) for r in series.align(s, ["a", "b"]).sort("TS").collect()] == [(1.0, 2.0, 3.0), (2.0, 2.0, 3.0)]


def test_mux_patterns(spark):
    f = frames(spark, [(i, 1, bytes([i % 3, i, 7 * i % 256])) for i in range(30)])
    p = {(r["prefix_len"], r["prefix"]): r for r in muxfind.patterns(f).collect()}
    assert {k for k in p if k[0] == 1} == {(1, "00"), (1, "01"), (1, "02")} and p[1, "00"]["support"] == 10 and p[1, "01"]["best_decode"]


def test_derived(spark, wave):
    _, s = wave
    config = {"branches": [{"source": {"kind": "signal", "series_id": "s"}, "transforms": [("scale", 2)]}] * 2, "ops": ["sub"]}
    assert values(derive.derive(config, series=s)) == [0.0] * 60
    with pytest.raises(ValueError):
        derive.derive({**config, "ops": ["sub", "add"]}, series=s)
    grouped = derive.formula_grouped(s, lambda g: (g["s"][0], g["s"][1] + 1))
    assert np.allclose(np.array(values(grouped)) - 1, wave[0])


def test_overlaps_in_pieces(spark, monkeypatch):
    """the pairs of a message are spread over partitions, and are the same as in one."""
    from busfleet.operators import decode

    monkeypatch.setattr(decode, "PIECE_ROWS", 10)
    rows = [(f"m{i % 2}", f"s{i}", None if i % 3 else 1, i * 5 % 40, 12) for i in range(60)]
    d = spark.createDataFrame(rows, "message_name string, signal_name string, mux_value long, start_bit int, length int").coalesce(1)
    found = decode.overlapping_signals(d)
    got = [(r["message_name"], r["signal_a"], r["signal_b"]) for r in found.collect()]
    want = {(m, a, b) for m, a, x, s, k in rows for n, b, y, t, j in rows if m == n and a < b and x == y and s < t + j and t < s + k}
    assert set(got) == want and len(got) == len(want) and len([p for p in found.rdd.glom().map(len).collect() if p]) > 4


def test_overlaps_meet_by_intervals(spark, monkeypatch):
    """names meet the intervals of other names, not each other; repeated names and null ones give what the SQL gives."""
    monkeypatch.setattr(decode, "PIECE_ROWS", 7)
    rows = [(f"m{i % 2}", None if i == 5 else f"s{i % 31}", None, i * 5 % 40, 12) for i in range(60)] + [(None, "s1", None, 0, 8), ("m0", "s2", None, None, 8)]
    d = spark.createDataFrame(rows, "message_name string, signal_name string, mux_value long, start_bit int, length int")
    found = decode.overlapping_signals(d)
    d.createOrReplaceTempView("own_signals")
    want = spark.sql("""select a.message_name, a.signal_name as signal_a, b.signal_name as signal_b from own_signals a join own_signals b on a.message_name = b.message_name
        and a.signal_name < b.signal_name and a.start_bit < b.start_bit + b.length and b.start_bit < a.start_bit + a.length""")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 500
    assert "Generate explode(names" in found._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_measured_on_whole_batches(spark):
    """A scan's plan has no row per frame and field, and groups split over batches give the same."""
    f = spark.range(600).select(
        F.lit("a").alias("log_id"), F.concat(F.lit("1"), (F.col("id") % 7).cast("string")).alias("ID"), F.lit(8).alias("LEN"), F.col("id").cast("double").alias("TS"), F.col("id").alias("seq"),
        *((F.col("id") * (31 + i) % 256).cast("int").alias(f"D{i}") for i in range(8)),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        columns = ["ID", "spec_id", "frames", "changes", "distinct_values", "low", "high", "first_values", F.round("autocorr", 9)]
        small = sorted(map(tuple, candidates.scan(f).select(*columns).collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
        whole = candidates.scan(f)
        assert small == sorted(map(tuple, whole.select(*columns).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(small) == 7 * 114 and "seen#" in whole._jdf.queryExecution().optimizedPlan().toString()  # the stored sums of batches, no frames
    values = {(r["ID"], r["spec_id"]): r for r in whole.collect()}
    for spec in candidates.specs(spark).where("length = 24 and type = 'int' and start_bit < 24").collect():
        seen = [[(n * (31 + i)) % 256 for i in range(8)] for n in range(3, 600, 7)]
        at = spec.start_bit // 8
        x = [int.from_bytes(bytes(d[at : at + 3]), "little" if spec.le else "big", signed=True) for d in seen]
        r = values["13", spec.spec_id]
        assert (r["frames"], r["distinct_values"], r["low"], r["high"], r["first_values"]) == (len(x), len(set(x)), min(x), max(x), x[:6])
        assert abs(r["autocorr"] - min(1, abs(np.corrcoef(x[1:], x[:-1])[0, 1]))) < 1e-9
