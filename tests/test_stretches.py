"""The prefix scan over stretches of time against one window for a key."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.operators import candidates, diff, muxfind, series, stretches, summary, transport
from busfleet.functions.bits import BYTES

DDL = "log_id string, ID string, TS double, seq long, x int, y string"


def rows(n=600, seed=1):
    rng, t = random.Random(seed), 0.0
    for k in range(n):
        t += rng.choice((0.0, 0.0, 0.5, 40.0)) if k % 97 else 5000.0
        yield "a" if k % 3 else "b", rng.choice(("p", "p", "p", "q")), t, k, rng.choice((None, 1, 2, 3)), rng.choice((None, "u", "v"))


@pytest.mark.parametrize("size", [7, 1 << 18])
def test_running(spark, monkeypatch, size):
    monkeypatch.setattr(stretches, "ROWS", size)
    table = spark.createDataFrame([*rows(), ("c", "p", 3.0, 1, 5, "w"), ("c", "p", 3.0, 2, None, None)], DDL).repartition(3)
    by = Window.partitionBy("log_id", "ID").orderBy("TS", "seq")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    want = table.withColumns({
        "l": F.lag("x").over(by), "k": F.last("y", ignorenulls=True).over(upto), "p": F.last("x", ignorenulls=True).over(before), "t": F.coalesce(F.sum("x").over(upto), F.lit(0)), "f": F.first("TS").over(by),
        "n": F.count(F.lit(1)).over(Window.partitionBy("log_id", "ID")),
    })
    got = stretches.running(table, ["log_id", "ID"], lag={"l": F.col("x")}, last={"k": F.col("y")}, prior={"p": F.col("x")}, total={"t": F.col("x")}, first={"f": F.col("TS")}, size="n")
    assert got.columns == want.columns[: len(table.columns)] + ["l", "k", "p", "t", "f", "n"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def one_id(spark, n=900):
    """A log of one id."""
    rng = random.Random(4)
    table = [("log", k, k / 10, "18FEF100", 0x18FEF100, 8, *(rng.choice((k % 256, 3, rng.randrange(256))) for _ in BYTES)) for k in range(n)]
    frames = spark.createDataFrame(table, "log_id string, seq long, TS double, ID string, id_int long, LEN int, " + ", ".join(f"{c} int" for c in BYTES))
    return frames.withColumn("DATA", F.concat(*(F.lpad(F.hex(c), 2, "0") for c in BYTES)))


def results(spark):
    frames = one_id(spark)
    points = frames.select("log_id", F.col("ID").alias("series_id"), "TS", "seq", F.col("D3").cast("double").alias("value"))
    specs = candidates.specs(spark, 8, orders=("le",), types=("uint",), longest=16)
    yield summary.frame_summary(frames)
    yield summary.byte_changes(frames)
    yield summary.byte_update_periods(frames)
    yield summary.changed_bytes(frames)
    yield diff.byte_diff(diff.default_windows(frames, 0.4)).select("byte", "class", "n_a", "n_b", "change_ratio_a", "counter_b", F.round("score", 9))
    yield candidates.scan(frames, specs).select("spec_id", "frames", "changes", "distinct_values", "first_values", F.round("score", 9), "category")
    yield series.minmax_downsample(points, 50)
    yield series.stride_sample(points, 70)


def test_one_id_in_many_tasks(spark, monkeypatch):
    want = [sorted(map(str, df.collect())) for df in results(spark)]
    monkeypatch.setattr(stretches, "ROWS", 50)
    assert [sorted(map(str, df.collect())) for df in results(spark)] == want
    held = stretches.stretched(one_id(spark)).groupBy("ID", "__s").count().collect()
    assert len(held) > 15 and max(r["count"] for r in held) <= 60


def announced(size, packets):
    return [0x20, size % 256, size // 256, packets, 0xFF, 0x01, 0xFE, 0]


def test_sessions_across_stretches(spark, monkeypatch):
    """Odd numberings, repeats, missing parts and interleaved sources, with a session over several stretches."""
    rng, table, t = random.Random(9), [], 0

    def put(sa, opens, data):
        nonlocal t
        t += 1
        table.append(("log", t, float(t), (0x18ECFF00 if opens else 0x18EBFF00) + sa, 8, *data))

    for _ in range(40):
        for sa in (1, 2):
            n = rng.randrange(2, 9)
            numbers = list(range(1, n + 1))
            if rng.random() < 0.3:
                numbers = sorted(rng.sample(range(1, 20), n))
            if rng.random() < 0.3:
                numbers.insert(rng.randrange(n), rng.choice(numbers))
            put(sa, True, announced(7 * n - rng.randrange(7), n))
            for k in numbers:
                put(sa, False, [k, *(rng.randrange(256) for _ in range(7))])
                if rng.random() < 0.2:
                    put(3 - sa, False, [k, *(rng.randrange(256) for _ in range(7))])
    frames = spark.createDataFrame(table, "log_id string, seq long, TS double, id_int long, LEN int, " + ", ".join(f"{c} int" for c in BYTES))

    def expected():
        open_, out = {}, []
        for _, _, ts, id_int, _, *d in table:
            sa = id_int % 256
            if id_int >> 16 & 0xFF == 0xEC:
                open_[sa] = (d[1] + 256 * d[2], d[3], {})
            elif sa in open_:
                size, packets, parts = open_[sa]
                parts[d[0]] = bytes(d[1:])
                if len(parts) == packets:
                    out.append((ts, sa, b"".join(parts.get(i + 1, bytes(7)) for i in range(-(-size // 7)))[:size]))
                    del open_[sa]
        return sorted(out)

    for size in (1 << 18, 11):
        monkeypatch.setattr(stretches, "ROWS", size)
        got = sorted((r.TS, r.sa, bytes(r.data)) for r in transport.bam_messages(frames).collect())
        assert got == expected() and len(got) > 60
    groups = transport.frame_groups(frames).where("not opens").collect()
    assert groups and all(r.announced in (0xFE01, None) for r in groups)


def test_look_ups_by_stretches(spark, monkeypatch):
    """No window looks over all rows that follow, and small stretches give what brute force gives."""
    monkeypatch.setattr(stretches, "ROWS", 7)
    rng = random.Random(8)
    rows = [("log", name, float(rng.randrange(60)), i, float(i)) for i, name in enumerate("ab" * 40)] + [("log", "c", 30.0, 99, 1.0), ("one", "a", 5.0, 1, 2.0)]
    s = spark.createDataFrame(rows, "log_id string, series_id string, TS double, seq long, value double")
    times = [-1e15, -5.0, 0.0, 12.0, 12.5, 30.0, 41.0, 59.0, 80.0, 1e15]
    p = spark.createDataFrame([(t,) for t in times], "probe double")
    around, strict = series._around(s, p), series.neighbours(s, p)
    for found in (around, strict):
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString()
    keys = sorted({r[:2] for r in rows})
    own = lambda k: sorted(r[2:] for r in rows if r[:2] == k)
    last, first = lambda x: (x[-1][0], x[-1][2]) if x else (None, None), lambda x: (x[0][0], x[0][2]) if x else (None, None)
    want = {(*k, t, *last([x for x in own(k) if x[0] <= t]), *first([x for x in own(k) if x[0] >= t])) for k in keys for t in times}
    assert {tuple(r) for r in around.collect()} == want and around.count() == len(want)
    want = {(*k, t, last([x for x in own(k) if x[0] < t])[0], first([x for x in own(k) if x[0] > t])[0]) for k in keys for t in times}
    assert {tuple(r) for r in strict.collect()} == want and strict.count() == len(want)


def test_transport_frames_move_once(spark, monkeypatch):
    """Messages come from stored sessions, whole ones as they are; odd ones still by the general rules."""
    monkeypatch.setattr(stretches, "ROWS", 5)
    opens = lambda n, k: bytes([0x20, n, 0, k, 255, 0xCA, 0xFE, 0])
    data = lambda i, x: bytes([i] + [x] * 7)
    sent = [opens(14, 2), data(1, 1), data(2, 2), data(1, 9), opens(14, 2), data(2, 4), data(2, 5), data(1, 3), opens(14, 2), data(1, 7), opens(7, 1), data(1, 8)]
    cells = [("log", float(t), t, 0x18ECFF05 if b[0] == 0x20 else 0x18EBFF05, 8, *b) for t, b in enumerate(sent)]
    table = spark.createDataFrame(cells, "log_id string, TS double, seq long, id_int long, LEN int, " + ", ".join(f"{c} int" for c in BYTES))
    found = transport.bam_messages(table)
    assert found.inputFiles() and all("/sessions-" in f or "/spans-" in f for f in found.inputFiles())
    got = [(r.TS, r.pgn, bytes(r.data)) for r in found.sort("TS").collect()]
    assert got == [(2.0, 0xFECA, bytes([1] * 7 + [2] * 7)), (7.0, 0xFECA, bytes([3] * 7 + [5] * 7)), (11.0, 0xFECA, bytes([8] * 7))]


def test_multiplexer_groups_are_counted_whole_or_by_shuffles(spark, monkeypatch):
    """Groups of up to ROWS frames are counted in one place, larger ones by shuffles: the same results, floats among them."""
    rng = np.random.default_rng(3)
    rows = [("a", f"{i % 3}", 8 if i % 3 else 6, float(i // 2), i, *(int(x) for x in (rng.integers(3), rng.integers(2), *rng.integers(0, 256, 2), 0, rng.integers(0, 3) * 64, rng.integers(60, 66), 66))) for i in range(700)]
    f = spark.createDataFrame(rows, "log_id string, ID string, LEN int, TS double, seq long, " + ", ".join(f"D{i} int" for i in range(8))).withColumn("DATA", F.lit("")).localCheckpoint()
    got = []
    for bound in (1 << 18, 240, 10):  # all groups whole, then none of them
        monkeypatch.setattr(stretches, "ROWS", bound)
        decodes = muxfind.decode_candidates(f).select("ID", "prefix_len", "prefix", "label", "n", "distinct_values", F.round("score", 8), "rank")
        entropy = muxfind.entropies(f).select("ID", "prefix_len", "prefix", "support", F.round("entropy", 9))
        got.append((sorted(map(tuple, decodes.collect())), sorted(map(tuple, entropy.collect()))))
    assert got[0] == got[1] == got[2] and any("f32" in r[3] for r in got[0][0])
    monkeypatch.setattr(stretches, "ROWS", 1 << 18)
    monkeypatch.setattr(muxfind, "WHOLE", 16)  # groups are cut off one by one
    assert got[0][1] == sorted(map(tuple, muxfind.entropies(f).select("ID", "prefix_len", "prefix", "support", F.round("entropy", 9)).collect()))
