"""Streams give what batches give."""

import os
import random

from pyspark.sql import functions as F

from busfleet.operators import diff, summary, transport
from busfleet.sources import logs
from busfleet.streaming import live
from tests.test_operators import bam, frames


def files(spark, rows, folder, parts):
    size = -(-len(rows) // parts)
    for k in range(parts):
        body = "".join(f"({t:.6f}) can0 {i:X}#{d.hex().upper()}\n" for t, i, d in rows[k * size : (k + 1) * size])
        (folder / f"{k:03d}.log").write_text(body)
        os.utime(folder / f"{k:03d}.log", (1e9 + k, 1e9 + k))  # files are taken in order of change
    return logs.stream_frames(spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)))


def test_latest_equals_batch(spark, tmp_path):
    rows = [(i, 256 + i % 3, bytes([i % 256, i % 5, 9])) for i in range(60)]
    (tmp_path / "in").mkdir()
    stream = live.latest(files(spark, rows, tmp_path / "in", 4))
    live.run_once(stream, live.append_updates(str(tmp_path / "out")), str(tmp_path / "state"), "update")
    got = {r["ID"]: r for r in live.upserted(live.read_updates(spark, str(tmp_path / "out"), live.LATEST), live.KEY).collect()}
    want = {r["ID"]: r for r in summary.frame_summary(frames(spark, rows)).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert (r["frames"], r["period_min"], r["period_max"]) == (want[k]["frames"], want[k]["period_min"], want[k]["period_max"])
        assert r["uniques"][:3] == [20, 5, 1] and r["ever_changed"] and r["changed_bytes"] == [0, 1]


def test_stream_of_transport(spark, tmp_path):
    rows = bam(0xFECA, bytes(range(20))) + bam(0xFECB, bytes(range(30)), 5.0)
    (tmp_path / "in").mkdir()
    stream = live.bam_messages(files(spark, rows, tmp_path / "in", 3))
    live.run_once(stream, live.append_updates(str(tmp_path / "out")), str(tmp_path / "state"), "append")
    got = live.read_updates(spark, str(tmp_path / "out"), "log_id string, TS double, sa int, pgn long, data binary")
    want = transport.bam_messages(frames(spark, rows))
    assert sorted((r["pgn"], bytes(r["data"])) for r in got.collect()) == sorted((r["pgn"], bytes(r["data"])) for r in want.collect())


def run(spark, stream, folder, name, ddl, mode="update"):
    live.run_once(stream, live.append_updates(str(folder / name)), str(folder / f"{name}-state"), mode)
    return live.read_updates(spark, str(folder / name), ddl)


def test_live_difference_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(float(i), 256 + i % 2, bytes([i * 40 % 256, i // 7 % 256, rng.randrange(3), 9][: 3 + i % 3 % 2])) for i in range(200)]
    (tmp_path / "in").mkdir()
    stream = lambda: files(spark, rows, tmp_path / "in", 4)
    present = live.upserted(run(spark, live.running(stream()), tmp_path, "running", live.RUNNING), ["log_id", "ID"])
    counts = live.upserted(run(spark, live.byte_counts(stream()), tmp_path, "counts", "log_id string, ID string, byte int, value int, n long"), ["log_id", "ID", "byte", "value"])
    whole = frames(spark, rows).withColumn("log_id", F.lit(counts.first()["log_id"]))
    base = diff.byte_observations(whole.where("TS < 60").withColumn("side", F.lit("a")))
    tagged = whole.where("TS < 60").withColumn("side", F.lit("a")).unionByName(whole.withColumn("side", F.lit("b")))
    columns = ["ID", "byte", "class", "n_a", "n_b", "new_values", "lost_values", "mean_delta", "counter_b", "change_ratio_b", "first_b", "last_b", "score", "u", "z"]
    got, want = (sorted(map(str, d.select(*columns).collect())) for d in (live.live_difference(base, counts, present), diff.byte_diff(tagged)))
    assert got == want and len(got) == 8
    carries = ["ID", "low", "high", "wraps", "carries", "is_16bit"]
    assert sorted(live.live_carries(present).select(*carries).collect()) == sorted(diff.carry_hints(whole).select(*carries).collect())


def test_rules_resets_and_rollup(spark, tmp_path):
    rows = [(float(i), 256, bytes([i % 2, i // 20, 7])) for i in range(60)]
    (tmp_path / "in").mkdir()
    rules = spark.createDataFrame([("100", None, [1]), ("100", 3, [0])], "can_id string, length int, mux_bytes array<int>").withColumn("position", F.when(F.col("length") == 3, 0).otherwise(1))
    stream = files(spark, rows, tmp_path / "in", 3)
    got = live.upserted(run(spark, live.latest(stream, rules, hold=25.0), tmp_path, "cases", live.LATEST), live.KEY)
    by = {r["mux_label"]: r for r in got.collect()}
    assert set(by) == {"00", "01"} and by["00"]["uniques"][:3] == [0, 3, 1] and by["01"]["frames"] == 30
    assert by["00"]["highlighted_bytes"] == [1] and by["00"]["changed_at"][1] == 40.0
    later = {r["mux_label"]: r["highlighted_bytes"] for r in live.expired(got, 66.0, 25.0).collect()}
    assert later == {"00": [], "01": [1]}
    one = live.rollup(got).first()
    assert one["uniques"][:3] == [0, 3, 1] and one["frames"] == 60 and one["period_mean"] == 2.0
    log = got.first()["log_id"]
    marks = spark.createDataFrame([(log, 45.0)], "log_id string, TS double")
    fresh = live.upserted(run(spark, live.latest(live.with_epoch(files(spark, rows, tmp_path / "in", 3), marks)), tmp_path, "epochs", live.LATEST), live.KEY)
    assert {r["mux_label"]: r["frames"] for r in fresh.collect()} == {"0|": 45, "1|": 15}


def test_timer_ends_highlights(spark, tmp_path):
    rows = [(100.0, 256, b"\x01"), (101.0, 256, b"\x02")] + [(100.0 + t, 257, b"\x01") for t in range(2, 40)]
    (tmp_path / "in").mkdir()
    out = run(spark, live.latest(files(spark, rows, tmp_path / "in", 4), hold=3.0, late="0 seconds"), tmp_path, "timed", live.LATEST)
    seen = [r["highlighted_bytes"] for r in out.where("ID = '100'").orderBy("batch").collect()]
    assert seen[0] == [0] and seen[-1] == []


def test_precedence_of_dictionaries(spark, tmp_path):
    from busfleet.operators import decode

    entry = lambda name, priority, scale: (name, "exact", True, priority, f"M{name}", 8, 256, None, "S", 0, 8, True, scale, 0.0, "uint", 0, 0, None, "", "")
    d = spark.createDataFrame([entry("b", 2, 10.0), entry("a", 1, 1.0)], decode.DDL)
    (tmp_path / "in").mkdir()
    out = run(spark, live.decoded(files(spark, [(0.0, 256, b"\x05"), (1.0, 0xE0000100, b"\x06")], tmp_path / "in", 1), d), tmp_path, "out", "log_id string, message_name string, value double", "append")
    assert sorted((r["message_name"], r["value"]) for r in out.collect()) == [("Ma", 5.0), ("Ma", 6.0)]


def test_late_rows_go_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(float(t), 256, b"\x01") for t in (0, 50, 100)] + [(float(t), 256, b"\x01") for t in (20, 95, 130)]
    stream = files(spark, rows, tmp_path / "in", 2).select("TS", "seq")
    live.run_once(stream, live.late_to_side(str(tmp_path / "out"), 30.0), str(tmp_path / "state"), "append")
    times = lambda name, ddl: sorted(r["TS"] for r in live.read_updates(spark, str(tmp_path / "out" / name), ddl).collect())
    assert times("rows", "TS double") == [0.0, 50.0, 95.0, 100.0, 130.0]
    late = live.read_updates(spark, str(tmp_path / "out" / "late"), "TS double, reason string").collect()
    assert [(r["TS"], r["reason"]) for r in late] == [(20.0, "older than 70.000000")]


def test_order_holds_when_a_group_comes_in_chunks(spark, tmp_path):
    """A group larger than an Arrow batch is taken in order of time as a whole, not chunk by chunk."""
    rng = random.Random(3)
    rows = [(float(i), 256, bytes([rng.randrange(256) for _ in range(4)])) for i in range(80)]
    message = [(100 + t, i, d) for t, i, d in bam(0xFECA, bytes(range(200)))]
    mixed = rows + message
    rng.shuffle(mixed)
    whole = frames(spark, rows)
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        stream = lambda: files(spark, mixed, tmp_path / "in", 1)
        running = run(spark, live.running(stream()), tmp_path, "running", live.RUNNING).where("ID = '100'").first()
        latest = run(spark, live.latest(stream()), tmp_path, "latest", live.LATEST).where("ID = '100'").first()
        rates = run(spark, live.rates(stream(), 1000.0), tmp_path, "rates", live.RATES).where("ID = '100'").first()
        got = run(spark, live.bam_messages(stream()), tmp_path, "bam", "log_id string, TS double, sa int, pgn long, data binary", "append").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = summary.frame_summary(whole).first()
    changes = sum(a != b for x, y in zip(rows, rows[1:]) for a, b in zip(x[2], y[2]))
    assert (running["payload_changes"], running["period_min"], running["period_max"]) == (want["payload_changes"], 1.0, 1.0)
    assert (latest["seq"] is not None, latest["TS"], latest["periods"], latest["period_max"]) == (True, 79.0, 79, 1.0)
    assert (rates["frames"], rates["changes"], rates["late"]) == (80, changes, 0)
    assert [bytes(r["data"]) for r in got] == [bytes(range(200))]


def test_transport_frames_move_packed(spark, tmp_path):
    """a source's frames of an Arrow batch are one row of 25 bytes a frame; odd sessions over several batches give what the batch gives."""
    rng = random.Random(11)
    rows = []
    for k in range(40):
        data, sa, at = bytes(rng.randrange(256) for _ in range(rng.randrange(9, 60))), k % 3, k * 10.0
        message = [(at + t / 1000, i, d) for t, i, d in bam(0xFE00 + k, data, sa=sa)]
        if k % 5 == 1:  # a number that repeats before the end and one after it
            message[2:2] = [(message[1][0] + 1e-5, message[1][1], message[1][2][:1] + bytes(7)), (at + 5.0, message[1][1], b"\x01" + bytes(7))]
        if k % 7 == 2:  # stays incomplete
            message.pop()
        if k % 7 == 3:  # numbers with a gap, and a 0 that counts for nothing
            message = [message[0], *((t, i, bytes([d[0] + 1]) + d[1:]) for t, i, d in message[1:]), (at + 6.0, message[1][1], bytes(8))]
        rows += message
    rows.sort()
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = run(spark, live.bam_messages(files(spark, rows, tmp_path / "in", 4)), tmp_path, "bam", "log_id string, TS double, sa int, pgn long, data binary", "append").collect()
        moved = live.packed(transport.transport_words(frames(spark, rows).coalesce(1))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = transport.bam_messages(frames(spark, rows)).collect()
    key = lambda r: (round(r["TS"], 6), r["sa"], r["pgn"], bytes(r["data"]))
    assert len(want) > 30 and sorted(map(key, got)) == sorted(map(key, want))
    assert sum(len(r["frames"]) for r in moved) == 25 * len(rows) and len(moved) < len(rows) / 3


def folded(rows):
    """Frames (TS, id, bytes) of each id, one after the other by the rules of ``live.latest``, in batches."""
    out = {}
    for batch in rows:
        for t, i, d in sorted(batch):
            s = out.get(i)
            if s is None:
                out[i] = {"TS": t, "DATA": d.hex().upper(), "received": 1, "frames": 1, "periods": [], "values": {(k, v) for k, v in enumerate(d + bytes(8 - len(d)))}, "changed_at": [None] * 8}
                continue
            gap, changed = round(t - s["TS"], 6), [k for k, (a, b) in enumerate(zip(bytes.fromhex(s["DATA"]), d)) if a != b]
            s["received"] += 1
            s["periods"] += [gap] if gap >= 0 else []
            if gap == 0 and not changed:
                continue
            s["frames"] += 1
            s["values"] |= {(k, v) for k, v in enumerate(d + bytes(8 - len(d)))}
            if gap >= 0:
                s |= {"TS": t, "DATA": d.hex().upper(), "changed_at": [t if k in changed else at for k, at in enumerate(s["changed_at"])]}
    return {f"{i:X}": s for i, s in out.items()}


def test_latest_takes_keys_in_buckets(spark, tmp_path):
    """many keys share a state, and give what a fold of each key's frames gives: late, equal and repeated ones too."""
    rng = random.Random(7)
    # quarters of seconds repeat; a later part brings times of earlier ones
    parts = [[((base + rng.randrange(60)) / 4, 256 + rng.randrange(1500) % (20 if rng.random() < 0.5 else 1500), bytes([rng.randrange(2), 5, rng.randrange(3)])) for _ in range(1500)] for base in (0, 30, 10)]
    (tmp_path / "in").mkdir()
    # seq follows the place in the file, so equal times are put in the order in which the fold takes them
    stream = files(spark, [r for p in parts for r in sorted(p)], tmp_path / "in", 3)
    query = live.latest(stream, hold=3.0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(live.append_updates(str(tmp_path / "out"))).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= live.BUCKETS < 1000
    got = {r["ID"]: r for r in live.upserted(live.read_updates(spark, str(tmp_path / "out"), live.LATEST), live.KEY).collect()}
    want = folded(parts)
    assert set(got) == set(want) and len(got) > 1000
    for i, s in want.items():
        r, p = got[i], s["periods"]
        assert (r["TS"], r["DATA"], r["received"], r["frames"], r["periods"], r["changed_at"]) == (s["TS"], s["DATA"], s["received"], s["frames"], len(p), s["changed_at"])
        assert (r["period_min"], r["period_max"], r["period_mean"]) == ((min(p), max(p), sum(p) / len(p)) if p else (None, None, None))
        assert r["byte_values"] == sorted(256 * k + v for k, v in s["values"]) and r["ever_changed"] == any(t is not None for t in s["changed_at"])
        assert r["highlighted_bytes"] == [k for k, t in enumerate(s["changed_at"]) if t is not None and s["TS"] - t <= 3.0]


def test_decoded_leaves_frames_in_place(spark, tmp_path):
    """frames without a group, or of one, are no task of their own: the dictionary is sent to them."""
    from busfleet.operators import decode

    d = spark.createDataFrame([("b", "exact", True, 2, "M", 8, 256, None, "S", 0, 8, True, 1.0, 0.0, "uint", 0, 0, None, "", "")], decode.DDL)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # only what is asked for is broadcast, as with tables of unknown size
    try:
        plan = live.decoded(frames(spark, [(0.0, 256, b"\x05")]), d)
        assert [r["value"] for r in plan.collect()] == [5.0]
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert text.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in text


def test_refreshed_matrix_takes_the_batch_once(spark, tmp_path):
    """each use of a micro-batch would run the stream's aggregation again."""
    rows = frames(spark, [(float(i), 256 + i % 2, bytes([i % 2 * i % 7, 3, i][: 2 + i % 3 % 2])) for i in range(40)])
    taken = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            taken.add(b.num_rows)
            yield b

    moving = live.moving_bytes(rows)
    batch = moving.coalesce(1).mapInArrow(counted, moving.schema)
    live.refresh_matrix(lambda s: rows, str(tmp_path / "out"), 4)(batch, 0)
    assert taken.value == moving.count()
    got = live.live_matrix(spark, str(tmp_path / "out"))
    want = summary.matrix(rows, 4).where("series_id like '101:%'")
    columns = ["series_id", "bucket", "seq", "value", "has_movement"]
    assert sorted(map(str, got.where("series_id like '101:%'").select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
