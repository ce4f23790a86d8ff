"""Live operators on streams of frames: latest row by key, summaries, differences, coverage, transport.

State is kept by (log_id, ID, LEN, selector bytes) or coarser, so it is bounded by the number of ids, not
of frames. The engine keeps offsets and state in the checkpoint folder; the functions here only give plans.
"""

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from busfleet.functions.bits import BYTES, fits, mux_value, packed_be, packed_le, physical, raw_bits
from busfleet.functions.ids import ID_MASK, pgn_of
from busfleet.operators.summary import with_cases

KEY = ["log_id", "ID", "LEN", "mux_label"]
LATEST = (
    "log_id string, ID string, LEN int, mux_label string, TS double, seq long, DATA string, delta_t double, changed_bytes array<int>, received long, frames long, "
    "periods long, period_mean double, period_min double, period_max double, uniques array<int>, byte_values array<int>, ever_changed boolean, changed_at array<double>, highlighted_bytes array<int>"
)
#: State of ``latest``: the keys of a bucket as JSON and a row of HELD for each. word and last are bits, NaN is none.
STATE = "keys string, rows binary"
HELD = np.dtype([
    ("ts", "f8"), ("seq", "i8"), ("word", "i8"), ("delta", "f8"), ("received", "i8"), ("frames", "i8"), ("psum", "f8"), ("pmin", "f8"), ("pmax", "f8"), ("pn", "i8"),
    ("seen", "u1", 256), ("changed", "?"), ("changed_at", "f8", 8), ("last", "u1"), ("until", "f8"),
])
BUCKETS = 512


def names_of(ddl):
    return [c.split()[0] for c in ddl.split(", ")]


def with_epoch(frames, resets):
    """Frames with ``epoch``: how many control records (log_id, TS) of a reset lie at or before them."""
    marks = resets.groupBy("log_id").agg(F.array_sort(F.collect_list("TS")).alias("__marks"))
    return frames.join(marks, "log_id", "left").withColumn("epoch", F.coalesce(F.size(F.filter("__marks", lambda t: t <= F.col("TS"))), F.lit(0))).drop("__marks")


def keyed(frames, rules=None, epoch=None):
    """Frames with their case label, by a table of rules; the first rule of an id that fits a frame counts.

    A column ``epoch`` (see with_epoch), or the one given, is part of the label: a new one starts state
    afresh, after a reset or with changed rules.
    """
    rows = with_cases(frames, rules, "first") if rules is not None else frames.withColumns({"mux_bytes": F.expr("cast(array() as array<int>)"), "mux_label": F.lit("")})
    if epoch is None and "epoch" not in frames.columns:
        return rows
    now = F.col("epoch") if epoch is None else F.lit(epoch)
    return rows.withColumn("mux_label", F.concat_ws("|", now.cast("string"), "mux_label"))


def in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a micro-batch in order of time; the engine hands over a large group in chunks without order."""
    parts = [p for p in parts if len(p)]
    part = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return part.sort_values(["TS", "seq"])


def _counted(seen, data, masked):
    """The value sets of eight bytes, 32 bytes of bits each, with one more frame."""
    out = bytearray(seen)
    for i, v in enumerate(data):
        if i not in masked:
            out[32 * i + v // 8] |= 1 << v % 8
    return bytes(out)


def _values(seen):
    """The values in eight sets, as 256 * byte + value."""
    return [8 * k + j for k, b in enumerate(seen) if b for j in range(8) if b >> j & 1]


def _dealt(held, keys, new, hold):
    """Takes a bucket's new frames into its ``held`` rows: (held, keys, which keys the frames have, their highlights).

    Each key's frames follow its held row in order of time. A frame is compared with the last one before it that
    counts as the key's newest; which ones do is settled from the front, and so found by repeating until it holds.
    """
    known = len(held)
    code = pd.concat([keys, new[KEY]], ignore_index=True).groupby(KEY, sort=False, dropna=False).ngroup().to_numpy()
    added = np.zeros(code.max() + 1 - known, HELD)
    for c in ("delta", "pmin", "pmax", "changed_at", "until"):
        added[c] = np.nan
    keys = pd.concat([keys, new[KEY][code[known:] >= known].drop_duplicates()], ignore_index=True)
    ts, seq, word = (np.concatenate([held[a], new[b].to_numpy()]) for a, b in (("ts", "TS"), ("seq", "seq"), ("word", "word")))
    mask = np.concatenate([np.zeros(known, np.int32), new["masked"].to_numpy()])
    held = np.concatenate([held, added])
    real = np.arange(len(code)) >= known
    order = np.lexsort((seq, ts, real, code))
    code, ts, seq, word, mask, real = (x[order] for x in (code, ts, seq, word, mask, real))
    data = word.astype("<i8").view(np.uint8).reshape(-1, 8)
    open_bits = np.unpackbits(~mask.astype(np.uint8), bitorder="little").reshape(-1, 8).astype(bool)
    first, place = np.diff(code, prepend=-1) != 0, np.arange(len(code))
    newest = np.round(ts - ts[np.maximum.accumulate(np.where(first, place, 0))], 6) >= 0
    while True:
        upto = np.maximum.accumulate(np.where(newest, place, 0))
        before = np.where(first, place, np.roll(upto, 1))
        gap, moved = np.round(ts - ts[before], 6), (data != data[before]) & open_bits
        again = first | (gap > 0) | (gap == 0) & moved.any(axis=1)
        if (again == newest).all():
            break
        newest = again
    shown = real & (newest | (gap < 0))
    timed, step = real & ~first & (gap >= 0), real & ~first & newest
    held["received"] += np.bincount(code[real], minlength=len(held))
    held["frames"] += np.bincount(code[shown], minlength=len(held))
    held["pn"] += np.bincount(code[timed], minlength=len(held))
    np.add.at(held["psum"], code[timed], gap[timed])  # one after the other, so parts of a stream round as the whole
    np.fmin.at(held["pmin"], code[timed], gap[timed])
    np.fmax.at(held["pmax"], code[timed], gap[timed])
    seen = held["seen"].reshape(-1).copy()
    for i in range(8):
        own = shown & open_bits[:, i]
        np.bitwise_or.at(seen, 256 * code[own] + 32 * i + data[own, i] // 8, np.uint8(1) << data[own, i] % 8)
        own = step & moved[:, i]
        held["changed_at"][code[own], i] = ts[own]  # of a key's rows, in order of time, the last one stays
    held["seen"] = seen.reshape(-1, 256)
    held["changed"][code[step & moved.any(axis=1)]] = True
    last = upto[np.append(first[1:], True)]  # of each key
    last = last[real[last]]
    own = code[last]
    held["ts"][own], held["seq"][own], held["word"][own] = ts[last], seq[last], word[last]
    held["delta"][own] = np.where(first[last], np.nan, gap[last])
    held["last"][own] = np.packbits(moved[last] & ~first[last, None], axis=1, bitorder="little")[:, 0]
    touched = np.unique(code[real])
    return held, keys, touched, held["ts"][touched, None] - held["changed_at"][touched] <= hold


def latest(frames, rules=None, hold=1.0, epoch=None, late=None):
    """One row per key in update mode: last frame, delta_t, changed bytes, counts, periods, values per byte.

    received counts all frames, frames those shown: a frame with the time and bytes of the last one counts
    for the period alone. Frames older than the key's last one count, but give no period and change
    nothing. changed_at has the time of each byte's last change; highlighted_bytes are those changed
    within the last ``hold`` seconds. With ``late``, a delay for a watermark, a timer of event time gives
    the row again, without highlights, once the watermark has passed the end of the last one.

    Keys are dealt into BUCKETS groups, each with one state of all its keys, as a call for each key costs
    far more than its frames.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, rows = state.get if state.exists else ("[]", b"")
        held, keys = np.frombuffer(rows, HELD), pd.DataFrame(json.loads(names), columns=KEY)
        out, lit = np.zeros(0, int), np.zeros((0, 8), bool)
        if not state.hasTimedOut:
            held, keys, out, lit = _dealt(held, keys, pd.concat([p for p in parts if len(p)], ignore_index=True), hold)
        if late is not None:
            held, now = held.copy(), state.getCurrentWatermarkMs()
            held["until"][out] = np.where(lit.any(axis=1), np.where(lit, held["changed_at"][out], -np.inf).max(axis=1) + hold, np.nan)
            ends = np.floor(held["until"] * 1000) + 1
            due = np.setdiff1d(np.flatnonzero(ends < now), out)
            out, lit = np.concatenate([out, due]), np.concatenate([lit, np.zeros((len(due), 8), bool)])
            held["until"][due] = ends[due] = np.nan
        state.update((json.dumps(keys.to_numpy(object).tolist()), held.tobytes()))
        if late is not None and not np.isnan(ends).all():
            state.setTimeoutTimestamp(max(int(np.nanmin(ends)), now + 1))
        yield rows_of(keys.iloc[out], held[out], lit)

    def rows_of(keys, held, lit):
        bits = np.unpackbits(held["seen"], axis=1, bitorder="little")
        places = lambda bits: [np.flatnonzero(x).astype(np.int32) for x in bits]
        some = lambda x: [[None if t != t else t for t in row] for row in x.tolist()]
        size, data = keys["LEN"].to_numpy(), held["word"].astype("<i8")
        out = {c: keys[c].to_numpy() for c in KEY}
        out |= {"TS": held["ts"], "seq": held["seq"], "DATA": [w.tobytes()[:n].hex().upper() for w, n in zip(data, size)], "delta_t": held["delta"], "changed_bytes": places(np.unpackbits(held["last"][:, None], axis=1, bitorder="little"))}
        out |= {"received": held["received"], "frames": held["frames"], "periods": held["pn"], "period_mean": held["psum"] / np.where(held["pn"] > 0, held["pn"], np.nan), "period_min": held["pmin"], "period_max": held["pmax"]}
        out |= {"uniques": list(bits.reshape(-1, 8, 256).sum(axis=2, dtype=np.int32)), "byte_values": places(bits), "ever_changed": held["changed"], "changed_at": some(held["changed_at"]), "highlighted_bytes": places(lit)}
        return pd.DataFrame(out)

    masked = reduce(lambda a, b: a + b, (F.when(F.array_contains("mux_bytes", i), 1 << i).otherwise(0) for i in range(8)))
    rows = keyed(frames, rules, epoch).withColumns({"bucket": F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int"), "masked": masked, "word": packed_le()})
    columns = ["bucket", *KEY, "TS", "seq", "masked", "word"]
    if late is None:
        return rows.select(*columns).groupBy("bucket").applyInPandasWithState(step, LATEST, STATE, "update", GroupStateTimeout.NoTimeout)
    timed = with_event_time(rows).withWatermark("event_time", late).select(*columns, "event_time")
    return timed.groupBy("bucket").applyInPandasWithState(step, LATEST, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def upserted(folder_rows, key, version="batch"):
    """The present rows of a table of appended updates: of each key the row of the last batch."""
    columns = [c for c in folder_rows.columns if c not in (*key, version)]
    last = folder_rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.col(version)).alias("x"))
    return last.select(*key, "x.*")


def append_updates(path):
    """A foreachBatch function that stores each batch under its number; a repeated batch replaces itself."""

    def write(batch, number):
        _store(batch, path, number)

    return write


def _store(rows, path, number):
    rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/run={number:08d}")


def read_updates(spark, path, schema):
    return spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", "true").parquet(path)


def expired(latest_rows, now, hold):
    """Latest rows as shown at a time: a byte is highlighted until ``hold`` seconds after its last change."""
    places = F.sequence(F.lit(0), F.lit(7))
    return latest_rows.withColumn("highlighted_bytes", F.filter(places, lambda i: F.coalesce(F.lit(now) - F.get("changed_at", i) <= hold, F.lit(False))))


def replay(frames, offset=0.0):
    """A stream's times moved so that each log's first frame stands at ``offset``, rounded to 6; append mode.

    The first frame is the one of least seq in the first micro-batch that brings the log; its time is all
    the state that a log has, so a frame that comes later, if from an earlier time, gets one below ``offset``.
    """

    def step(key, parts, state):
        parts = list(parts)
        if not state.exists:
            state.update((float(min((p["seq"].min(), p.loc[p["seq"].idxmin(), "TS"]) for p in parts)[1]),))
        (start,) = state.get
        for part in parts:
            yield part.assign(TS=(offset + part["TS"] - start).round(6))

    return frames.groupBy("log_id").applyInPandasWithState(step, frames.schema, "start double", "append", GroupStateTimeout.NoTimeout)


def rollup(latest_rows):
    """Entries of one id rolled up: period range and mean, frames, merged numbers of values by byte, ever_changed.

    Selector bytes of an entry have no values, so they are masked here too.
    """
    merged = F.array_distinct(F.flatten(F.collect_list("byte_values")))
    out = latest_rows.groupBy("log_id", "ID").agg(
        F.min("period_min").alias("period_min"), F.max("period_max").alias("period_max"), (F.sum(F.col("period_mean") * F.col("periods")) / F.nullif(F.sum("periods"), F.lit(0))).alias("period_mean"),
        F.sum("periods").alias("periods"), F.sum("frames").alias("frames"), F.count("*").alias("entries"), F.max("ever_changed").alias("ever_changed"), merged.alias("__v"),
    )
    counts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.size(F.filter("__v", lambda v: F.floor(v / 256) == i)))
    return out.withColumn("uniques", counts).drop("__v")


def changing_ids(latest_rows):
    """Ids with a byte that ever changed, selector bytes aside; of an epoch's rows, since its reset."""
    return latest_rows.where("ever_changed").select("log_id", "ID").distinct()


RUNNING = (
    "log_id string, ID string, frames long, lengths string, payload_changes long, period_mean double, period_min double, period_max double, changes array<long>, uniques array<int>, "
    "steps array<long>, moved array<long>, up array<long>, first array<int>, last array<int>, wraps array<long>, carries array<long>"
)
RUNNING_STATE = (
    "ts double, data binary, size int, frames long, lengths int, payload_changes long, psum double, pmin double, pmax double, pn long, changes array<long>, seen binary, "
    "steps array<long>, moved array<long>, up array<long>, first array<int>, last array<int>, wraps array<long>, carries array<long>"
)
#: Neighbouring bytes: the one that wraps, and the one that may carry.
NEIGHBOURS = [pair for i in range(7) for pair in ((i, i + 1), (i + 1, i))]


def running(frames):
    """Incremental summary, one row per id in update mode; chunks in order of time give what the whole gives.

    frames, lengths, payload changes and periods; by byte: changes and uniques (all frames), steps, moved, up,
    first and last (frames that cover the byte); wraps and carries by pair of neighbouring bytes.
    """
    from busfleet.operators.diff import CARRY_STEP

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = (None, b"", 0, 0, 0, 0, 0.0, None, None, 0, [0] * 8, bytes(256), [0] * 8, [0] * 8, [0] * 8, [None] * 8, [None] * 8, [0] * 14, [0] * 14)
        s = dict(zip(names_of(RUNNING_STATE), state.get if state.exists else empty))
        s |= {k: list(v) for k, v in s.items() if isinstance(v, (list, tuple))}
        for row in in_order(parts).itertuples(index=False):
            data, size = bytes(getattr(row, c) for c in BYTES), int(row.LEN)
            if s["frames"]:
                gap, before = round(row.TS - s["ts"], 6), s["data"]
                s["psum"], s["pn"] = s["psum"] + gap, s["pn"] + 1
                s["pmin"], s["pmax"] = min(gap, gap if s["pmin"] is None else s["pmin"]), max(gap, gap if s["pmax"] is None else s["pmax"])
                s["payload_changes"] += before[: s["size"]] != data[:size] or s["size"] != size
                for i in range(8):
                    s["changes"][i] += before[i] != data[i]
                for k, (a, b) in enumerate(NEIGHBOURS):
                    if size > max(a, b) and s["size"] > a and abs(data[a] - before[a]) >= CARRY_STEP:
                        s["wraps"][k] += 1
                        s["carries"][k] += s["size"] > b and abs(data[b] - before[b]) == 1
            for i in range(size):
                if s["last"][i] is not None:
                    d = data[i] - s["last"][i]
                    s["steps"][i] += 1
                    s["moved"][i] += d != 0
                    s["up"][i] += d in (1, -255)
                else:
                    s["first"][i] = data[i]
                s["last"][i] = data[i]
            s["seen"] = _counted(s["seen"], data, ())
            s |= {"ts": row.TS, "data": data, "size": size, "frames": s["frames"] + 1, "lengths": s["lengths"] | 1 << size}
        state.update(tuple(s.values()))
        values = _values(s["seen"])
        out = {"log_id": key[0], "ID": key[1], "frames": s["frames"], "lengths": ",".join(str(i) for i in range(9) if s["lengths"] >> i & 1), "payload_changes": int(s["payload_changes"]), "period_mean": s["psum"] / s["pn"] if s["pn"] else None}
        out |= {"period_min": s["pmin"], "period_max": s["pmax"], "uniques": [sum(v // 256 == i for v in values) for i in range(8)]}
        yield pd.DataFrame([out | {c: s[c] for c in ("changes", "steps", "moved", "up", "first", "last", "wraps", "carries")}])[names_of(RUNNING)]

    rows = frames.select("log_id", "ID", "LEN", "TS", "seq", *BYTES)
    return rows.groupBy("log_id", "ID").applyInPandasWithState(step, RUNNING, RUNNING_STATE, "update", GroupStateTimeout.NoTimeout)


def payload_counts(frames):
    """Streaming counts of each id's distinct payloads."""
    return frames.groupBy("log_id", "ID", "DATA").agg(F.count("*").alias("n"))


def summary(running_rows, payloads):
    """What ``operators.summary.frame_summary`` gives, from the present ``running`` rows and payload counts."""
    distinct = payloads.groupBy("log_id", "ID").agg(F.count("*").alias("distinct_payloads"))
    return running_rows.join(distinct, ["log_id", "ID"]).select("log_id", "ID", "frames", "lengths", "distinct_payloads", "payload_changes", "period_mean", "period_min", "period_max")


def byte_counts(frames):
    """Streaming counts (log_id, ID, byte, value) of covered bytes: bounded state for summaries and live diffs."""
    cells = ", ".join(f"{i}, {c}" for i, c in enumerate(BYTES))
    rows = frames.select("log_id", "ID", "LEN", F.expr(f"stack(8, {cells}) as (byte, value)")).where("byte < LEN")
    return rows.groupBy("log_id", "ID", "byte", "value").agg(F.count("*").alias("n"))


def live_observations(counts, running_rows):
    """Observations of each byte, as ``diff.byte_observations`` has them for a side, from present counts and rows."""
    from busfleet.operators.diff import observed, of_counts

    by_value = counts.withColumnRenamed("n", "c").groupBy("log_id", "ID", "byte").agg(*of_counts())
    cells = F.arrays_zip(*(F.col(c) for c in ("steps", "moved", "up", "first", "last")))
    by_byte = running_rows.select("log_id", "ID", F.posexplode(cells).alias("byte", "x")).select("log_id", "ID", "byte", "x.*")
    return observed(by_value.join(by_byte, ["log_id", "ID", "byte"]))


def live_difference(baseline, counts, running_rows):
    """``diff.byte_diff`` of a frozen table of observations (side a) with the present ones (side b)."""
    from busfleet.operators.diff import compared

    return compared(baseline.drop("side"), live_observations(counts, running_rows))


def live_carries(running_rows):
    """``diff.carry_hints`` from the present rows of the incremental summary."""
    from busfleet.operators.diff import CARRY_RATIO

    cells = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in NEIGHBOURS))
    rows = running_rows.select("log_id", "ID", F.explode(F.arrays_zip(cells.alias("p"), F.col("wraps"), F.col("carries"))).alias("x")).select("log_id", "ID", "x.p.low", "x.p.high", "x.wraps", "x.carries")
    return rows.where("wraps > 0").withColumn("carry_ratio", F.col("carries") / F.col("wraps")).withColumn("is_16bit", F.col("carry_ratio") >= CARRY_RATIO)


def decoded(frames, dictionary):
    """Signals of a stream of frames, append mode; the dictionary is a plain table.

    A frame's message is looked up by its id masked to 29 bits (exact dictionaries) and by its group
    (j1939 ones); the dictionary with the least priority wins, then the first message by name. Frames stay where
    they are: many have one group, and those without a group have one key, so a shuffle by these is one task's work.
    """
    from busfleet.operators.decode import bounded

    d = dictionary.where("active")
    fitting = d.where(fits("start_bit", "length", "le"))  # others are parts of transport messages
    choice = F.struct("priority", "message_name", "dict_name")
    exact = d.where("mode = 'exact'").groupBy(F.col("frame_id").bitwiseAND(F.lit(ID_MASK)).alias("masked")).agg(F.min(choice).alias("by_id"))
    group = d.where("mode = 'j1939'").groupBy(F.col("pgn").alias("own_pgn")).agg(F.min(choice).alias("by_group"))
    words = frames.withColumns({"w": packed_le(), "v": packed_be(), "masked": F.col("id_int").bitwiseAND(F.lit(ID_MASK)), "own_pgn": pgn_of("id_int")})
    matched = words.join(bounded(exact), "masked", "left").join(bounded(group), "own_pgn", "left").withColumn("m", F.least("by_id", "by_group")).where("m is not null")
    signals = fitting.select("dict_name", "message_name", "signal_name", "start_bit", "length", "le", "type", "scale", "offset", "unit", "mux_start", "mux_bytes", "mux_value").distinct()
    rows = matched.select("*", F.col("m.dict_name").alias("dict_name"), F.col("m.message_name").alias("message_name")).join(bounded(signals), ["dict_name", "message_name"])
    rows = rows.where(F.col("mux_value").isNull() | (mux_value("mux_start", "mux_bytes") == F.col("mux_value")))
    return rows.select("log_id", "ID", "TS", "seq", "message_name", "signal_name", physical(raw_bits("w", "v", "start_bit", "length", "le"), "length", "type", "scale", "offset").alias("value"), "unit")


def last_values(decoded_rows):
    """Streaming last value of each signal; other statistics of a coverage stay as they were scanned."""
    return decoded_rows.groupBy("log_id", "ID", "message_name", "signal_name").agg(F.max(F.struct("TS", "seq", "value")).alias("x")).select("log_id", "ID", "message_name", "signal_name", F.col("x.TS").alias("TS"), F.col("x.value").alias("last"))


def refreshed_coverage(covered, latest_values):
    """A coverage table with the live last values; signals without data stay so."""
    key = ["log_id", "ID", "message_name", "signal_name"]
    now = latest_values.select(*key, F.col("last").alias("__now"))
    return covered.join(now, key, "left").withColumn("last", F.when(F.col("frames") > 0, F.coalesce("__now", "last"))).drop("__now")


def history(frames, *bounds, ids=None):
    """The incremental form of the time and id filters."""
    from busfleet.operators.summary import select_ids, time_range

    rows = time_range(frames, *bounds)
    return rows if ids is None else select_ids(rows, ids)


def new_ids(frames):
    """Each id once, when it is first seen."""
    return frames.select("log_id", "ID").dropDuplicates(["log_id", "ID"])


def with_event_time(frames):
    return frames.withColumn("event_time", F.timestamp_micros(F.round(F.col("TS") * 1e6).cast("long")))


RATES = "log_id string, ID string, start double, frames long, changes long, late long"


def rates(frames, width=10.0):
    """Frames and changed bytes per id and tumbling window of event time, update mode: one row for each window touched.

    A byte's change counts in the window of the frame that brings it. Frames of windows before the id's
    last one change nothing; ``late`` counts them.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, changes, late, data = state.get if state.exists else (None, 0, 0, 0, None)
        out = {}
        for row in in_order(parts).itertuples(index=False):
            own, now = row.TS // width * width, bytes(getattr(row, c) for c in BYTES)
            if start is not None and own < start:
                late += 1
                continue
            if own != start:
                start, n, changes = own, 0, 0
            n, changes, data = n + 1, changes + (sum(a != b for a, b in zip(data, now)) if data is not None else 0), now
            out[start] = (n, changes)
        state.update((start, n, changes, late, data))
        yield pd.DataFrame([(key[0], key[1], at, *counts, late) for at, counts in out.items()], columns=names_of(RATES))

    rows = frames.select("log_id", "ID", "TS", "seq", *BYTES)
    return rows.groupBy("log_id", "ID").applyInPandasWithState(step, RATES, "start double, n long, changes long, late long, data binary", "update", GroupStateTimeout.NoTimeout)


def split_late(batch, newest, seconds):
    """A batch as (in time, late): late rows are told apart with a reason instead of being lost."""
    bound = newest - seconds
    return batch.where(F.col("TS") >= bound), batch.where(F.col("TS") < bound).withColumn("reason", F.format_string("older than %.6f", F.lit(float(bound))))


def late_to_side(path, seconds):
    """A foreachBatch function: rows in time go to ``path/rows``, later ones with a reason to ``path/late``.

    Late means older by more than ``seconds`` than the newest row of the batches before, which are kept in
    ``path/newest``; so a batch that runs again is split as before.
    """

    def write(batch, number):
        spark = batch.sparkSession
        own = batch.agg(F.max("TS").alias("newest")).withColumn("at", F.lit(number).cast("long"))
        before = None
        if number > 0:
            before = read_updates(spark, f"{path}/newest", "newest double, at long").where(F.col("at") < number).agg(F.max("newest")).first()[0]
        rows, late = (batch, batch.limit(0).withColumn("reason", F.lit(""))) if before is None else split_late(batch, before, seconds)
        _store(rows, f"{path}/rows", number)
        _store(late, f"{path}/late", number)
        _store(own, f"{path}/newest", number)

    return write


def moving_bytes(frames):
    """Streaming (log_id, ID, byte) that have moved: they join a live matrix and never leave it."""
    cells = ", ".join(f"{i}, {c}" for i, c in enumerate(BYTES))
    rows = frames.select("log_id", "ID", F.expr(f"stack(8, {cells}) as (byte, value)"))
    return rows.groupBy("log_id", "ID", "byte").agg((F.min("value") != F.max("value")).alias("moves"))


def refresh_matrix(history, path, points=400):
    """A foreachBatch function for ``moving_bytes``: the matrix of the ids touched is made anew from history(spark), the frames so far.

    Only ids with a byte that moves are made; see ``live_matrix`` for the present rows.
    """
    from busfleet.operators.summary import matrix
    from busfleet.streaming.folders import stored

    def write(batch, number):
        # stored: the plan of the matrix reads them several times, each of which would run the stream's step again
        touched = stored(batch.where("moves").select("log_id", "ID").distinct(), "touched")
        frames = history(batch.sparkSession).join(touched, ["log_id", "ID"], "left_semi")
        _store(matrix(frames, points).select("log_id", "series_id", "bucket", "TS", "seq", "value", "has_movement"), path, number)

    return write


def live_matrix(spark, path):
    """The rows of each series that its last refresh gave."""
    rows = read_updates(spark, path, "log_id string, series_id string, bucket long, TS double, seq long, value double, has_movement boolean")
    last = rows.groupBy("log_id", "series_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["log_id", "series_id", "batch"]).drop("batch")


#: Of a packed frame: its time, its number, its eight bytes, whether it opens a session.
PACKED = (np.dtype("<f8"), np.dtype("<i8"), np.dtype("<i8"), np.dtype("u1"))


def packed(words):
    """Transport words of each log and source in an Arrow batch as one row, byte place by byte place, which compress well."""

    def pack(batches):
        for batch in batches:
            rows = {"log_id": [], "sa": [], "frames": []}
            for (log, sa), g in batch.to_pandas().groupby(["log_id", "sa"], sort=False, dropna=False):
                places = (np.ascontiguousarray(g[c].to_numpy(), k).view(np.uint8).reshape(-1, k.itemsize).T.tobytes() for c, k in zip(("TS", "seq", "word", "opens"), PACKED))
                for c, x in zip(rows, (log, sa, b"".join(places))):
                    rows[c].append(x)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("log_id", pa.string()), ("sa", pa.int32()), ("frames", pa.binary())]))

    return words.select("log_id", F.col("sa").cast("int").alias("sa"), "TS", "seq", "word", F.col("opens").cast("byte").alias("opens")).mapInArrow(pack, "log_id string, sa int, frames binary")


def _unpacked(data):
    """The columns of packed frames: times, numbers, words, openings."""
    raw, n, columns = np.frombuffer(data, np.uint8), len(data) // sum(k.itemsize for k in PACKED), []
    for k in PACKED:
        own, raw = raw[: n * k.itemsize], raw[n * k.itemsize :]
        columns.append(np.ascontiguousarray(own.reshape(k.itemsize, n).T).view(k).ravel())
    return columns


def bam_messages(frames):
    """Streaming reassembly of transport messages, append mode; state per (log, source) is one open session.

    The rules are those of the batch operator; frames are taken in order of time within each batch. They move packed,
    a row for each source of an Arrow batch. The state is the words of the open session: its announcement and the
    last frame of each number.
    """
    from busfleet.operators.transport import transport_words

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [_unpacked(x) for p in parts for x in p["frames"]]
        ts, seq, words, opens = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((seq, ts))
        held = np.array(state.get[0] if state.exists else [], np.int64)
        ts, words = np.append(np.full(len(held), np.nan), ts[order]), np.append(held, words[order])
        opens = np.append((np.arange(len(held)) == 0).astype(np.uint8), opens[order])
        octets = words.astype(">i8").view(np.uint8).reshape(-1, 8)
        starts, done, left = np.flatnonzero(opens), [], []
        for start, end in zip(starts, np.append(starts[1:], len(words))):
            head = octets[start].astype(int)
            size, packets, pgn = head[1] + 256 * head[2], head[3], head[5] + 256 * head[6] + 65536 * head[7]
            own = start + 1 + np.flatnonzero(octets[start + 1 : end, 0])  # numbers from 1 on
            _, firsts = np.unique(octets[own, 0], return_index=True)
            segments = np.zeros((256, 7), np.uint8)
            if 0 < packets <= len(firsts):
                last = np.sort(firsts)[packets - 1]
                segments[octets[own[: last + 1], 0]] = octets[own[: last + 1], 1:]  # a later one of a number overwrites
                done.append((key[0], ts[own[last]], int(key[1]), int(pgn), segments[1:].tobytes()[:size].ljust(size, b"\0")))
            elif packets and end == len(words):
                newest = {int(octets[i, 0]): int(words[i]) for i in own}
                left = [int(words[start]), *newest.values()]
        state.update((left,))
        yield pd.DataFrame(done, columns=["log_id", "TS", "sa", "pgn", "data"])

    schema = "log_id string, TS double, sa int, pgn long, data binary"
    return packed(transport_words(frames)).groupBy("log_id", "sa").applyInPandasWithState(step, schema, "words array<long>", "append", GroupStateTimeout.NoTimeout)


def run_once(stream, sink, checkpoint, mode):
    """Runs a streaming plan over what is there, into a foreachBatch function."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
