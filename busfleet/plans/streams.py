"""Registered queries of the live operators: frames arrive in three parts, each taken as a micro-batch; the stored output is the result."""

from pyspark.sql import functions as F

from busfleet.operators import coverage, diff
from busfleet.plans import oracle
from busfleet.plans.frames import events_frames, frames_of, table, transport_place
from busfleet.plans.queries import dictionary, rules
from busfleet.streaming import live
from busfleet.streaming.folders import shared_folder, stored

PARTS = 3
DAY = 86400.0


def by_time(frames):
    """Frames with ``part``: thirds of the time span."""
    span = frames.agg(F.min("TS").alias("t0"), F.max("TS").alias("t1"))
    third = F.least(F.floor((F.col("TS") - F.col("t0")) * PARTS / (F.col("t1") - F.col("t0"))), F.lit(PARTS - 1))
    return frames.crossJoin(F.broadcast(span)).withColumn("part", third.cast("int")).drop("t0", "t1")  # one row


THIRDS = f"parts as (select *, cast(least(floor((TS - a) * {PARTS} / (b - a)), {PARTS - 1}) as int) as part from frames, (select min(TS) as a, max(TS) as b from frames))"


class Feed:
    """Frames with ``part``, stored once; ``run`` brings the parts to a stream one after the other.

    With ``kept`` false they are not stored but made anew for each part, as suits rows of a given table for one stream.
    """

    def __init__(self, spark, frames, kept=True):
        self.spark, self.base, self.frames = spark, shared_folder(spark, "live"), frames
        if kept:
            frames.write.partitionBy("part").parquet(f"{self.base}/all")
            self.frames = spark.read.parquet(f"{self.base}/all")
        self.schema = self.frames.drop("part").schema

    def part(self, number):
        return self.frames.where(F.col("part") == number).drop("part")

    def run(self, name, plan, mode="update", sink=None):
        """Runs plan(stream) after each part; its updates are stored in the folder that is returned."""
        source, out = f"{self.base}/{name}-in", f"{self.base}/{name}-out"
        for number in range(PARTS):
            self.part(number).write.mode("append").parquet(source)
            stream = self.spark.readStream.schema(self.schema).parquet(source)
            live.run_once(plan(stream), sink(source, out) if sink else live.append_updates(out), f"{self.base}/{name}-state", mode)
        return out

    def present(self, name, plan, ddl, key):
        return live.upserted(live.read_updates(self.spark, self.run(name, plan), ddl), key)


def feed(spark, sf):
    return Feed(spark, by_time(events_frames(spark, sf)))


def _latest(spark, sf):
    f = feed(spark, sf)
    table = rules(spark, f.frames)
    return f.present("latest", lambda s: live.latest(s, table, hold=DAY), live.LATEST, live.KEY)


def q_live_latest(spark, sf):
    return _latest(spark, sf).select("ID", "LEN", "mux_label", "seq", "received", "frames", "periods", F.round("period_mean", 9).alias("period_mean"), "period_min", "period_max", "ever_changed", F.array_join("uniques", ",").alias("uniques"))


def q_live_rollup(spark, sf):
    return live.rollup(_latest(spark, sf)).select("ID", "entries", "frames", "periods", F.round("period_mean", 9).alias("period_mean"), "period_min", "period_max", F.array_join("uniques", ",").alias("uniques"))


def q_live_highlights(spark, sf):
    """What a display shows at the time of the newest frame: bytes changed within the last three days."""
    rows = _latest(spark, sf)
    now = rows.agg(F.max("TS")).first()[0] or 0.0
    return live.expired(rows, now, 3 * DAY).select("ID", "LEN", "mux_label", F.array_join("highlighted_bytes", ",").alias("bytes"))


def q_live_changing(spark, sf):
    """Ids that have changed since a reset at the end of the first third."""
    f = feed(spark, sf)
    resets = f.part(0).groupBy("log_id").agg(F.max("TS").alias("TS")).withColumn("TS", F.col("TS") + 1e-6)
    resets.write.parquet(f"{f.base}/resets")
    marks = spark.read.parquet(f"{f.base}/resets")
    rows = f.present("changing", lambda s: live.latest(live.with_epoch(s, marks)), live.LATEST, live.KEY)
    return live.changing_ids(rows.where("mux_label like '1|%'")).select("ID")


RUNNING_KEY, PAYLOAD = ["log_id", "ID"], "log_id string, ID string, DATA string, n long"


def q_live_summary(spark, sf):
    f = feed(spark, sf)
    rows = f.present("running", live.running, live.RUNNING, RUNNING_KEY)
    payloads = f.present("payloads", live.payload_counts, PAYLOAD, ["log_id", "ID", "DATA"])
    return live.summary(rows, payloads).withColumn("period_mean", F.round("period_mean", 9))


def q_live_difference(spark, sf):
    """The first third, frozen, against all frames so far."""
    f = feed(spark, sf)
    base = diff.byte_observations(f.part(0).withColumn("side", F.lit("a")))
    rows = f.present("running", live.running, live.RUNNING, RUNNING_KEY)
    counts = f.present("counts", live.byte_counts, "log_id string, ID string, byte int, value int, n long", ["log_id", "ID", "byte", "value"])
    d = live.live_difference(base, counts, rows)
    return d.select("ID", "byte", "class", "n_a", "n_b", F.round("mean_delta", 6).alias("mean_delta"), "counter_a", "counter_b", "first_a", "last_b", F.round("score", 6).alias("score"), F.round("z", 6).alias("z"))


def q_live_carries(spark, sf):
    return live.live_carries(feed(spark, sf).present("running", live.running, live.RUNNING, RUNNING_KEY)).select("ID", "low", "high", "wraps", "carries", "is_16bit")


DECODED = "log_id string, ID string, TS double, seq long, message_name string, signal_name string, value double, unit string"


def stored_dictionary(spark, sf):
    """The dictionary, made once for all micro-batches."""
    return stored(dictionary(spark, sf), "dictionary")


def q_live_decoded(spark, sf):
    f, d = feed(spark, sf), stored_dictionary(spark, sf)
    out = f.run("decoded", lambda s: live.decoded(s, d), "append")
    return live.read_updates(spark, out, DECODED).select("seq", "ID", "message_name", "signal_name", "value", "unit")


def q_live_replay(spark, sf):
    """All frames with the times of a log that begins at 100 seconds."""
    f = feed(spark, sf)
    out = f.run("replay", lambda s: live.replay(s.select("log_id", "TS", "seq", "ID"), 100.0), "append")
    return live.read_updates(spark, out, "log_id string, TS double, seq long, ID string").select("seq", "ID", "TS")


def q_live_coverage(spark, sf):
    """A coverage of the first third with the last values of all frames so far."""
    f, d = feed(spark, sf), stored_dictionary(spark, sf)
    now = f.present("last", lambda s: live.last_values(live.decoded(s, d)), "log_id string, ID string, message_name string, signal_name string, TS double, last double", ["log_id", "ID", "message_name", "signal_name"])
    return live.refreshed_coverage(coverage.coverage(f.part(0), d), now).select("ID", "message_name", "signal_name", "frames", "unique", "last")


def q_live_new_ids(spark, sf):
    f = feed(spark, sf)
    return live.read_updates(spark, f.run("ids", live.new_ids, "append"), "log_id string, ID string").select("ID")


def q_live_history(spark, sf):
    f = feed(spark, sf)
    wanted = f.frames.where("id_int > 2047").select("ID").distinct()
    out = f.run("history", lambda s: live.history(s, (1704067200.0 + 5 * DAY, None), ids=wanted).select("seq", "ID"), "append")
    return live.read_updates(spark, out, "seq long, ID string").drop("batch")


def q_live_rates(spark, sf):
    f = feed(spark, sf)
    rows = live.read_updates(spark, f.run("rates", lambda s: live.rates(s, DAY)), live.RATES)
    return live.upserted(rows, ["log_id", "ID", "start"]).select("ID", "start", "frames", "changes")


def q_live_matrix(spark, sf):
    f = feed(spark, sf)
    sink = lambda source, out: live.refresh_matrix(lambda s: s.read.schema(f.schema).parquet(source), out, 20)
    return live.live_matrix(spark, f.run("matrix", live.moving_bytes, sink=sink)).select("series_id", "seq", "value", "has_movement")


def q_live_late(spark, sf):
    """Frames out of order, dealt by number: those later than five days go to the side output."""
    f = Feed(spark, events_frames(spark, sf).withColumn("part", (F.col("seq") % PARTS).cast("int")))
    out = f.run("late", lambda s: s.select("seq", "TS"), "append", lambda source, out: live.late_to_side(out, 5 * DAY))
    rows = live.read_updates(spark, f"{out}/rows", "seq long, TS double").select("seq", F.lit(False).alias("late"))
    return rows.unionByName(live.read_updates(spark, f"{out}/late", "seq long, TS double, reason string").select("seq", F.lit(True).alias("late")))


def q_live_bam(spark, sf):
    """Documents come in three parts, and the stream makes their frames, which would take many times the room of the texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % PARTS).cast("int").alias("part"))
    out = Feed(spark, docs, kept=False).run("bam", lambda s: live.bam_messages(frames_of(s)), "append")
    rows = live.read_updates(spark, out, "log_id string, TS double, sa int, pgn long, data binary")
    return rows.select(*transport_place(), "sa", "pgn", F.lower(F.hex("data")).alias("data"))


QUERIES = {
    "live_latest": q_live_latest, "live_rollup": q_live_rollup, "live_highlights": q_live_highlights, "live_changing": q_live_changing, "live_summary": q_live_summary, "live_difference": q_live_difference,
    "live_carries": q_live_carries, "live_decoded": q_live_decoded, "live_coverage": q_live_coverage, "live_new_ids": q_live_new_ids, "live_history": q_live_history, "live_rates": q_live_rates,
    "live_matrix": q_live_matrix, "live_late": q_live_late, "live_bam": q_live_bam, "live_replay": q_live_replay,
}

LABEL = "case when LEN = 8 then printf('%02X', D2) else '' end"
MOVED = " or ".join(f"D{i} <> lag(D{i}) over w" for i in range(8))
# within a case the selector byte is the same, so a change of it is none of the case's
CASES = f"""lab as (select *, {LABEL} as mux_label from frames),
    gap as (select *, round(TS - lag(TS) over w, 6) as gap, coalesce({MOVED}, false) as moved from lab window w as (partition by ID, LEN, mux_label order by TS, seq)),
    per as (select ID, LEN, mux_label, count(*) as received, count(*) filter (not (gap is not distinct from 0 and not moved)) as frames, count(gap) as periods, avg(gap) as m, min(gap) as lo, max(gap) as hi, bool_or(moved) as ever,
        {', '.join(f"count(distinct D{i}) filter ({'not (LEN = 8)' if i == 2 else 'true'}) as u{i}" for i in range(8))}, arg_max(seq, (TS, seq)) filter (not (gap is not distinct from 0 and not moved)) as seq from gap group by all)"""
UNIQUES = "concat_ws(',', " + ", ".join(f"u{i}" for i in range(8)) + ")"
LAST_CHANGE = ", ".join(f"max(TS) filter (c{i}) as t{i}" for i in range(8))
CHANGED = ", ".join(f"D{i} <> lag(D{i}) over w and {'LEN <> 8' if i == 2 else 'true'} as c{i}" for i in range(8))

ORACLE = {
    "live_latest": oracle._events(f"select ID, LEN, mux_label, seq, received, frames, periods, round(m, 9) as period_mean, lo as period_min, hi as period_max, ever as ever_changed, {UNIQUES} as uniques from per", CASES),
    "live_rollup": oracle._events(f"""select p.ID, count(*) as entries, cast(sum(frames) as bigint) as frames, cast(sum(periods) as bigint) as periods, round(sum(m * periods) / nullif(sum(periods), 0), 9) as period_mean, min(lo) as period_min, max(hi) as period_max,
        any_value(u) as uniques from per p join (select ID, concat_ws(',', {', '.join(f"count(distinct D{i}) filter ({'LEN <> 8' if i == 2 else 'true'})" for i in range(8))}) as u from frames group by ID) x on x.ID = p.ID group by p.ID""", CASES),
    "live_highlights": oracle._events(f"""select ID, LEN, mux_label, concat_ws(',', {', '.join(f"case when t{i} >= now - 3 * {DAY} then '{i}' end" for i in range(8))}) as bytes from (select ID, LEN, mux_label, {LAST_CHANGE} from (
        select ID, LEN, mux_label, TS, {CHANGED} from lab window w as (partition by ID, LEN, mux_label order by TS, seq)) group by all), (select max(TS) as now from frames)""", CASES),
    "live_changing": oracle._events(f"select distinct ID from (select ID, coalesce({MOVED}, false) as moved from parts where part > 0 window w as (partition by ID, LEN order by TS, seq)) where moved", THIRDS),
    "live_summary": oracle.ORACLE["frame_summary"].replace("round(avg(dt), 6)", "round(avg(dt), 9)"),
    "live_difference": oracle._events("""select sc.ID, sc.byte, class, n_a, n_b, round(mb - ma, 6) as mean_delta, ca as counter_a, cb as counter_b, first_a, last_b, round(score, 6) as score,
        case when n_a >= 2 and n_b >= 2 and len(list_distinct(list_concat(va, vb))) > 1 then round(greatest(abs(ra - n_a * (n_a + 1) / 2.0 - n_a * n_b / 2.0) - 0.5, 0) / sqrt(n_a * n_b / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))), 6) end as z
        from sc join us on sc.ID = us.ID and sc.byte = us.byte""", THIRDS, "sided as (select *, 'a' as side from parts where part = 0 union all select *, 'b' from parts)", oracle.OBSERVED),
    "live_carries": oracle.ORACLE["carry_hints"],
    "live_decoded": oracle._events("select seq, ID, message_name, signal_name, value, unit from dec", oracle.DICTIONARY),
    "live_coverage": oracle._events(f"""select d.ID, d.message_name, d.signal_name, count(*) filter (part = 0) as frames, count(distinct value) filter (part = 0) as "unique", arg_max(value, (d.TS, d.seq)) as last
        from dec d join parts p on p.seq = d.seq group by all having count(*) filter (part = 0) > 0""", oracle.DICTIONARY, THIRDS),
    "live_new_ids": oracle._events("select distinct ID from frames"),
    "live_history": oracle._events(f"select seq, ID from frames where TS >= 1704067200.0 + 5 * {DAY} and id_int > 2047"),
    "live_rates": oracle._events(f"""select ID, floor(TS / {DAY}) * {DAY} as start, count(*) as frames, cast(sum(c) as bigint) as changes from (
        select ID, TS, {' + '.join(f"coalesce(cast(D{i} <> lag(D{i}) over w as int), 0)" for i in range(8))} as c from frames window w as (partition by ID order by TS, seq)) group by all"""),
    "live_matrix": f"select series_id, seq, value, has_movement from ({oracle.ORACLE['matrix']}) where split_part(series_id, ':', 1) in (select split_part(series_id, ':', 1) from ({oracle.ORACLE['matrix']}) where has_movement)",
    "live_late": oracle._events(f"""select seq, coalesce(TS < (select max(TS) from frames g where g.seq % {PARTS} < f.seq % {PARTS}) - 5 * {DAY}, false) as late from frames f"""),
    "live_replay": oracle._events("select seq, ID, round(100.0 + TS - (select arg_min(TS, seq) from parts where part = 0), 6) as TS from frames", THIRDS),
    "live_bam": oracle.ORACLE["bam_messages"],
}
