"""What each id does: periods, changes, distinct bytes, entropy, multiplexer cases; ranges and selections.

Order is (TS, seq) within a log. Work is keyed by (log_id, ID) and, where it needs the frame before, by
stretches of time, so no id is one task; what follows aggregates partially. Tables of byte statistics are long: one row for each byte.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.functions.bits import BYTES
from busfleet.functions.ids import by_id
from busfleet.operators.stretches import running, spans

KEY = ["log_id", "ID"]


def ordered(*key):
    return Window.partitionBy(*(key or KEY)).orderBy("TS", "seq")


def time_range(frames, *bounds):
    """Frames within all the given inclusive (low, high) bounds; None leaves a side open."""
    low, high = [b[0] for b in bounds if b[0] is not None], [b[1] for b in bounds if b[1] is not None]
    if low:
        frames = frames.where(F.col("TS") >= max(low))
    return frames.where(F.col("TS") <= min(high)) if high else frames


def select_ids(frames, ids):
    """Frames of the given ids, a list or a DataFrame with an ID column; an empty selection has no frames."""
    if isinstance(ids, (list, tuple, set)):
        return frames.where(F.col("ID").isin(list(ids)) if ids else F.lit(False))
    return frames.join(ids.select("ID").distinct(), "ID", "left_semi")


def case_label(mux_bytes):
    """Multiplexer case of a frame: its selector bytes as hex, such as '0A 1F'; '' without any."""
    label = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    return F.concat_ws(" ", *(label(BYTES[i]) for i in mux_bytes)) if mux_bytes else F.lit("")


def with_cases(frames, rules, prefer="exact"):
    """Adds mux_bytes (array of int, empty without a rule) and mux_label by a table of rules.

    rules: can_id, length (null: any), mux_bytes. Where several fit, 'exact' takes the one for the frame's
    length first, 'any' the one for any length, 'first' the first by a column ``position``.
    """
    rank = {"exact": F.col("length").isNull().cast("int"), "any": F.col("length").isNotNull().cast("int"), "first": F.col("position") if "position" in rules.columns else F.lit(0)}[prefer]
    rule = F.struct(rank.alias("rank"), F.array_join("mux_bytes", ",").alias("order"), "mux_bytes", "length")
    # an id's rules travel together, so frames, of a stream too, meet a plain table by id
    r = rules.groupBy(F.col("can_id").alias("ID")).agg(F.collect_list(rule).alias("__rules"))
    fitting = F.filter("__rules", lambda x: x["length"].isNull() | (x["length"] == F.col("LEN")))
    joined = frames.join(r, "ID", "left").withColumn("mux_bytes", F.coalesce(F.array_min(fitting)["mux_bytes"], F.expr("cast(array() as array<int>)"))).drop("__rules")
    values = F.array(*BYTES)
    return joined.withColumn("mux_label", F.array_join(F.transform("mux_bytes", lambda i: F.lpad(F.hex(F.get(values, i).cast("long")), 2, "0")), " "))


def byte_rows(frames, keep=(), covered=False):
    """One row per frame and byte: byte, value and the columns of ``keep``; with ``covered`` only bytes below LEN."""
    pairs = ", ".join(f"{i}, {c}" for i, c in enumerate(BYTES))
    rows = frames.select(*KEY, "TS", "seq", "LEN", *[k for k in keep if k not in ("log_id", "ID", "TS", "seq", "LEN")], F.expr(f"stack(8, {pairs}) as (byte, value)"))
    return rows.where("byte < LEN") if covered else rows


def distinct_ids(frames):
    """The ids of each log, in numeric order."""
    return frames.select(*KEY).distinct().orderBy("log_id", *by_id())


def id_lengths(frames):
    """(log_id, ID, LEN) groups with a payload."""
    return frames.where("LEN > 0").select(*KEY, "LEN").distinct()


def periods(frames, *key):
    """Each frame with delta_t: seconds since the frame before it, rounded to 6; null for the first."""
    rows = running(frames, key or KEY, lag={"__before": F.col("TS")})
    return rows.withColumn("delta_t", F.round(F.col("TS") - F.col("__before"), 6)).drop("__before")


def frame_summary(frames, *key):
    """Per id: frames, lengths, distinct_payloads, payload_changes, period_mean, period_min, period_max.

    Ordering by time first leaves no negative period. Further columns of ``key``, such as a multiplexer
    case, split an id.
    """
    key = key or KEY
    frames = frames.select(*key, "TS", "seq", *(c for c in ("LEN", "DATA") if c not in key))
    steps = running(frames, key, lag={"at": F.col("TS"), "before": F.col("DATA")}).withColumn("delta_t", F.round(F.col("TS") - F.col("at"), 6))
    sums = steps.groupBy(*key).agg(
        F.count("*").alias("frames"), F.array_join(F.array_sort(F.collect_set("LEN")), ",").alias("lengths"), F.count_if(F.col("before") != F.col("DATA")).alias("payload_changes"),
        F.round(F.avg("delta_t"), 6).alias("period_mean"), F.min("delta_t").alias("period_min"), F.max("delta_t").alias("period_max"),
    )
    # counted apart, so that means are summed in the order of time within each task
    distinct = frames.groupBy(*key).agg(F.count_distinct("DATA").alias("distinct_payloads"))
    return sums.join(distinct, key).select(*key, "frames", "lengths", "distinct_payloads", "payload_changes", "period_mean", "period_min", "period_max")


def byte_changes(frames, *key):
    """Per id and byte: changes and uniques. The lag is taken on the frame, before bytes become rows."""
    key = key or KEY
    steps = running(frames.select(*key, "TS", "seq", *BYTES), key, lag={f"p{i}": F.col(c) for i, c in enumerate(BYTES)})
    pairs = ", ".join(f"{i}, {c}, p{i}" for i, c in enumerate(BYTES))
    rows = steps.select(*key, F.expr(f"stack(8, {pairs}) as (byte, value, before)"))
    counts = rows.groupBy(*key, "byte", "value").agg(F.count_if(F.col("before") != F.col("value")).alias("c"))
    return counts.groupBy(*key, "byte").agg(F.sum("c").alias("changes"), F.count("value").alias("uniques"))


def byte_entropy(frames, *key):
    """Per id and byte: Shannon entropy in bits, by counts of values first."""
    key = key or KEY
    counts = byte_rows(frames, key).groupBy(*key, "byte", "value").agg(F.count("*").alias("n"))
    sums = counts.groupBy(*key, "byte").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(*key, "byte", F.round(F.greatest(F.log2("total") - F.col("s") / F.col("total"), F.lit(0.0)), 6).alias("entropy"))


def byte_update_periods(frames, *key):
    """Per id and byte that changes twice or more: mean, least and largest time between its changes."""
    key = key or KEY
    pairs = ", ".join(f"{i}, {c}, p{i}" for i, c in enumerate(BYTES))
    logs = spans(frames)
    steps = running(frames.select(*key, "TS", "seq", *BYTES), key, lag={f"p{i}": F.col(c) for i, c in enumerate(BYTES)}, found=logs)
    changed = steps.select(*key, "TS", "seq", F.expr(f"stack(8, {pairs}) as (byte, value, before)")).where("before <> value")
    gaps = running(changed, [*key, "byte"], lag={"at": F.col("TS")}, found=logs).withColumn("gap", F.round(F.col("TS") - F.col("at"), 6)).where("gap is not null")
    return gaps.groupBy(*key, "byte").agg(F.round(F.avg("gap"), 6).alias("update_mean"), F.min("gap").alias("update_min"), F.max("gap").alias("update_max"))


def mux_cases(frames, mux_bytes=None):
    """Cases of each id with their frames, in the order of first sight; needs mux_label or selector bytes."""
    rows = frames if mux_bytes is None else frames.withColumn("mux_label", case_label(mux_bytes))
    first = rows.groupBy(*KEY, "mux_label").agg(F.min(F.struct("TS", "seq")).alias("first"), F.count("*").alias("frames"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*KEY).orderBy("first"))).drop("first")


def changed_bytes(frames, mux_bytes=(), *key):
    """Each frame with changed_bytes: the bytes that differ from the frame before, selector bytes aside."""
    lag = {f"__p{i}": F.col(c) for i, c in enumerate(BYTES) if i not in mux_bytes}
    parts = [F.when(F.col(f"__p{i}") != F.col(c), F.lit(i)) for i, c in enumerate(BYTES) if i not in mux_bytes]
    return running(frames, key or KEY, lag=lag).withColumn("changed_bytes", F.array_compact(F.array(*parts))).drop(*lag)


def matrix(frames, points=400):
    """Every byte of every id as a series of at most about 2 * points rows, and whether the byte moves.

    Buckets of equal row counts keep their least and largest value in time order. Frames are numbered once for
    all of their bytes.
    """
    from busfleet.operators.series import extremes

    rows = frames.select(*KEY, "TS", "seq", *BYTES)
    moves = rows.groupBy(*KEY).agg(F.array(*(F.min(c) != F.max(c) for c in BYTES)).alias("__moves"))
    numbered = running(rows, KEY, total={"__r": F.lit(1)}, size="__n").join(moves, KEY)
    place = F.floor((F.col("__r") - 1) / F.greatest(F.ceil(F.col("__n") / points), F.lit(1))).alias("bucket")
    cells = F.posexplode(F.array(*BYTES)).alias("byte", "value")
    long = numbered.select(*KEY, "TS", "seq", "__moves", place, cells).withColumn("has_movement", F.get("__moves", F.col("byte")))
    small = extremes(long, [*KEY, "byte", "has_movement", "bucket"])
    return small.select("log_id", F.concat_ws(":", "ID", "byte").alias("series_id"), "bucket", "TS", "seq", F.col("value").cast("double").alias("value"), "has_movement")


def summary_text(frames):
    """Per id the byte statistics as texts: 'B0:3  B1:0 ...' for changes and for uniques."""
    cells = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte", c))), lambda x: F.format_string("B%d:%d", x["byte"], x[c])), "  ")
    return byte_changes(frames).groupBy(*KEY).agg(cells("changes").alias("changes_text"), cells("uniques").alias("uniques_text"))


def union_logs(*frames):
    """All frames of several logs or chunks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sorted_frames(frames, column, descending=False):
    """Frames by any display column; ids in numeric order; equal ones in capture order."""
    first = by_id() if column == "ID" else [F.col(column).asc_nulls_last()]
    if descending:
        first = [F.col(column).desc_nulls_last()] if column != "ID" else [F.col("id_int").desc_nulls_last(), F.col("ID").desc()]
    return frames.orderBy(*first, "TS", "seq")


def changed_set_delta(before, after, column="ID"):
    """What to tell a viewer of a growing set: the added members, or all members after a reset.

    Gives (column, kind): 'added' if the set grew, 'reset' with the whole new set if any member left.
    """
    old, new = before.select(column).distinct(), after.select(column).distinct()
    left = old.join(new, column, "left_anti").agg((F.count("*") > 0).alias("shrank"))
    marked = new.join(old.withColumn("known", F.lit(True)), column, "left").crossJoin(F.broadcast(left))  # one row
    return marked.where("shrank or known is null").select(column, F.when(F.col("shrank"), "reset").otherwise("added").alias("kind"))
