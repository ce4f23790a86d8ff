"""Comparison of two time windows, byte by byte: observations, change classes, scores, rank tests.

One scan tags frames by side; an id's bytes are lagged once on the frame, become rows and are counted by
value. All statistics of a byte come from these counts (at most 256 values) and from step sums, so no list
of raw values is ever held.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from busfleet.functions.bits import BYTES
from busfleet.functions.numeric import divide
from busfleet.operators.stretches import running

#: Weights of the classes of change; a counter on both sides damps the score.
WEIGHTS = {"const_shift": 1.0, "new_territory": 0.8, "range_shift": 0.5, "same_oscillation": 0.1, "unchanged": 0.0}
COUNTER_SHARE, COUNTER_DAMP, LENGTH_BONUS, BYTE_BONUS, PRESENCE_SCORE = 0.85, 0.2, 0.3, 0.05, 0.3
CARRY_STEP, CARRY_RATIO = 200, 0.7
KEY = ["log_id", "ID"]


def sides(frames, a, b):
    """Frames of windows a and b (inclusive (low, high) times) with ``side``; frames of both appear twice."""
    tag = F.array_compact(F.array(F.when(F.col("TS").between(*a), F.lit("a")), F.when(F.col("TS").between(*b), F.lit("b"))))
    return frames.withColumn("side", F.explode(tag))


def default_windows(frames, share=0.1):
    """Frames of the first and the last tenth of each log's time span, with ``side``."""
    span = frames.groupBy("log_id").agg(F.min("TS").alias("t0"), F.max("TS").alias("t1"))
    w = (F.col("t1") - F.col("t0")) * share
    tag = F.array_compact(F.array(F.when(F.col("TS") <= F.col("t0") + w, F.lit("a")), F.when(F.col("TS") >= F.col("t1") - w, F.lit("b"))))
    return frames.join(span, "log_id").withColumn("side", F.explode(tag)).drop("t0", "t1")


def byte_observations(tagged):
    """Per id, side and byte, frames with LEN above the byte only: n, values (sorted set), low, high, mean,
    first, last, change_ratio, counter, and hist (value -> count).

    The lag is taken on the frame: the last value of each byte in frames that cover it.
    """
    lagged = running(tagged.select(*KEY, "side", "TS", "seq", "LEN", *BYTES), [*KEY, "side"], prior={f"p{i}": F.when(F.col("LEN") > i, F.col(c)) for i, c in enumerate(BYTES)})
    pairs = ", ".join(f"{i}, {c}, {c} - p{i}" for i, c in enumerate(BYTES))
    rows = lagged.select(*KEY, "side", "TS", "seq", "LEN", F.expr(f"stack(8, {pairs}) as (byte, value, step)")).where("byte < LEN")
    place = F.struct("TS", "seq")
    cells = rows.groupBy(*KEY, "side", "byte", "value").agg(
        F.count("*").alias("c"), F.count("step").alias("steps"), F.count_if(F.col("step") != 0).alias("moved"), F.count_if(F.col("step").isin(1, -255)).alias("up"),
        F.min(place).alias("f"), F.max(place).alias("l"),
    )
    out = cells.groupBy(*KEY, "side", "byte").agg(*of_counts(), F.min_by("value", "f").alias("first"), F.max_by("value", "l").alias("last"), F.sum("steps").alias("steps"), F.sum("moved").alias("moved"), F.sum("up").alias("up"))
    return observed(out)


def of_counts():
    """What the counts (value, c) of a byte tell by themselves."""
    return [
        F.sum("c").alias("n"), F.array_sort(F.collect_list("value")).alias("values"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.sum(F.col("value") * F.col("c")).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "c")))).alias("hist"),
    ]


def observed(sums):
    """Observations from a byte's sums: mean, change_ratio and whether it counts."""
    share = lambda c: F.when(F.col("steps") > 0, F.col(c) / F.col("steps")).otherwise(0.0)
    counter = (F.col("steps") > 0) & ((share("up") >= COUNTER_SHARE) | ((F.size("values") == 2) & (share("moved") >= COUNTER_SHARE)))
    key = [c for c in (*KEY, "side", "byte") if c in sums.columns]
    return sums.select(*key, "n", "values", "low", "high", (F.col("total") / F.col("n")).alias("mean"), "first", "last", share("moved").alias("change_ratio"), counter.alias("counter"), "hist")


def change_class(a="values_a", b="values_b"):
    a, b = F.col(a), F.col(b)
    same = F.array_sort(a) == F.array_sort(b)
    return (
        F.when(same & (F.size(a) == 1), "unchanged").when(same, "same_oscillation").when((F.size(a) == 1) & (F.size(b) == 1), "const_shift")
        .when(F.size(F.array_except(b, a)) > 0, "new_territory").otherwise("range_shift")
    )


def byte_diff(tagged):
    """Per id and byte seen on both sides: class, new and lost values, mean_delta, counters, score, and the rank statistics.

    score = weight of the class * (0.5 + 0.5 * min(1, |mean_delta| / 255)), damped for counters on both sides.
    """
    obs = byte_observations(tagged)
    return compared(obs.where("side = 'a'"), obs.where("side = 'b'"))


def compared(a, b):
    """``byte_diff`` of two tables of observations."""
    side = lambda obs, s: obs.select(*KEY, "byte", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "values", "low", "high", "mean", "first", "last", "change_ratio", "counter", "hist")))
    both = side(a, "a").join(side(b, "b"), [*KEY, "byte"])
    delta = F.col("mean_b") - F.col("mean_a")
    kind = change_class()
    weight = F.coalesce(*(F.when(F.col("class") == k, F.lit(w)) for k, w in WEIGHTS.items()))
    out = both.withColumns({"class": kind, "mean_delta": delta, "new_values": F.array_except("values_b", "values_a"), "lost_values": F.array_except("values_a", "values_b")})
    score = weight * (0.5 + 0.5 * F.least(F.lit(1.0), F.abs("mean_delta") / 255)) * F.when(F.col("counter_a") & F.col("counter_b"), COUNTER_DAMP).otherwise(1.0)
    return rank_test(out.withColumn("score", score))


def rank_test(rows):
    """Adds u and z of the Mann-Whitney test of side a against b, from the two histograms; null if undefined.

    Midranks come from cumulated counts of the at most 256 values, so the test needs no sort of the frames.
    """
    values = F.array_sort(F.array_union(F.map_keys("hist_a"), F.map_keys("hist_b")))
    at = lambda h, v: F.coalesce(F.element_at(F.col(h), v), F.lit(0).cast("long")).cast("double")
    start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("rank"), F.lit(0.0).alias("ties"))

    def step(acc, v):
        a, t = at("hist_a", v), at("hist_a", v) + at("hist_b", v)
        return F.struct((acc["below"] + t).alias("below"), (acc["rank"] + a * (acc["below"] + (t + 1) / 2)).alias("rank"), (acc["ties"] + t * t * t - t).alias("ties"))

    folded = F.aggregate(values, start, step)
    n1, n2 = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n1 + n2
    ok = (n1 >= 2) & (n2 >= 2) & (F.size(values) > 1)
    rows = rows.withColumn("fold", folded)
    u = F.col("fold.rank") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("fold.ties") / (n * (n - 1))))
    z = divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), spread)
    return rows.withColumns({"u": F.when(ok, u), "z": F.when(ok, z)}).drop("fold")


def exact_p(u, n1, n2):
    """Two-sided exact p of U for samples without ties, by counting arrangements."""
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):  # Gaussian binomial by its factors
        for j in range(n1 * n2, n2 + i - 1, -1):
            ways[j] -= ways[j - n2 - i]
        for j in range(i, n1 * n2 + 1):
            ways[j] += ways[j - i]
    low = int(min(u, n1 * n2 - u))
    return min(1.0, 2 * sum(ways[: low + 1]) / math.comb(n1 + n2, n1))


def with_p(rows):
    """Adds p_value to rows of ``byte_diff``: exact without ties if a side has up to 8 frames, else normal."""
    import pandas as pd

    @F.pandas_udf(DoubleType())
    def p(u: pd.Series, z: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series) -> pd.Series:
        one = lambda u, z, a, b, t: None if u != u else exact_p(u, int(a), int(b)) if min(a, b) <= 8 and not t else math.erfc(z / math.sqrt(2))
        return pd.Series([one(*x) for x in zip(u, z, a, b, ties)], dtype="float64")

    ties = F.size("values_a") + F.size("values_b") - F.size(F.array_intersect("values_a", "values_b")) < F.col("n_a") + F.col("n_b")
    return rows.withColumn("p_value", p("u", "z", "n_a", "n_b", ties))


def id_diff(tagged, bytes_diff=None):
    """Per id: presence (both, only_a, only_b), frames and lengths per side, changed bytes, score.

    score = largest byte score + 0.05 for each changed byte + 0.3 if the lengths changed; ids on one side
    only have the presence score 0.3.
    """
    bytes_diff = byte_diff(tagged) if bytes_diff is None else bytes_diff
    ids = tagged.groupBy(*KEY).agg(
        F.count_if(F.col("side") == "a").alias("frames_a"), F.count_if(F.col("side") == "b").alias("frames_b"),
        F.array_sort(F.collect_set(F.when(F.col("side") == "a", F.col("LEN")))).alias("lengths_a"), F.array_sort(F.collect_set(F.when(F.col("side") == "b", F.col("LEN")))).alias("lengths_b"),
    )
    scores = bytes_diff.groupBy(*KEY).agg(F.max("score").alias("top"), F.count_if(~F.col("class").isin("unchanged", "same_oscillation")).alias("changed_bytes"))
    presence = F.when(F.col("frames_b") == 0, "only_a").when(F.col("frames_a") == 0, "only_b").otherwise("both")
    joined = ids.join(scores, KEY, "left").withColumns({"presence": presence, "len_changed": (F.col("frames_a") > 0) & (F.col("frames_b") > 0) & (F.col("lengths_a") != F.col("lengths_b"))})
    score = F.when(F.col("presence") != "both", PRESENCE_SCORE).otherwise(F.coalesce("top", F.lit(0.0)) + BYTE_BONUS * F.coalesce("changed_bytes", F.lit(0)) + F.when(F.col("len_changed"), LENGTH_BONUS).otherwise(0.0))
    return joined.select(*KEY, "presence", "frames_a", "frames_b", "lengths_a", "lengths_b", "len_changed", F.coalesce("changed_bytes", F.lit(0)).alias("changed_bytes"), score.alias("score"))


def filter_bytes(rows, min_frames=3, oscillation=False, counters=False, new_territory_only=False, alpha=None):
    """Display filters over ``byte_diff``: never a new scan. ``alpha`` needs ``with_p``."""
    rows = rows.where((F.col("n_a") >= min_frames) & (F.col("n_b") >= min_frames) & (F.col("class") != "unchanged"))
    if not oscillation:
        rows = rows.where("class <> 'same_oscillation'")
    if not counters:
        rows = rows.where(~(F.col("counter_a") & F.col("counter_b")))
    if new_territory_only:
        rows = rows.where("class = 'new_territory'")
    return rows if alpha is None else rows.where(F.col("p_value").isNull() | (F.col("p_value") <= alpha))


def filter_ids(ids, kept_bytes, presence=True):
    """Ids with a byte left by ``filter_bytes``, with changed lengths, or on one side only, by score."""
    left = kept_bytes.select(*KEY).distinct().withColumn("has_bytes", F.lit(True))
    keep = F.coalesce("has_bytes", F.lit(False)) | F.col("len_changed") | (F.lit(presence) & (F.col("presence") != "both"))
    return ids.join(left, KEY, "left").where(keep).drop("has_bytes").orderBy(F.desc("score"), "log_id", "ID")


def carry_hints(frames, *key):
    """Per id and pair of neighbouring bytes: wraps of the low byte, carries of the other, and the verdict.

    A wrap is a step of 200 or more; a carry is a step of +-1 of the neighbour at a wrap. low is the byte
    that wraps; 16-bit if at least 0.7 of its wraps carry. Frames shorter than the pair are left out.
    """
    key = key or KEY
    by = Window.partitionBy(*key).orderBy("TS", "seq")
    out = []
    for i in range(7):
        out += [(i, i + 1), (i + 1, i)]
    lagged = frames.withColumns({f"s{i}": F.col(c) - F.when(F.lag("LEN").over(by) > i, F.lag(c).over(by)) for i, c in enumerate(BYTES)})
    cells = ", ".join(f"{a}, {b}, case when LEN > {max(a, b)} then s{a} end, case when LEN > {max(a, b)} then s{b} end" for a, b in out)
    rows = lagged.select(*key, F.expr(f"stack({len(out)}, {cells}) as (low, high, step, other)"))
    wrap = F.abs("step") >= CARRY_STEP
    sums = rows.groupBy(*key, "low", "high").agg(F.count_if(wrap).alias("wraps"), F.count_if(wrap & (F.abs("other") == 1)).alias("carries"))
    return sums.where("wraps > 0").withColumn("carry_ratio", F.col("carries") / F.col("wraps")).withColumn("is_16bit", F.col("carry_ratio") >= CARRY_RATIO)


def density(frames, bins=200):
    """Frames per time bin of each log: bin, start, frames; the last bin is closed, empty bins have no row."""
    span = frames.groupBy("log_id").agg(F.min("TS").alias("t0"), F.max("TS").alias("t1"))
    w = F.greatest((F.col("t1") - F.col("t0")) / bins, F.lit(1e-300))
    rows = frames.join(span, "log_id").withColumn("bin", F.least(F.floor((F.col("TS") - F.col("t0")) / w), F.lit(bins - 1)).cast("int"))
    return rows.groupBy("log_id", "bin").agg(F.min(F.col("t0") + F.col("bin") * w).alias("start"), F.count("*").alias("frames"))


def report_rows(bytes_diff):
    """The flat rows of a diff report for CSV: formatted cells in twelve columns."""
    hexes = lambda c: F.array_join(F.transform(c, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), " ")
    return bytes_diff.select(
        "log_id", "ID", F.format_string("D%d", F.col("byte").cast("int")).alias("byte"), "class", F.format_string("%.3f", "score").alias("score"), "n_a", "n_b",
        F.format_string("%d-%d", F.col("low_a").cast("int"), F.col("high_a").cast("int")).alias("range_a"), F.format_string("%d-%d", F.col("low_b").cast("int"), F.col("high_b").cast("int")).alias("range_b"),
        F.format_string("%.2f", "mean_delta").alias("mean_delta"), hexes("new_values").alias("new_values"), hexes("lost_values").alias("lost_values"),
    )
