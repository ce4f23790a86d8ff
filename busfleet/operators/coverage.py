"""Coverage of a dictionary by a log: for each signal and concrete id what values occur."""

from pyspark.sql import functions as F

from busfleet.operators.decode import concrete_ids, decode_all
from busfleet.operators.transport import decode_messages

KEY = ["log_id", "ID", "message_name", "signal_name"]


def _statistics(valid, prefix):
    v, at = F.when(valid, F.col("value")), F.when(valid, F.struct("TS", "seq"))
    return [
        F.count(v).alias(f"{prefix}frames"), F.count_distinct(v).alias(f"{prefix}unique"), F.min(v).alias(f"{prefix}low"), F.max(v).alias(f"{prefix}high"),
        F.avg(v).alias(f"{prefix}mean"), F.max_by("value", at).alias(f"{prefix}last"),
    ]


def coverage(frames, dictionary, messages=None):
    """Per signal and id: frames, unique, low, high, mean, last of all values and (real_...) of real ones.

    A raw value of all ones means 'not available' and is left out of the real statistics, which are null
    without any real value; is_changing tells of two values or more. With ``messages`` (reassembled
    transport messages) their signals are covered too, by source address.
    """
    all_ones = F.when(F.col("length") >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.col("length"), F.lit(63)).cast("int")) - F.lit(1).cast("long"))
    real = F.col("raw") != all_ones
    rows = decode_all(frames, dictionary).withColumn("real", real).select(*KEY, "TS", "seq", "value", "real")
    if messages is not None:
        more = decode_messages(messages, dictionary)
        rows = rows.unionByName(more.select("log_id", F.format_string("SA%02X", F.col("sa").cast("int")).alias("ID"), "message_name", "signal_name", "TS", F.lit(0).cast("long").alias("seq"), "value", real.alias("real")))
    out = rows.groupBy(*KEY).agg(*_statistics(F.lit(True), ""), *_statistics(F.col("real"), "real_"))
    return out.withColumns({"is_changing": F.col("unique") > 1, "real_is_changing": F.when(F.col("real_frames") > 0, F.col("real_unique") > 1)})


def with_empty(covered, frames, dictionary):
    """Adds signals whose message is in the log but that have no value (their multiplexer case is absent)."""
    ids = concrete_ids(frames, dictionary).select("log_id", "ID", "message_name")
    names = dictionary.where("active").select("message_name", "signal_name").distinct()
    missing = ids.join(names, "message_name").join(covered.select(*KEY), KEY, "left_anti")
    return covered.unionByName(missing.withColumns({"frames": F.lit(0).cast("long"), "unique": F.lit(0).cast("long"), "is_changing": F.lit(False)}), allowMissingColumns=True)


def display_filter(covered, exclude_no_data=False, only_changing=False, hide_pdu1=False, search=None, aligned=None):
    """Display filters over ``coverage``; excluding no-data reads the real statistics instead of all.

    aligned: a dictionary; signals not made of whole bytes are hidden.
    """
    changing = F.col("real_is_changing") if exclude_no_data else F.col("is_changing")
    rows = covered.where(F.col("real_frames") > 0) if exclude_no_data else covered
    if only_changing:
        rows = rows.where(changing)
    if hide_pdu1:
        from busfleet.functions.ids import hex_to_int, is_pdu1, pgn_of

        rows = rows.where(~F.coalesce(is_pdu1(pgn_of(hex_to_int("ID"))), F.lit(False)))
    if search:
        rows = rows.where(F.lower(F.concat_ws(" ", "ID", "message_name", "signal_name")).contains(search.lower()))
    if aligned is not None:
        whole = aligned.where("start_bit % 8 = 0 and length % 8 = 0").select("message_name", "signal_name").distinct()
        rows = rows.join(whole, ["message_name", "signal_name"], "left_semi")
    return rows


def last_values(decoded):
    """The last value of each signal in log order."""
    return decoded.groupBy(*KEY).agg(F.max_by("value", F.struct("TS", "seq")).alias("last"), F.max("TS").alias("last_TS"))


def export_rows(covered, dictionary):
    """Rows of a coverage CSV with the signals' geometry: readable again as a dictionary (see sources)."""
    d = dictionary.select("message_name", "signal_name", "start_bit", "length", "le", "type", "scale", "offset", "unit", "mux_start", "mux_bytes", "mux_value").dropDuplicates(["message_name", "signal_name"])
    r = covered.join(d, ["message_name", "signal_name"])
    mux = lambda c: F.when(F.col("mux_value").isNotNull(), F.col(c))
    return r.select(
        F.col("ID").alias("CAN ID"), F.col("message_name").alias("Message"), F.col("signal_name").alias("Parameter"), F.coalesce("unit", F.lit("")).alias("Unit"),
        F.col("start_bit").alias("Start Bit"), F.col("length").alias("Length (bits)"), F.when(F.col("le"), "little_endian").otherwise("big_endian").alias("Byte Order"),
        F.col("type").alias("Value Type"), F.col("scale").alias("Scale"), F.col("offset").alias("Offset"), mux("mux_start").alias("MUX Start"), mux("mux_bytes").alias("MUX bytes"),
        F.col("mux_value").alias("MUX value"), F.col("frames").alias("Frames"), F.col("unique").alias("Unique"), F.col("low").alias("Min"), F.col("high").alias("Max"), F.col("last").alias("Last"),
    )
