"""Signals out of frames: selectors, dictionaries, decoding of one, several or all signals.

A dictionary (``signal_dict``) has a row per signal: dict_name, mode (exact, j1939), active, priority,
message_name, message_len, frame_id, pgn, signal_name, start_bit, length, le, scale, offset, type,
mux_start, mux_bytes, mux_value, unit, description. Frames meet it by equi-joins, on the id and on the group.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.functions.bits import fits, mux_value, packed_be, packed_le, physical, raw_bits
from busfleet.functions.ids import ID_MASK, pgn_of

DDL = (
    "dict_name string, mode string, active boolean, priority int, message_name string, message_len int, frame_id long, pgn long, "
    "signal_name string, start_bit int, length int, le boolean, scale double, offset double, type string, "
    "mux_start int, mux_bytes int, mux_value long, unit string, description string"
)
#: A dimension of more rows is joined by a shuffle, not a broadcast.
BROADCAST_ROWS = 200_000


def bounded(small, most=BROADCAST_ROWS):
    """Broadcasts a dimension whose row count is checked; a larger one joins by Spark's own choice.

    The count runs at once and stops at the bound, so ``small`` should be a dictionary, not a scan of frames.
    """
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def select_frames(frames, mode="exact", id=None, pgn=None):
    """Frames that a selector means: 'exact' an id, 'j1939' a group and, if given, an id too."""
    if mode == "exact":
        return frames.where(F.col("id_int") == F.lit(id))
    chosen = frames.where(pgn_of("id_int") == F.lit(pgn))
    return chosen.where(F.col("id_int") == F.lit(id)) if id is not None else chosen


def _value(le, be, s):
    return physical(raw_bits(le, be, s["start_bit"], s["length"], bool(s.get("le", True))), s["length"], s.get("type", "uint"), float(s.get("scale", 1.0)), float(s.get("offset", 0.0)))


def decode_signal(frames, signal):
    """A series (log_id, series_id, TS, seq, value) of one signal, given as a dict with the dictionary's names."""
    rows = select_frames(frames, signal.get("mode", "exact"), signal.get("frame_id"), signal.get("pgn"))
    if signal.get("mux_bytes"):
        rows = rows.where(mux_value(signal["mux_start"], signal["mux_bytes"]) == F.lit(signal["mux_value"]))
    return rows.select("log_id", F.lit(signal["signal_name"]).alias("series_id"), "TS", "seq", _value(packed_le(), packed_be(), signal).alias("value"))


def decode_columns(frames, signals):
    """Many signals of the same frames in one projection: a column for each."""
    return frames.select("log_id", "TS", "seq", "ID", *(_value(packed_le(), packed_be(), s).alias(s["signal_name"]) for s in signals))


def messages(dictionary):
    """One row per message and dictionary, active ones only: the join keys and the order."""
    active = dictionary.where("active")
    return active.select("dict_name", "mode", "priority", "message_name", "message_len", "frame_id", "pgn").distinct()


def match_messages(frames, dictionary):
    """Each distinct id with its message: dict_name, mode, message_name, message_len.

    An exact dictionary matches the id masked to 29 bits, a j1939 one the group. The dictionary with the
    least priority wins, then the first message by name. Ids without a message are left out.
    """
    ids = frames.select("id_int").where("id_int is not null").distinct().withColumns({"masked": F.col("id_int").bitwiseAND(F.lit(ID_MASK)), "own_pgn": pgn_of("id_int")})
    m = messages(dictionary)
    exact = m.where("mode = 'exact'").withColumn("masked", F.col("frame_id").bitwiseAND(F.lit(ID_MASK)))
    group = m.where("mode = 'j1939'").withColumn("own_pgn", F.col("pgn"))
    both = ids.join(bounded(exact), "masked").unionByName(ids.join(bounded(group), "own_pgn"))
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("id_int").orderBy("priority", "message_name", "dict_name")))
    return best.where("rank = 1").select("id_int", "dict_name", "mode", "priority", "message_name", "message_len")


def decode_all(frames, dictionary):
    """Every frame by every signal of its message: log_id, id_int, ID, TS, seq, message_name, signal_name, value, raw, unit, length.

    Bytes beyond a frame's length count as 0. Multiplexed signals give rows only for their case; signals
    that do not fit eight bytes give none here (transport messages decode theirs).
    """
    signals = dictionary.where("active").where(fits("start_bit", "length", "le"))
    # at most ids x signals rows, found at run time: AQE broadcasts them if they are few
    known = match_messages(frames, dictionary).join(signals.drop("active", "mode", "priority", "message_len"), ["dict_name", "message_name"])
    rows = frames.withColumns({"le_word": packed_le(), "be_word": packed_be()}).join(known, "id_int")
    rows = rows.where(F.col("mux_value").isNull() | (mux_value("mux_start", "mux_bytes") == F.col("mux_value")))
    raw = raw_bits("le_word", "be_word", "start_bit", "length", "le")
    return rows.withColumn("raw", raw).select(
        "log_id", "id_int", "ID", "TS", "seq", "dict_name", "message_name", "signal_name", physical("raw", "length", "type", "scale", "offset").alias("value"), "raw", "unit", "length",
    )


def present_messages(frames, dictionary, present=True):
    """Messages of the dictionary that the log has (left semi) or lacks (left anti)."""
    found = match_messages(frames, dictionary).select("dict_name", "message_name").distinct()
    return messages(dictionary).join(found, ["dict_name", "message_name"], "left_semi" if present else "left_anti")


def concrete_ids(frames, dictionary):
    """One row for each id in the log that carries a message: a group may come from several sources."""
    ids = frames.select("log_id", "ID", "id_int").distinct()
    return ids.join(match_messages(frames, dictionary), "id_int").select("log_id", "ID", "id_int", "message_name", "mode")


def matching_ids(frames, id=None, pgn=None):
    """Ids of the log that equal a target id, or carry a target group."""
    ids = frames.select("log_id", "ID", "id_int").distinct()
    return ids.where(F.col("id_int") == F.lit(id)) if pgn is None else ids.where(pgn_of("id_int") == F.lit(pgn))


def listing(dictionary):
    """Active messages and signals by name."""
    return dictionary.where("active").select("dict_name", "message_name", "signal_name", "unit").distinct().orderBy("dict_name", "message_name", "signal_name")


#: So many signals of a message meet so many others in one piece.
PIECE_ROWS = 10_000


def overlapping_signals(dictionary):
    """Pairs of signals of a message (same multiplexer case) whose bit intervals overlap, little-endian reading.

    The pairs grow with the square of a message's signals. These are dealt into groups by name, and two groups meet
    in a piece of their own. There the names of equal intervals are one row, so a signal meets each
    other interval once, and only pairs that are found cost time.
    """
    case = [F.coalesce("mux_value", F.lit(0)).alias("mux"), F.col("mux_value").isNull().alias("plain")]
    s = dictionary.select("message_name", *case, "signal_name", F.col("start_bit").alias("s"), (F.col("start_bit") + F.col("length")).alias("e"))
    message = ["message_name", "mux", "plain"]
    sizes = s.where("message_name is not null").groupBy(*message).agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("groups"))
    total = sizes.agg(F.sum(F.col("groups") * (F.col("groups") + 1) / 2).cast("long")).first()[0] or 0
    count = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * total, 20_000))
    group = F.pmod(F.xxhash64("signal_name"), F.col("groups")).cast("int").alias("group")
    dealt = s.join(sizes, message).select(*message, "groups", group, F.struct("s", "e").alias("bits"), "signal_name")
    cells = dealt.groupBy(*message, "groups", "group", "bits").agg(F.collect_list("signal_name").alias("names"))
    piece = F.concat_ws("|", "i", "j", "plain", "mux", "message_name").alias("piece")  # the join's only key, so that it keeps these partitions
    own, rest = F.col("group"), F.sequence(F.col("group"), F.col("groups") - 1)
    a = dealt.select("*", own.alias("i"), F.explode(rest).alias("j")).select(piece, "message_name", (own == F.col("j")).alias("one"), "bits", F.col("signal_name").alias("x")).repartition(count, "piece").alias("a")
    b = cells.select("*", F.explode(F.sequence(F.lit(0), own)).alias("i"), own.alias("j")).select(piece, "bits", "names").repartition(count, "piece").alias("b")
    meet = (F.col("a.piece") == F.col("b.piece")) & (F.col("a.bits.s") < F.col("b.bits.e")) & (F.col("b.bits.s") < F.col("a.bits.e"))
    # rows with names on one side: a row of the join gives no more pairs than a group has names, as the engine holds these
    cells = a.join(b.hint("shuffle_hash"), meet & (~F.col("one") | (F.col("a.bits") <= F.col("b.bits"))))
    pairs = cells.select("message_name", "x", (F.col("one") & (F.col("a.bits") == F.col("b.bits"))).alias("same"), F.explode("names").alias("y"))
    pairs = pairs.where((F.col("x") != F.col("y")) & ((F.col("x") < F.col("y")) | ~F.col("same")))
    return pairs.select("message_name", F.least("x", "y").alias("signal_a"), F.greatest("x", "y").alias("signal_b"))


def signals_of_bytes(byte_table, dictionary):
    """Rows with id_int and byte, each with the names of exact-mode signals that touch the byte.

    A signal covers the bits start .. start + length, for big-endian ones too.
    """
    s = dictionary.where("active and mode = 'exact'").select(F.col("frame_id").bitwiseAND(F.lit(ID_MASK)).alias("id_int"), "signal_name", "start_bit", "length")
    covered = s.withColumn("byte", F.explode(F.sequence(F.floor(F.col("start_bit") / 8).cast("int"), F.floor((F.col("start_bit") + F.col("length") - 1) / 8).cast("int"))))
    joined = byte_table.join(bounded(covered.select("id_int", "byte", "signal_name")), ["id_int", "byte"])
    return joined.groupBy("id_int", "byte").agg(F.array_join(F.array_sort(F.collect_set("signal_name")), ",").alias("signals"))
