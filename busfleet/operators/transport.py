"""J1939 transport (broadcast announce): reassembly of multi-packet messages and what they carry."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.functions.bits import BYTES, float32, packed_be, signed, typed_read, unsigned_double
from busfleet.functions.ids import pdu_format, source_address
from busfleet.operators.decode import bounded
from busfleet.operators.stretches import PLACE, running, spans, stretched
from busfleet.streaming.folders import stored

ANNOUNCE, DATA = 0xEC, 0xEB


def transport_words(frames):
    """Announcements (control byte 0x20, 8 bytes) and data frames: log_id, sa, TS, seq, opens, word (the eight bytes)."""
    rows = frames.where("LEN >= 8 and id_int > 2047").withColumns({"pf": pdu_format("id_int"), "sa": source_address("id_int")})
    announce = (F.col("pf") == ANNOUNCE) & (F.col("D0") == 0x20)
    return rows.where(announce | (F.col("pf") == DATA)).select("log_id", "sa", "TS", "seq", announce.alias("opens"), packed_be().alias("word"))


def _byte(word, i):
    return F.shiftrightunsigned(word, 56 - 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _number(word, *places):
    """The little-endian number of bytes of a word."""
    return sum((_byte(word, x) * 256**i for i, x in enumerate(places)), F.lit(0).cast("long"))


def _part(word):
    """The seven bytes that a data frame carries, in hex."""
    return F.lpad(F.hex(word), 16, "0").substr(3, 14)


def _rows(words):
    """Words with what they say: size, packets and group of an announcement, number and part of a data frame."""
    w, opens = F.col("word"), F.col("opens")
    return words.select(
        "log_id", "sa", "TS", "seq", "opens", F.when(opens, _number(w, 1, 2)).alias("size"), F.when(opens, _byte(w, 3).cast("int")).alias("packets"),
        F.when(opens, _number(w, 5, 6, 7)).alias("pgn"), F.when(~opens, _byte(w, 0).cast("int")).alias("number"), F.when(~opens, _part(w)).alias("part"),
    )


def transport_rows(frames):
    """Announcements and data frames with sa, announced size, packets and group."""
    return _rows(transport_words(frames))


def bam_messages(frames):
    """Complete messages: log_id, TS (of the completing frame), sa, pgn, data (binary).

    Any announcement of a source opens a session and closes the one before. It completes with the frame
    by which as many distinct packet numbers (1..255) as announced have come; a repeated number before
    that overwrites, frames after it and sessions that stay incomplete are ignored. Missing segments of
    an odd numbering are zeros. Frames move once, as words, to the stretch of their source's time. A session
    whose first frames there are its packets, each once, is a message at once; its announcement, made void, and the
    frames of all others go through ``_across``. The stretches' sessions are stored, so both come from one pass.
    """
    found, parts = spans(frames), ["log_id", "sa", "__s"]
    cut = stretched(transport_words(frames), found)
    upto = Window.partitionBy(*parts).orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("__n", F.sum(F.col("opens").cast("int")).over(upto))
    # the window leaves the rows dealt as the sessions of a stretch need them
    own = cut.groupBy(*parts, "__n").agg(F.max(F.when(F.col("opens"), F.struct(*PLACE, "word"))).alias("head"), F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct(*PLACE, "word")))).alias("rest"))
    head = F.col("head.word")
    packets = F.coalesce(_byte(head, 3).cast("int"), F.lit(0))
    first = F.array_sort(F.transform(F.slice("rest", 1, packets), lambda x: F.struct(_byte(x["word"], 0).cast("int").alias("number"), x["word"].alias("word"))))
    own = own.withColumn("first", F.when((packets > 0) & (F.size("rest") >= packets), first))
    settled = F.coalesce(F.transform("first", lambda x: x["number"]) == F.when(packets > 0, F.sequence(F.lit(1), packets)), F.lit(False))
    digits = F.array_join(F.transform("first", lambda x: _part(x["word"])), "")
    data = F.unhex(F.rpad(digits, (2 * _number(head, 1, 2)).cast("int"), "0"))
    own = own.withColumn("settled", settled).select(
        "log_id", "sa", "head", "settled", F.when(F.col("settled"), F.get("rest", packets - 1)["TS"]).alias("TS"), F.when(F.col("settled"), _number(head, 5, 6, 7)).alias("pgn"),
        F.when(F.col("settled"), data).alias("data"), F.when(~F.col("settled"), F.col("rest")).alias("rest"),
    )
    own = stored(own, "sessions")
    heads = own.where("head is not null").select("log_id", "sa", "head.*", F.lit(True).alias("opens"), "settled")
    rest = own.where("not settled").select("log_id", "sa", F.explode("rest").alias("x")).select("log_id", "sa", "x.*", F.lit(False).alias("opens"), F.lit(False).alias("settled"))
    # a void announcement has no packets: byte 3 of its word is 0
    void = F.when(F.col("settled"), F.col("word").bitwiseAND(F.lit(~(0xFF << 32)).cast("long"))).otherwise(F.col("word"))
    left = _rows(heads.unionByName(rest).withColumn("word", void))
    done = own.where("settled").select("log_id", "TS", "sa", "pgn", "data")
    return done.unionByName(_across(left, found))


def _across(rows, found):
    """Messages of transport rows in general: sessions over several stretches, repeated and odd numbers.

    Sessions are numbered by a prefix scan over stretches of a source's time; a session then is its numbers, 255
    at most, each with its first and last frame. Only sessions in which a number comes again after the end are
    read a second time, up to that end.
    """
    key = ["log_id", "sa", "session"]
    head = F.when(F.col("opens"), F.struct("size", "packets", "pgn"))
    rows = running(rows, ["log_id", "sa"], total={"session": F.col("opens").cast("long")}, last={"head": head}, found=found)
    rows = rows.where("not opens and session > 0 and number between 1 and 255 and head.packets > 0").withColumn("at", F.struct("TS", "seq"))
    numbers = rows.groupBy(*key, "head", "number").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max_by("part", "at").alias("part"))
    whole = numbers.groupBy(*key, "head").agg(F.array_sort(F.collect_list(F.struct("first", "number", "last", "part"))).alias("found"))
    ended = whole.withColumn("end", F.get("found", F.col("head.packets") - 1)["first"]).where("end is not null")
    ended = ended.withColumn("used", F.filter("found", lambda x: x["first"] <= F.col("end")))
    late = F.exists("used", lambda x: x["last"] > F.col("end"))
    clean = ended.where(~late).select(*key, "head", "end", F.transform("used", lambda x: F.struct(x["number"].alias("number"), x["part"].alias("part"))).alias("used"))
    again = rows.join(ended.where(late).select(*key, "end"), key).where("at <= end").groupBy(*key, "head", "end", "number").agg(F.max_by("part", "at").alias("part"))
    again = again.groupBy(*key, "head", "end").agg(F.collect_list(F.struct("number", "part")).alias("used"))
    used = clean.unionByName(again).withColumn("used", F.array_sort("used"))
    # each part with zeros for the numbers missing before it; both arrays are made once for a message
    numbers = F.transform("used", lambda x: x["number"])
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), numbers), numbers, lambda a, b: b - a - 1)
    digits = F.array_join(F.zip_with("used", gaps, lambda x, gap: F.concat(F.repeat(F.lit("0" * 14), gap), x["part"])), "")
    width = 2 * F.col("head.size").cast("int")
    return used.select("log_id", F.col("end.TS").alias("TS"), "sa", F.col("head.pgn").alias("pgn"), F.unhex(F.rpad(digits, width, "0")).alias("data"))


def announced_groups(frames):
    """Groups announced in each log with their sources and number of announcements."""
    return transport_rows(frames).where("opens").groupBy("log_id", "pgn", "sa").agg(F.count("*").alias("announcements"), F.max("size").alias("size"))


def groups_present(frames):
    """Parameter groups of a log's frames and how many frames carry each."""
    from busfleet.functions.ids import pgn_of

    return frames.withColumn("pgn", pgn_of("id_int")).where("pgn is not null").groupBy("log_id", "pgn").agg(F.count("*").alias("frames"))


def payload_length(frames, messages=None, id=None, pgn=None):
    """The largest payload of a selection, transport messages included."""
    from busfleet.operators.decode import select_frames

    sizes = select_frames(frames, "exact" if pgn is None else "j1939", id, pgn).select("LEN")
    if messages is not None and pgn is not None:
        sizes = sizes.unionByName(messages.where(F.col("pgn") == pgn).select(F.length("data").alias("LEN")))
    return sizes.agg(F.max("LEN").alias("length"))


def long_bits(data, start, length):
    """Little-endian bits of a payload of any length, up to 56 bits at a time; null beyond its end."""
    n = lambda x: F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x
    d, s, k = F.col(data) if isinstance(data, str) else data, n(start), n(length)
    first = F.floor(s / 8).cast("int")
    size = (F.floor((s % 8 + k + 7) / 8)).cast("int")
    digits = F.hex(F.substring(d, first + 1, size))
    word = F.aggregate(F.sequence(size, F.lit(1), F.lit(-1)), F.lit(0).cast("long"), lambda a, i: a * 256 + F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    cut = F.call_function("shiftright", word, (s % 8).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int")) - F.lit(1).cast("long"))
    return F.when(F.length(d) * 8 >= s + k, cut)


def selector_value(data, start, count):
    """The big-endian number of ``count`` bytes (7 at most) from byte ``start``; bytes beyond the payload are 0."""
    d, s, k = F.col(data), F.lit(start) if isinstance(start, int) else F.col(start), F.lit(count) if isinstance(count, int) else F.col(count)
    digits = F.rpad(F.hex(F.substring(d, s + 1, k)), 2 * k, "0")
    return F.when(k > 0, F.conv(digits, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def long_raw(data, start, length, le):
    """Up to 64 bits of a payload of any length as a signed long; null beyond its end.

    A little-endian field starts at its least bit, a big-endian one at its greatest, as in dictionaries.
    """
    d, s, k = F.col(data), F.col(start), F.col(length)
    first_bit = F.when(F.col(le), s).otherwise(F.floor(s / 8) * 8 + 7 - s % 8).cast("int")
    first, size = F.floor(first_bit / 8).cast("int"), F.floor((first_bit % 8 + k + 7) / 8).cast("int")
    digits = F.hex(F.substring(d, first + 1, size))
    parts = F.transform(F.sequence(F.lit(1), size), lambda i: F.lpad(F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 2), 8, "0"))
    cells = F.array_join(F.when(F.col(le), F.reverse(parts)).otherwise(parts), "")
    at = F.when(F.col(le), size * 8 - first_bit % 8 - k + 1).otherwise(first_bit % 8 + 1).cast("int")
    return F.when((k > 0) & (F.length(d) * 8 >= first_bit + k), F.conv(F.substring(cells, at, k), 2, -10).cast("long"))


def decode_messages(messages, dictionary):
    """Signals of reassembled messages by their group: log_id, TS, sa, pgn, message_name, signal_name, value, unit, raw, length.

    Every message is decoded, not only a log's last. A payload is cut or filled up with zeros to the length
    that the dictionary has for its message. Signals of either byte order, up to 64 bits.
    """
    s = dictionary.where("active and mode = 'j1939' and message_len > 8 and length <= 64").select("pgn", "message_name", "message_len", "signal_name", "start_bit", "length", "le", "type", "scale", "offset", "unit", "mux_start", "mux_bytes", "mux_value")
    rows = messages.join(bounded(s), "pgn").withColumn("data", F.expr("rpad(data, message_len, x'00')"))
    rows = rows.where(F.col("mux_value").isNull() | (selector_value("data", "mux_start", "mux_bytes") == F.col("mux_value"))).withColumn("raw", long_raw("data", "start_bit", "length", "le")).where("raw is not null")
    number = F.when(F.col("type") == "float32", float32("raw")).when(F.col("type") == "int", signed("raw", "length").cast("double")).otherwise(unsigned_double("raw"))
    return rows.select("log_id", "TS", "sa", "pgn", "message_name", "signal_name", (number * F.col("scale") + F.col("offset")).alias("value"), "unit", "raw", "length")


def frame_groups(frames):
    """Transport frames with the group that the source announced last, at or before the frame."""
    rows = running(transport_rows(frames), ["log_id", "sa"], last={"announced": F.col("pgn")}, found=spans(frames))
    return rows.select("log_id", "sa", "TS", "seq", "opens", "announced")


def chunks(messages, size, first=0):
    """Records of ``size`` bytes within each payload from byte ``first`` on; a partial tail is dropped."""
    n = F.floor((F.length("data") - first) / size).cast("int")
    rows = messages.withColumn("chunk", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return rows.withColumn("record", F.substring("data", F.col("chunk") * size + first + 1, F.lit(size)))


def read_field(rows, offset, dtype, column="data"):
    """A typed value at a byte offset of each payload; short payloads give no row."""
    return rows.withColumn("value", typed_read(F.col(column), offset, dtype).cast("double")).where("value is not null")
