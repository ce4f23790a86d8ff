"""Frame tables derived from the star-schema tables, by the same arithmetic in Spark and in SQL.

F: frames from ``events``. B: many frames with equal times, from ``lineitem``. D: multi-packet transport
frames that carry the texts of ``documents``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.functions.bits import BYTES

COLUMNS = ["log_id", "seq", "TS", "Bus", "ID", "id_int", "DATA", "LEN", *BYTES]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _finish(rows):
    """Adds ID and DATA to rows that have id_int, LEN and the bytes."""
    digits = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in BYTES))
    return rows.select(
        "log_id", "seq", "TS", "Bus", F.hex("id_int").alias("ID"), "id_int", digits.substr(F.lit(1), 2 * F.col("LEN")).alias("DATA"), F.col("LEN").cast("int").alias("LEN"),
        *(F.col(c).cast("int").alias(c) for c in BYTES),
    )


def events_frames(spark, sf_dir):
    """F: one log; ids mix the series of several users."""
    e = table(spark, sf_dir, "events").withColumn("TS", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("TS", "event_id")).cast("long"))
    u, cents = F.col("user_id"), F.round(F.col("value") * 100).cast("long")
    error = F.col("event_type") == "error"
    return _finish(e.select(
        F.lit("events").alias("log_id"), F.col("event_id").cast("long").alias("seq"), "TS", F.concat(F.lit("can"), (u % 2).cast("string")).alias("Bus"),
        F.when(u % 5 == 0, 256 + u).otherwise(402653184 + (240 + u % 10) * 65536 + (F.floor(u / 10) % 16) * 256 + u % 3).cast("long").alias("id_int"),
        F.when(error, 6).otherwise(8).alias("LEN"), (F.col("rn") * 37 % 256).alias("D0"), (F.floor(F.col("rn") * 37 / 256) % 256).alias("D1"),
        F.when(F.col("event_type") == "click", 0).when(error, 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4).alias("D2"),
        (F.floor("value") % 256).alias("D3"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("D4"), F.lit(255).alias("D5"),
        F.when(error, 0).otherwise(cents % 256).alias("D6"), F.when(error, 0).otherwise(F.floor(cents / 256) % 256).alias("D7"),
    ))


EVENTS_SQL = r"""
    e as (select event_id, epoch_us(ts) / 1000000.0::double as TS, user_id, event_type, value, props,
            row_number() over (partition by user_id order by ts, event_id) as rn from events),
    f as (select 'events' as log_id, event_id as seq, TS, concat('can', cast(user_id % 2 as varchar)) as Bus,
        cast(case when user_id % 5 = 0 then 256 + user_id
             else 402653184 + (240 + user_id % 10) * 65536 + (cast(floor(user_id / 10) as bigint) % 16) * 256 + user_id % 3 end as bigint) as id_int,
        case when event_type = 'error' then 6 else 8 end as LEN,
        cast((rn * 37) % 256 as int) as D0, cast(cast(floor(rn * 37 / 256) as bigint) % 256 as int) as D1,
        case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as D2,
        cast(cast(floor(value) as bigint) % 256 as int) as D3, cast(regexp_extract(props, '([0-9]+)', 1) as int) as D4, 255 as D5,
        cast(case when event_type = 'error' then 0 else cast(round(value * 100) as bigint) % 256 end as int) as D6,
        cast(case when event_type = 'error' then 0 else cast(floor(round(value * 100) / 256) as bigint) % 256 end as int) as D7
        from e),
    frames as (select *, printf('%X', id_int) as ID,
        substr(printf('%02X%02X%02X%02X%02X%02X%02X%02X', D0, D1, D2, D3, D4, D5, D6, D7), 1, 2 * LEN) as DATA from f)"""


def lineitem_frames(spark, sf_dir):
    """B: an id per supplier, a time per shipping day, many equal times."""
    by = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    r = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(by).cast("long"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return _finish(r.select(
        F.lit("lineitem").alias("log_id"), "seq", (F.unix_date(F.col("l_shipdate").cast("date")) * 86400.0).alias("TS"), F.lit("can0").alias("Bus"),
        (402653184 + F.col("l_suppkey")).cast("long").alias("id_int"), F.lit(8).alias("LEN"), (F.col("seq") % 256).alias("D0"), (F.col("l_linenumber") % 256).alias("D1"),
        (F.floor("l_quantity") % 256).alias("D2"), (F.col("l_partkey") % 256).alias("D3"), (cents % 256).alias("D4"), (F.floor(cents / 256) % 256).alias("D5"),
        (F.floor(cents / 65536) % 256).alias("D6"), F.lit(255).alias("D7"),
    ))


LINEITEM_SQL = r"""
    e as (select *, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as seq,
            cast(round(l_extendedprice * 100) as bigint) as cents from lineitem),
    frames as (select 'lineitem' as log_id, seq, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) * 86400.0::double as TS, 'can0' as Bus,
        cast(402653184 + l_suppkey as bigint) as id_int, printf('%X', cast(402653184 + l_suppkey as bigint)) as ID, 8 as LEN, cast(seq % 256 as int) as D0, cast(l_linenumber % 256 as int) as D1,
        cast(cast(floor(l_quantity) as bigint) % 256 as int) as D2, cast(l_partkey % 256 as int) as D3, cast(cents % 256 as int) as D4,
        cast((cents // 256) % 256 as int) as D5, cast((cents // 65536) % 256 as int) as D6, 255 as D7 from e)"""


#: A transport message carries so many bytes at most: 255 packets of 7. A longer text goes as several messages.
MESSAGE_BYTES = 1785
#: Times of the transport frames: documents, then messages of a document, then frames of a message.
PER_DOCUMENT, PER_MESSAGE = 100_000_000, 1000


def transport_frames(spark, sf_dir):
    """D: the whole text of each document as successive messages: an announcement and its packets each."""
    return frames_of(table(spark, sf_dir, "documents"))


def frames_of(documents):
    """The transport frames of a table or a stream of documents."""
    docs = documents.select("doc_id", F.encode("text", "UTF-8").alias("b")).where(F.length("b") > 0)
    count = F.ceil(F.length("b") / MESSAGE_BYTES).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("b", i * MESSAGE_BYTES + 1, F.lit(MESSAGE_BYTES)))
    m = docs.select("doc_id", F.posexplode(pieces).alias("message", "p"))
    n, packets = F.length("p"), F.ceil(F.length("p") / 7).cast("int")
    # a row per frame first, so that its bytes are made in compiled code and only if they are asked for
    rows = m.select("doc_id", "message", "p", n.alias("n"), packets.alias("packets"), F.explode(F.sequence(F.lit(0), packets)).alias("k"))
    le = lambda x, i: F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0")
    n, packets, pgn = F.col("n"), F.col("packets"), F.lit(0xFE00) + F.col("doc_id") % 256
    announcement = F.concat(F.lit("20"), le(n, 0), le(n, 1), le(packets, 0), F.lit("FF"), le(pgn, 0), le(pgn, 1), le(pgn, 2))
    part = F.concat(le(F.col("k"), 0), F.rpad(F.hex(F.substring("p", (F.col("k") - 1) * 7 + 1, F.lit(7))), 14, "F"))
    at = F.col("doc_id") * PER_DOCUMENT + F.col("message") * PER_MESSAGE + F.col("k")
    out = rows.select(
        F.lit("documents").alias("log_id"), at.cast("long").alias("seq"), at.cast("double").alias("TS"),
        F.lit("can0").alias("Bus"), (F.when(F.col("k") == 0, 0x18ECFF00).otherwise(0x18EBFF00) + F.col("doc_id") % 254).cast("long").alias("id_int"), F.lit(8).alias("LEN"),
        F.conv(F.when(F.col("k") == 0, announcement).otherwise(part), 16, -10).cast("long").alias("word"),
    )
    byte = lambda i: F.shiftrightunsigned("word", 56 - 8 * i).bitwiseAND(F.lit(255).cast("long"))
    return _finish(out.withColumns({c: byte(i) for i, c in enumerate(BYTES)}).drop("word"))


def transport_place(ts="TS"):
    """The document and the message in it that a transport frame's time stands for."""
    return F.floor(F.col(ts) / PER_DOCUMENT).cast("long").alias("doc_id"), (F.floor(F.col(ts) / PER_MESSAGE) % (PER_DOCUMENT // PER_MESSAGE)).cast("int").alias("message")
