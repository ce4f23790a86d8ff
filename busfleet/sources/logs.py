"""Capture logs as frame tables: candump (compact and spaced) and memorator text, batch or stream.

Each line's format is told by its file (batch) or by the line (stream), so a folder may mix formats. seq
sorts lines as the files have them: file, split, position; it is stored once, at ingest.
"""

from pyspark.sql import functions as F

from busfleet.functions.bits import BYTES
from busfleet.functions.ids import hex_to_int

# The line formats of the captures.
COMPACT = r"^\(([\d.]+)\)\s+(\S+)\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]{0,16})\s*$"
SPACED = r"^\(([\d.]+)\)\s+(\S+)\s+([0-9A-Fa-f]+)\s+\[(\d+)\]\s*((?:[0-9A-Fa-f]{2}\s*){0,8})\s*$"
MEMORATOR = r"^\s*([\d.]+)\s+(\d+)\s+([0-9A-Fa-f]+)x?\s+\S+\s+(\d+)\s+((?:[0-9A-Fa-f]{2}(?:\s+|$)){0,8})"
CREATED = r"Memorator Binary logfile created at:\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"

SCHEMA = "log_id string, seq long, TS double, Bus string, ID string, id_int long, DATA string, LEN int, " + ", ".join(f"{c} int" for c in BYTES)


def _at(pattern, group):
    return F.regexp_extract("value", pattern, group)


def parse_lines(rows, format="auto"):
    """Rows with a ``value`` line to raw frames (TS, Bus, ID, DATA, declared); lines of no format are dropped.

    format: 'auto', 'compact', 'spaced', 'memorator', or a column with one of these ('candump' for either
    of the first two). Lines with 'Trigger' are no memorator frames.
    """
    kind = F.lit(format) if isinstance(format, str) else format
    any_of = lambda *k: kind.isin("auto", *k)
    form = (
        F.when(any_of("compact", "candump") & F.col("value").rlike(COMPACT), "c").when(any_of("spaced", "candump") & F.col("value").rlike(SPACED), "s")
        .when(any_of("memorator") & F.col("value").rlike(MEMORATOR) & ~F.col("value").contains("Trigger"), "m")
    )
    pick = lambda g: F.when(F.col("form") == "c", _at(COMPACT, g)).when(F.col("form") == "s", _at(SPACED, g)).otherwise(_at(MEMORATOR, g))
    # generated, as filters on columns that are only computed would repeat every pattern below
    rows = rows.withColumn("form", F.explode(F.array(form))).where("form is not null")
    data = F.when(F.col("form") == "c", _at(COMPACT, 4)).otherwise(F.regexp_replace(F.when(F.col("form") == "s", _at(SPACED, 5)).otherwise(_at(MEMORATOR, 5)), r"\s+", ""))
    declared = F.when(F.col("form") == "s", _at(SPACED, 4)).when(F.col("form") == "m", _at(MEMORATOR, 4)).cast("int")
    parts = {"TS": pick(1).try_cast("double"), "Bus": pick(2), "ID": pick(3), "DATA": data, "declared": declared}
    rows = rows.withColumn("__parts", F.explode(F.array(F.struct(*(c.alias(n) for n, c in parts.items())))))
    return rows.withColumns({n: F.col(f"__parts.{n}") for n in parts}).where("TS is not null").drop("form", "value", "__parts")


def normalize_frames(rows):
    """Raw frames to the frame schema: clean ids and payloads, lengths, bytes padded by zeros.

    LEN is the declared length or the payload's, whichever is less; odd digit counts round down. Payloads
    keep eight bytes.
    """
    data = F.substring(F.upper(F.coalesce("DATA", F.lit(""))), 1, 16)
    length = F.floor(F.length("DATA") / 2).cast("int")
    declared = F.col("declared") if "declared" in rows.columns else F.lit(None).cast("int")
    rows = rows.withColumns({"ID": F.regexp_replace(F.upper(F.trim("ID")), "X$", ""), "DATA": data})
    rows = rows.withColumns({"id_int": hex_to_int("ID"), "LEN": F.when(declared.isNull(), length).otherwise(F.least(declared, length)), "padded": F.rpad("DATA", 16, "0")})
    out = rows.withColumns({c: F.conv(F.substring("padded", 2 * i + 1, 2), 16, 10).cast("int") for i, c in enumerate(BYTES)})
    return out.select("log_id", F.col("seq").cast("long").alias("seq"), "TS", "Bus", "ID", "id_int", "DATA", "LEN", *BYTES)


def text_lines(spark, path):
    """Lines of text files: log_id (the path), value, place (split), line; blank lines too."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("log_id"), "value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def detect_formats(lines):
    """Per file: 'memorator' by its header, else the format of its first line that parses; 'candump' by default."""
    form = F.when(F.col("value").rlike(COMPACT), "compact").when(F.col("value").rlike(SPACED), "spaced").when(F.col("value").rlike(MEMORATOR), "memorator")
    return lines.withColumn("form", form).groupBy("log_id").agg(
        F.when(F.max(F.col("value").rlike(CREATED)), F.lit("memorator")).otherwise(F.coalesce(F.min_by(F.when(F.col("form").isNotNull(), F.col("form")), F.when(F.col("form").isNotNull(), F.struct("split", "line"))), F.lit("candump"))).alias("format"),
        F.max(F.nullif(F.regexp_extract("value", CREATED, 1), F.lit(""))).alias("created"),
    )


def read_logs(spark, path, normalize=False, utc_offset_hours=None):
    """Frames of all files below a path, whatever their formats.

    normalize: the first frame of each log is time 0. utc_offset_hours: memorator times become epoch
    seconds by the file's creation time at that offset from UTC.
    """
    lines = text_lines(spark, path)
    rows = lines.join(detect_formats(lines), "log_id")
    # within a file lines rise with (split, line); splits of a file are read by growing start
    frames = parse_lines(rows.withColumn("seq", F.col("split") * 2**20 + F.pmod(F.col("line"), F.lit(2**33))), F.col("format"))
    if utc_offset_hours is not None:
        start = F.unix_timestamp(F.to_timestamp("created")) - utc_offset_hours * 3600.0
        frames = frames.withColumn("TS", F.col("TS") + F.when(F.col("format") == "memorator", F.coalesce(start, F.lit(0.0))).otherwise(0.0))
    frames = normalize_frames(frames)
    return normalize_time(frames) if normalize else frames


def read_candump(spark, path, normalize=False):
    """Frames of candump logs, compact or spaced lines; other lines are dropped."""
    rows = text_lines(spark, path).withColumn("seq", F.col("split") * 2**20 + F.pmod(F.col("line"), F.lit(2**33)))
    frames = normalize_frames(parse_lines(rows, "candump"))
    return normalize_time(frames) if normalize else frames


def normalize_time(frames, offset=0.0):
    """Times from each log's first frame in capture order (not the least time), plus an offset, rounded to 6."""
    first = frames.groupBy("log_id").agg(F.min_by("TS", "seq").alias("__t0"))
    return frames.join(first, "log_id").withColumn("TS", F.round(F.lit(offset) + F.col("TS") - F.col("__t0"), 6)).select(*frames.columns)


def replay(frames, offset):
    """A log's times moved to start at ``offset``."""
    return normalize_time(frames, offset)


def frames_from_records(rows, log_id="records"):
    """Structured rows (seq, ts, bus, id as number or hex text, data BINARY) to frames; eight bytes are kept."""
    id = F.upper(F.col("id")) if dict(rows.dtypes)["id"] == "string" else F.hex(F.col("id").cast("long"))
    raw = rows.select(F.lit(log_id).alias("log_id"), "seq", F.col("ts").cast("double").alias("TS"), F.col("bus").cast("string").alias("Bus"), id.alias("ID"), F.hex(F.substring("data", 1, 8)).alias("DATA"))
    return normalize_frames(raw)


def merge_logs(base, incoming, shift=False):
    """Both logs as one, named as the base's first row; incoming rows come after the base's in seq.

    shift: times of the incoming log become relative to the base's original first time.
    """
    top = base.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("__top"), F.min_by("TS", "seq").alias("__t0"), F.min_by("log_id", "seq").alias("__log"))
    moved = incoming.crossJoin(F.broadcast(top))  # one row
    moved = moved.withColumns({"seq": F.col("seq") + F.col("__top"), "log_id": F.coalesce("__log", "log_id"), "TS": F.col("TS") - F.coalesce("__t0", F.lit(0.0)) if shift else F.col("TS")})
    return base.unionByName(moved.select(*base.columns))


def stream_frames(lines, format="auto", log_id="stream", ts_offset=0.0, arrival=None, start=None):
    """A stream of lines (column value) to a stream of frames.

    arrival: a timestamp column to use instead of the device's time; ts_offset is added; start: an epoch
    that is subtracted. Lines of error frames parse as no format and are dropped.
    """
    rows = lines.select(F.col("value").cast("string").alias("value"), *([F.col(arrival).alias("__arrival")] if arrival else []))
    frames = parse_lines(rows.withColumns({"log_id": F.lit(log_id)}), format)
    ts = F.unix_micros("__arrival") / 1e6 if arrival else F.col("TS")
    frames = frames.withColumn("TS", ts + ts_offset - (start or 0.0)).withColumn("seq", F.round(F.col("TS") * 1e6).cast("long"))
    return normalize_frames(frames)


def read_stream(spark, path, files_per_trigger=1, **options):
    """Frames of log files as they appear in a folder."""
    return stream_frames(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), **options)


def candump_lines(frames):
    """Each frame as a compact candump line; null times, buses and ids become 0, can0 and 0."""
    return frames.select(F.format_string("(%.6f) %s %s#%s", F.coalesce("TS", F.lit(0.0)), F.coalesce("Bus", F.lit("can0")), F.coalesce("ID", F.lit("0")), F.coalesce("DATA", F.lit(""))).alias("value"))


def write_candump(frames, path):
    candump_lines(frames.sort("log_id", "TS", "seq")).write.text(path)
