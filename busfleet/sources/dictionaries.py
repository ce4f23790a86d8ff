"""Signal dictionaries as tables: DBC text, group-map CSV, exported scan CSV. See operators.decode for the columns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.functions.ids import ID_MASK, hex_to_int, id_of_pgn, pgn_of
from busfleet.operators.decode import DDL

COLUMNS = [c.split()[0] for c in DDL.split(", ")]
MESSAGE = r"^\s*BO_\s+(\d+)\s+([^\s:]+)\s*:\s*(\d+)"
SIGNAL = r'^\s*SG_\s+(\S+)\s*(M|m\d+M?)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(([^,]+),([^)]+)\)\s*\[[^\]]*\]\s*"([^"]*)"'
FLOAT = r"^\s*SIG_VALTYPE_\s+(\d+)\s+(\S+)\s*:?\s*([12])"
COMMENT = r'^\s*CM_\s+SG_\s+(\d+)\s+(\S+)\s+"([^"]*)"'
GROUP_COLUMNS = {"PGN", "PGN Byte Offset", "Parameter Length (Bytes)"}
SCAN_COLUMNS = {"CAN ID", "Parameter", "Start Bit", "Length (bits)"}


def sanitized(text, fallback):
    """A name of letters, digits and underscores that does not start with a digit."""
    name = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")
    name = F.when(name == "", fallback).otherwise(name)
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def unique_names(rows, name, order, scope=("dict_name",)):
    """In order, a name that is taken gets the first of _2, _3, ... that makes it free, within its scope.

    A name given so may take a later one's, which then gets a number itself. Only names that differ in
    numbers at their ends can meet, so each such family of a dictionary is settled by itself.
    """

    def settle(family):
        taken, upto, out = set(), {}, []
        for base in family.sort_values(list(order))[name]:
            found, k = base, upto.get(base, 2)
            while found in taken:
                found, k = f"{base}_{k}", k + 1
            upto[base] = k
            taken.add(found)
            out.append(found)
        return family.sort_values(list(order)).assign(**{name: out})

    stem = F.regexp_replace(name, "(_[0-9]+)+$", "")
    return rows.groupBy(*scope, stem).applyInPandas(settle, rows.schema)


def with_mux(signals):
    """Fills mux_start and mux_bytes of multiplexed signals from their message's first selector, in whole bytes.

    Needs mux_value (null: none) and selector (true for a selector), start_bit and length.
    """
    first = signals.where("selector").groupBy("dict_name", "frame_id").agg(F.min_by(F.struct((F.floor(F.col("start_bit") / 8)).cast("int").alias("s"), F.greatest(F.floor((F.col("length") + 7) / 8), F.lit(1)).cast("int").alias("n")), "line").alias("m"))
    joined = signals.join(first, ["dict_name", "frame_id"], "left")
    has = F.col("mux_value").isNotNull() & F.col("m").isNotNull()
    return joined.withColumns({"mux_start": F.when(has, F.col("m.s")).otherwise(0), "mux_bytes": F.when(has, F.col("m.n")).otherwise(0)}).drop("m")


#: The characters of cp1252 at the bytes 0x80 to 0x9F, where it differs from Latin-1; fixed values, five are undefined.
CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def dbc_text(content):
    """The text of a DBC file's bytes: UTF-8 if they are, else cp1252."""
    as_utf8, as_latin = content.cast("string"), F.decode(content, "ISO-8859-1")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.translate(as_latin, "".join(map(chr, range(0x80, 0xA0))), CP1252))


def read_dbc(spark, path, mode="exact", priority=0, active=True):
    """The dictionary of DBC files; dict_name is the file. Lines outside the known subset are passed over.

    A signal belongs to the message line before it. Files that are no UTF-8 are read as cp1252. Scale 0
    counts as 1; of several multiplexer ids the first is kept; length 0 becomes the signals' span, or 8.
    A file is read whole, as its encoding is a matter of all its bytes.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("dict_name"), dbc_text(F.col("content")).alias("text"))
    return parse_dbc(dbc_lines(files), mode, priority, active)


def dbc_lines(files):
    """Files (dict_name, text) as rows (dict_name, line, value)."""
    return files.select("dict_name", F.posexplode(F.split("text", "\r?\n")).alias("line", "value")).withColumn("line", F.col("line").cast("long"))


def parse_dbc(rows, mode="exact", priority=0, active=True):
    """Rows (dict_name, line, value) of DBC text to a dictionary."""
    x = lambda p, g: F.nullif(F.regexp_extract("value", p, g), F.lit(""))
    by = Window.partitionBy("dict_name").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("value").rlike(MESSAGE), F.struct(x(MESSAGE, 1).cast("long").alias("id"), x(MESSAGE, 2).alias("name"), x(MESSAGE, 3).cast("int").alias("len")))
    body = rows.where(F.col("value").rlike("^\\s*(BO_|SG_)\\s")).withColumn("m", F.last(head, ignorenulls=True).over(by))
    s = body.where(F.col("value").rlike(SIGNAL) & F.col("m").isNotNull()).select(
        "dict_name", "line", F.col("m.name").alias("message_name"), F.col("m.len").alias("declared"), F.col("m.id").alias("dbc_id"), F.col("m.id").bitwiseAND(F.lit(ID_MASK)).alias("frame_id"), x(SIGNAL, 1).alias("signal_name"),
        F.coalesce(x(SIGNAL, 2), F.lit("")).alias("mux"), x(SIGNAL, 3).cast("int").alias("start_bit"), x(SIGNAL, 4).cast("int").alias("length"), (x(SIGNAL, 5) == "1").alias("le"), (x(SIGNAL, 6) == "-").alias("signed"),
        x(SIGNAL, 7).cast("double").alias("scale"), x(SIGNAL, 8).cast("double").alias("offset"), F.coalesce(x(SIGNAL, 9), F.lit("")).alias("unit"),
    )
    floats = rows.where(F.col("value").rlike(FLOAT)).select("dict_name", x(FLOAT, 1).cast("long").alias("dbc_id"), x(FLOAT, 2).alias("signal_name"), F.lit(True).alias("float"))
    notes = rows.where(F.col("value").rlike(COMMENT)).select("dict_name", x(COMMENT, 1).cast("long").alias("dbc_id"), x(COMMENT, 2).alias("signal_name"), x(COMMENT, 3).alias("description"))
    key = ["dict_name", "dbc_id", "signal_name"]
    s = s.join(floats.dropDuplicates(key), key, "left").join(notes.dropDuplicates(key), key, "left")
    s = s.withColumns({"mux_value": F.regexp_extract("mux", r"^m(\d+)", 1).try_cast("long"), "selector": F.col("mux").endswith("M")})
    span = F.ceil(F.max(F.col("start_bit") + F.col("length")).over(Window.partitionBy("dict_name", "frame_id")) / 8).cast("int")
    s = s.withColumn("message_len", F.when(F.col("declared") > 0, F.col("declared")).otherwise(F.coalesce(span, F.lit(8))))
    s = s.withColumns({"type": F.when(F.col("float"), "float32").when(F.col("signed"), "int").otherwise("uint"), "scale": F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))})
    return _complete(with_mux(s), mode, priority, active)


def _complete(rows, mode, priority, active):
    rows = rows.withColumns({"mode": F.lit(mode), "active": F.lit(active), "priority": F.lit(priority), "pgn": pgn_of("frame_id") if mode == "j1939" else F.lit(None).cast("long")})
    if "description" not in rows.columns:
        rows = rows.withColumn("description", F.lit(None).cast("string"))
    kinds = dict(c.split() for c in DDL.split(", "))
    return rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))


def _csv(spark, path):
    rows = spark.read.option("header", True).option("multiLine", False).csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("dict_name"), F.monotonically_increasing_id().alias("line"))


def csv_schema(rows):
    """'groups' or 'scan' by the column names; other tables are an error."""
    names = set(rows.columns)
    if GROUP_COLUMNS <= names:
        return "groups"
    if SCAN_COLUMNS <= names:
        return "scan"
    raise ValueError(f"neither a group map nor a scan export: {sorted(names)}")


def read_dictionary_csv(spark, path, **options):
    """Either kind of dictionary CSV, told by its columns."""
    rows = _csv(spark, path)
    return (group_map if csv_schema(rows) == "groups" else scan_export)(rows, **options)


def _number(rows, name, default, kind="double"):
    if name not in rows.columns:
        return F.lit(default).cast(kind)
    return F.coalesce(F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit("")).try_cast("double"), F.lit(default).cast("double")).cast(kind)


def _little(column):
    return ~F.lower(F.trim(F.coalesce(column, F.lit("")))).isin("be", "big", "big endian", "big-endian", "big_endian", "motorola")


def group_map(rows, priority=0, active=True, source=0):
    """Rows of a group map (byte offsets and lengths by PGN) to a j1939 dictionary."""
    rows = rows.where(F.trim(F.coalesce(F.col("PGN").cast("string"), F.lit(""))) != "").withColumn("pgn", _number(rows, "PGN", 0, "long"))
    order = [c for c in rows.columns if c.lower().replace(" ", "").replace("_", "") in ("byteorder", "endian", "endianness")]
    first = Window.partitionBy("dict_name", "pgn").orderBy("line")
    s = rows.withColumns({
        "at": _number(rows, "PGN Byte Offset", 0, "int"), "size": _number(rows, "Parameter Length (Bytes)", 1, "int"), "rank": F.first(_number(rows, "PGN Priority", 6, "int")).over(first),
        "message_len": F.max(_number(rows, "PGN Max Size", 8, "int")).over(Window.partitionBy("dict_name", "pgn")), "scale": _number(rows, "Scale/Resolution", 1.0), "offset": _number(rows, "Offset", 0.0),
    })
    s = s.select(
        "dict_name", "line", "pgn", "message_len", F.format_string("PGN_%d", "pgn").alias("message_name"), id_of_pgn("pgn", F.col("rank"), source).alias("frame_id"),
        sanitized(F.col("Description") if "Description" in rows.columns else F.lit(""), F.format_string("SPN_%d", "at")).alias("signal_name"), (F.col("at") * 8).alias("start_bit"), (F.col("size") * 8).alias("length"),
        (_little(F.col(f"`{order[0]}`")) if order else F.lit(True)).alias("le"), F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")).alias("scale"), "offset", F.lit("uint").alias("type"),
        (F.trim(F.coalesce("Unit", F.lit(""))) if "Unit" in rows.columns else F.lit("")).alias("unit"), F.lit(0).alias("mux_start"), F.lit(0).alias("mux_bytes"), F.lit(None).cast("long").alias("mux_value"),
    )
    return _complete(unique_names(s, "signal_name", ["pgn", "line"]), "j1939", priority, active)


def scan_export(rows, priority=0, active=True):
    """Rows of an exported scan to an exact dictionary.

    A multiplexed row's selector is the plain row at its byte position and size; where no plain row is
    there, one is made.
    """
    rows = rows.withColumn("frame_id", hex_to_int(F.col("CAN ID"))).where("frame_id is not null")
    text = lambda n, d="": F.trim(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(d))) if n in rows.columns else F.lit(d)
    multiplexed = text("MUX Start") != ""
    s = rows.select(
        "dict_name", "line", "frame_id", text("Message").alias("message"), F.lit(8).alias("message_len"), _number(rows, "Start Bit", 0, "int").alias("start_bit"), F.greatest(_number(rows, "Length (bits)", 1, "int"), F.lit(1)).alias("length"),
        _little(text("Byte Order")).alias("le"), F.when(text("Value Type", "uint") == "", "uint").otherwise(F.lower(text("Value Type", "uint"))).alias("type"), _number(rows, "Scale", 1.0).alias("scale"), _number(rows, "Offset", 0.0).alias("offset"),
        text("Unit").alias("unit"), text("Parameter").alias("parameter"), F.when(multiplexed, _number(rows, "MUX value", 0, "long")).alias("mux_value"),
        F.when(multiplexed, _number(rows, "MUX Start", 0, "int")).otherwise(0).alias("mux_start"), F.when(multiplexed, F.greatest(_number(rows, "MUX bytes", 1, "int"), F.lit(1))).otherwise(0).alias("mux_bytes"),
    )
    s = s.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))
    needed = s.where("mux_value is not null").select("dict_name", "frame_id", "mux_start", "mux_bytes").distinct()
    plain = s.where("mux_value is null").select("dict_name", "frame_id", F.floor(F.col("start_bit") / 8).cast("int").alias("mux_start"), F.greatest(F.floor((F.col("length") + 7) / 8), F.lit(1)).cast("int").alias("mux_bytes")).distinct()
    made = needed.join(plain, ["dict_name", "frame_id", "mux_start", "mux_bytes"], "left_anti").select(
        "dict_name", F.lit(2**52).alias("line"), "frame_id", F.lit("").alias("message"), F.lit(8).alias("message_len"), (F.col("mux_start") * 8).alias("start_bit"), (F.col("mux_bytes") * 8).alias("length"), F.lit(True).alias("le"),
        F.lit("uint").alias("type"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit("").alias("unit"), F.format_string("MUX_%d", "mux_start").alias("parameter"), F.lit(None).cast("long").alias("mux_value"), F.lit(0).alias("mux_start"), F.lit(0).alias("mux_bytes"),
    )
    s = s.unionByName(made).withColumn("signal_name", sanitized(F.col("parameter"), F.format_string("SIG_%d", "start_bit")))
    name = s.groupBy("dict_name", "frame_id").agg(F.min_by("message", "line").alias("message_name")).withColumn("message_name", sanitized(F.col("message_name"), F.concat(F.lit("ID_"), F.hex("frame_id"))))
    s = s.join(unique_names(name, "message_name", ["frame_id"]), ["dict_name", "frame_id"])
    return _complete(unique_names(s, "signal_name", ["frame_id", "line"]), "exact", priority, active)
