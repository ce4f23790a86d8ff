"""Texts of values, payloads and times; and times from texts."""

from pyspark.sql import functions as F

from busfleet.functions.bits import _n


def spaced_payload(data):
    """Hex digits as spaced bytes; an odd count stays as it is."""
    t = F.upper(F.trim(F.coalesce(_n(data), F.lit(""))))
    return F.when(F.length(t) % 2 == 0, F.rtrim(F.regexp_replace(t, "(..)", "$1 "))).otherwise(t)


def bit_groups(data):
    """Hex digits as spaced groups of 8 bits; an odd count stays as it is."""
    t = F.upper(F.trim(F.coalesce(_n(data), F.lit(""))))
    pairs = F.filter(F.split(F.regexp_replace(t, "(..)", "$1 "), " "), lambda x: x != "")
    return F.when(F.length(t) % 2 == 0, F.array_join(F.transform(pairs, lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), " ")).otherwise(t)


def value_text(value):
    """Four decimals without trailing zeros; null for null."""
    v = _n(value).cast("double")
    return F.when(v.isNotNull(), F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", ""))


def clean_text(text):
    """Hard blanks become blanks; UTF-8 that was read as Latin-1 is repaired.

    In a text to repair, characters beyond Latin-1 and bytes that are no UTF-8 are left out.
    """
    t = F.trim(F.replace(_n(text), F.lit("\u00a0"), F.lit(" ")))
    broken = t.contains("\u00c2") | t.contains("\u00c3")
    raw = F.encode(F.regexp_replace(t, "[^\\x00-\\xFF]", ""), "ISO-8859-1").cast("string")
    return F.when(broken, F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))).otherwise(t)


def display_line(name, value, unit):
    """'name: value unit'."""
    u = F.coalesce(_n(unit), F.lit(""))
    return F.concat(_n(name), F.lit(": "), F.coalesce(value_text(value), F.lit("")), F.when(u != "", F.concat(F.lit(" "), u)).otherwise(""))


def time_text(ts, zone=None):
    """HH:MM:SS in a zone; seconds with two decimals without one; empty for null and non-finite times."""
    t = _n(ts).cast("double")
    good = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < 1e12)
    text = F.format_string("%.2f", t) if zone in (None, "none") else F.date_format(F.from_utc_timestamp(F.timestamp_micros(F.floor(t * 1e6)), zone), "HH:mm:ss")
    return F.when(good, text).otherwise("")


def date_bound(text, zone, end=False):
    """Epoch seconds of 'Y-m-d[ H[:M[:S]]]' in a zone; with ``end`` the last microsecond of the period named."""
    t = F.trim(_n(text))
    out = F.lit(None).cast("double")
    for pattern, shape, seconds in (("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", 1), ("yyyy-MM-dd HH:mm", r"^\d{4}-\d\d-\d\d \d\d:\d\d$", 60), ("yyyy-MM-dd HH", r"^\d{4}-\d\d-\d\d \d\d$", 3600), ("yyyy-MM-dd", r"^\d{4}-\d\d-\d\d$", 86400)):
        when = F.to_utc_timestamp(F.try_to_timestamp(F.when(t.rlike(shape), t), F.lit(pattern)), zone)
        out = F.coalesce(out, F.unix_micros(when) / 1e6 + (seconds - 1e-6 if end else 0))
    return out


def clock_to_epoch(day, clock, offset_days=0, zone=None):
    """Epoch seconds of a clock time 'H:M[:S]' on a day (date), some days on, in a zone; without a zone elapsed seconds."""
    part = F.split(_n(clock), ":")
    seconds = F.get(part, 0).cast("double") * 3600 + F.coalesce(F.get(part, 1).cast("double"), F.lit(0.0)) * 60 + F.coalesce(F.get(part, 2).cast("double"), F.lit(0.0))
    if zone in (None, "none"):
        return seconds + F.lit(86400.0) * offset_days
    local = F.timestamp_micros((F.unix_date(F.date_add(_n(day), offset_days)).cast("long") * 86400000000 + F.round(seconds * 1e6)).cast("long"))
    return F.unix_micros(F.to_utc_timestamp(local, zone)) / 1e6


def first_number(text):
    """The first number in a text, a comma read as the decimal point; null without one."""
    return F.try_cast(F.nullif(F.regexp_extract(F.replace(_n(text), F.lit(","), F.lit(".")), r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")), "double") if hasattr(F, "try_cast") else F.nullif(F.regexp_extract(F.replace(_n(text), F.lit(","), F.lit(".")), r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def decoding_text(start, length, little, kind, scale, offset):
    """One line on a signal's geometry and conversion."""
    return F.concat_ws(
        " ", F.format_string("bits %d+%d", _n(start).cast("int"), _n(length).cast("int")), F.when(_n(little), F.lit("LE")).otherwise("BE"), _n(kind),
        F.concat(F.lit("x"), value_text(scale)), F.concat(F.lit("+"), value_text(offset)),
    )
