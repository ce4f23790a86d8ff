"""Frame identifiers: hex ids, parameter group numbers and the fields of 29-bit ids. Columns in, columns out."""

from pyspark.sql import functions as F

ID_MASK, STANDARD_MAX = 0x1FFFFFFF, 0x7FF


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def hex_to_int(id):
    """The value of a hex id, case and a trailing X aside; null where it is no hex number."""
    text = F.regexp_replace(F.upper(F.trim(_c(id))), "X$", "")
    return F.when(text.rlike("^[0-9A-F]{1,15}$"), F.conv(text, 16, 10).cast("long"))


def pgn_of(id_int):
    """Parameter group number of an id; null for ids up to 0x7FF. The target byte of PDU1 is dropped."""
    i = _c(id_int).bitwiseAND(F.lit(ID_MASK))
    dp, pf = F.shiftright(i, 24).bitwiseAND(F.lit(1)), F.shiftright(i, 16).bitwiseAND(F.lit(255))
    ps = F.when(pf < 240, F.lit(0)).otherwise(F.shiftright(i, 8).bitwiseAND(F.lit(255)))
    return F.when(i > STANDARD_MAX, (dp * 65536 + pf * 256 + ps).cast("long"))


def pdu_format(id_int):
    return F.shiftright(_c(id_int), 16).bitwiseAND(F.lit(255)).cast("int")


def source_address(id_int):
    return _c(id_int).bitwiseAND(F.lit(255)).cast("int")


def priority(id_int):
    return F.shiftright(_c(id_int), 26).bitwiseAND(F.lit(7)).cast("int")


def id_of_pgn(pgn, priority=6, source=0):
    """The 29-bit id that carries a group; pgn, priority and source may be columns or numbers."""
    p, q, s = (x if not isinstance(x, (int, str)) else (F.col(x) if isinstance(x, str) else F.lit(x)) for x in (pgn, priority, source))
    p = p.cast("long").bitwiseAND(F.lit(0x3FFFF))
    dp = F.shiftright(p, 16).bitwiseAND(F.lit(1))
    return (q.cast("long").bitwiseAND(F.lit(7)) * (1 << 26) + dp * (1 << 24) + p.bitwiseAND(F.lit(0xFFFF)) * 256 + s.cast("long").bitwiseAND(F.lit(255))).cast("long")


def pgn_text(pgn):
    return F.when(_c(pgn).isNotNull(), F.format_string("0x%04X", _c(pgn)))


def is_pdu1(pgn):
    return F.shiftright(_c(pgn), 8).bitwiseAND(F.lit(255)) < 240


def by_id(id="ID"):
    """Sort columns: numeric order of hex ids, others last."""
    return [hex_to_int(id).asc_nulls_last(), _c(id).asc()]
