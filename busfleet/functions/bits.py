"""Bits and bytes of payloads: packing, extraction in both byte orders, typed values. Native expressions.

An 8-byte payload is packed once into a LONG in either byte order; a field then is a shift and a mask.
Start bits follow the dictionary's numbering: the least bit for little-endian fields, the sawtooth number
of the most significant bit for big-endian ones. Start and length may be columns or numbers.
"""

from pyspark.sql import functions as F

BYTES = [f"D{i}" for i in range(8)]


def _n(x):
    """A column for a column, a column's name or a number."""
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, (int, float)) else x


def lenient_bytes(text):
    """Hex text to BINARY; an odd digit count is padded on the right, malformed text is empty."""
    t = F.coalesce(_n(text), F.lit(""))
    t = F.when(F.length(t) % 2 == 1, F.concat(t, F.lit("0"))).otherwise(t)
    return F.coalesce(F.try_to_binary(F.when(t.rlike("^([0-9A-Fa-f]{2})*$"), t), F.lit("hex")), F.lit(bytearray()))


def byte_hex(value):
    """A byte as two upper-case digits; null gives an empty text."""
    return F.when(_n(value).isNull(), F.lit("")).otherwise(F.lpad(F.hex(_n(value).cast("long")), 2, "0"))


def packed_le(columns=BYTES):
    """The first eight bytes as one LONG, the first byte lowest."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        out = out.bitwiseOR(F.shiftleft(_n(c).cast("long"), 8 * i))
    return out


def packed_be(columns=BYTES):
    """The first eight bytes as one LONG, the first byte highest."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        out = out.bitwiseOR(F.shiftleft(_n(c).cast("long"), 56 - 8 * i))
    return out


def _field(word, shift, length):
    length, shift = _n(length).cast("int"), _n(shift).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), length) - F.lit(1).cast("long")
    return F.when(length >= 64, word).otherwise(F.call_function("shiftrightunsigned", word, shift).bitwiseAND(F.when(length < 63, mask).otherwise(F.lit(2**63 - 1))))


def raw_le(word, start, length):
    """Bits of a little-endian field of a packed_le word, as LONG (64 bits: two's complement)."""
    return _field(_n(word), start, length)


def raw_be(word, start, length):
    """Bits of a big-endian field of a packed_be word."""
    s = _n(start)
    top = (F.lit(7) - F.floor(s / 8)) * 8 + s % 8
    return _field(_n(word), top - _n(length) + 1, length)


def raw_bits(le_word, be_word, start, length, little):
    """Either byte order, chosen by a column or a truth value. ``fits`` tells which fields are valid."""
    if isinstance(little, bool):
        return raw_le(le_word, start, length) if little else raw_be(be_word, start, length)
    ok = fits(start, length, little)
    return F.when(ok & _n(little), raw_le(le_word, start, length)).when(ok, raw_be(be_word, start, length))


def fits(start, length, little):
    """Whether a field lies within 64 bits."""
    s, n = _n(start), _n(length)
    top = (F.lit(7) - F.floor(s / 8)) * 8 + s % 8
    low = F.lit(little) if isinstance(little, bool) else _n(little)
    return (n >= 1) & (n <= 64) & (s >= 0) & (s <= 63) & F.when(low, s + n <= 64).otherwise(top - n + 1 >= 0)


def unsigned_double(word):
    """A LONG read as unsigned, as DOUBLE."""
    w = _n(word)
    return F.when(w >= 0, w.cast("double")).otherwise(F.shiftrightunsigned(w, 1).bitwiseOR(w.bitwiseAND(F.lit(1).cast("long"))).cast("double") * 2.0)


def signed(raw, length):
    """Two's complement of a raw field of ``length`` bits, as LONG."""
    n, r = _n(length).cast("int"), _n(raw)
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.least(n, F.lit(63)) - 1, F.lit(0)))
    return F.when((n < 63) & (r >= half), r - F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(62)))).when((n == 63) & (r >= half), r + F.lit(-(2**62)) + F.lit(-(2**62))).otherwise(r)


def float32(raw):
    """The value of 32 bits read as an IEEE float; NaN and infinities become 0."""
    r = _n(raw)
    sign = F.when(r.bitwiseAND(F.lit(1 << 31)) != 0, -1.0).otherwise(1.0)
    exponent, part = F.shiftright(r, 23).bitwiseAND(F.lit(255)), r.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    return F.when(exponent == 255, 0.0).when(exponent == 0, sign * part * 2.0**-149).otherwise(sign * (part + 2.0**23) * F.pow(F.lit(2.0), exponent - 150))


def float64(raw):
    """The value of 64 bits read as an IEEE double; NaN and infinities become 0."""
    r = _n(raw)
    sign = F.when(r < 0, -1.0).otherwise(1.0)
    exponent, part = F.shiftright(r, 52).bitwiseAND(F.lit(2047)), r.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    return F.when(exponent == 2047, 0.0).when(exponent == 0, sign * part * F.pow(F.lit(2.0), F.lit(-1074))).otherwise(sign * (part / 2.0**52 + 1.0) * F.pow(F.lit(2.0), exponent - 1023))


def physical(raw, length, kind, scale=1.0, offset=0.0):
    """Raw bits to the physical value: kind is 'uint', 'int' or 'float32', a column or a text."""
    number = {"uint": unsigned_double(raw), "int": signed(raw, length).cast("double"), "float32": float32(raw)}
    if isinstance(kind, str) and kind in number:
        value = number[kind]
    else:
        k = _n(kind)
        value = F.when(k == "float32", number["float32"]).when(k == "int", number["int"]).otherwise(number["uint"])
    return value * _n(scale).cast("double") + _n(offset).cast("double")


def mux_value(start, count, columns=BYTES):
    """The big-endian number of ``count`` bytes from byte ``start``; bytes beyond the payload are 0."""
    if isinstance(start, int) and isinstance(count, int):
        out = F.lit(0).cast("long")
        for i in range(start, start + count):
            out = out * 256 + (_n(columns[i]).cast("long") if i < 8 else F.lit(0).cast("long"))
        return out
    all_bytes = F.array(*(_n(c).cast("long") for c in columns))
    at = F.sequence(F.lit(1), F.greatest(_n(count), F.lit(1)))
    return F.when(_n(count) > 0, F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a * 256 + F.coalesce(F.get(all_bytes, _n(start) + i - 1), F.lit(0).cast("long")))).otherwise(F.lit(0).cast("long"))


#: Typed reads: name -> (bytes, kind, little-endian).
TYPES = {f"{k}{n}_{e}": (n // 8, k, e == "le") for k, sizes in (("u", (8, 16, 32, 64)), ("i", (8, 16, 32, 64)), ("f", (32, 64))) for n in sizes for e in ("le", "be")}


def typed_read(data, offset, dtype):
    """A value of BINARY ``data`` at a byte offset; null where the payload is too short.

    dtype is a key of TYPES, such as 'u16_le'. u64 gives DECIMAL(20,0), floats DOUBLE, others LONG.
    """
    size, kind, little = TYPES[dtype]
    at = _n(offset)
    digits = F.hex(F.substring(_n(data), at + 1, F.lit(size)) if not isinstance(offset, int) else F.substring(_n(data), offset + 1, size))
    if little and size > 1:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    whole = F.length(_n(data)) >= at + size
    number = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if kind == "u":
        value = number if size == 8 else number.cast("long")
    else:
        half = F.expr("cast(9223372036854775808BD as decimal(20,0))")
        word = F.when(number >= half, (number - half).cast("long") + F.lit(-(2**63))).otherwise(F.when(number < half, number).cast("long"))
        value = (signed(word, 8 * size) if size < 8 else word) if kind == "i" else (float32(word) if size == 4 else float64(word))
    return F.when(whole, value)
