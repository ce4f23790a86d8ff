"""Further registered queries, each beside its SQL: displays, selections, texts, long messages, dictionary files."""

from pyspark.sql import functions as F

from busfleet.functions import text
from busfleet.operators import coverage, decode, derive, diff, series, summary, transport
from busfleet.plans import frames as frames_sql
from busfleet.plans import oracle
from busfleet.plans.frames import MESSAGE_BYTES, events_frames, lineitem_frames, table, transport_frames, transport_place
from busfleet.plans.queries import dictionary, halves, kind_series
from busfleet.sources import dictionaries

FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss")


def q_date_bounds(spark, sf):
    e = table(spark, sf, "events")
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    t = F.coalesce(*(F.when(kind == i, F.date_format(ts, f)) for i, f in enumerate(FORMATS)))
    return e.select("event_id", F.round(text.date_bound(t, "UTC"), 6).alias("low"), F.round(text.date_bound(t, "UTC", end=True), 6).alias("high"))


def q_clock(spark, sf):
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    clock = F.date_format(ts, "HH:mm:ss")
    return e.select("event_id", text.clock_to_epoch(F.to_date(ts), clock, 1, "UTC").alias("next_day"), text.clock_to_epoch(F.to_date(ts), clock).alias("elapsed"))


def q_select_ids(spark, sf):
    f = events_frames(spark, sf)
    some = summary.select_ids(f, f.where("id_int <= 2047"))
    return some.unionByName(summary.select_ids(f, [])).select("seq", "ID")


def q_coverage_display(spark, sf):
    c = coverage.coverage(events_frames(spark, sf), dictionary(spark, sf))
    return coverage.display_filter(c, exclude_no_data=True, only_changing=True, hide_pdu1=True, search="GROUP").select("ID", "message_name", "signal_name")


def q_diff_display(spark, sf):
    h = halves(spark, sf)
    b = diff.byte_diff(h)
    return diff.filter_ids(diff.id_diff(h, b), diff.filter_bytes(b, min_frames=5)).select("ID", F.round("score", 6).alias("score"))


def q_decoding_texts(spark, sf):
    d = dictionary(spark, sf).where("active")
    return d.select("message_name", "signal_name", text.decoding_text("start_bit", "length", "le", "type", "scale", "offset").alias("decoding"))


def q_common_zero(spark, sf):
    return series.common_zero(kind_series(spark, sf)).select("series_id", "seq", F.round("TS", 6).alias("TS"))


def q_neighbours(spark, sf):
    s = kind_series(spark, sf)
    probes = s.where("seq % 1000 = 7").select(F.col("TS").alias("probe"))
    return series.neighbours(s, probes).select("series_id", "probe", "previous", "next")


def q_union_logs(spark, sf):
    both = summary.union_logs(events_frames(spark, sf), lineitem_frames(spark, sf))
    return both.groupBy("log_id", "Bus").agg(F.count("*").alias("frames"), F.sum("LEN").alias("bytes"), F.max("D3").alias("top"))


def q_set_delta(spark, sf):
    f = events_frames(spark, sf)
    grew = summary.changed_set_delta(f.where("D2 <> 4"), f).withColumn("step", F.lit("grew"))
    return grew.unionByName(summary.changed_set_delta(f, f.where("D2 <> 0 and id_int > 2047")).withColumn("step", F.lit("shrank")))


def q_ids_of_group(spark, sf):
    f = events_frames(spark, sf)
    return decode.matching_ids(f, pgn=0xF103).unionByName(decode.matching_ids(f, id=261)).select("ID")


def q_distinct_ids(spark, sf):
    return summary.distinct_ids(events_frames(spark, sf)).select("ID")


def q_byte_columns(spark, sf):
    """Many signals of the same frames at once: a column for each."""
    signals = [{"signal_name": n, "start_bit": s, "length": k, "le": le, "type": t, "scale": c} for n, s, k, le, t, c in (("count", 0, 16, True, "uint", 1.0), ("level", 24, 8, True, "int", 0.5), ("tail", 55, 16, False, "uint", 1.0))]
    return decode.decode_columns(events_frames(spark, sf), signals).select("seq", "count", "level", "tail")


def q_summary_texts(spark, sf):
    return summary.summary_text(events_frames(spark, sf)).select("ID", F.trim("changes_text").alias("changes_text"), F.trim("uniques_text").alias("uniques_text"))


def messages(spark, sf):
    m = transport.bam_messages(transport_frames(spark, sf))
    return m.select("*", *transport_place())


def q_bam_texts(spark, sf):
    """The messages of each document, joined in order: its whole text again."""
    m = messages(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("message", F.hex("data").alias("h")))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda x: x["h"]), ""))
    return m.select("doc_id", F.size("parts").alias("messages"), F.length(whole).alias("bytes"), F.sha2(whole, 256).alias("sha256"))


#: Signals of long messages: either byte order, beyond 56 bits, signed, in one case of a selector, beyond a short payload.
LONG = [
    ("Low", 12, 20, True, "uint", None), ("Wide", 64, 60, True, "uint", None), ("Motorola", 71, 16, False, "uint", None), ("Crossing", 85, 12, False, "uint", None), ("Signed", 40, 24, True, "int", None),
    ("Case", 16, 8, True, "uint", 101), ("Late", 8 * 1700, 16, True, "uint", None),
]


def q_message_signals(spark, sf):
    rows = [("d", "j1939", True, 0, "Text", MESSAGE_BYTES, None, None, n, s, k, le, 0.5, 1.0, t, 0, 1 if case else 0, case, "", "") for n, s, k, le, t, case in LONG]
    groups = spark.range(256).select((F.col("id") + 0xFE00).alias("g"))
    d = spark.createDataFrame(rows, decode.DDL).crossJoin(groups).withColumn("pgn", F.col("g")).drop("g")
    m = messages(spark, sf)
    out = transport.decode_messages(m, d)
    return out.select(*transport_place(), "signal_name", "raw", "value")


#: Fields of whole messages as sources of derived signals: name -> field.
FIELDS = {
    "motorola": {"start_bit": 39, "length": 24, "le": False, "type": "uint", "scale": 0.5}, "wide": {"start_bit": 128, "length": 64, "type": "int", "offset": 1.0},
    "cased": {"start_bit": 16, "length": 16, "type": "int", "mux_start": 0, "mux_bytes": 2, "mux_value": 0x5468}, "double": {"start_bit": 8, "length": 64, "type": "float64"},
}


def q_derived_bam(spark, sf):
    """Big-endian, 64-bit, multiplexed and float fields of the long messages of a group."""
    m, out = timed_messages(spark, sf), None
    for name, field in FIELDS.items():
        rows = derive.derive({"branches": [{"source": {"kind": "bam", "pgn": 0xFE00, **field}}]}, name, messages=m)
        out = rows if out is None else out.unionByName(rows)
    return out.select("series_id", "TS", "value")


#: Stretches of a log and how far formulas look back, in seconds.
DAY, LOOK_BACK = 86400.0, 43200.0


def timed_messages(spark, sf):
    """Each document as one message of the log ``events``: a message an hour, then the hours again, a second later."""
    docs = table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    hour, round_ = F.col("doc_id") % 700, F.floor(F.col("doc_id") / 700)
    return docs.select(F.lit("events").alias("log_id"), (F.lit(1704067200.0) + hour * 3600.0 + round_).alias("TS"), (F.col("doc_id") % 254).cast("int").alias("sa"), (F.lit(0xFE00) + F.col("doc_id") % 2).cast("long").alias("pgn"), "b").withColumnRenamed("b", "data")


def reads_all(given):
    """At each message of a group: its third byte, the frames of an id in the twelve hours before, the last click in them."""
    import numpy as np

    ts, payloads = given.messages(0xFE00)
    frames, _, lengths = given.raw_frames(id=261)
    clicks, values = given.get("click", (np.zeros(0), np.zeros(0)))
    count = np.searchsorted(frames, ts, "right") - np.searchsorted(frames, ts - LOOK_BACK, "left")
    last = np.searchsorted(clicks, ts, "right") - 1
    fresh = (last >= 0) & (np.append(clicks, np.nan)[last] >= ts - LOOK_BACK)
    third = np.array([p[2] if len(p) > 2 else 0 for p in payloads], float)
    return ts, third + 1000.0 * count + np.where(fresh, np.append(values, 0.0)[last], 0.0)


#: What ``reads_all`` asks for.
ALL_READ = {"series": ["click"], "ids": [261], "messages": [0xFE00]}


def q_formula_all(spark, sf):
    out = derive.formula_grouped(kind_series(spark, sf), reads_all, frames=events_frames(spark, sf), messages=timed_messages(spark, sf), stretch=DAY, lead=LOOK_BACK, reads=ALL_READ)
    return out.select(F.round("TS", 6).alias("TS"), F.round("value", 6).alias("value"))


def q_formula_columns(spark, sf):
    """A formula of columns: a series, a field of raw frames and one of messages, aligned."""
    sources = {"raw": {"kind": "raw", "mode": "exact", "frame_id": 261, "start_bit": 0, "length": 16, "type": "uint"}, "long": {"kind": "bam", "pgn": 0xFE00, "start_bit": 7, "length": 16, "le": False}}
    out = derive.formula(kind_series(spark, sf), ["click"], lambda c: c["click"] + c["raw"] + c["long"] * 10.0, sources=sources, frames=events_frames(spark, sf), messages=timed_messages(spark, sf))
    return out.select(F.round("TS", 6).alias("TS"), F.round("value", 6).alias("value"))


#: Names that meet each other's numbered forms.
CLASHING = "concat('n', cast(p_partkey % 97 as string), element_at(array('', '', '_2', '_2_2', '_3'), cast(p_partkey % 5 as int) + 1))"


def q_unique_names(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_partkey") % 10).cast("string").alias("dict_name"), F.col("p_partkey").cast("long").alias("line"), F.expr(CLASHING).alias("name"))
    return dictionaries.unique_names(p, "name", ["line"])


def q_dictionary_dbc(spark, sf):
    """Dictionary files made from ``part``, 20 messages each, in UTF-8 or cp1252, read back."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"))
    unit = "°C €"
    body = F.format_string(
        'BO_ %d Msg_%d: 8 V\r\n SG_ Sel M : 0|8@1+ (1,0) [0|0] "" V\n SG_ A m3 : 16|16@1- (0.5,%d) [0|0] "%s" V\n SG_ B : 39|8@0+ (0,0) [0|0] "" V\nCM_ SG_ %d A "note %d";\nSIG_VALTYPE_ %d B : 1;\n',
        F.col("k") + 2147483648, "k", F.col("k") % 7, F.lit(unit), F.col("k") + 2147483648, "k", F.col("k") + 2147483648,
    )
    files = p.groupBy(F.floor(F.col("k") / 20).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("t")))), lambda x: x["t"]), "").alias("t"))
    old = F.unhex(F.replace(F.replace(F.hex(F.encode("t", "UTF-8")), F.lit("C2B0"), F.lit("B0")), F.lit("E282AC"), F.lit("80")))  # the same unit in cp1252
    content = F.when(F.col("file") % 2 == 0, F.encode("t", "UTF-8")).otherwise(old)
    lines = dictionaries.dbc_lines(files.select(F.format_string("f%d", "file").alias("dict_name"), dictionaries.dbc_text(content).alias("text")))
    return dictionaries.parse_dbc(lines).select("dict_name", "message_name", "message_len", "frame_id", "signal_name", "start_bit", "length", "le", "scale", "offset", "type", "mux_start", "mux_bytes", "mux_value", "unit", "description")


QUERIES = {
    "date_bounds": q_date_bounds, "clock_times": q_clock, "select_ids": q_select_ids, "coverage_display": q_coverage_display, "diff_display": q_diff_display, "decoding_texts": q_decoding_texts,
    "common_zero": q_common_zero, "neighbours": q_neighbours, "union_logs": q_union_logs, "set_delta": q_set_delta, "ids_of_group": q_ids_of_group, "distinct_ids": q_distinct_ids,
    "decode_columns": q_byte_columns, "summary_texts": q_summary_texts, "bam_texts": q_bam_texts, "message_signals": q_message_signals, "dictionary_dbc": q_dictionary_dbc, "derived_bam": q_derived_bam, "formula_all": q_formula_all, "formula_columns": q_formula_columns,
    "unique_names": q_unique_names,
}

TEXT = "regexp_replace(printf('%.4f', {}), '\\.?0+$', '')"
BODY_OF = lambda name, *more: oracle.ORACLE[name][len(oracle._events("", *more)) :]
EPOCH = "epoch_us({}) / 1000000.0::double"
HEX_PARTS = f"""parts as (select doc_id, cast(k as int) as message, substr(hex(encode(text)), 2 * {MESSAGE_BYTES} * k + 1, 2 * {MESSAGE_BYTES}) as h
    from documents, lateral (select unnest(range(cast(ceil(octet_length(encode(text)) / {MESSAGE_BYTES}.0) as bigint))) as k) where octet_length(encode(text)) > 0)"""


EVENT_FRAMES = frames_sql.EVENTS_SQL.strip()


def _byte(i):
    return f"cast('0x' || substr(p, {2 * i + 1}, 2) as hugeint)"


def _raw(start, length, le):
    """SQL of a field of the padded hex digits p."""
    first = start if le else 8 * (start // 8) + 7 - start % 8
    own = range(first // 8, (first + length - 1) // 8 + 1)
    word = " + ".join(f"{_byte(b)} * {256 ** (i if le else len(own) - 1 - i)}::hugeint" for i, b in enumerate(own))
    drop = first % 8 if le else 8 * len(own) - first % 8 - length
    return f"((({word}) >> {drop}) & {2**length - 1}::hugeint)"


def _message_signals():
    cells = []
    for name, start, length, le, kind, case in LONG:
        raw = _raw(start, length, le)
        value = f"case when {raw} >= {2 ** (length - 1)} then {raw} - {2**length} else {raw} end" if kind == "int" else raw
        where = f" where {_byte(0)} = {case}" if case else ""
        cells.append(f"select doc_id, message, '{name}' as signal_name, cast({raw} as bigint) as raw, cast({value} as double) * 0.5 + 1.0 as value from padded{where}")
    return f"with {HEX_PARTS}, padded as (select *, rpad(h, {2 * MESSAGE_BYTES}, '0') as p from parts) " + " union all ".join(cells)


ORACLE = {
    "date_bounds": f"""select event_id, round({EPOCH.format('t')}, 6) as low, round({EPOCH.format('t')} + s - 1e-6, 6) as high from (
        select event_id, case event_id % 4 when 0 then date_trunc('day', ts) when 1 then date_trunc('hour', ts) when 2 then date_trunc('minute', ts) else date_trunc('second', ts) end as t,
            case event_id % 4 when 0 then 86400 when 1 then 3600 when 2 then 60 else 1 end as s from events)""",
    "clock_times": f"""select event_id, {EPOCH.format("date_trunc('second', ts)")} + 86400 as next_day, cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as double) as elapsed from events""",
    "select_ids": oracle._events("select seq, ID from frames where id_int <= 2047"),
    "coverage_display": f"select ID, message_name, signal_name from ({oracle.ORACLE['coverage']}) where real_frames > 0 and real_is_changing and contains(lower(ID || ' ' || message_name || ' ' || signal_name), 'group')",
    "diff_display": oracle._events(f"""select q.ID, q.score from ({BODY_OF('id_diff', oracle.SIDES, oracle.OBSERVED)}) q where q.len_changed or q.presence <> 'both'
        or q.ID in (select ID from sc where n_a >= 5 and n_b >= 5 and class not in ('unchanged', 'same_oscillation') and not (ca and cb))""", oracle.SIDES, oracle.OBSERVED),
    "decoding_texts": oracle._events(f"""select message_name, signal_name, 'bits ' || start_bit || '+' || length || ' ' || case when le then 'LE' else 'BE' end || ' ' || type
        || ' x' || {TEXT.format('scale')} || ' +' || {TEXT.format('"offset"')} as decoding from dict""", oracle.DICTIONARY),
    "common_zero": f"with {oracle.KINDS} select series_id, seq, round(TS - (select min(TS) from s), 6) as TS from s",
    "neighbours": f"""with {oracle.KINDS}, p as (select distinct TS as probe from s where seq % 1000 = 7), k as (select distinct series_id from s)
        select k.series_id as series_id, probe, (select max(TS) from s where s.series_id = k.series_id and s.TS < probe) as previous, (select min(TS) from s where s.series_id = k.series_id and s.TS > probe) as next from k, p""",
    "union_logs": f"""with {oracle.EVENTS_SQL}, ev as (select log_id, Bus, LEN, D3 from frames), li as (select 'lineitem' as log_id, 'can0' as Bus, 8 as LEN, cast(l_partkey % 256 as int) as D3 from lineitem)
        select log_id, Bus, count(*) as frames, cast(sum(LEN) as bigint) as bytes, max(D3) as top from (select * from ev union all select * from li) group by all""",
    "set_delta": oracle._events("""select distinct ID, 'added' as kind, 'grew' as step from frames where ID not in (select ID from frames where D2 <> 4)
        union all select distinct ID, 'reset', 'shrank' from frames where D2 <> 0 and id_int > 2047"""),
    "ids_of_group": oracle._events(f"select distinct ID from frames where {oracle.PGN} = 61699 or id_int = 261"),
    "distinct_ids": oracle._events("select distinct ID from frames"),
    "decode_columns": oracle._events("select seq, cast(D0 + 256 * D1 as double) as count, (case when D3 > 127 then D3 - 256 else D3 end) * 0.5::double as level, cast(D6 * 256 + D7 as double) as tail from frames"),
    "summary_texts": oracle._events("""select ID, array_to_string(list('B' || byte || ':' || changes order by byte), '  ') as changes_text, array_to_string(list('B' || byte || ':' || uniques order by byte), '  ') as uniques_text from (
        select ID, byte, cast(sum(case when value <> p then 1 else 0 end) as bigint) as changes, count(distinct value) as uniques from (select *, lag(value) over (partition by ID, byte order by TS, seq) as p from bytes) group by all) group by ID""", oracle.BYTES),
    "bam_texts": f"""select doc_id, cast(ceil(octet_length(encode(text)) / {MESSAGE_BYTES}.0) as int) as messages, cast(octet_length(encode(text)) as int) as bytes, sha256(text) as sha256 from documents where octet_length(encode(text)) > 0""",
    "message_signals": _message_signals(),
    "dictionary_dbc": """with p as (select cast(p_partkey as bigint) as k from part)
        select 'f' || cast(k // 20 as varchar) as dict_name, 'Msg_' || k as message_name, 8 as message_len, k as frame_id, s.signal_name, s.start_bit, s.length, s.le, s.scale, case when s.signal_name = 'A' then cast(k % 7 as double) else 0.0 end as "offset", s.type,
            0 as mux_start, case when s.signal_name = 'A' then 1 else 0 end as mux_bytes, case when s.signal_name = 'A' then 3 end::bigint as mux_value,
            case when s.signal_name = 'A' then chr(176) || 'C ' || chr(8364) else '' end as unit, case when s.signal_name = 'A' then 'note ' || k end as description
        from p, (values ('Sel', 0, 8, true, 1.0::double, 'uint'), ('A', 16, 16, true, 0.5, 'int'), ('B', 39, 8, false, 1.0, 'float32')) s(signal_name, start_bit, length, le, scale, type)""",
    "derived_bam": f"""with m as (select 1704067200.0::double + (doc_id % 700) * 3600.0 + floor(doc_id / 700) as TS, hex(encode(coalesce(text, ''))) as p from documents where doc_id % 2 = 0),
        v as (select *, {_byte(0)} * 256 + {_byte(1)} as sel, {_byte(2)} + {_byte(3)} * 256 as c, {" + ".join(f"{_byte(16 + i)}::hugeint * {256 ** i}::hugeint" for i in range(8))} as w,
            {" + ".join(f"{_byte(1 + i)}::hugeint * {256 ** i}::hugeint" for i in range(8))} as d from (select TS, length(p) // 2 as n, rpad(p, 48, '0') as p from m)),
        f as (select *, d // 9223372036854775808 as neg, (d // 4503599627370496) % 2048 as ex, (d % 4503599627370496)::double as part from v)
        select 'motorola' as series_id, TS, ({_byte(4)} * 65536 + {_byte(5)} * 256 + {_byte(6)})::double * 0.5 as value from v where n >= 7
        union all select 'wide', TS, (case when w >= 9223372036854775808 then w - 18446744073709551616 else w end)::double + 1.0 from v where n >= 24
        union all select 'cased', TS, (case when c >= 32768 then c - 65536 else c end)::double from v where n >= 4 and sel = 21608
        union all select 'double', TS, case when ex = 2047 then 0.0 when ex = 0 then part * pow(2.0, -1074) else (case when neg = 1 then -1.0 else 1.0 end) * (part / pow(2.0, 52) + 1.0) * pow(2.0, ex::double - 1023) end from f where n >= 9""",
    "formula_all": f"""with {oracle.KINDS}, {EVENT_FRAMES}, m as (select doc_id, 1704067200.0::double + (doc_id % 700) * 3600.0 + floor(doc_id / 700) as TS, hex(encode(coalesce(text, ''))) as h from documents where doc_id % 2 = 0)
        select round(TS, 6) as TS, round(cast('0x' || rpad(substr(h, 5, 2), 2, '0') as int)::double + 1000.0 * (select count(*) from frames f where f.id_int = 261 and f.TS between m.TS - 43200.0 and m.TS)
            + coalesce((select arg_max(value, (s.TS, s.seq)) from s where series_id = 'click' and s.TS between m.TS - 43200.0 and m.TS), 0.0), 6) as value from m""",
    "formula_columns": f"""with {oracle.KINDS}, {EVENT_FRAMES}, m as (select doc_id, 1704067200.0::double + (doc_id % 700) * 3600.0 + floor(doc_id / 700) as TS, hex(encode(coalesce(text, ''))) as h from documents where doc_id % 2 = 0),
        u as (select TS, value as c, null::double as r, null::double as g from s where series_id = 'click' union all select TS, null, (D0 + 256 * D1)::double, null from frames where id_int = 261
            union all select TS, null, null, cast('0x' || substr(h, 1, 4) as int)::double from m where length(h) >= 4),
        w as (select TS, max(c) as c, max(r) as r, max(g) as g from u group by TS),
        v as (select TS, last_value(c ignore nulls) over (order by TS) as c, last_value(r ignore nulls) over (order by TS) as r, last_value(g ignore nulls) over (order by TS) as g from w)
        select round(TS, 6) as TS, round(c + r + g * 10.0, 6) as value from v where c is not null and r is not null and g is not null""",
    "unique_names": r"""with recursive p as (select cast(p_partkey % 10 as varchar) as dict_name, cast(p_partkey as bigint) as line, concat('n', cast(p_partkey % 97 as varchar), ['', '', '_2', '_2_2', '_3'][cast(p_partkey % 5 as int) + 1]) as name from part),
        f as (select *, regexp_replace(name, '(_[0-9]+)+$', '') as stem, row_number() over (partition by dict_name, regexp_replace(name, '(_[0-9]+)+$', '') order by line) as k from p),
        r as (select dict_name, stem, k, line, name as given, [name] as used from f where k = 1
            union all
            select dict_name, stem, k, line, given, list_append(used, given) from (select f.dict_name, f.stem, f.k, f.line, r.used,
                case when not list_contains(r.used, f.name) then f.name else list_filter(list_transform(range(2, f.k + 3), lambda i: f.name || '_' || i), lambda x: not list_contains(r.used, x))[1] end as given
                from r join f on f.dict_name = r.dict_name and f.stem = r.stem and f.k = r.k + 1))
        select dict_name, line, given as name from r""",
}
