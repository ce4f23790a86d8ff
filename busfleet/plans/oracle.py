"""SQL for the registered queries, over the same tables and the same derived frames."""

from busfleet.operators.series import gaussian_weights, savgol_weights
from busfleet.plans.frames import EVENTS_SQL, LINEITEM_SQL, MESSAGE_BYTES

D = [f"D{i}" for i in range(8)]
ALL = "log_id, seq, TS, Bus, ID, id_int, DATA, LEN, D0, D1, D2, D3, D4, D5, D6, D7"


def _events(body, *more):
    return f"with {', '.join([EVENTS_SQL, *more])} {body}"


def _lineitem(body, *more):
    return f"with {', '.join([LINEITEM_SQL, *more])} {body}"


BYTES = "bytes as (" + " union all ".join(f"select seq, TS, ID, LEN, {i} as byte, D{i} as value from frames" for i in range(8)) + ")"
LE = " | ".join(f"(cast(D{i} as hugeint) << {8 * i})" for i in range(8))
BE = " | ".join(f"(cast(D{i} as hugeint) << {56 - 8 * i})" for i in range(8))
PGN = "case when id_int <= 2047 then null when (id_int >> 16) & 255 < 240 then ((id_int >> 24) & 1) * 65536 + ((id_int >> 16) & 255) * 256 else ((id_int >> 24) & 1) * 65536 + ((id_int >> 16) & 255) * 256 + ((id_int >> 8) & 255) end"
SUMMARY = """
    select log_id, ID, count(*) as frames, array_to_string(list_sort(list(distinct LEN)), ',') as lengths, count(distinct DATA) as distinct_payloads,
        cast(sum(case when before <> DATA then 1 else 0 end) as bigint) as payload_changes, round(avg(dt), 6) as period_mean, min(dt) as period_min, max(dt) as period_max
    from (select *, round(TS - lag(TS) over w, 6) as dt, lag(DATA) over w as before from frames window w as (partition by ID order by TS, seq)) group by all"""
USERS = "s as (select cast(user_id as varchar) as series_id, epoch_us(ts) / 1000000.0::double as TS, event_id as seq, cast(value as double) as value from events)"
KINDS = "s as (select event_type as series_id, epoch_us(ts) / 1000000.0::double as TS, event_id as seq, cast(value as double) as value from events)"
PROBES = "p as (select a + floor((b - a) * (k + 0.5) / 10) as probe from (select min(epoch_us(ts) / 1000000.0::double) as a, max(epoch_us(ts) / 1000000.0::double) as b from events), range(10) t(k))"
SIDES = "sided as (select *, case when TS <= (select (min(TS) + max(TS)) / 2 from frames) then 'a' else 'b' end as side from frames)"
OBSERVED = (
    "sb as (" + " union all ".join(f"select ID, side, TS, seq, {i} as byte, D{i} as value from sided where LEN > {i}" for i in range(8)) + "),"
    """ st as (select *, value - lag(value) over (partition by ID, side, byte order by TS, seq) as step from sb),
    o as (select ID, side, byte, count(*) as n, list_sort(list(distinct value)) as vs, avg(value) as mean, arg_min(value, (TS, seq)) as first, arg_max(value, (TS, seq)) as last,
        coalesce(avg(case when step is null then null when step <> 0 then 1.0 else 0.0 end), 0.0) as cr, coalesce(avg(case when step is null then null when step in (1, -255) then 1.0 else 0.0 end), 0.0) as up,
        count(step) as steps from st group by all),
    oc as (select *, steps > 0 and (up >= 0.85 or (len(vs) = 2 and cr >= 0.85)) as counter from o),
    ab as (select a.ID, a.byte, a.n as n_a, b.n as n_b, a.vs as va, b.vs as vb, a.mean as ma, b.mean as mb, a.cr as cr_a, a.counter as ca, b.counter as cb, a.first as first_a, b.last as last_b
        from oc a join oc b on a.ID = b.ID and a.byte = b.byte and a.side = 'a' and b.side = 'b'),
    cl as (select *, case when va = vb and len(va) = 1 then 'unchanged' when va = vb then 'same_oscillation' when len(va) = 1 and len(vb) = 1 then 'const_shift'
        when len(list_filter(vb, lambda x: not list_contains(va, x))) > 0 then 'new_territory' else 'range_shift' end as class from ab),
    sc as (select *, case class when 'const_shift' then 1.0 when 'new_territory' then 0.8 when 'range_shift' then 0.5 when 'same_oscillation' then 0.1 else 0.0 end
        * (0.5 + 0.5 * least(1.0, abs(mb - ma) / 255)) * case when ca and cb then 0.2 else 1.0 end as score from cl),
    rk as (select ID, byte, side, rank() over (partition by ID, byte order by value) + (count(*) over (partition by ID, byte, value) - 1) / 2.0 as r, count(*) over (partition by ID, byte, value) as t from sb),
    us as (select ID, byte, sum(case when side = 'a' then r end) as ra, sum(cast(t as double) * t - 1) as ties, count(*) as n from rk group by all)"""
)
DICTIONARY = """
    base(dict_name, mode, message, signal_name, start_bit, length, le, scale, "offset", type, mux_value, unit) as (values
        ('own', 'exact', 'Counters', 'Count', 0, 16, true, 1.0::double, 0.0::double, 'uint', null, ''), ('own', 'exact', 'Counters', 'Value', 24, 8, true, 0.5, 10.0, 'uint', null, 'u'),
        ('own', 'exact', 'Counters', 'Missing', 40, 8, true, 1.0, 0.0, 'uint', null, ''), ('fleet', 'j1939', 'Group', 'Kind', 23, 8, false, 1.0, 0.0, 'uint', null, ''),
        ('fleet', 'j1939', 'Group', 'Cents', 48, 16, true, 0.01, 0.0, 'int', null, 'cur'), ('fleet', 'j1939', 'Group', 'BuyProps', 32, 8, true, 1.0, 0.0, 'uint', 2, '')),
    """ + f"ids as (select distinct id_int, {PGN} as pgn from frames)," + """
    dict as (select base.*, message || '_' || printf('%X', id_int) as message_name, id_int as frame_id, null as pgn from base, (select distinct id_int from ids where id_int <= 2047) where mode = 'exact'
        union all select base.*, message || '_' || printf('%X', pgn), 402653184 + pgn * 256, pgn from base, (select distinct pgn from ids where pgn is not null) where mode = 'j1939'),
    """ + f"words as (select *, {LE} as le_word, {BE} as be_word, {PGN} as own from frames)," + """
    raws as (select w.seq, w.TS, w.ID, w.id_int, d.message_name, d.signal_name, d.length, d.type, d.scale, d."offset", d.unit,
        case when d.le then (w.le_word >> d.start_bit) & ((1::hugeint << d.length) - 1)
             else (w.be_word >> ((7 - d.start_bit // 8) * 8 + d.start_bit % 8 - d.length + 1)) & ((1::hugeint << d.length) - 1) end as raw
        from words w join dict d on (d.mode = 'exact' and w.id_int = d.frame_id) or (d.mode = 'j1939' and w.own = d.pgn) where d.mux_value is null or w.D2 = d.mux_value),
    dec as (select seq, TS, ID, message_name, signal_name, length, cast(raw as bigint) as raw, unit,
        cast(case when type = 'int' and raw >= (1::hugeint << (length - 1)) then raw - (1::hugeint << length) else raw end as double) * scale + "offset" as value from raws)"""


def _weighted(weights):
    n = len(weights)
    cells = " + ".join(f"{float(w)!r} * coalesce(lag(value, {n - 1 - i}) over w, first_value(value) over w)" for i, w in enumerate(weights))
    return f"with {USERS} select series_id, seq, round({cells}, 6) as value from s window w as (partition by series_id order by TS, seq)"


def _entropy(start, key="ID, LEN, prefix_len, prefix"):
    return f"""rest as (select {key}, byte, value from pre, range(8) b(byte), lateral (select case byte {' '.join(f'when {i} then D{i}' for i in range(8))} end as value) where byte >= {start} and byte < LEN),
        cnt as (select {key}, byte, value, count(*) as n from rest group by all), be as (select {key}, byte, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from cnt group by all),
        en as (select {key}, avg(greatest(h, 0.0)) as entropy from be group by all)"""


PREFIX = """pre as (select f.*, prefix_len, substr(printf('%02X%02X%02X%02X%02X%02X%02X%02X', D0, D1, D2, D3, D4, D5, D6, D7), 1, 2 * prefix_len) as prefix
        from (select * replace (D2 as D0, D0 as D2) from frames) f, (values (1), (2), (3), (4)) p(prefix_len) where prefix_len <= LEN),
    tot as (select ID, LEN, count(*) as total from frames group by all),
    st as (select ID, LEN, prefix_len, prefix, count(*) as support, any_value(total) as total, count(*) / any_value(total)::double as ratio from pre join tot using (ID, LEN) group by all having count(*) >= 6 or count(*) / any_value(total)::double >= 0.02)"""
#: Longer states of each accepted one, and all states that need scores.
MUX_PAIRS = """cn as (select ID, LEN, prefix_len, prefix, count(*) as n from pre group by all),
    pairs as (select s.ID, s.LEN, s.prefix_len, s.prefix, s.support, c.prefix_len as next_len, c.prefix as next, c.n, c.n / s.support::double as w
        from st s join cn c on c.ID = s.ID and c.LEN = s.LEN and c.prefix_len > s.prefix_len and substr(c.prefix, 1, 2 * s.prefix_len) = s.prefix where c.n >= 6 or c.n / s.support::double >= 0.02),
    needed as (select ID, LEN, prefix_len, prefix from st union select ID, LEN, next_len, next from pairs)"""
MUX_GAINS = """best as (select ID, LEN, prefix_len, prefix, label as best_decode, score as decode_score from sc where rank = 1),
    base as (select st.*, coalesce(entropy, 0.0) as entropy, greatest(0.0, 1 - coalesce(entropy, 0.0) / 8) as stability, best_decode, coalesce(decode_score, 0.0) as decode_score
        from st left join en using (ID, LEN, prefix_len, prefix) left join best using (ID, LEN, prefix_len, prefix)),
    parts as (select p.*, coalesce(e.entropy, 0.0) as e, coalesce(b.decode_score, 0.0) as top from pairs p
        left join en e on e.ID = p.ID and e.LEN = p.LEN and e.prefix_len = p.next_len and e.prefix = p.next left join best b on b.ID = p.ID and b.LEN = p.LEN and b.prefix_len = p.next_len and b.prefix = p.next),
    sums as (select ID, LEN, prefix_len, prefix, next_len, sum(w * e) as we, sum(w * top) as wd, sum(n) as used,
        case when count(*) > 1 then greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0) / greatest(1.0, log2(count(*))) else 0.0 end as split from parts group by all having sum(n) >= 6),
    weighed as (select s.*, greatest(wd - decode_score, 0.0) as dg, greatest(entropy - we, 0.0) as eg, wd < greatest(0.35, 0.55 * decode_score) as weak from sums s join base using (ID, LEN, prefix_len, prefix)),
    gains as (select ID, LEN, prefix_len, prefix, max(gain) as gain, arg_max(next_len, (gain, -next_len)) as better_len from (
        select *, eg * case when weak then 0.15 else 1.0 end + 0.6 * dg + 0.35 * split * case when weak then 0.10 else 1.0 end as gain from weighed
        where not (we = 0 and wd = 0 and split = 0) and not (weak and dg <= 0)) where gain > 0 group by all),
    rated as (select base.*, coalesce(gain, 0.0) as gain, better_len, 0.45 * stability + 0.45 * least(greatest(decode_score / 1.25, 0.0), 1.0) + 0.10 * least(ratio / 0.25, 1.0) as semantic
        from base left join gains using (ID, LEN, prefix_len, prefix)),
    told as (select *, decode_score >= 0.55 and semantic >= 0.5 and gain <= 0.1 as recommended, case when best_decode is null then 'no decode of the payload' when decode_score < 0.55 then 'the best decode is weak'
        when semantic < 0.5 then 'the meaning is mixed' when gain > 0.1 then 'a prefix of ' || coalesce(better_len, 0) || ' bytes tells more' else 'the shortest stable prefix' end as reason from rated)"""


#: Decodes of a payload's bytes: label, kind, first and last byte, and the value's expression over the bytes D0 to D7.
def mux_decode_rows():
    for size in (1, 2, 4):
        for at in range(9 - size):
            for order in ("be", "le") if size > 1 else ("le",):
                places = range(at, at + size) if order == "le" else range(at + size - 1, at - 1, -1)
                raw = " + ".join(f"D{p}::bigint * {256 ** i}" for i, p in enumerate(places))
                tail = f"{8 * size}_{order}" if size > 1 else "8"
                yield f"u{tail}[{at}]", "uint", at, at + size - 1, f"({raw})::double"
                yield f"i{tail}[{at}]", "int", at, at + size - 1, f"(case when {raw} >= {1 << (8 * size - 1)} then {raw} - {1 << (8 * size)} else {raw} end)::double"
                if size == 4:
                    exponent, part = f"((({raw}) >> 23) & 255)", f"(({raw}) & 8388607)::double"
                    sign = f"(case when ({raw}) >= 2147483648 then -1.0 else 1.0 end)"
                    yield f"f32_{order}[{at}]", "float32", at, at + 3, f"round_even(case when {exponent} = 255 then 0.0 when {exponent} = 0 then {sign} * {part} * pow(2.0, -149) else {sign} * ({part} + 8388608.0) * pow(2.0, {exponent} - 150) end, 6)"


def mux_scores(states, key="ID, LEN, prefix_len, prefix"):
    """``sc``: the ranked decodes of the states of a table, over ``pre``."""
    cells = ", ".join(f"{{'label': '{label}', 'kind': '{kind}', 'a': {a}, 'b': {b}, 'x': {value}}}" for label, kind, a, b, value in mux_decode_rows())
    return f"""dec as (select {key}, TS, seq, unnest([{cells}]) as d from pre semi join {states} using ({key})),
        own as (select {key}, TS, seq, d.label as label, d.kind as kind, d.x as x from dec where d.a >= prefix_len and d.b < LEN),
        lagged as (select *, case when abs(x - lag(x) over (partition by {key}, label order by TS, seq)) > 1e-9 then 1 else 0 end as moved from own),
        vals as (select {key}, label, kind, x, count(*) as c, sum(moved) as moved from lagged group by all),
        agg as (select {key}, label, kind, cast(sum(c) as bigint) as n, count(*) as distinct_values, max(c) as most, sum(c * log2(c)) as clogc, sum(moved) as moved, max(abs(x)) as top from vals group by all having sum(c) >= 4 and count(*) >= 2),
        sc as (select *, row_number() over (partition by {key} order by score desc, label) as rank from (select *, round(1.1 * moved / greatest(n - 1, 1) + 0.8 * (1 - most / n)
            + 0.4 * greatest(log2(n) - clogc / n, 0.0) / greatest(1.0, log2(greatest(distinct_values, 2)))
            + case when kind = 'float32' then case when top < 1e4 then 0.8 when top < 1e6 then 0.65 else 0.0 end else case when top > 1e8 then -0.5 when top > 1e6 then -0.25 else 0.0 end end, 9) as score from agg))"""


#: The messages that carry each document: (doc_id, message, h: hex digits, n: bytes).
BAM = f"""x as (select doc_id, cast(k as int) as message, substr(hex(encode(text)), 2 * {MESSAGE_BYTES} * k + 1, 2 * {MESSAGE_BYTES}) as h, least({MESSAGE_BYTES}, octet_length(encode(text)) - {MESSAGE_BYTES} * k) as n
    from documents, lateral (select unnest(range(cast(ceil(octet_length(encode(text)) / {MESSAGE_BYTES}.0) as bigint))) as k) where octet_length(encode(text)) > 0)"""
WIDER = f"own as (select distinct id_int, {PGN} as pgn from frames), ids as (select distinct id_int, {PGN} as pgn from (select id_int from frames union all select case when id_int <= 2047 then id_int + 1024 else id_int + 4096 end from frames)),"
WIDER_DICTIONARY = DICTIONARY.replace(f"ids as (select distinct id_int, {PGN} as pgn from frames),", WIDER)
PRESENT = "exists (select 1 from own i where (dict.mode = 'exact' and i.id_int = dict.frame_id) or (dict.mode = 'j1939' and i.pgn = dict.pgn))"
MUX_SIGNED = lambda raw, n: f"case when ({raw}) >= {1 << (n - 1)} then ({raw}) - {1 << n} else ({raw}) end"


def _candidate_cells(kinds, lengths=(8, 16, 24, 32), orders=("true", "false")):
    """The fields of each payload length that the frames have, 6 and 8 bytes."""
    cells = []
    for size in (6, 8):
        for n in lengths:
            k = n // 8
            for kind in kinds:
                for at in range(size - k + 1):
                    for le in orders:
                        raw = " + ".join(f"D{at + i} * {256 ** (i if le == 'true' else k - 1 - i)}::bigint" for i in range(k))
                        x = MUX_SIGNED(raw, n) if kind == "int" else raw
                        cells.append(f"select ID, LEN, TS, seq, {8 * at + (0 if le == 'true' else 7)} as start_bit, {n} as length, {le} as le, '{kind}' as type, cast({x} as double) as x from frames where LEN = {size}")
    return " union all ".join(cells)


CANDIDATES = """
    lg as (select *, lag(x) over (partition by ID, LEN, start_bit, length, le, type order by TS, seq) as p from cand),
    ag as (select ID, LEN, start_bit, length, le, type, count(*) as frames, cast(sum(case when abs(x - p) > 1e-9 then 1 else 0 end) as bigint) as changes, count(distinct x) as distinct_values, min(x) as low, max(x) as high,
        cast(sum(case when x - p in (1, -255) then 1 else 0 end) as double) / greatest(count(p), 1) as up, array_to_string(list(cast(x as bigint) order by TS, seq)[1:6], ',') as first_values,
        case when count(*) < 3 or coalesce(stddev_pop(x) filter (p is not null), 0) < 1e-12 or coalesce(stddev_pop(p), 0) < 1e-12 then 0.0
             else abs(covar_pop(x, p) / (stddev_pop(x) filter (p is not null) * stddev_pop(p))) end as autocorr from lg group by all),
    sh as (select *, 0.5 * changes / greatest(frames - 1, 1) + 0.3 * least(1.0, (distinct_values - 1) / greatest(1.0, least(frames - 1, 16))) + 0.2 * case when high - low > 1e-9 then 1 else 0 end as shape from ag)"""

ORACLE = {
    "log_round_trip": _events(f"select {ALL} from frames"), "spaced_lines": _events(f"select {ALL} from frames"),
    "memorator_lines": _events("select * replace ('1' as Bus) from (select " + ALL + " from frames)"), "records_source": _events(f"select {ALL} from frames"),
    "normalize_time": _lineitem("select ID, seq, round(TS - first_value(TS) over (partition by ID order by seq), 6) as TS from frames"),
    "merge_logs": "select 'events' as log_id, (select count(*) from events) + (select count(*) from lineitem) as frames, (select max(event_id) from events) + 1 + (select max(n) from (select count(*) as n from lineitem group by l_suppkey)) as top",
    "id_fields": _events(f"""select ID, id_int as value, p as pgn, case when p is not null then printf('0x%04X', p) end as pgn_text, (p >> 8) & 255 < 240 as pdu1, cast((id_int >> 16) & 255 as int) as pf,
        cast(id_int & 255 as int) as sa, cast((id_int >> 26) & 7 as int) as priority, case when p is not null then ((id_int >> 26) & 7) * 67108864 + ((p >> 16) & 1) * 16777216 + (p & 65535) * 256 + (id_int & 255) end as back
        from (select distinct ID, id_int, {PGN} as p from frames)"""),
    "bits": _events(f"""select seq, D0 + 256 * D1 as le_0_16, cast((l >> 20) & 4095 as bigint) as le_20_12, D0 * 256 + D1 as be_7_16, (D0 & 15) * 256 + D1 as be_3_12,
        case when D3 > 127 then D3 - 256 else D3 end as i8, D1 * 256 + D2 as mux, D3 * 0.5 + 10.0 as physical from (select *, {LE} as l from frames)"""),
    "typed_reads": _events("""select seq, cast(D3 as varchar) as u8_le_3, cast(D0 + 256 * D1 as varchar) as u16_le_0, cast(D0 * 256 + D1 as varchar) as u16_be_0,
        case when LEN = 8 then cast(case when D7 > 127 then D6 + 256 * D7 - 65536 else D6 + 256 * D7 end as varchar) end as i16_le_6, cast(D0 + 256 * D1 + 65536 * D2 + 16777216::bigint * D3 as varchar) as u32_le_0,
        case when LEN = 8 then cast(16777216::bigint * D4 + 65536 * D5 + 256 * D6 + D7 - case when D4 > 127 then 4294967296 else 0 end as varchar) end as i32_be_4,
        case when LEN = 8 then cast(""" + LE + """ as varchar) end as u64_le_0 from frames"""),
    "texts": _events("""select seq, rtrim(regexp_replace(DATA, '(..)', '\\1 ', 'g')) as spaced, printf('%08b %08b', D0, D1) as bits, strftime(make_timestamp(cast(floor(TS * 1000000) as bigint)), '%H:%M:%S') as clock,
        regexp_replace(printf('%.4f', D3 / 8.0), '\\.?0+$', '') as value, 'Kind: ' || regexp_replace(printf('%.4f', D2 / 2.0), '\\.?0+$', '') || ' u' as line, printf('%02X', D4) as d4 from frames"""),
    "frame_summary": _events(SUMMARY), "frame_summary_large": f"with {LINEITEM_SQL.replace('255 as D7 from e', chr(39) + chr(39) + ' as x, 255 as D7 from e')}, g as (select * from frames) " + SUMMARY.replace("from frames window", "from (select *, printf('%02X%02X%02X%02X%02X%02X%02X%02X', D0, D1, D2, D3, D4, D5, D6, D7) as DATA from g) window"),
    "byte_changes": _events("select ID, byte, cast(sum(case when value <> p then 1 else 0 end) as bigint) as changes, count(distinct value) as uniques from (select *, lag(value) over (partition by ID, byte order by TS, seq) as p from bytes) group by all", BYTES),
    "byte_entropy": _events("select ID, byte, round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0), 6) as entropy from (select ID, byte, value, count(*) as n from bytes group by all) group by all", BYTES),
    "byte_update_period": _events("""select ID, byte, round(avg(gap), 6) as update_mean, min(gap) as update_min, max(gap) as update_max from (
        select ID, byte, round(TS - lag(TS) over (partition by ID, byte order by TS, seq), 6) as gap from (select *, lag(value) over (partition by ID, byte order by TS, seq) as p from bytes) where p <> value) where gap is not null group by all""", BYTES),
    "mux_cases": _events("select ID, mux_label, frames, cast(row_number() over (partition by ID order by t, s) as int) as position from (select ID, printf('%02X', D2) as mux_label, count(*) as frames, min(TS) as t, arg_min(seq, (TS, seq)) as s from frames group by all)"),
    "mux_rules": _events("select ID, LEN, case when LEN = 8 then printf('%02X', D2) else '' end as mux_label, count(*) as frames from frames group by all"),
    "id_lengths": _events("select distinct ID, LEN from frames"),
    "changed_bytes": _events("select seq, concat_ws(',', " + ", ".join(f"case when lag(D{i}) over w <> D{i} then '{i}' end" for i in range(8) if i != 2) + ") as changed from frames window w as (partition by ID order by TS, seq)"),
    "time_range": _events("select seq from frames where TS between 1704067200.0 + 86400 and 1704067200.0 + 20 * 86400"),
    "matrix": _events("""select ID || ':' || byte as series_id, seq, cast(value as double) as value, m as has_movement from (
        select *, row_number() over (partition by ID, byte, b order by value, TS, seq) as lo, row_number() over (partition by ID, byte, b order by value desc, TS, seq) as hi,
            min(value) over (partition by ID, byte) <> max(value) over (partition by ID, byte) as m
        from (select *, (row_number() over (partition by ID, byte order by TS, seq) - 1) // greatest(cast(ceil(count(*) over (partition by ID, byte) / 20.0) as bigint), 1) as b from bytes)) where lo = 1 or hi = 1""", BYTES),
    "range_diff": _events("""select sc.ID, sc.byte, class, n_a, n_b, array_to_string(list_sort(list_filter(vb, lambda x: not list_contains(va, x))), ',') as new_values, array_to_string(list_sort(list_filter(va, lambda x: not list_contains(vb, x))), ',') as lost_values,
        round(mb - ma, 6) as mean_delta, round(cr_a, 6) as change_ratio_a, ca as counter_a, first_a, last_b, round(score, 6) as score,
        case when n_a >= 2 and n_b >= 2 and len(list_distinct(list_concat(va, vb))) > 1 then round(ra - n_a * (n_a + 1) / 2.0, 6) end as u,
        case when n_a >= 2 and n_b >= 2 and len(list_distinct(list_concat(va, vb))) > 1 then round(greatest(abs(ra - n_a * (n_a + 1) / 2.0 - n_a * n_b / 2.0) - 0.5, 0) / sqrt(n_a * n_b / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))), 6) end as z
        from sc join us on sc.ID = us.ID and sc.byte = us.byte""", SIDES, OBSERVED),
    "id_diff": _events("""select i.ID, case when fb = 0 then 'only_a' when fa = 0 then 'only_b' else 'both' end as presence, fa as frames_a, fb as frames_b, fa > 0 and fb > 0 and la <> lb as len_changed, coalesce(k, 0) as changed_bytes,
        round(case when fa = 0 or fb = 0 then 0.3 else coalesce(top, 0) + 0.05 * coalesce(k, 0) + case when la <> lb then 0.3 else 0 end end, 6) as score
        from (select ID, count(*) filter (side = 'a') as fa, count(*) filter (side = 'b') as fb, coalesce(list_sort(list(distinct LEN) filter (side = 'a')), []) as la, coalesce(list_sort(list(distinct LEN) filter (side = 'b')), []) as lb from sided group by all) i
        left join (select ID, max(score) as top, count(*) filter (class not in ('unchanged', 'same_oscillation')) as k from sc group by all) b on i.ID = b.ID""", SIDES, OBSERVED),
    "frame_density": _events("select cast(least(floor((TS - a) / ((b - a) / 50)), 49) as int) as bin, count(*) as frames from frames, (select min(TS) as a, max(TS) as b from frames) group by all"),
    "carry_hints": _events("select ID, low, high, count(*) filter (abs(s) >= 200) as wraps, count(*) filter (abs(s) >= 200 and abs(o) = 1) as carries, count(*) filter (abs(s) >= 200 and abs(o) = 1) / count(*) filter (abs(s) >= 200)::double >= 0.7 as is_16bit from (" + " union all ".join(
        f"select ID, {a} as low, {b} as high, case when LEN > {max(a, b)} and lag(LEN) over w > {a} then D{a} - lag(D{a}) over w end as s, case when LEN > {max(a, b)} and lag(LEN) over w > {b} then D{b} - lag(D{b}) over w end as o from frames window w as (partition by ID order by TS, seq)"
        for i in range(7) for a, b in ((i, i + 1), (i + 1, i))) + ") group by all having count(*) filter (abs(s) >= 200) > 0"),
    "groups_present": _events(f"select p as pgn, count(*) as frames from (select {PGN} as p from frames) where p is not null group by all"),
    "dictionary_listing": _events("select distinct dict_name, message_name, signal_name, unit from dict", DICTIONARY),
    "decode_all": _events("select seq, ID, message_name, signal_name, value, raw, unit from dec", DICTIONARY),
    "coverage": _events("""select ID, message_name, signal_name, count(*) as frames, count(distinct value) as "unique", min(value) as low, max(value) as high, round(avg(value), 9) as mean, arg_max(value, (TS, seq)) as last,
        count(*) filter (r) as real_frames, count(distinct value) filter (r) as real_unique, min(value) filter (r) as real_low, max(value) filter (r) as real_high, round(avg(value) filter (r), 9) as real_mean, arg_max(value, (TS, seq)) filter (r) as real_last,
        count(distinct value) > 1 as is_changing, case when count(*) filter (r) > 0 then count(distinct value) filter (r) > 1 end as real_is_changing
        from (select *, raw <> (1::hugeint << length) - 1 as r from dec) group by all""", DICTIONARY),
    "present_messages": _events(f"select distinct message_name from dict where {PRESENT}", WIDER_DICTIONARY),
    "absent_messages": _events(f"select distinct message_name from dict where not {PRESENT}", WIDER_DICTIONARY),
    "changed_signals": _events("""select i.id_int, sc.byte, array_to_string(list_sort(list(distinct signal_name)), ',') as signals from sc join (select distinct ID, id_int from frames) i on i.ID = sc.ID
        join dict d on d.mode = 'exact' and d.frame_id = i.id_int and sc.byte between d.start_bit // 8 and (d.start_bit + d.length - 1) // 8 where class <> 'unchanged' group by all""", SIDES, OBSERVED, DICTIONARY),
    "dictionary_overlaps": """with s as (select 'm' || cast(p_partkey % 200 as varchar) as m, 's' || cast(p_partkey as varchar) as n, (p_partkey * 5) % 48 as s from part)
        select a.m as message_name, a.n as signal_a, b.n as signal_b from s a join s b on a.m = b.m and a.n < b.n and a.s < b.s + 12 and b.s < a.s + 12""",
    "group_map": """select 61440 + p_partkey % 200 as pgn, count(*) as signals, count(*) as names, 201326592 + (61440 + p_partkey % 200) * 256 as frame_id, cast(sum((p_partkey % 7) * 8) as bigint) as start_bits, 0.125::double as scale from part group by p_partkey % 200""",
    "align_ffill": f"""with {KINDS}, w as (select TS, arg_max(value, seq) filter (series_id = 'click') as c, arg_max(value, seq) filter (series_id = 'purchase') as p from s where series_id in ('click', 'purchase') group by TS)
        select TS, last_value(c ignore nulls) over (order by TS) as click, last_value(p ignore nulls) over (order by TS) as purchase from w""",
    "value_at_time": f"""with {KINDS}, {PROBES}, k as (select distinct series_id from s),
        a as (select k.series_id, p.probe, s.TS, s.value from (k cross join p) asof left join s on k.series_id = s.series_id and p.probe >= s.TS), b as (select k.series_id, p.probe, s.TS, s.value from (k cross join p) asof left join s on k.series_id = s.series_id and p.probe <= s.TS)
        select series_id, probe, round(case when a.TS is null then b.value when b.TS is null then a.value when b.TS > a.TS then a.value + (b.value - a.value) * (probe - a.TS) / (b.TS - a.TS) else a.value end, 6) as value from a join b using (series_id, probe)""".replace("k.series_id, p.probe", "k.series_id as series_id, p.probe as probe"),
    "nearest_sample": f"""with {KINDS}, {PROBES} select series_id, probe, TS, value from (select series_id, probe, TS, value, row_number() over (partition by series_id, probe order by abs(TS - probe), TS) as r from s, p) where r = 1""",
    "value_search": f"""with {USERS}, {PROBES}, k as (select series_id, count(*) as n, min(value) as low, max(value) as high, min(TS) as t0, max(TS) as t1 from s group by 1),
        a as (select k.series_id as series_id, p.probe as probe, s.TS, s.value from (k cross join p) asof left join s on k.series_id = s.series_id and p.probe >= s.TS),
        b as (select k.series_id as series_id, p.probe as probe, s.TS, s.value from (k cross join p) asof left join s on k.series_id = s.series_id and p.probe <= s.TS),
        x as (select series_id, probe, case when a.TS is null then b.value when b.TS is null then a.value when b.TS > a.TS then a.value + (b.value - a.value) * (probe - a.TS) / (b.TS - a.TS) else a.value end as inter,
            case when b.TS is null or probe - a.TS <= b.TS - probe then a.TS else b.TS end as near_ts, case when b.TS is null or probe - a.TS <= b.TS - probe then a.value else b.value end as near_value from a join b using (series_id, probe)),
        y as (select series_id, probe, abs(near_ts - probe) > 432000.0 as missing, abs((case when probe between t0 and t1 then inter else near_value end - low) / nullif(high - low, 0.0) - 0.5) > 0.45 as off from x join k using (series_id)),
        f as (select series_id, arg_min(case when missing then 'no_data_near_constraint' else 'outside_tolerance' end, probe) as why from y where missing or off group by 1)
        select series_id, case when n < 2 then 'too_few_samples' when high = low then 'zero_variance' else coalesce(why, 'match') end as reason from k left join f using (series_id)""",
    "window_stats": f"""with {USERS}, q(lo, hi) as (values (1704067200.0::double + 3 * 86400, 1704067200.0::double + 9 * 86400)),
        e as (select series_id, t, (select arg_max(value, (TS, seq)) from s x where x.series_id = k.series_id and x.TS <= t) as va, (select max(TS) from s x where x.series_id = k.series_id and x.TS <= t) as ta,
                (select arg_min(value, (TS, seq)) from s x where x.series_id = k.series_id and x.TS >= t) as vb, (select min(TS) from s x where x.series_id = k.series_id and x.TS >= t) as tb
              from (select distinct series_id from s) k, (select lo as t from q union all select hi from q)),
        v as (select series_id, t, case when ta is null then vb when tb is null then va when tb > ta then va + (vb - va) * (t - ta) / (tb - ta) else va end as x from e),
        i as (select series_id, count(*) as n, avg(value) as a, min(value) as low, max(value) as high from s, q where TS between lo and hi group by all)
        select series_id, coalesce(n, 0) as n, case when n >= 2 then round(a, 6) end as average, low, high, round(f, 6) as at_low, round(g, 6) as at_high, round(g - f, 6) as delta
        from (select series_id, max(x) filter (t = lo) as f, max(x) filter (t = hi) as g from v, q group by all) left join i using (series_id)""",
    "moving_average": _weighted([0.2] * 5), "gaussian_filter": _weighted(gaussian_weights(1.0)), "savgol_filter": _weighted(savgol_weights(7, 2)),
    "median_filter": f"with {USERS} select series_id, seq, round(list_median([coalesce(lag(value, 4) over w, f), coalesce(lag(value, 3) over w, f), coalesce(lag(value, 2) over w, f), coalesce(lag(value, 1) over w, f), value]), 6) as value from (select *, first_value(value) over (partition by series_id order by TS, seq) as f from s) window w as (partition by series_id order by TS, seq)".replace("list_median(", "list_aggregate(").replace(", value]), 6)", ", value], 'median'), 6)"),
    "ema_filter": f"with {USERS} select series_id, seq, round(list_reduce(list(value) over (partition by series_id order by TS, seq rows between 176 preceding and current row), lambda a, x: a + 0.2 * (x - a)), 6) as value from s",
    "stride_sample": f"with {KINDS} select series_id, seq from (select *, row_number() over (partition by series_id order by TS, seq) - 1 as r, count(*) over (partition by series_id) as n from s) where r % cast(ceil(n / 100.0) as bigint) = 0",
    "minmax_sample": f"""with {KINDS} select series_id, seq, value from (select *, row_number() over (partition by series_id, b order by value, TS, seq) as lo, row_number() over (partition by series_id, b order by value desc, TS, seq) as hi
        from (select *, (row_number() over (partition by series_id order by TS, seq) - 1) // cast(ceil(count(*) over (partition by series_id) / 50.0) as bigint) as b from s)) where lo = 1 or hi = 1""",
    "bam_messages": f"with {BAM} select doc_id, message, cast(doc_id % 254 as int) as sa, 65024 + doc_id % 256 as pgn, lower(h) as data from x",
    "bam_groups": f"with {BAM} select 65024 + doc_id % 256 as pgn, count(distinct doc_id % 254) as sources, count(*) as announcements from x group by all",
    "bam_bits": f"""with {BAM}, y as (select doc_id, message, n, [cast('0x' || coalesce(nullif(substr(h, 2 * i + 1, 2), ''), '0') as bigint) for i in range(9)] as c from x)
        select doc_id, message, case when n >= 4 then ((c[2] + 256 * c[3] + 65536 * c[4]) >> 4) & 1048575 end as bits, case when n >= 6 then c[5] * 256 + c[6] end as word from y""",
    "bam_chunks": f"""with {BAM} select doc_id, message, cast(k as int) as chunk, cast('0x' || substr(h, 2 * (1 + 16 * k + 2) + 1, 2) as bigint) + 256 * cast('0x' || substr(h, 2 * (1 + 16 * k + 3) + 1, 2) as bigint) as value
        from x, range(112) t(k) where (k + 1) * 16 + 1 <= n""",
    "candidate_scan": _events("""select ID, LEN, start_bit, length, le, type, frames, changes, distinct_values, low, high, round(autocorr, 6) as autocorr,
        round(case when frames < 2 then 0.0 else least(greatest(shape * (0.3 + 0.7 * autocorr), 0), 1) * least(1.0, sqrt(frames / 30.0)) end, 6) as score,
        case when distinct_values <= 1 then 'constant' when distinct_values = 2 then 'binary' when length = 8 and type = 'uint' and up >= 0.85 then 'counter'
            when distinct_values <= 16 and changes / greatest(frames - 1, 1) < 0.5 then 'enum' when autocorr >= 0.5 then 'analog' else 'other' end as category, first_values from sh""", f"cand as ({_candidate_cells(('uint', 'int'))})", CANDIDATES),
    "candidate_counts": _events("select ID, count(*) as candidates, min(high - low) filter (abs(low) < 1e15 and abs(high) < 1e15) as span_low, max(high - low) filter (abs(low) < 1e15 and abs(high) < 1e15) as span_high from (select ID, LEN, start_bit, length, le, type, min(x) as low, max(x) as high from cand group by all) group by ID", f"cand as ({_candidate_cells(('uint', 'int'))})"),
    "candidate_tags": _events("select ID, LEN, start_bit, 'level' as tag from cand where start_bit = 24 group by all having count(*) >= 5 and max(x) - min(x) >= 1", f"cand as ({_candidate_cells(('uint',), (8,), ('true',))})"),
    "mux_prefix": _events("select ID, LEN, prefix_len, prefix, support, round(ratio, 6) as ratio from st", PREFIX),
    "mux_entropy": _events("select ID, LEN, prefix_len, prefix, round(coalesce(entropy, 0), 6) as entropy, round(greatest(0.0, 1 - coalesce(entropy, 0) / 8), 6) as stability from st left join en using (ID, LEN, prefix_len, prefix)", PREFIX, _entropy("prefix_len")),
    "mux_decodes": _events(f"""select ID, LEN, prefix_len, prefix, label, n, distinct_values, round(score, 6) as score, cast(rank as int) as rank from sc where rank <= 12""", PREFIX, mux_scores("st")),
    "mux_patterns": _events("""select ID, LEN, prefix_len, prefix, support, best_decode, round(decode_score, 6) as decode_score, round(gain, 6) as gain, round(semantic, 6) as semantic, recommended, reason
        from (select *, row_number() over (partition by ID, LEN order by recommended desc, prefix_len, round(semantic, 9) desc, decode_score desc, support desc, round(gain, 9), prefix) as position from told) where position <= 25""",
        PREFIX, _entropy("prefix_len"), MUX_PAIRS, mux_scores("needed"), MUX_GAINS),
    "derived_signal": f"""with {KINDS}, w as (select TS, arg_max(2.0 * value + 1.0, seq) filter (series_id = 'click') as c, arg_max(least(greatest(value, 10.0), 400.0), seq) filter (series_id = 'purchase') as p from s where series_id in ('click', 'purchase') group by TS),
        v as (select TS, last_value(c ignore nulls) over (order by TS) as c, last_value(case when p > 100 then p else p * 0.5 + 5.0 end ignore nulls) over (order by TS) as p from w)
        select TS, round_even(sqrt(abs(c - p)), 4) as value from v where c is not null and p is not null""",
    "derived_raw": _events(f"select TS, seq, floor((D6 + 256 * D7) * 0.01::double * 10.0) / 10.0 as value from frames where {PGN} = 61696"),
    "formula": f"""with {KINDS}, w as (select TS, arg_max(value, seq) filter (series_id = 'click') as c, arg_max(value, seq) filter (series_id = 'signup') as p from s where series_id in ('click', 'signup') group by TS),
        v as (select TS, last_value(c ignore nulls) over (order by TS) as c, last_value(p ignore nulls) over (order by TS) as p from w)
        select TS, case when c > 0 then 'inf'::double when c < 0 then '-inf'::double else 'nan'::double end as value from v where c is not null and p is not null""",
    "readings_series": "select event_type as series_id, event_id as seq, round(cast(value as double), 2) as value from events where (user_id % 10) / 10.0 >= 0.45 and value is not null",
    "series_export": f"""with {KINDS}, r as (select *, row_number() over (partition by series_id order by TS, seq) as n from s where series_id in ('click', 'error'))
        select cast(n as int) as row, max(TS) filter (series_id = 'click') as "click Timestamp", max(value) filter (series_id = 'click') as "click Value", max(TS) filter (series_id = 'error') as "error Timestamp", max(value) filter (series_id = 'error') as "error Value" from r group by n""",
}
