"""The registered queries: every operator over frames derived from the given tables."""

from pyspark.sql import functions as F

from busfleet.functions import bits, ids, numeric, text
from busfleet.operators import candidates, coverage, decode, derive, diff, muxfind, series, summary, transport
from busfleet.plans.frames import events_frames, lineitem_frames, table, transport_frames, transport_place
from busfleet.sources import dictionaries, logs, readings, sinks

#: The dictionary of the derived frames: an exact and a group one, plain, signed, big-endian, multiplexed.
SIGNALS = [
    ("own", "exact", True, 1, "Counters", 8, None, None, "Count", 0, 16, True, 1.0, 0.0, "uint", 0, 0, None, "", "wrapping counter"),
    ("own", "exact", True, 1, "Counters", 8, None, None, "Value", 24, 8, True, 0.5, 10.0, "uint", 0, 0, None, "u", "analog"),
    ("own", "exact", True, 1, "Counters", 8, None, None, "Missing", 40, 8, True, 1.0, 0.0, "uint", 0, 0, None, "", "not available"),
    ("fleet", "j1939", True, 2, "Group", 8, None, None, "Kind", 23, 8, False, 1.0, 0.0, "uint", 0, 0, None, "", "big-endian"),
    ("fleet", "j1939", True, 2, "Group", 8, None, None, "Cents", 48, 16, True, 0.01, 0.0, "int", 0, 0, None, "cur", "signed"),
    ("fleet", "j1939", True, 2, "Group", 8, None, None, "BuyProps", 32, 8, True, 1.0, 0.0, "uint", 2, 1, 2, "", "only in case 2"),
    ("fleet", "j1939", False, 0, "Group", 8, None, None, "Off", 0, 8, True, 1.0, 0.0, "uint", 0, 0, None, "", "inactive"),
]


def wider_ids(frames):
    """The ids of the frames and as many others, most of which no frame has."""
    other = F.when(F.col("id_int") <= 2047, F.col("id_int") + 1024).otherwise(F.col("id_int") + 4096)
    return frames.select("id_int").union(frames.select(other.cast("long")))


def dictionary(spark, sf_dir, ids_of=lambda frames: frames):
    """SIGNALS for every id (exact, 11 bits) and every group of the frames, so it grows with the log."""
    found = ids_of(events_frames(spark, sf_dir)).select("id_int").distinct()
    base = spark.createDataFrame(SIGNALS, decode.DDL)
    name = lambda c: F.concat("message_name", F.lit("_"), F.hex(c)).alias("message_name")
    rest = [c for c in base.columns if c not in ("message_name", "frame_id", "pgn")]
    exact = base.where("mode = 'exact'").crossJoin(found.where("id_int <= 2047")).select(*rest, name("id_int"), F.col("id_int").alias("frame_id"), F.lit(None).cast("long").alias("pgn"))
    groups = found.withColumn("g", ids.pgn_of("id_int")).where("g is not null").select("g").distinct()
    group = base.where("mode = 'j1939'").crossJoin(groups).select(*rest, name("g"), ids.id_of_pgn("g").alias("frame_id"), F.col("g").alias("pgn"))
    return exact.unionByName(group).select(*base.columns)


def user_series(spark, sf_dir):
    """A series per user from ``events``: the value over time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("log_id"), F.col("user_id").cast("string").alias("series_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("TS"), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))


def kind_series(spark, sf_dir):
    """A series per event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("log_id"), F.col("event_type").alias("series_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("TS"), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))


def probes(spark, sf_dir):
    """Ten probe times spread over the span of ``events``."""
    span = events_frames(spark, sf_dir).agg(F.min("TS").alias("a"), F.max("TS").alias("b"))
    return span.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "a", "b").select((F.col("a") + F.floor((F.col("b") - F.col("a")) * (F.col("k") + 0.5) / 10)).alias("probe"))


def halves(spark, sf_dir):
    """Frames of the first and the second half of the log, tagged a and b."""
    f = events_frames(spark, sf_dir)
    mid = f.agg(((F.min("TS") + F.max("TS")) / 2).alias("mid"))
    return f.crossJoin(F.broadcast(mid)).withColumn("side", F.when(F.col("TS") <= F.col("mid"), "a").otherwise("b")).drop("mid")


RULE = "can_id string, length int, mux_bytes array<int>"


def rules(spark, frames):
    """A rule per id: the byte D2 selects; for payloads of 8 bytes only."""
    return frames.select(F.col("ID").alias("can_id"), F.lit(8).alias("length"), F.array(F.lit(2)).alias("mux_bytes")).distinct()


def _round(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})



def q_log_round_trip(spark, sf):
    f = events_frames(spark, sf)
    lines = f.select("log_id", "seq", F.format_string("(%.6f) %s %s#%s", "TS", "Bus", "ID", "DATA").alias("value"))
    return logs.normalize_frames(logs.parse_lines(lines, "candump"))


def q_spaced_lines(spark, sf):
    f = events_frames(spark, sf)
    lines = f.select("log_id", "seq", F.format_string("(%.6f) %s %s [%d] %s", "TS", "Bus", "ID", "LEN", text.spaced_payload("DATA")).alias("value"))
    return logs.normalize_frames(logs.parse_lines(lines, "spaced"))


def q_memorator_lines(spark, sf):
    f = events_frames(spark, sf)
    lines = f.select("log_id", "seq", F.format_string("  %.6f  1  %sx  R  %d  %s", "TS", "ID", "LEN", text.spaced_payload("DATA")).alias("value"))
    return logs.normalize_frames(logs.parse_lines(lines, "memorator"))


def q_id_fields(spark, sf):
    f = events_frames(spark, sf).select("ID", "id_int").distinct()
    return f.select(
        "ID", ids.hex_to_int("ID").alias("value"), ids.pgn_of("id_int").alias("pgn"), ids.pgn_text(ids.pgn_of("id_int")).alias("pgn_text"), ids.is_pdu1(ids.pgn_of("id_int")).alias("pdu1"),
        ids.pdu_format("id_int").alias("pf"), ids.source_address("id_int").alias("sa"), ids.priority("id_int").alias("priority"), ids.id_of_pgn(ids.pgn_of("id_int"), ids.priority("id_int"), ids.source_address("id_int")).alias("back"),
    )


def q_bits(spark, sf):
    f = events_frames(spark, sf)
    le, be = bits.packed_le(), bits.packed_be()
    return f.select(
        "seq", bits.raw_le(le, 0, 16).alias("le_0_16"), bits.raw_le(le, 20, 12).alias("le_20_12"), bits.raw_be(be, 7, 16).alias("be_7_16"), bits.raw_be(be, 3, 12).alias("be_3_12"),
        bits.signed(bits.raw_le(le, 24, 8), 8).alias("i8"), bits.mux_value(1, 2).alias("mux"), bits.physical(bits.raw_le(le, 24, 8), 8, "uint", 0.5, 10.0).alias("physical"),
    )


def q_typed_reads(spark, sf):
    f = events_frames(spark, sf).withColumn("data", bits.lenient_bytes("DATA"))
    names = (("u8_le", 3), ("u16_le", 0), ("u16_be", 0), ("i16_le", 6), ("u32_le", 0), ("i32_be", 4), ("u64_le", 0))
    return f.select("seq", *(bits.typed_read("data", at, k).cast("decimal(20,0)").cast("string").alias(f"{k}_{at}") for k, at in names))


def q_texts(spark, sf):
    f = events_frames(spark, sf)
    return f.select("seq", text.spaced_payload("DATA").alias("spaced"), text.bit_groups(F.substring("DATA", 1, 4)).alias("bits"), text.time_text("TS", "UTC").alias("clock"), text.value_text(F.col("D3") / 8).alias("value"), text.display_line(F.lit("Kind"), F.col("D2") / 2, F.lit("u")).alias("line"), bits.byte_hex("D4").alias("d4"))


def q_frame_summary(spark, sf):
    return summary.frame_summary(events_frames(spark, sf))


def q_frame_summary_large(spark, sf):
    return summary.frame_summary(lineitem_frames(spark, sf))


def q_byte_diff(spark, sf):
    d = diff.byte_diff(halves(spark, sf))
    hexes = lambda c: F.array_join(F.transform(F.array_sort(c), lambda v: v.cast("string")), ",")
    return d.select("ID", "byte", "class", "n_a", "n_b", hexes("new_values").alias("new_values"), hexes("lost_values").alias("lost_values"), F.round("mean_delta", 6).alias("mean_delta"), F.round("change_ratio_a", 6).alias("change_ratio_a"), "counter_a", "first_a", "last_b", F.round("score", 6).alias("score"), F.round("u", 6).alias("u"), F.round("z", 6).alias("z"))


def q_coverage(spark, sf):
    c = coverage.coverage(events_frames(spark, sf), dictionary(spark, sf))
    # nine decimals: means of amounts in cents lie on ties at six
    return c.withColumns({m: F.round(m, 9) for m in ("mean", "real_mean")}).drop("log_id")


def q_decode_all(spark, sf):
    return decode.decode_all(events_frames(spark, sf), dictionary(spark, sf)).select("seq", "ID", "message_name", "signal_name", "value", "raw", "unit")


def q_candidates(spark, sf):
    f = events_frames(spark, sf)
    c = candidates.scan(f, candidates.specs(spark, candidates.payload_lengths(f), types=("uint", "int")))
    firsts = F.array_join(F.transform("first_values", lambda x: x.cast("long").cast("string")), ",")
    c = _round(c, "autocorr", "score").withColumn("first_values", firsts)
    return c.select("ID", "LEN", "start_bit", "length", "le", "type", "frames", "changes", "distinct_values", "low", "high", "autocorr", "score", "category", "first_values")


def q_candidate_counts(spark, sf):
    f = events_frames(spark, sf)
    return candidates.per_id(candidates.scan(f, candidates.specs(spark, candidates.payload_lengths(f), types=("uint", "int")))).drop("log_id")


def q_candidate_floats(spark, sf):
    f = events_frames(spark, sf)
    c = candidates.scan(f, candidates.specs(spark, candidates.payload_lengths(f), 32, 32, types=("float32",)))
    return c.select("ID", "LEN", "start_bit", "le", "frames", "changes", "distinct_values", "category")


def q_candidate_tags(spark, sf):
    """Whole bytes that pass the display filters and bear a user's tag."""
    f = events_frames(spark, sf)
    c = candidates.scan(f, candidates.specs(spark, candidates.payload_lengths(f), 8, 8, orders=("le",), types=("uint",)))
    tags = f.select(F.concat("ID", F.lit("/24+8/LE/uint")).alias("label"), F.lit("level").alias("tag")).distinct()
    shown = candidates.display_filter(c, types=["uint"], low_span=1.0, min_frames=5, little=True, min_length=8, tags=tags)
    return shown.select("ID", "LEN", "start_bit", "tag")


def q_clusters(spark, sf):
    c = candidates.kept(candidates.scan(events_frames(spark, sf)))
    return candidates.clusters(c).where("rank = 1").select("ID", "LEN", "start_bit", "length", "le", "members", F.round("score", 6).alias("score"), "category")


def q_fragments(spark, sf):
    f = events_frames(spark, sf)
    c = candidates.scan(f, candidates.specs(spark, candidates.payload_lengths(f), 8, 8, orders=("le",), types=("uint",)))
    return candidates.with_fragments(c, diff.carry_hints(f)).select("ID", "LEN", "start_bit", "fragment")


def selector_first(spark, sf):
    """F with D2, which selects, as the first byte."""
    f = events_frames(spark, sf)
    return f.withColumns({"D0": F.col("D2"), "D2": F.col("D0")})


def q_value_search(spark, sf):
    s = user_series(spark, sf)
    c = probes(spark, sf).select("probe", F.lit(0.5).alias("target"), F.lit(0.45).alias("tolerance"), F.lit(86400.0 * 5).alias("precision"))
    return candidates.search_values(s, c).select("series_id", "reason")


def q_derived(spark, sf):
    config = {
        "branches": [
            {"source": {"kind": "signal", "series_id": "click"}, "transforms": [("scale", 2.0), ("offset", 1.0)]},
            {"source": {"kind": "signal", "series_id": "purchase"}, "transforms": [("clamp", 10.0, 400.0), ("conditional", (">"), 100.0, (1.0, 0.0), (0.5, 5.0))]},
        ],
        "ops": ["sub"], "output": [("abs",), ("math", "sqrt"), ("round", 4)],
    }
    return derive.derive(config, series=kind_series(spark, sf)).select("TS", "value")


def q_derived_raw(spark, sf):
    config = {"branches": [{"source": {"kind": "raw", "mode": "j1939", "pgn": 0xF100, "start_bit": 48, "length": 16, "type": "uint", "scale": 0.01}, "transforms": [("truncate", 1)]}]}
    return derive.derive(config, frames=events_frames(spark, sf)).select("TS", "seq", "value")


def q_bam_messages(spark, sf):
    m = transport.bam_messages(transport_frames(spark, sf))
    return m.select(*transport_place(), "sa", "pgn", F.lower(F.hex("data")).alias("data"))


def q_bam_bits(spark, sf):
    m = transport.bam_messages(transport_frames(spark, sf))
    return m.select(*transport_place(), transport.long_bits("data", 12, 20).alias("bits"), bits.typed_read("data", 4, "u16_be").alias("word"))


def q_bam_chunks(spark, sf):
    m = transport.bam_messages(transport_frames(spark, sf))
    c = transport.read_field(transport.chunks(m, 16, 1), 2, "u16_le", "record")
    return c.select(*transport_place(), "chunk", F.col("value").cast("long").alias("value"))


def q_readings(spark, sf):
    e = table(spark, sf, "events")
    r = e.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("timestamp"), F.col("event_id").cast("int").alias("frame"), F.col("event_type").alias("variable"), text.first_number(F.concat(F.lit("v="), F.replace(F.round("value", 2).cast("string"), F.lit("."), F.lit(",")), F.lit(" km"))).alias("value"), F.lit("km").alias("unit"), ((F.col("user_id") % 10) / 10).alias("confidence"), F.lit("r").alias("roi_id"), F.lit("ocr").alias("method"), F.lit("").alias("raw_text"))
    return r


def q_dictionary_csv(spark, sf):
    """The coverage export read as a dictionary again."""
    d = dictionary(spark, sf)
    rows = coverage.export_rows(coverage.coverage(events_frames(spark, sf), d).where("signal_name <> 'Kind'"), d)
    back = dictionaries.scan_export(rows.withColumns({"dict_name": F.lit("export"), "line": F.xxhash64("CAN ID", "Parameter")}))
    return back.select("frame_id", "start_bit", "length", "le", "scale", "offset", "type", "mux_start", "mux_bytes", "mux_value")


def q_group_map(spark, sf):
    """A group map derived from ``part``: several parameters per group, some with equal names."""
    p = table(spark, sf, "part")
    rows = p.select(
        (F.lit(0xF000) + F.col("p_partkey") % 200).cast("string").alias("PGN"), F.lit("3").alias("PGN Priority"), F.lit("8").alias("PGN Max Size"), (F.col("p_partkey") % 7).cast("string").alias("PGN Byte Offset"),
        F.lit("2").alias("Parameter Length (Bytes)"), F.col("p_name").alias("Description"), F.lit("0.125").alias("Scale/Resolution"), F.lit("0").alias("Offset"), F.lit("rpm").alias("Unit"),
        F.lit("parts").alias("dict_name"), F.col("p_partkey").alias("line"),
    )
    d = dictionaries.group_map(rows)
    return d.groupBy("pgn").agg(F.count("*").alias("signals"), F.count_distinct("signal_name").alias("names"), F.min("frame_id").alias("frame_id"), F.sum("start_bit").alias("start_bits"), F.max("scale").alias("scale"))


def q_overlaps(spark, sf):
    p = table(spark, sf, "part")
    d = p.select(F.concat(F.lit("m"), (F.col("p_partkey") % 200).cast("string")).alias("message_name"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("signal_name"), F.lit(None).cast("long").alias("mux_value"), ((F.col("p_partkey") * 5) % 48).cast("int").alias("start_bit"), F.lit(12).alias("length"))
    return decode.overlapping_signals(d)


def _series_out(rows):
    return rows.select("series_id", "seq", F.round("value", 6).alias("value"))


QUERIES = {
    "log_round_trip": q_log_round_trip, "spaced_lines": q_spaced_lines, "memorator_lines": q_memorator_lines,
    "records_source": lambda s, d: logs.frames_from_records(events_frames(s, d).select("seq", F.col("TS").alias("ts"), F.col("Bus").alias("bus"), F.col("id_int").alias("id"), F.unhex("DATA").alias("data")), "events"),
    "normalize_time": lambda s, d: logs.normalize_time(lineitem_frames(s, d).withColumn("log_id", F.col("ID"))).select("ID", "seq", "TS"),
    "merge_logs": lambda s, d: logs.merge_logs(events_frames(s, d), lineitem_frames(s, d)).groupBy("log_id").agg(F.count("*").alias("frames"), F.max("seq").alias("top")),
    "id_fields": q_id_fields, "bits": q_bits, "typed_reads": q_typed_reads, "texts": q_texts,
    "frame_summary": q_frame_summary, "frame_summary_large": q_frame_summary_large,
    "byte_changes": lambda s, d: summary.byte_changes(events_frames(s, d)).drop("log_id"),
    "byte_entropy": lambda s, d: summary.byte_entropy(events_frames(s, d)).drop("log_id"),
    "byte_update_period": lambda s, d: summary.byte_update_periods(events_frames(s, d)).drop("log_id"),
    "mux_cases": lambda s, d: summary.mux_cases(events_frames(s, d), [2]).drop("log_id"),
    "mux_rules": lambda s, d: summary.with_cases(f := events_frames(s, d), rules(s, f)).groupBy("ID", "LEN", "mux_label").agg(F.count("*").alias("frames")),
    "id_lengths": lambda s, d: summary.id_lengths(events_frames(s, d)).drop("log_id"),
    "changed_bytes": lambda s, d: summary.changed_bytes(events_frames(s, d), (2,)).select("seq", F.array_join("changed_bytes", ",").alias("changed")),
    "time_range": lambda s, d: summary.time_range(events_frames(s, d), (1704067200.0 + 86400, None), (None, 1704067200.0 + 20 * 86400)).select("seq"),
    "matrix": lambda s, d: summary.matrix(events_frames(s, d), 20).select("series_id", "seq", "value", "has_movement"),
    "range_diff": q_byte_diff,
    "id_diff": lambda s, d: diff.id_diff(h := halves(s, d), diff.byte_diff(h)).select("ID", "presence", "frames_a", "frames_b", "len_changed", "changed_bytes", F.round("score", 6).alias("score")),
    "diff_report": lambda s, d: diff.report_rows(diff.filter_bytes(diff.byte_diff(halves(s, d)))).drop("log_id"),
    "frame_density": lambda s, d: diff.density(events_frames(s, d), 50).select("bin", "frames"),
    "carry_hints": lambda s, d: diff.carry_hints(events_frames(s, d)).select("ID", "low", "high", "wraps", "carries", "is_16bit"),
    "groups_present": lambda s, d: transport.groups_present(events_frames(s, d)).drop("log_id"),
    "dictionary_listing": lambda s, d: decode.listing(dictionary(s, d)),
    "decode_all": q_decode_all, "coverage": q_coverage,
    "present_messages": lambda s, d: decode.present_messages(events_frames(s, d), dictionary(s, d, wider_ids)).select("message_name"),
    "absent_messages": lambda s, d: decode.present_messages(events_frames(s, d), dictionary(s, d, wider_ids), False).select("message_name"),
    "changed_signals": lambda s, d: decode.signals_of_bytes(diff.byte_diff(halves(s, d)).where("class <> 'unchanged'").withColumn("id_int", ids.hex_to_int("ID")), dictionary(s, d)),
    "dictionary_overlaps": q_overlaps, "group_map": q_group_map, "scan_export": q_dictionary_csv,
    "align_ffill": lambda s, d: series.align(kind_series(s, d), ["click", "purchase"]).select("TS", "click", "purchase"),
    "value_at_time": lambda s, d: _round(series.value_at(kind_series(s, d), probes(s, d)), "value").drop("log_id"),
    "nearest_sample": lambda s, d: series.nearest(kind_series(s, d), probes(s, d)).drop("log_id"),
    "window_stats": lambda s, d: _round(series.window_statistics(user_series(s, d), 1704067200.0 + 3 * 86400, 1704067200.0 + 9 * 86400), "average", "at_low", "at_high", "delta").drop("log_id"),
    "moving_average": lambda s, d: _series_out(series.moving_average(user_series(s, d), 5)),
    "median_filter": lambda s, d: _series_out(series.median_filter(user_series(s, d), 5)),
    "gaussian_filter": lambda s, d: _series_out(series.gaussian_filter(user_series(s, d), 1.0)),
    "savgol_filter": lambda s, d: _series_out(series.savgol_filter(user_series(s, d), 7, 2)),
    "ema_filter": lambda s, d: _series_out(series.ema(user_series(s, d), 0.2)),
    "stride_sample": lambda s, d: series.stride_sample(kind_series(s, d), 100).select("series_id", "seq"),
    "minmax_sample": lambda s, d: series.minmax_downsample(kind_series(s, d), 50).select("series_id", "seq", "value"),
    "spectrum": lambda s, d: series.spectrum(kind_series(s, d)),
    "bam_messages": q_bam_messages, "bam_bits": q_bam_bits, "bam_chunks": q_bam_chunks,
    "bam_groups": lambda s, d: transport.announced_groups(transport_frames(s, d)).groupBy("pgn").agg(F.count("*").alias("sources"), F.sum("announcements").alias("announcements")),
    "candidate_scan": q_candidates, "candidate_counts": q_candidate_counts, "candidate_floats": q_candidate_floats, "candidate_tags": q_candidate_tags, "candidate_clusters": q_clusters, "candidate_fragments": q_fragments, "value_search": q_value_search,
    "mux_prefix": lambda s, d: muxfind.prefixes(selector_first(s, d)).select("ID", "LEN", "prefix_len", "prefix", "support", F.round("ratio", 6).alias("ratio")),
    "mux_entropy": lambda s, d: muxfind.entropies(selector_first(s, d)).select("ID", "LEN", "prefix_len", "prefix", F.round("entropy", 6).alias("entropy"), F.round("stability", 6).alias("stability")),
    "mux_patterns": lambda s, d: muxfind.patterns(selector_first(s, d)).select("ID", "LEN", "prefix_len", "prefix", "support", "best_decode", F.round("decode_score", 6).alias("decode_score"), F.round("gain", 6).alias("gain"), F.round("semantic", 6).alias("semantic"), "recommended", "reason"),
    "mux_decodes": lambda s, d: muxfind.decode_candidates(selector_first(s, d)).select("ID", "LEN", "prefix_len", "prefix", "label", "n", "distinct_values", F.round("score", 6).alias("score"), "rank"),
    "derived_signal": q_derived, "derived_raw": q_derived_raw,
    "formula": lambda s, d: derive.formula(kind_series(s, d), ["click", "signup"], lambda c: numeric.divide(c["click"], c["signup"] - c["signup"])).select("TS", "value"),
    "readings_series": lambda s, d: readings.to_series(q_readings(s, d)).select("series_id", "seq", "value"),
    "readings_penalty": lambda s, d: readings.penalised(q_readings(s, d)).select("variable", "frame", "confidence"),
    "series_export": lambda s, d: sinks.series_columns(kind_series(s, d), ["click", "error"]).drop("log_id"),
}
