"""Derived signals: sources, transforms, combination and user formulas, as column chains on aligned series.

A configuration is a dict: branches, a list of {source, transforms}; ops, the names that combine branches
from left to right ('add' where absent); output, transforms of the result.

Sources: {'kind': 'signal', 'series_id'}; {'kind': 'raw', signal fields as in decode.decode_signal};
{'kind': 'bam', 'pgn', 'start_bit', 'length' up to 64, optional 'le' (else big-endian), 'type' (also float64), 'scale',
'offset', 'mux_start', 'mux_bytes', 'mux_value', 'source' (an address)}; {'kind': 'chunks', 'pgn', 'size', 'first', 'offset', 'dtype'}; {'kind': 'read', 'pgn',
'offset', 'dtype'}.
"""

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from busfleet.functions.bits import BYTES, float32, float64, packed_le, signed, unsigned_double
from busfleet.functions.ids import pgn_of
from busfleet.functions.numeric import COMBINE, transform
from busfleet.operators.decode import decode_signal
from busfleet.operators.series import align
from busfleet.operators.transport import chunks, long_raw, read_field, selector_value

COLUMNS = ["log_id", "series_id", "TS", "seq", "value"]


def source(config, name, frames=None, series=None, messages=None):
    """The series of a source under a name."""
    kind = config["kind"]
    if kind == "signal":
        return series.where(F.col("series_id") == config["series_id"]).withColumn("series_id", F.lit(name)).select(COLUMNS)
    if kind == "raw":
        return decode_signal(frames, {**config, "signal_name": name})
    rows = messages.where(F.col("pgn") == config["pgn"])
    if config.get("source") is not None:
        rows = rows.where(F.col("sa") == config["source"])
    if kind == "bam":
        if config.get("mux_bytes"):
            rows = rows.where(selector_value("data", config["mux_start"], config["mux_bytes"]) == config["mux_value"])
        field = {"__start": F.lit(config["start_bit"]), "__length": F.lit(config["length"]), "__le": F.lit(config.get("le", True))}
        raw, length = F.col("__raw"), config["length"]
        number = {"float32": float32(raw), "float64": float64(raw), "int": signed(raw, length).cast("double"), "uint": unsigned_double(raw)}[config.get("type", "uint")]
        rows = rows.withColumns(field).withColumn("__raw", long_raw("data", "__start", "__length", "__le"))
        rows = rows.withColumn("value", number * float(config.get("scale", 1.0)) + float(config.get("offset", 0.0))).where("value is not null").withColumn("seq", F.lit(0).cast("long"))
    elif kind == "chunks":
        rows = read_field(chunks(rows, config["size"], config.get("first", 0)), config.get("offset", 0), config["dtype"], "record").withColumn("seq", F.col("chunk").cast("long"))
    else:
        rows = read_field(rows, config["offset"], config["dtype"]).withColumn("seq", F.lit(0).cast("long"))
    return rows.withColumn("series_id", F.lit(name)).select(COLUMNS)


def derive(config, name="derived", frames=None, series=None, messages=None):
    """The series of a configuration: branches are transformed, aligned, combined and transformed again.

    Points before a branch's first sample have no value and are left out when branches are combined.
    """
    branches = config["branches"]
    ops = config.get("ops") or ["add"] * (len(branches) - 1)
    if len(ops) != len(branches) - 1:
        raise ValueError(f"{len(branches)} branches need {len(branches) - 1} operations, not {len(ops)}")
    parts = []
    for i, b in enumerate(branches):
        value = reduce(transform, b.get("transforms", ()), F.col("value"))
        parts.append(source(b["source"], f"b{i}", frames, series, messages).withColumn("value", value))
    if len(parts) == 1:
        rows = parts[0]
    else:
        names = [f"b{i}" for i in range(len(parts))]
        wide = align(reduce(lambda a, b: a.unionByName(b), parts), names)
        value = F.col("b0")
        for op, n in zip(ops, names[1:]):
            value = COMBINE[op](value, F.col(n))
        rows = wide.where(" and ".join(f"{n} is not null" for n in names)).select("log_id", "TS", F.lit(0).cast("long").alias("seq"), value.alias("value"))
    return rows.select("log_id", F.lit(name).alias("series_id"), "TS", "seq", reduce(transform, config.get("output", ()), F.col("value")).alias("value"))


def formula(series, names, function, name="formula", sources=None, frames=None, messages=None):
    """A user's row-wise formula on aligned series: function(dict of columns) -> column; rows without a value go.

    ``sources`` adds columns of other kinds, fields of raw frames or of transport messages, as name -> source.
    """
    parts = [series.where(F.col("series_id").isin(list(names))).select(COLUMNS)] if names else []
    parts += [source(config, n, frames, series, messages) for n, config in (sources or {}).items()]
    every = [*names, *(sources or {})]
    wide = align(reduce(lambda a, b: a.unionByName(b), parts), every)
    value = function({n: F.col(n) for n in every})
    return wide.select("log_id", F.lit(name).alias("series_id"), "TS", F.lit(0).cast("long").alias("seq"), value.cast("double").alias("value")).where("value is not null")


class Payloads(Sequence):
    """Payloads of messages, read one by one where they lie in the Arrow column, so that they are not copied whole."""

    def __init__(self, column, rows):
        self._column, self._rows = column, rows

    def __len__(self):
        return len(self._rows)

    def __getitem__(self, at):
        return Payloads(self._column, self._rows[at]) if isinstance(at, slice) else self._column[int(self._rows[at])].as_py()


class Inputs(dict):
    """What a grouped formula gets: series by name as (ts, values) arrays, raw frames and transport messages.

    ``reads``: what the formula may ask for, if this was said; all else is an error.
    """

    def __init__(self, samples, frames, data=None, reads=None):
        own = samples.loc[samples["series_id"].notna(), ["series_id", "TS", "seq", "value"]]
        # only what is asked for is brought in order, so that frames and payloads are not copied whole
        ordered = ((n, g.sort_values(["TS", "seq"])) for n, g in own.groupby("series_id"))
        super().__init__({n: (g["TS"].to_numpy(), g["value"].to_numpy()) for n, g in ordered})
        self._samples, self._frames, self._data, self._reads = samples, frames, data, reads

    def _ask(self, kind, name):
        if self._reads is not None and name not in self._reads.get(kind, ()):
            raise KeyError(f"{name!r} is not among the {kind} that the formula reads")

    def get(self, name, default=None):
        self._ask("series", name)
        return super().get(name, default)

    def signal(self, name):
        """A series; an error that names those there are, if it is missing."""
        self._ask("series", name)
        if name not in self:
            raise KeyError(f"no series {name!r} here; there are {sorted(self)}")
        return self[name]

    def raw_frames(self, id=None, pgn=None):
        """(ts, bytes of n frames as an (n, 8) array, their lengths) of an id or a group."""
        self._ask(*(("ids", id) if id is not None else ("groups", pgn)))
        f = self._frames
        f = f[(f["id_int"] == id) if id is not None else (f["pgn"] == pgn)].sort_values(["TS", "seq"])
        data = np.ascontiguousarray(f["w"].to_numpy(np.int64)).astype("<i8").view(np.uint8).reshape(-1, 8)
        return f["TS"].to_numpy(), data.astype(np.int32), f["LEN"].to_numpy(np.int32)

    def messages(self, pgn, source=None):
        """(ts, payloads) of the transport messages of a group, of one source if given."""
        self._ask("messages", pgn)
        m = self._samples
        rows = np.flatnonzero(m["series_id"].isna() & (m["pgn"] == pgn) & ((m["sa"] == source) if source is not None else True))
        rows = rows[np.lexsort((m["seq"].to_numpy()[rows], m["TS"].to_numpy()[rows]))]
        return m["TS"].to_numpy()[rows], Payloads(self._data, rows)


def formula_grouped(series, function, name="formula", frames=None, messages=None, stretch=None, lead=0.0, reads=None):
    """A user's formula on whole arrays: function(Inputs) -> (ts, values).

    It sees a log's series and, if given, its frames and transport messages. With ``stretch`` it runs for
    each so many seconds of a log, in tasks of their own, on what lies there and ``lead`` seconds before;
    its results within the stretch count. A formula that looks back no further gives the same as on the
    whole log. Without it, a log is one task. Results of unequal lengths or other shapes fail.

    ``reads`` says what the formula asks for: a dict of lists, series (names), ids and groups (of raw frames) and
    messages (groups). Only that is sent to its task; to ask for anything else is an error. Stretches in which there is nothing of it have
    no results.
    """
    spark = series.sparkSession
    part = F.floor(F.col("TS") / stretch).cast("long") if stretch else F.lit(0).cast("long")
    reach = F.floor((F.col("TS") + lead) / stretch).cast("long") if stretch else part
    cut = lambda rows: rows.withColumn("part", F.explode(F.sequence(part, reach)))
    samples = series.select(*COLUMNS, F.lit(None).cast("long").alias("pgn"), F.lit(None).cast("int").alias("sa"), F.lit(None).cast("binary").alias("data"))
    if messages is not None:
        samples = samples.unionByName(messages.select("log_id", F.lit(None).cast("string").alias("series_id"), "TS", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("value"), F.col("pgn").cast("long").alias("pgn"), F.col("sa").cast("int").alias("sa"), "data"))
    if frames is None:
        frames = spark.createDataFrame([], "log_id string, TS double, seq long, id_int long, LEN int, " + ", ".join(f"{c} int" for c in BYTES))
    # a frame's bytes go as one word, which the inputs take apart for the frames asked for
    raw = frames.select("log_id", "TS", "seq", "id_int", pgn_of("id_int").cast("int").alias("pgn"), F.col("LEN").cast("byte").alias("LEN"), packed_le().alias("w"))
    if reads is not None:
        asked = lambda column, kind: F.col(column).isin(list(reads.get(kind, ())))
        samples = samples.where(asked("series_id", "series") | (F.col("series_id").isNull() & asked("pgn", "messages")))
        raw = raw.where(asked("id_int", "ids") | asked("pgn", "groups"))

    def run(key, samples, raw):
        columns = samples.drop_columns(["log_id", "part", "data"]), raw.drop_columns(["log_id", "part"])
        given = Inputs(*(t.to_pandas(split_blocks=True) for t in columns), samples["data"], reads)
        ts, values = (np.asarray(x, dtype=float) for x in function(given))
        if ts.ndim != 1 or ts.shape != values.shape:
            raise ValueError(f"a formula must return two arrays of one length, not {ts.shape} and {values.shape}")
        if stretch:
            own = np.floor(ts / stretch) == key[1].as_py()
            ts, values = ts[own], values[own]
        texts = lambda x: pa.array([x] * len(ts), pa.string())
        # a value that is NaN is a missing one, as it was from pandas
        return pa.table({"log_id": texts(key[0].as_py()), "series_id": texts(name), "TS": pa.array(ts, from_pandas=True), "seq": np.arange(len(ts)), "value": pa.array(values, from_pandas=True)})

    grouped = cut(samples).groupBy("log_id", "part").cogroup(cut(raw).groupBy("log_id", "part"))
    return grouped.applyInArrow(run, "log_id string, series_id string, TS double, seq long, value double")
