"""Shared helpers: the shared folder, and whole texts as numpy byte arrays.

Texts reach a task as Arrow batches. ``pieces`` cuts a batch into runs of whole rows of a few MB, so
that a task's memory does not follow the batch size, and gives freed memory back after each batch, as
workers are reused by later stages; ``Bytes`` gives the words of such a run without a Python object for
each word. A null text is an empty text everywhere.
"""

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All bytes but letters, digits and those of characters beyond ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_STEP = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd and 5 mod 8: its powers repeat late
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}
_own = {}  # folders of applications without a shared one


def shared_dir(spark, name):
    """A new folder below the cluster's shared checkpoint folder; one in /tmp only for a local master without one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors and the driver share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _own[app] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df, name, *partition_by):
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows, *order):
    """The rows with ``pos``, their number from 0 in this order: a sorted table and the sizes of its partitions."""
    rows = stored(rows.orderBy(*order).withColumn("mid", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("part", F.shiftright("mid", 33))
    starts, total = [], 0
    for part, n in sorted(rows.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition of the sort
        starts.append((part, total))
        total += n
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, before long"))
    return rows.join(before, "part").withColumn("pos", F.col("before") + F.expr(f"mid & {(1 << 33) - 1}L")).drop("mid", "part", "before")


def located(docs, *columns):
    """``docs`` if its rows have a file of their own; else these columns of it (of a join or of rows in memory, say), stored."""
    try:
        docs.select(F.input_file_name())
        own = bool(docs.inputFiles())
    except AnalysisException:
        own = False
    return docs if own else stored(docs.select(*columns), "input")


def plus(schema, ddl):
    """A schema with further columns given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def utf8(column):
    """Bytes and offsets (int64) of a string or binary Arrow array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def pieces(batch, column="text", most=2_000_000, rows=4000):
    """The batch in runs of whole rows with about ``most`` bytes of text each; a longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    _, at = utf8(batch.column(column))
    start = 0
    while start < n:
        end = int(np.searchsorted(at, at[start] + most, "right")) - 1
        end = min(max(end, start + 1), start + rows, n)
        yield batch.slice(start, end - start)
        start = end
    release()


def release():
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def kept():
    """From now on freed memory below 32 MB stays with the process, as loops over numpy arrays ask for it again at once."""
    try:
        for option, size in ((-3, 32 << 20), (-1, 128 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            ctypes.CDLL(None).mallopt(option, size)
    except (AttributeError, OSError):
        pass


def mix(x):
    """A 64-bit finaliser; x is changed in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n):
    """The first n powers of the hash step and of its inverse, modulo 2**64; those of long texts are not kept."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
        if size > 1 << 21:
            return _powers.pop("up")[:n], _powers.pop("down")[:n]
    return _powers["up"][:n], _powers["down"][:n]


class Bytes:
    """The bytes of some whole texts, their words and hashes of any stretch.

    Words are the runs of bytes that ``split`` does not mark: ``[^\\x20\\x09-\\x0D]+`` by default.
    starts, ends: byte range of each word; doc: its row. hashed(a, b): 64-bit hashes of the byte ranges.
    """

    def __init__(self, data, offsets, lower=True, split=SPACE):
        self.data = LOWER[data] if lower else data
        self.offsets, self.n, self._sum = offsets, len(offsets) - 1, None
        if not len(data):
            self.starts = self.ends = self.doc = np.zeros(0, np.int64)
            return
        word = ~split[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1

    def hashed(self, a, b):
        up, down = powers(len(self.data) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:-1], out=self._sum[1:])
        out = (self._sum[b] - self._sum[a]) * down[a]
        out += (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(out)

    def words(self):
        """A hash of each word."""
        return self.hashed(self.starts, self.ends)
