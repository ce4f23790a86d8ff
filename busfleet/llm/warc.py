"""WARC archives: a writer with revisit records and a sequential reader.

An archive is a file of gzip members, one for each record. The reader takes each archive as a stream in
one task: it inflates member after member by small chunks, frames the record by its Content-Length and
verifies its digests; at no time does it hold more than one record. Archives lie in the shared folder and
are opened through pyarrow's file systems, so that local, HDFS and object-store folders serve alike.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from busfleet.llm._text import shared_dir

#: Archives are closed once they hold this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
_CRLF = b"\r\n"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload):
    """Base32 SHA-1 in upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(kind, fields, block):
    """One gzip member: the version line, the fields, the block and the closing line ends."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    lines += [f"{k}: {v}".encode() for k, v in fields if v is not None]
    lines += [b"WARC-Block-Digest: sha1:" + digest(block).encode(), b"Content-Length: " + str(len(block)).encode()]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(_CRLF.join(lines) + _CRLF * 2 + block + _CRLF * 2) + deflate.flush()


def _line(text):
    """A value that cannot end its header line."""
    return None if text is None else " ".join(text.split())


def page_record(page_id, url, payload, full_digest, refers_to):
    """The response record of a page, or a revisit of ``refers_to``, whose block ends with the headers."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + _CRLF * 2
    fields = [
        ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _line(url)),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{full_digest}"),
    ]
    if refers_to is None:
        return record("response", fields, head + payload)
    return record("revisit", [*fields, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _SAME)], head)


def with_revisits(pages, least_bytes=0, payload="html", id="page_id", url="url"):
    """page_id, url, payload (bytes; null: empty), sha1 and refers_to of each row.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the least page_id are
    responses and the others revisit it; smaller payloads are all responses. A row without an id is a
    revisit where its group has an id, else a response. Groups are told apart by SHA-1 and SHA-256, and
    found by an aggregation that combines before its shuffle; AQE splits the join of a hot payload.
    """
    rows = pages.select(
        F.col(id).cast("long").alias("page_id"), (F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")).alias("url"),
        F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "sha256": F.unhex(F.sha2("payload", 256))})
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1", "sha256").agg(F.min("page_id").alias("first"))
    joined = rows.join(first, ["sha1", "sha256"], "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(rows, folder, archive_bytes=ARCHIVE_BYTES):
    """Writes the rows of ``with_revisits`` to archives below ``folder``; returns the archive paths as a table.

    Each task writes files with names of its own; only those of tasks that ended are listed, so files
    left by a lost or repeated task are never read.
    """
    paths = f"{folder}/archives"

    def run(batches):
        files, path = _open(paths)
        files.create_dir(path)
        done, out, size = [], None, 0
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    for r in batch.slice(start, 64).to_pylist():
                        if out is None or size >= archive_bytes:
                            if out is not None:
                                out.close()
                            done.append(f"{uuid.uuid4().hex}.warc.gz")
                            out, size = files.open_output_stream(f"{path}/{done[-1]}", compression=None), 0
                            out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                        data = page_record(r["page_id"], r["url"], r["payload"], base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["refers_to"])
                        out.write(data)
                        size += len(data)
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{paths}/{name}" for name in done], pa.string())], ["path"])

    listed = f"{folder}/listed"
    rows.mapInArrow(run, "path string").write.parquet(listed)
    return rows.sparkSession.read.schema("path string").parquet(listed)


class Members:
    """The records of one archive in turn: the bytes of each gzip member, inflated by chunks."""

    def __init__(self, stream):
        self.stream, self.rest, self.inflate, self.data = stream, b"", None, bytearray()

    def more(self):
        """Inflates one chunk of the present member; False at its end."""
        if self.inflate.eof:
            return False
        got = self.rest or self.stream.read(CHUNK)
        if not got:
            raise ValueError("the archive ends within a gzip member")
        self.data += self.inflate.decompress(got, 1 << 20)
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def __iter__(self):
        while True:
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
            if not self.rest:
                return
            self.inflate, self.data = zlib.decompressobj(31), bytearray()
            yield self._record()

    def _record(self):
        while (end := self.data.find(_CRLF * 2)) < 0:
            if not self.more():
                raise ValueError("a record has no end of its header")
        version, *lines = bytes(self.data[:end]).split(_CRLF)
        if not version.startswith(b"WARC/"):
            raise ValueError("a record has no version line")
        fields = {}
        for line in lines:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        length, start = int(fields["content-length"]), end + 4
        while len(self.data) < start + length + 4 and self.more():
            pass
        while self.more():
            pass
        if bytes(self.data[start + length :]) != _CRLF * 2:
            raise ValueError("a record's length differs from its Content-Length")
        return fields, bytes(self.data[start : start + length])


def _sha(value):
    return (value or "").removeprefix("sha1:")


def parse(fields, block):
    """The row of a response or revisit record; the digests are verified, a mismatch is an error."""
    if "warc-block-digest" in fields and _sha(fields["warc-block-digest"]) != digest(block):
        raise ValueError(f"block digest of {fields.get('warc-record-id')} differs")
    head, _, body = block.partition(_CRLF * 2)
    length = next((int(h.partition(b":")[2]) for h in head.split(_CRLF) if h.lower().startswith(b"content-length:")), len(body))
    kind = fields["warc-type"]
    if kind == "response" and (len(body) != length or _sha(fields.get("warc-payload-digest")) not in ("", digest(body))):
        raise ValueError(f"payload of {fields.get('warc-record-id')} differs")
    page = lambda key: None if (v := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")) in ("", "None") else int(v)
    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": length,
        "payload_digest": _sha(fields.get("warc-payload-digest")), "refers_to": page("warc-refers-to"), "payload": body if kind == "response" else None,
    }


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_DDL = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "payload": "binary"}


def read_archives(paths, columns=tuple(_FIELDS)):
    """The response and revisit records of a table of archive paths; other records are passed over.

    Columns: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for
    revisits). An archive is one task's work, read in order; a broken member, length or digest fails.
    """
    spark = paths.sparkSession
    names = list(columns)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = _open(path)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as stream:
                    for fields, block in Members(stream):
                        if fields["warc-type"] in ("response", "revisit"):
                            rows.append(parse(fields, block))
                            size += len(block)
                        if size > 4_000_000 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _FIELDS[c]) for c in names], names)
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _FIELDS[c]) for c in names], names)

    spread = paths.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(run, ", ".join(f"{c} {_DDL[c]}" for c in names))


def round_trip(pages, least_bytes=0):
    """Writes all pages to archives in the shared folder and returns their records, without payloads.

    page_id, payload_bytes, payload_digest, record_type, refers_to and url, one row per page; null html
    is an empty payload, repeated rows have a record each, an empty table gives no rows.
    """
    paths = write_archives(with_revisits(pages, least_bytes), shared_dir(pages.sparkSession, "warc"))
    return read_archives(paths, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"))
