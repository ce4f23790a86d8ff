"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from busfleet.llm._text import pieces, plus

#: Texts longer than this many characters are encoded in pieces cut at safe boundaries.
PIECE_CHARS = 1 << 16

_encodings = {}


def encoding(rank_file, pattern):
    """The tiktoken encoding of a rank file, built once in each Python worker. It has no special tokens."""
    key = (rank_file, pattern)
    if key not in _encodings:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


#: White space of the pattern.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Some characters that are surely letters, and some that are surely neither letters nor white space, the apostrophe aside.
_LETTERS, _OTHERS = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3", "!-&(-@\\[-`{-~\u3001\u3002\u300c-\u300f\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_SAFE = re.compile(f"(?<=[^{_SPACES}])(?=[{_SPACES}])|(?<=[{_LETTERS}])(?=[{_OTHERS}])")


#: The pattern that the cuts are derived from; with others a long text is encoded as one.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def safe_pieces(text, most=PIECE_CHARS):
    """Cuts a text where no match of CUT_PATTERN can run over: before white space, and between letters and other marks.

    White space opens a match or lies in a run of white space; a cut before the whole run leaves that run,
    and the look-ahead after it, as they are. A run of letters is one match as far as it goes, whatever
    follows. A stretch without such a place, such as one endless word, stays whole.
    """
    start, n = 0, len(text)
    while n - start > most:
        found = _SAFE.search(text, start + most)
        at = found.start() if found else n
        if at >= n:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encode(text, enc, most=PIECE_CHARS):
    """Ids of a whole text; special-token strings count as plain text."""
    if len(text) <= most or enc._pat_str != CUT_PATTERN:
        return enc.encode_ordinary(text)
    ids = []
    for piece in safe_pieces(text, most):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_documents(docs, rank_file, pattern, text="text", id="doc_id", keep=()):
    """Each row with ``n_tokens`` (long) and ``ids`` (array of int), in the order of the text.

    A null text is empty and gives no ids; repeated rows are encoded each; further columns named in
    ``keep`` pass through, others are left out, whatever their names.
    """
    docs = docs.select(*dict.fromkeys([id, *keep]), F.col(text).alias("__text"))
    names = [c for c in docs.columns if c != "__text"]
    schema = plus(docs.select(*names).schema, "n_tokens long, ids array<int>")

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in pieces(batch, "__text", rows=256):
                ids = [encode(t or "", enc) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [*names, "n_tokens", "ids"])

    return docs.mapInArrow(run, schema)


def decode_documents(encoded, rank_file, pattern, ids="ids", keep=("doc_id",)):
    """Each row with ``data`` (binary): the bytes that the ids stand for. Null ids give empty bytes.

    The bytes of an id need not be whole characters, so decoding never goes through text.
    """
    encoded = encoded.select(*keep, F.col(ids).alias("__ids"))
    names = list(keep)
    schema = plus(encoded.select(*names).schema, "data binary")

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                data = [enc.decode_bytes(x or []) for x in part.column("__ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(data, pa.binary())], [*names, "data"])

    return encoded.mapInArrow(run, schema)


def encode_digests(docs, rank_file, pattern, text="text", id="doc_id"):
    """Per row: id, n_tokens, ids_sha256 (of decimal ids joined by one blank), decoded_sha256.

    The ids go through the same ``encode`` and the library's raw-byte decoder; only their digests leave
    the task, so the ids of a corpus are not moved to be hashed.
    """
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("__text"))
    schema = plus(docs.select("doc_id").schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        enc = encoding(rank_file, pattern)
        decimal = [str(i) for i in range(enc.n_vocab)].__getitem__
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for part in pieces(batch, "__text", rows=256):
                sizes, digests, decoded = [], [], []
                for t in part.column("__text").to_pylist():
                    ids = encode(t or "", enc)
                    sizes.append(len(ids))
                    digests.append(sha(" ".join(map(decimal, ids)).encode()))
                    decoded.append(sha(enc.decode_bytes(ids)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, schema)
