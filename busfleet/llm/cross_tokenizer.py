"""Cross-tokenizer alignment: which ids of two tokenizers share bytes, and in how many documents.

Both tokenizers cut the same bytes, so the alignment follows from the ends of their tokens: ends that both
have cut a text into groups, and between two neighbouring ends of either lies one link. Documents are
encoded once and their ids stored. The first pass aligns them and keeps, by task, in how many documents
each linked pair of ids occurs. A minimal perfect hash over the distinct pairs, built shard by shard in
Spark, gives each pair its place in a dense vector; the tasks' counts go into such vectors, which are
summed as a tree. The second pass aligns the documents again and looks each link up: the hash gives the
place, the key stored there is compared, and the count is read.

Pairs are taken in blocks of at most BLOCK_PAIRS, so what is broadcast is bounded whatever the corpus
holds; each further block costs one more pass over the stored ids, and no pair is left out.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from busfleet.llm import byte_bpe
from busfleet.llm._text import mix, pieces, release, stored, utf8

#: Pairs that one broadcast holds (16 bytes and 4 bits each), pairs of a shard, places of a dense vector's segment.
BLOCK_PAIRS, SHARD_PAIRS, SEGMENT = 1 << 22, 1 << 18, 1 << 16
#: Partial sums that one task adds up.
FAN = 16
#: Pairs that a task counts before it hands them on, and those that it gathers before it counts them.
HELD_PAIRS, GATHERED = 1 << 20, 1 << 21

_SALTS = [np.uint64(x | 1) for x in np.random.default_rng(29).integers(1, 2**63, 64, dtype=np.uint64)]
_PRIME = 1_000_003
_loaded = {}


# tokenizers


def byte_level():
    """The characters that stand for bytes in a byte-level vocabulary, as a map to the bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in [*zip(plain, plain), *zip(range(256, 512), rest)]}


class First:
    """The byte-level tokenizer of a JSON file: ``ids(text)`` of the text as it is, ``tokens`` the bytes by id.

    Where the ids follow the order of the merges, ranks say the same as merges, and the faster library
    encodes; else, or with settings that this does not know, the file's own library does.
    """

    def __init__(self, path, pattern):
        spec = json.load(open(path, encoding="utf-8"))
        vocabulary, back = spec["model"]["vocab"], byte_level()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.tokens = [b""] * size
        for token, number in vocabulary.items():
            self.tokens[number] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        own = spec["pre_tokenizer"] or {}
        by_rank = [vocabulary[a + b] for a, b in merges] == list(range(256, 256 + len(merges))) and len(vocabulary) == 256 + len(merges)
        if by_rank and spec["normalizer"] is None and own.get("type") == "ByteLevel" and own["use_regex"] and not own["add_prefix_space"]:
            import tiktoken

            ranks = {self.tokens[i]: i for i in vocabulary.values()}
            encoder = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.ids = lambda text: byte_bpe.encode(text, encoder)
            self.joined = encoder.decode_bytes
        else:
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(path)
            encoder.encode_special_tokens = True
            self.ids = lambda text: encoder.encode(text, add_special_tokens=False).ids
            self.joined = lambda ids: b"".join(map(self.tokens.__getitem__, ids))


class Second:
    """The piece tokenizer of a model file; it puts a blank before a text itself."""

    def __init__(self, path):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        self.kind = np.dtype("<u2" if len(names) <= 65536 else "<u4")

    def packed(self, texts):
        """The ids of each text as bytes; None if they do not spell a blank and the text."""
        return [
            np.array(ids, self.kind).tobytes() if b"".join(map(self.tokens.__getitem__, ids)) == b" " + text.encode() else None
            for text, ids in zip(texts, self.model.encode(texts, num_threads=1))
        ]


def loaded(first, second, pattern):
    """Both tokenizers, once in each Python worker."""
    key = (first, second, pattern)
    if key not in _loaded:
        _loaded[key] = First(first, pattern), Second(second)
    return _loaded[key]


# alignment


class Alignment:
    """The links and groups of some documents, given as ids, places of documents in them, and lengths by id.

    a, b: ids of each link's ends, doc: its document; by document n_a, n_b, n_groups, n_links.
    """

    def __init__(self, ids_a, at_a, ids_b, at_b, long_a, long_b):
        self.ids, self.at, n = (ids_a, ids_b), (at_a, at_b), len(at_a) - 1
        ends_a, ends_b = np.cumsum(long_a[ids_a]), np.cumsum(long_b[ids_b])
        mark = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] |= 2
        ends = np.flatnonzero(mark)
        kind = mark[ends]
        self.is_a, self.is_b, self.both = kind & 1 > 0, kind & 2 > 0, kind == 3
        self.up_a, self.up_b, self.up = np.cumsum(self.is_a), np.cumsum(self.is_b), np.cumsum(self.both)
        self.a, self.b = ids_a[self.up_a - self.is_a], ids_b[self.up_b - self.is_b]
        self.n_a, self.n_b = np.diff(at_a), np.diff(at_b)
        # links up to the end of each document: the place of its last token's end
        last = np.flatnonzero(self.is_a)
        self.cut = np.r_[0, last + 1][at_a]
        self.n_links = np.diff(self.cut)
        self.n_groups = np.diff(np.r_[0, self.up][self.cut])
        self.doc = np.repeat(np.arange(n), self.n_links)

    def keys(self):
        """A number for each link's pair of ids, which are below 2**24."""
        return self.a.astype(np.int64) << 24 | self.b.astype(np.int64)

    def pairs(self):
        """The keys of each document's distinct pairs."""
        both = np.sort(self.doc << 48 | self.keys())
        return both[np.r_[True, both[1:] != both[:-1]][: len(both)]] & ((1 << 48) - 1)

    def texts(self, numerals, sizes):
        """The groups of each document in decimal, as bytes: ``a1,a2|b1;a3|b2,b3``."""
        ids_a, ids_b = self.ids
        group_a, group_b = (self.up - self.both)[self.is_a], (self.up - self.both)[self.is_b]
        first_b, past_a = np.r_[0, self.up_b[self.both]], self.up_a[self.both]
        cells, long = np.zeros(len(ids_a) + len(ids_b), "<u8"), np.zeros(len(ids_a) + len(ids_b), np.int64)
        for ids, place, last, mark in ((ids_a, first_b[group_a], self.is_a, "|"), (ids_b, past_a[group_b], self.is_b, ";")):
            place += np.arange(len(ids))
            cells[place] = np.where(self.both[last], numerals[mark][ids], numerals[","][ids])
            long[place] = sizes[ids] + 1
        flat = cells.view(np.uint8)
        flat = flat[flat != 0].tobytes()
        cut = np.r_[0, np.cumsum(long)][self.at[0] + self.at[1]]
        return [flat[s : max(s, e - 1)] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]


def decimals(n):
    """(numerals, sizes): by mark, the numbers below n in decimal with the mark behind, eight bytes as an integer; their digits."""
    text = np.arange(n).astype("S8")
    sizes = (text.view(np.uint8).reshape(n, 8) != 0).sum(1)
    return {mark: text.view("<u8") | np.uint64(ord(mark)) << (8 * sizes).astype(np.uint64) for mark in ",|;"}, sizes


def tallied(keys, counts=None):
    """Distinct keys and the sums of their counts (of ones, if not given)."""
    order = None if counts is None else np.argsort(keys)
    keys = np.sort(keys) if counts is None else keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    if counts is None:
        return keys[first], np.diff(np.r_[first, len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


# minimal perfect hashing


def hashed(keys, level):
    return mix(keys.astype(np.uint64) * _SALTS[2 * level] + _SALTS[2 * level + 1])


def build(keys):
    """A minimal perfect hash of distinct keys: levels of bits, twice as many as the keys that are left.

    A key whose bit no other key of its level has is placed there; the others go on. Its number is the
    number of bits set before its own, so the numbers are those from 0 to len(keys) - 1.
    """
    levels, left = [], np.asarray(keys, np.int64)
    while len(left):
        size = max(64, 2 * len(left))
        place = (hashed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[place]]
        if len(levels) == 32:
            raise ValueError("keys repeat")
    return levels


class Hash:
    """Numbers of keys by the levels of ``build``; -1 for one that ends nowhere. Others may get any number."""

    def __init__(self, levels):
        self.levels, self.before = levels, []
        start = 0
        for bits in levels:
            self.before.append(start + np.cumsum(bits, dtype=np.int32) - 1)
            start += int(bits.sum())

    def __call__(self, keys):
        out, left, at = np.full(len(keys), -1, np.int64), np.asarray(keys, np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            place = (hashed(left, level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[at[hit]] = before[place[hit]]
            left, at = left[~hit], at[~hit]
        return out


class Block:
    """The hashes of some shards, as broadcast: places of pairs, the keys at the places, later their counts."""

    def __init__(self, rows, shards, first):
        self.shards, self.first, self.packed, self.counts = shards, first, [], None
        keys = []
        for row in sorted(rows, key=lambda r: r["shard"]):
            self.packed.append((row["sizes"], bytes(row["bits"])))
            keys.append(np.frombuffer(row["keys"], "<i8"))
        self.starts = np.r_[0, np.cumsum([len(k) for k in keys])]
        self.keys, self.hashes = np.concatenate(keys), None

    def __getstate__(self):
        return {**self.__dict__, "hashes": None}

    def find(self, keys):
        """The place of each key, -1 for keys of other blocks; the key at the place is compared."""
        if self.hashes is None:
            self.hashes = []
            for sizes, bits in self.packed:
                flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                self.hashes.append(Hash([flat[e - s : e] for s, e in zip(sizes, np.cumsum(sizes))]))
        out = np.full(len(keys), -1, np.int64)
        shard = keys % _PRIME % self.shards - self.first
        for k, hash_ in enumerate(self.hashes):
            mine = np.flatnonzero(shard == k)
            place = hash_(keys[mine])
            fine = place >= 0
            place += self.starts[k]
            fine &= self.keys[np.where(fine, place, 0)] == keys[mine]
            if not fine.all():
                raise ValueError("a pair that the first pass has not seen: the stored documents changed")
            out[mine] = place
        return out


# passes


def encoded(docs, first, second, pattern, text="text", id="doc_id"):
    """The stored ids: rows with part 0 (doc_id, a, b: packed ids) and with part 1 (keys, counts of a task).

    Texts without tokens have empty a and b. counts: documents of the task in which the pair is linked.
    """
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
    names = ["doc_id", "a", "b", "keys", "counts", "part"]

    def batch(ids, a, b, keys, counts, part):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((ids, a, b, keys, counts, [part] * len(ids)), kinds)], names)

    def run(batches):
        one, two = loaded(first, second, pattern)
        long_a, long_b = (np.array(list(map(len, t.tokens)), np.int64) for t in (one, two))
        kind_a = np.dtype("<u2" if len(one.tokens) <= 65536 else "<u4")
        keys = counts = np.zeros(0, np.int64)
        gathered, size = [], 0
        for whole in batches:
            for part in pieces(whole, "text", most=1_000_000):
                packed_a, packed_b = [], []
                texts = part.column("text").to_pylist()
                for text, b in zip(texts, two.packed(texts)):
                    ids = one.ids(" " + text) if text else []
                    fine = text and b is not None and one.joined(ids) == (" " + text).encode()
                    packed_a.append(np.array(ids, kind_a).tobytes() if fine else b"")
                    packed_b.append(b if fine else b"")
                yield batch(part.column("doc_id").to_pylist(), packed_a, packed_b, [None] * len(packed_a), [None] * len(packed_a), 0)
                found = _aligned(packed_a, packed_b, kind_a, two.kind, long_a, long_b)
                gathered.append(found.pairs())
                size += len(gathered[-1])
                if size > GATHERED:
                    more, n = tallied(np.concatenate(gathered))
                    keys, counts = tallied(np.r_[keys, more], np.r_[counts, n])
                    gathered, size = [], 0
                if len(keys) > HELD_PAIRS:
                    yield batch([None], [None], [None], [keys], [counts], 1)
                    keys = counts = np.zeros(0, np.int64)
        if gathered:
            more, n = tallied(np.concatenate(gathered))
            keys, counts = tallied(np.r_[keys, more], np.r_[counts, n])
        if len(keys):
            yield batch([None], [None], [None], [keys], [counts], 1)

    rows = docs.mapInArrow(run, "doc_id long, a binary, b binary, keys array<long>, counts array<long>, part int")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _aligned(packed_a, packed_b, kind_a, kind_b, long_a, long_b):
    at_a = np.r_[0, np.cumsum([len(x) for x in packed_a])] // kind_a.itemsize
    at_b = np.r_[0, np.cumsum([len(x) for x in packed_b])] // kind_b.itemsize
    ids_a, ids_b = np.frombuffer(b"".join(packed_a), kind_a), np.frombuffer(b"".join(packed_b), kind_b)
    return Alignment(ids_a, at_a, ids_b, at_b, long_a, long_b)


def hash_shards(partials):
    """(rows, shards): for each shard of the distinct pairs its hash and keys, in a stored table."""
    pairs = stored(partials.select(F.explode("keys").alias("key")).distinct(), "pairs")
    shards = max(1, -(-pairs.count() // SHARD_PAIRS))

    def run(table):
        keys = np.sort(table.column("key").to_numpy())
        levels = build(keys)
        ordered = np.zeros(len(keys), "<i8")
        ordered[Hash(levels)(keys)] = keys
        bits = np.packbits(np.concatenate(levels)).tobytes()
        return pa.table({
            "shard": pa.array([int(keys[0]) % _PRIME % shards], pa.int64()), "n": pa.array([len(keys)], pa.int64()),
            "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary()),
        })

    rows = pairs.withColumn("shard", F.expr(f"key % {_PRIME} % {shards}")).groupBy("shard").applyInArrow(run, "shard long, n long, sizes array<long>, bits binary, keys binary")
    return stored(rows, "hash"), shards


def blocks(rows, shards):
    """The blocks of neighbouring shards with at most BLOCK_PAIRS pairs (one shard at least), one after another."""
    sizes, first = {r.shard: r.n for r in rows.select("shard", "n").collect()}, 0  # a row for each shard
    while first < shards:
        last, total = first, sizes.get(first, 0)
        while last + 1 < shards and total + sizes.get(last + 1, 0) <= BLOCK_PAIRS:
            last, total = last + 1, total + sizes.get(last + 1, 0)
        found = rows.where(F.col("shard").between(first, last)).collect()
        if found:
            held = {r["shard"] for r in found}
            empty = {"sizes": [], "bits": b"", "keys": b""}
            yield Block(found + [{"shard": s, **empty} for s in range(first, last + 1) if s not in held], shards, first)
        first = last + 1


def dense_sums(partials, block):
    """The dense vector of a block's counts: each task's own, cut into segments, summed FAN by FAN."""
    spark = partials.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def scatter(batches):
        from pyspark import TaskContext

        total = np.zeros(len(sent.value.keys), np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                place = sent.value.find(keys.values.to_numpy())
                np.add.at(total, place[place >= 0], counts.values.to_numpy()[place >= 0])
        number = TaskContext.get().partitionId()
        for k, start in enumerate(range(0, len(total), SEGMENT)):
            if (part := total[start : start + SEGMENT]).any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int64()), "leaf": pa.array([number], pa.int64()), "v": pa.array([part], pa.list_(pa.int64()))})

    def add(table):
        total = np.sum([v.values.to_numpy() for v in table.column("v")], axis=0)
        return pa.table({"segment": table.column("segment").slice(0, 1), "leaf": pa.array([table.column("leaf")[0].as_py() // FAN], pa.int64()), "v": pa.array([total], pa.list_(pa.int64()))})

    schema = "segment long, leaf long, v array<long>"
    vectors = stored(partials.select("keys", "counts").mapInArrow(scatter, schema), "vectors")
    while vectors.agg(F.max("leaf")).first()[0]:
        # a group has at most FAN segments of bounded length
        vectors = stored(vectors.groupBy("segment", F.expr(f"leaf div {FAN}").alias("up")).applyInArrow(add, schema), "vectors")
    sent.destroy()
    return vectors


def vector(segments, n):
    """The whole dense vector of a block."""
    out = np.zeros(n, np.int64)
    for row in segments.toLocalIterator():
        out[row.segment * SEGMENT : row.segment * SEGMENT + len(row.v)] = row.v
    return out


def looked_up(rows, block, best, files, whole):
    """The second pass: row, n_best and count_sum of a block's pairs; if ``whole`` also what needs no counts."""
    sent = rows.sparkSession.sparkContext.broadcast((block, best))

    def run(batches):
        one, two = loaded(*files)
        long_a, long_b = (np.array(list(map(len, t.tokens)), np.int64) for t in (one, two))
        kind_a = np.dtype("<u2" if len(one.tokens) <= 65536 else "<u4")
        digits = decimals(max(len(one.tokens), len(two.tokens)))
        block, best = sent.value
        for batch in batches:
            for part in pieces(batch, "a", most=600_000):
                found = _aligned(part.column("a").to_pylist(), part.column("b").to_pylist(), kind_a, two.kind, long_a, long_b)
                n, count, top = part.num_rows, np.zeros(len(found.a), np.int64), np.zeros(len(found.a), bool)
                if block is not None and len(count):
                    place = block.find(found.keys())
                    mine = place >= 0
                    count[mine] = block.counts[place[mine]]
                    top = mine & (count == best[found.a])
                sums = [np.diff(np.r_[0, np.cumsum(v)][found.cut]) for v in (top, count)]
                columns = {"row": part.column("row"), "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
                if whole:
                    texts = [hashlib.sha256(t).hexdigest() if t else "" for t in found.texts(*digits)]
                    columns |= {"doc_id": part.column("doc_id"), **{c: pa.array(getattr(found, c), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups_sha256": pa.array(texts, pa.string())}
                assert n == len(found.n_a)
                yield pa.RecordBatch.from_pydict(columns)
            release()

    schema = "row long, n_best long, count_sum long" + (", doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" if whole else "")
    return rows.mapInArrow(run, schema)


def aligned(docs, first, second, pattern, text="text", id="doc_id"):
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    first, second: files of the two tokenizers; pattern: the first one's. Texts that are null or empty, or
    that a tokenizer does not give back byte for byte, have no tokens: zeros, and an empty groups_sha256.
    Rows are documents, also where they repeat; other columns play no part; an empty table gives no rows.
    """
    files = (first, second, pattern)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    table = encoded(docs, *files, text=text, id=id)
    rows, partials = table.where("part = 0").select("row", "doc_id", "a", "b"), table.where("part = 1").select("keys", "counts")
    hashes, shards = hash_shards(partials)
    best, sums = np.zeros(0, np.int64), []
    for block in blocks(hashes, shards):
        sums.append(dense_sums(partials, block))
        ids = block.keys >> 24
        best = np.r_[best, np.zeros(max(0, int(ids.max()) + 1 - len(best)), np.int64)]
        np.maximum.at(best, ids, vector(sums[-1], len(ids)))
    out = []
    for number, block in enumerate(blocks(hashes, shards)):
        block.counts = vector(sums[number], len(block.keys))
        found = looked_up(rows, block, best, files, whole=not number)
        out.append(found if len(sums) == 1 else stored(found, "looked-up"))
    if not out:
        out = [looked_up(rows, None, best, files, whole=True)]
    if len(out) > 1:
        more = out[1]
        for part in out[2:]:
            more = more.unionByName(part)
        more = more.groupBy("row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
        out = [out[0].join(more, "row").withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})]
    return out[0].select("doc_id", *names, "groups_sha256")
