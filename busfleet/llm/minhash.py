"""MinHash near-dedup: fast similarity sketches, banding and exact verification.

A text's set holds its distinct word shingles. Its sketch has t coordinates filled by rounds: in round
i < t each element falls into one bin with value i + hash, in round t + j all fall into bin j; a bin
keeps its least value and the rounds end once every bin is filled, so no coordinate stays empty and
agreement of two sketches is concentrated about their similarity. Bands of r coordinates bring together
texts that may be similar; links are confirmed on the full sets.

Components, not pairs, are the aim, so a bucket costs no pairs of its members. Texts with the same words in
the same order, told by SHA-256, are one class from the start. Each member is first compared with the bucket's least member alone; whatever the links
found so far have joined needs no further comparison. Buckets that still hold several components compare
the members outside the main one with another of its members (ROUNDS times). What is left outside the
main component then is compared with the whole bucket, in blocks of bounded size within a task.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from busfleet.llm._components import components
from busfleet.llm._text import Bytes, mix, pieces, stored, utf8

_EMPTY = np.uint64(2**64 - 1)
_ODD = [np.uint64(x | 1) for x in np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64)]
#: Members of a bucket on either side of one task's full comparison; larger buckets take several tasks.
BLOCK = 256
#: Rounds in which a bucket's members outside its main component meet one member of that, picked anew.
ROUNDS = 1


def shingle_sets(data, at, k):
    """Sorted distinct (row << 52 | hash) keys of the k-word shingles of at most 4096 texts.

    A text of fewer than k words gives its whole sequence as the one shingle; without words, none.
    """
    text = Bytes(data, at)
    if not len(text.starts):
        return np.zeros(0, np.uint64)
    words, doc = text.words(), text.doc
    keys, m = [], len(words) - k + 1
    if m > 0:
        h = words[:m] * _ODD[0]
        for j in range(1, k):
            h += words[j : m + j] * _ODD[j]
        inside = doc[:m] == doc[k - 1 :]
        keys.append(doc[:m][inside].astype(np.uint64) << np.uint64(52) | mix(h[inside]) >> np.uint64(12))
    n = np.bincount(doc, minlength=text.n)
    short = np.flatnonzero((n < k)[doc])
    if len(short):
        first = np.flatnonzero(np.r_[True, doc[short][1:] != doc[short][:-1]])
        place = np.arange(len(short)) - np.repeat(first, np.diff(np.r_[first, len(short)]))
        odd = np.array(_ODD[k : 2 * k])[place]
        h = np.add.reduceat(words[short] * odd, first) + n[doc[short][first]].astype(np.uint64) * _ODD[-1]
        keys.append(doc[short][first].astype(np.uint64) << np.uint64(52) | mix(h) >> np.uint64(12))
    return np.unique(np.concatenate(keys))


def sketch(values, doc, n, t):
    """The (n, t) fast similarity sketches of n sets; rows of empty sets stay unfilled."""
    out = np.full((n, t), _EMPTY)
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values * _ODD[40] + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64))
        place = doc * t + (((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)).astype(np.int64) if i < t else doc * t + (i - t)
        h &= np.uint64((1 << 40) - 1)
        h |= np.uint64(i << 40)
        np.minimum.at(flat, place, h)
        live = np.unique(doc)
        unfilled = np.zeros(n, bool)
        unfilled[live] = (out[live] == _EMPTY).any(1)
        on = unfilled[doc]
        if not on.all():
            values, doc = values[on], doc[on]
    return out


def banding(percent, rows=6, miss=1e-5):
    """(bands, rows) such that a pair at the threshold misses every band with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)), rows


def band_keys(coordinates, bands, rows):
    """(n, bands) hashes of each band's coordinates and its number."""
    n = len(coordinates)
    parts = coordinates.reshape(n, bands, rows)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[50], (n, 1))
    for j in range(rows):
        h = mix((h ^ parts[:, :, j]) * _ODD[51 + j])
    return h


def sketches(docs, k, percent, text="text", id="doc_id"):
    """doc_id, n (size of the set), words (SHA-256 of the words in order), keys (of the bands; null if empty)."""
    bands, rows = banding(percent)
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "__text"):
                keys = shingle_sets(*utf8(part.column("__text")), k)
                doc, values, n = (keys >> np.uint64(52)).astype(np.int64), keys & np.uint64(2**52 - 1), part.num_rows
                size = np.bincount(doc, minlength=n)
                full = np.flatnonzero(size)
                digests = [hashlib.sha256(b" ".join(t.encode().lower().split())).digest() for t in part.column("__text").to_pylist()]
                found = band_keys(sketch(values, doc, n, bands * rows)[full], bands, rows).view(np.int64)
                sizes = np.where(size > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(digests, pa.binary()), lists], ["doc_id", "n", "words", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, words binary, keys array<long>")


def _packed(docs, text, id):
    """(cid, z): texts, compressed, for shuffles that move them again."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([zlib.compress(t.encode(), 1) for t in part.column("text").to_pylist()], pa.binary())], ["cid", "z"])

    return docs.select(F.col(id).cast("long").alias("cid"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "cid long, z binary")


def _sets(texts, k):
    """The sorted shingle sets of compressed texts."""
    out = []
    for start in range(0, len(texts), 64):
        raw = [zlib.decompress(z) for z in texts[start : start + 64]]
        keys = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64), k)
        cut = np.searchsorted(keys >> np.uint64(52), np.arange(len(raw) + 1, dtype=np.uint64))
        out += [keys[cut[i] : cut[i + 1]] & np.uint64(2**52 - 1) for i in range(len(raw))]
    return out


def _linked(common, a, b, percent):
    return 100 * common >= percent * (a + b - common)


def _verified_stars(pairs, k, percent):
    """Of (cid, z, leader, leader_z) rows, the (a, b) links confirmed on the full sets."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, leaders = part.column("cid").to_pylist(), part.column("leader").to_pylist()
                own = _sets(part.column("z").to_pylist(), k)
                distinct = dict(zip(leaders, part.column("leader_z").to_pylist()))
                theirs = dict(zip(distinct, _sets(list(distinct.values()), k)))
                ok = [_linked(len(np.intersect1d(s, theirs[x], assume_unique=True)), len(s), len(theirs[x]), percent) for s, x in zip(own, leaders)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, y in zip(ids, ok) if y], pa.int64()), pa.array([x for x, y in zip(leaders, ok) if y], pa.int64())], ["a", "b"])

    return pairs.select("cid", "z", "leader", "leader_z").mapInArrow(run, "a long, b long")


def common_sizes(xs, ys, most_cells=4_000_000):
    """The matrix of intersection sizes of some sets with others."""
    sets = xs + ys
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    place, owner = number[place[keep]], owner[keep]
    total, width = np.zeros((len(xs), len(ys))), max(1, most_cells // len(sets))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, (start, start + width))
        cells = np.zeros((len(sets), width), np.float32)
        cells[owner[a:b], place[a:b] - start] = 1
        total += cells[: len(xs)] @ cells[len(xs) :].T
    return total


def forest(xs, ys):
    """The places of the links (x, y) that join what was not yet joined by those before."""
    root, keep = {}, []

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for i, (x, y) in enumerate(zip(xs, ys)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def _compared_blocks(units, k, percent):
    """Links between different components from the x rows to the y rows of each unit: as few as join what all links join."""

    def run(table):
        ids, comps, x = (table.column(c).to_numpy() for c in ("cid", "comp", "x"))
        sets = _sets(table.column("z").to_pylist(), k)
        px, py = np.flatnonzero(x), np.flatnonzero(~x)
        xs, ys = [sets[i] for i in px], [sets[i] for i in py]
        nx, ny = (np.array([len(s) for s in side]) for side in (xs, ys))
        common = common_sizes(xs, ys) if xs and ys else np.zeros((len(xs), len(ys)))
        a, b = np.nonzero(_linked(common, nx[:, None], ny[None, :], percent) & (comps[px][:, None] != comps[py][None, :]))
        keep = forest(comps[px[a]].tolist(), comps[py[b]].tolist())
        return pa.table({"a": pa.array(ids[px[a]][keep], pa.int64()), "b": pa.array(ids[py[b]][keep], pa.int64())})

    return units.select("key", "i", "j", "x", "cid", "comp", "z").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _with_leader(pairs, texts):
    """(cid, leader) pairs with both texts. The merge join lets AQE split what meets a frequent leader."""
    theirs = texts.select(F.col("cid").alias("leader"), F.col("z").alias("leader_z"))
    return pairs.join(texts.hint("merge"), "cid").join(theirs.hint("merge"), "leader")


def _mixed(members, label):
    """Of (key, cid) rows, those of buckets with several components: key, cid, comp, main, m, outside.

    main is the component with most members in the bucket, outside the number of members not in it.
    """
    placed = members.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("m"), F.count("*").alias("k")).where("k > 1")
    return placed.join(main.select("key", F.col("x.comp").alias("main"), "m", (F.col("m") - F.col("x.c")).alias("outside")), "key")


def _units(mixed):
    """The rows of each unit of comparison: members outside the main component (x) and all members."""
    count = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("cid"), count(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    x = mixed.where("comp <> main").select("key", part("outside").alias("i"), every("m").alias("j"), F.lit(True).alias("x"), "cid", "comp")
    y = mixed.select("key", every("outside").alias("i"), part("m").alias("j"), F.lit(False).alias("x"), "cid", "comp")
    return x.unionByName(y)


def near_duplicates(docs, k=5, percent=80, text="text", id="doc_id"):
    """Per row: doc_id, n_shingles, component_id, kept; linked where 100 * common >= percent * union.

    component_id is the least id reachable by links; kept marks it. Null and empty texts have an empty
    set and are linked with nothing. Texts of the same words in the same order are linked as they are, all
    others by comparing their full sets. Rows that repeat an id
    are one document to the links. A row without an id links nothing and is kept. Other columns are
    left out. An empty table gives no rows.
    """
    rows = stored(sketches(docs, k, percent, text, id), "sketches")
    sets = rows.where("n > 0 and doc_id is not null")
    classes = sets.groupBy("words").agg(F.min(F.struct("doc_id", "keys")).alias("x")).select("words", F.col("x.doc_id").alias("cid"), F.col("x.keys").alias("keys"))
    bands = classes.select("cid", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("leader"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("mark")).where("m > 1")
    # both sides of the join are plain shuffles of tables, so AQE can split a key that many members share
    members = stored(bands.join(stored(buckets, "buckets"), "key"), "members")
    needed = members.select(F.col("cid").alias("__cid")).distinct()
    found = docs.select(F.col(id).cast("long").alias("__cid"), F.col(text).alias("__text")).join(needed.hint("merge"), "__cid")
    texts = stored(_packed(found, "__text", "__cid").groupBy("cid").agg(F.min("z").alias("z")), "texts")

    stars = members.where("cid <> leader").select("cid", "leader").distinct()
    label = stored(components(stored(_verified_stars(_with_leader(stars, texts), k, percent), "links")), "label")
    joined_by = lambda links: stored(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "label")

    # buckets with a pair left that may join two components; of buckets with the same members, one
    once = members.where("m > 2").groupBy("m", "mark", "leader").agg(F.min("key").alias("key")).select("key")
    mixed = stored(_mixed(members.where("m > 2").select("key", "cid").join(once, "key"), label), "mixed")
    for number in range(ROUNDS):
        if mixed.isEmpty():
            break
        pick = mixed.where("comp = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("cid", "key", F.lit(number)), "cid")).alias("x")).select("key", F.col("x.cid").alias("leader"))
        again = mixed.where("comp <> main").select("key", "cid").join(pick, "key").select("cid", "leader").distinct()
        label = joined_by(stored(_verified_stars(_with_leader(again, texts), k, percent), "links"))
        mixed = stored(_mixed(mixed.select("key", "cid"), label), "mixed")
    more = stored(_compared_blocks(_units(mixed).join(texts.hint("merge"), "cid"), k, percent), "links")
    if not more.isEmpty():
        label = joined_by(more)

    named = classes.select("words", "cid").join(label.withColumnRenamed("node", "cid"), "cid", "left").select("words", F.coalesce("component", "cid").alias("component"))
    joined = sets.select("doc_id", "n", "words").join(named, "words").select("doc_id", "n", F.col("component").alias("component_id"))
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs, k=5, percent=80, text="text", id="doc_id"):
    """The rows of ``docs``, with all columns: of each component the one with the least id stays."""
    kept = near_duplicates(docs, k, percent, text, id).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(kept, docs[id].cast("long").eqNullSafe(kept["__keep"]), "left_semi")
