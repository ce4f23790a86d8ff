"""Suffix-array dedup: removes each byte of a string of 100 bytes that also starts earlier.

Spark deals the work by content, in three steps.

1. Anchors. Of the 32-byte substrings within each 100-byte window, the one with the least hash is the
   window's anchor; windows side by side mostly share it. Equal windows have equal anchors at equal
   places, so windows whose anchor's hash occurs once in the corpus are unique and are left out.
2. Sparse suffix arrays. The stretches around repeated anchors meet by the anchor's hash. Their suffixes
   from the anchor on, and their reversed prefixes before it, are sorted by deep-shallow sorting:
   multikey sorting on 8-byte symbols to a shallow depth, then blind tries for the groups whose common
   prefix is longer. From both orders and their longest common prefixes follow, for each distance from
   window start to anchor, the classes of equal windows; all but a class's first are covered.
3. Removal. The covered intervals meet the texts again.

Equal stretches are combined within a task, so a passage costs one stretch per task however often it
occurs. Around it stretches differ; anchors of so many stretches that a task could not hold them (a set
bounded by 1/HOT_SHARE of all anchors, hence of bounded size) are split further: their windows meet by a
digest of their bytes. What meets is sorted by the same deep-shallow sorting of the bytes themselves; equal
neighbours in that order, byte for byte, are the classes. Digests only choose the task.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from busfleet.llm._text import _BYTE, mix, pieces, powers, stored, utf8

LENGTH, GRAM = 100, 32
SPREAD = LENGTH - GRAM + 1
#: An anchor is hot with this many occurrences, or this share of all, whichever is more.
HOT_LEAST, HOT_SHARE = 1000, 1e-6
_POSITION = np.uint64((1 << 22) - 1)
_SEGMENT = 3_000_000
_SHALLOW = 64


def _runs_within(data, mask):
    n = len(data) - GRAM + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    h = total[GRAM:] - total[:-GRAM]
    h *= down[:n]
    mix(h)
    least = (h & ~_POSITION) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPREAD - width)], least[SPREAD - width :])
    p = np.flatnonzero(mask[: len(least)])
    a = (least[p] & _POSITION).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(p)] - 1
    return p[first], p[last], a[first], h[a[first]]


def runs(data, at):
    """Windows of LENGTH bytes in some texts, by anchor: (first start, last start, anchor, its hash) arrays."""
    mask = np.ones(len(data), bool)
    for end, start in zip(at[1:].tolist(), at[:-1].tolist()):
        mask[max(start, end - LENGTH + 1) : end] = False
    out = []
    for start in range(0, len(data), _SEGMENT):
        part = data[start : start + _SEGMENT + LENGTH - 1]
        if len(part) >= LENGTH:
            lo, hi, a, h = _runs_within(part, mask[start : start + _SEGMENT + LENGTH - 1])
            out.append((lo + start, hi + start, a + start, h))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]


def _pack(*arrays):
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob, *kinds, tail=False):
    """Arrays of equal length, of the given kinds; with tail also the bytes behind them."""
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], size, codec="zstd", asbytes=True)
    n, at = (int.from_bytes(raw[:8], "little") if tail else size // sum(np.dtype(k).itemsize for k in kinds)), 8 * tail
    out = []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return [*out, raw[at:]] if tail else out


def _dealt(rid, values, buckets):
    """(bucket, blob) rows that bring values (int64, one or more for each entry) to their documents' buckets."""
    bucket = (mix(rid.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return [(b, _pack(rid[i], values[i])) for b, i in _by_bucket(bucket, np.lexsort((rid, bucket)))]


def _by_bucket(bucket, order):
    """(bucket, its places in order) of each bucket that occurs; ``order`` sorts by bucket."""
    if not len(order):
        return
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for i, part in zip(first, np.split(order, first[1:])):
        yield int(bucket[order[i]]), part


def _regrouped(batches, width):
    """(document, its values in bytes) from the blobs of a partition: one row for each document."""
    rids, values = [], []
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            flat = _unpack(blob, np.int64)[0]
            n = len(flat) // (1 + width)
            rids.append(flat[:n])
            values.append(flat[n:].reshape(n, width))
    if rids:
        rid, value = np.concatenate(rids), np.concatenate(values)
        order = np.argsort(rid, kind="stable")
        rid, value = rid[order], value[order]
        first = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]])
        for i in range(0, len(first), 5000):
            part = np.r_[first[i : i + 5000], first[i + 5000] if i + 5000 < len(first) else len(rid)]
            own = np.ascontiguousarray(value[part[0] : part[-1]])
            offsets = ((part - part[0]) * 8 * width).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(rid[part[:-1]]), column], ["rid", "blob"])


def _batch(ddl_names, *columns):
    return pa.RecordBatch.from_arrays(list(columns), ddl_names)


def _anchor_blobs(batches, buckets):
    """Rows (bucket, kind, blob): of each hash in a task its first anchor votes (0); the rest is repeated (1)."""
    held, size = [], 0

    def flush():
        h, rid, a = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, rid, a = h[order], rid[order], a[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[first, len(h)])
        rest = np.ones(len(h), bool)
        rest[first] = False
        h1, rid1, a1 = h[first], rid[first], a[first]
        bucket = (h1 % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((a1, rid1, bucket))
        rows = [(b, 0, _pack(h1[i], rid1[i], a1[i], count[i].astype(np.int32))) for b, i in _by_bucket(bucket, order)]
        if rest.any():
            rid2, a2 = rid[rest], a[rest]
            order = np.lexsort((a2, rid2))
            rows += [(int(i) % buckets, 1, _pack(rid2[k], a2[k])) for i, k in enumerate(np.array_split(order, max(1, len(order) // 20000)))]
        held.clear()
        return _batch(["bucket", "kind", "blob"], *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))))

    for batch in batches:
        for part in pieces(batch):
            data, at = utf8(part.column("text"))
            lo, _, a, h = runs(data, at)
            doc = np.searchsorted(at, lo, "right") - 1
            held.append((h, part.column("rid").to_numpy()[doc], a - at[doc]))
            size += len(h)
            if size > 3_000_000:
                yield flush()
                size = 0
    if size:
        yield flush()


def _repeated(batches, buckets, hot_from):
    """Rows (kind, bucket, blob): 0 anchors whose hash occurs again, dealt by document; 2 hashes of hot anchors."""
    held, rids, places = [], [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
            if kind == 0:
                held.append(_unpack(blob, np.uint64, np.int64, np.int64, np.int32))
            else:
                rid, a = _unpack(blob, np.int64, np.int64)
                rids.append(rid)
                places.append(a)
    rows = []
    if held:
        h, rid, a, count = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        total = np.add.reduceat(count[order].astype(np.int64), first)
        again = order[np.repeat(total > 1, np.diff(np.r_[first, len(h)]))]
        rids.append(rid[again])
        places.append(a[again])
        hot = h[first][total >= hot_from].view(np.int64)
        rows += [(2, 0, _pack(hot))] if len(hot) else []
    if rids:
        rows += [(0, *r) for r in _dealt(np.concatenate(rids), np.concatenate(places), buckets)]
    yield _batch(["kind", "bucket", "blob"], *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.int32(), pa.binary()))))


def _stretches(batches, buckets, hot):
    """Rows (bucket, kind, blob): 0 stretches around repeated anchors, 1 covered intervals, 2 windows of hot anchors."""
    held, size = [], 0

    def flush():
        held.sort(key=lambda x: (x[1], x[2]))
        seen, keep, covered = {}, [], []
        windows = {}
        for h, rid, lo, off, seg in held:
            if h in hot:
                for i in range(len(seg) - LENGTH + 1):
                    w = seg[i : i + LENGTH]
                    if w in windows:
                        covered.append((rid, lo + i, lo + i + LENGTH))
                    else:
                        windows[w] = (rid, lo + i)
            elif (off, seg) in seen:
                covered.append((rid, lo, lo + len(seg)))
            else:
                seen[off, seg] = None
                keep.append((h % buckets, h, rid, lo, off, seg))
        held.clear()
        rows = []
        keep.sort(key=lambda x: x[0])
        cut = np.searchsorted(np.array([x[0] for x in keep], np.int64), np.arange(buckets + 1)) if keep else np.zeros(buckets + 1, int)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = keep[cut[b] : cut[b + 1]]
            if own:
                _, h, rid, lo, off, seg = zip(*own)
                rows.append((b, 0, _pack(np.array([len(own)], np.int64), np.array(h, np.uint64), np.array(rid, np.int64), np.array(lo, np.int64), np.array(off, np.int32), np.array([*map(len, seg)], np.int32), np.frombuffer(b"".join(seg), np.uint8))))
        if windows:
            sums = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in windows), np.uint64)
            texts = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, LENGTH)
            places = np.array(list(windows.values()), np.int64)
            bucket = (sums % np.uint64(buckets)).astype(np.int64)
            rows += [(b, 2, _pack(np.array([len(i)], np.int64), places[i, 0], places[i, 1], texts[i])) for b, i in _by_bucket(bucket, np.argsort(bucket, kind="stable"))]
        if covered:
            c = np.array(covered, np.int64)
            rows += [(i % buckets, 1, _pack(part)) for i, part in enumerate(np.array_split(c, max(1, len(c) // 20000)))]
        return _batch(["bucket", "kind", "blob"], *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.int32(), pa.binary()))))

    for batch in batches:
        for part in pieces(batch):
            data, at = utf8(part.column("text"))
            lo, hi, a, h = runs(data, at)
            mark = np.zeros(len(data), bool)
            for start, places in zip(at.tolist(), part.column("anchors").to_pylist()):
                mark[start + np.frombuffer(places, np.int64)] = True
            on = mark[a]
            lo, hi, a, h = lo[on], hi[on], a[on], h[on]
            doc = np.searchsorted(at, lo, "right") - 1
            raw = data.tobytes()
            rid = part.column("rid").to_numpy()[doc]
            held += [(x, r, s - f, m - s, raw[s : e + LENGTH]) for x, r, s, e, m, f in zip(h.tolist(), rid.tolist(), lo.tolist(), hi.tolist(), a.tolist(), at[doc].tolist())]
            if len(held) > 200_000:
                yield flush()
    if held:
        yield flush()


class BlindTrie:
    """A trie of the branching bytes only: a string goes down by them unseen, then is compared once."""

    def __init__(self, string, name):
        self.root = [len(string), {}, string, [name]]  # depth, children, a string of the subtree, names that end here

    def add(self, string, name):
        node, n = self.root, len(string)
        while node[0] < n and node[1] and (child := node[1].get(string[node[0]])):
            node = child
        other = node[2]
        most = min(n, len(other))
        differ = int.from_bytes(string[:most], "big") ^ int.from_bytes(other[:most], "big")
        common = most - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] < common:
            above, node = node, node[1][string[node[0]]]
        if node[0] == common and common == n:
            node[3].append(name)
            return
        if node[0] > common:  # a branch within the edge to the node
            fork = [common, {node[2][common]: node}, node[2], []]
            if above:
                above[1][string[above[0]]] = fork
            else:
                self.root = fork
            node = fork
        if common == n:
            node[3].append(name)
        else:
            node[1][string[common]] = [n, {}, string, [name]]

    def names(self):
        """Names in the order of their strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            out += node[3]
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(matrix, group):
    """Order of the rows of a byte matrix within their groups (sorted ints), rows padded by 0.

    Multikey sorting on symbols of 8 bytes up to the shallow depth; blind tries order what is left.
    """
    n, width = matrix.shape
    order, rank = np.arange(n), group.copy()
    for start in range(0, min(_SHALLOW, width), 8):
        same = np.zeros(n, bool)
        r = rank[order]
        same[1:] |= r[1:] == r[:-1]
        same[:-1] |= r[1:] == r[:-1]
        at = np.flatnonzero(same)
        if not len(at):
            break
        rows = order[at]
        symbol = np.zeros((len(rows), 8), np.uint8)
        symbol[:, : min(8, width - start)] = matrix[rows, start : start + 8]
        symbol = symbol.view(">u8").reshape(-1).astype(np.uint64)
        by = np.lexsort((symbol, rank[rows]))
        rows, symbol = rows[by], symbol[by]
        order[at] = rows
        r = rank[rows]
        new = np.r_[True, (r[1:] != r[:-1]) | (symbol[1:] != symbol[:-1])]
        rank[rows] = at[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))] + len(group) * 2
    r = rank[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if n else np.zeros(0, int)
    for i, j in zip(first, np.r_[first[1:], n]):
        if j - i > 1 and width > _SHALLOW:
            rows = order[i:j]
            tails = [matrix[k, _SHALLOW:].tobytes() for k in rows]
            trie = BlindTrie(tails[0], rows[0])
            for k, tail in zip(rows[1:], tails[1:]):
                trie.add(tail, k)
            order[i:j] = trie.names()
    return order


def _common(matrix, order, group):
    """Of each row but the first in order: bytes in common with the row before it; -1 across groups."""
    out = np.full(len(order), -1)
    for start in range(1, len(order), 20000):
        i, j = order[start - 1 : start + 19999], order[start : start + 20000]
        i = i[: len(j)]
        differ = (matrix[i] != matrix[j]) | (matrix[i] == 0)
        found = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
        out[start : start + len(j)] = np.where(group[i] == group[j], found, -1)
    return out


def covered_windows(h, off, segs):
    """(member, distance) of windows that an earlier member has too; members in order of place.

    A member is a stretch with its anchor ``off`` bytes from its start; its windows start ``distance``
    bytes before the anchor. h: sorted groups are formed by it.
    """
    _, group = np.unique(h, return_inverse=True)
    sizes = np.array([*map(len, segs)])
    low = off - (sizes - LENGTH)
    flat = np.frombuffer(b"".join(segs), np.uint8)
    start = np.cumsum(sizes) - sizes
    reach = np.arange(LENGTH)

    def table(first, step, count, width):
        at = first[:, None] + step * reach[None, :width]
        return np.where(reach[None, :width] < count[:, None], flat[np.clip(at, 0, len(flat) - 1)] + 1, 0).astype(np.uint8)

    by_group = np.argsort(group, kind="stable")

    def ranked(matrix):
        order = by_group[deep_shallow_order(matrix[by_group], group[by_group])]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank, _common(matrix, order, group)

    right, right_common = ranked(table(start + off, 1, sizes - off, LENGTH))
    left, left_common = ranked(table(start + off - 1, -1, off, int(off.max(initial=0)) or 1))
    for s in range(int(off.max(initial=-1)) + 1):
        own = np.flatnonzero((low <= s) & (s <= off))
        if len(own) < 2:
            continue
        a, b = np.cumsum(right_common < LENGTH - s)[right[own]], np.cumsum(left_common < s)[left[own]]
        _, first, which = np.unique(a * np.int64(len(h) + 1) + b, return_index=True, return_inverse=True)
        later = np.flatnonzero(first[which] != np.arange(len(own)))
        if len(later):
            yield own[later], np.full(len(later), s)


def repeats(matrix, rid, place):
    """Of some windows, rows of a byte matrix, those equal to one with a smaller (rid, place); ties keep the first."""
    order = deep_shallow_order(matrix, np.zeros(len(matrix), np.int64))
    new = np.ones(len(order), bool)
    for start in range(1, len(order), 100_000):
        i, j = order[start - 1 : start + 99_999], order[start : start + 100_000]
        new[start : start + len(j)] = (matrix[i[: len(j)]] != matrix[j]).any(1)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new)
    by = np.lexsort((place, rid, kind))
    return by[np.r_[False, kind[by][1:] == kind[by][:-1]]] if len(by) else by


def _covered(batches, buckets):
    """Rows (bucket, blob) of covered intervals, dealt by document, from what meets in a partition."""
    held, windows, rids, spans = [], [], [], []

    def out(rid, span):
        rids.append(rid)
        spans.append(span)

    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
            if kind == 1:
                c = _unpack(blob, np.int64)[0].reshape(-1, 3)
                out(c[:, 0], c[:, 1:])
            elif kind == 2:
                windows.append(_unpack(blob, np.int64, np.int64, tail=True))
            else:
                h, rid, lo, off, size, raw = _unpack(blob, np.uint64, np.int64, np.int64, np.int32, np.int32, tail=True)
                end = np.cumsum(size).tolist()
                held += zip(h.tolist(), rid.tolist(), lo.tolist(), off.tolist(), [raw[b - n : b] for b, n in zip(end, size.tolist())])
    if windows:
        rid, p = (np.concatenate([w[k] for w in windows]) for k in (0, 1))
        matrix = np.frombuffer(b"".join(w[2] for w in windows), np.uint8).reshape(-1, LENGTH)
        windows.clear()
        again = repeats(matrix, rid, p)
        out(rid[again], np.stack([p[again], p[again] + LENGTH], 1))
    held.sort(key=lambda x: (x[1], x[2]))
    seen, count, keep, whole = set(), {}, [], []
    for x in held:
        if (x[3], x[4]) in seen:
            whole.append((x[1], x[2], x[2] + len(x[4])))
        else:
            seen.add((x[3], x[4]))
            keep.append(x)
            count[x[0]] = count.get(x[0], 0) + 1
    del held, seen
    if whole:
        c = np.array(whole, np.int64)
        out(c[:, 0], c[:, 1:])
    keep = [x for x in keep if count[x[0]] > 1]
    if keep:
        h, rid, lo, off, segs = zip(*keep)
        rid, lo, off = np.array(rid, np.int64), np.array(lo, np.int64), np.array(off, np.int64)
        found = list(covered_windows(np.array(h, np.uint64), off, segs))
        if found:
            member, s = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((-s, member))
            member, s = member[order], s[order]
            new = np.r_[True, (member[1:] != member[:-1]) | (s[1:] != s[:-1] - 1)]
            first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(s)] - 1
            m = member[first]
            begin = lo[m] + off[m]
            out(rid[m], np.stack([begin - s[first], begin - s[last] + LENGTH], 1))
    rows = _dealt(np.concatenate(rids), np.concatenate(spans), buckets) if rids else []
    yield _batch(["bucket", "blob"], *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 2, (pa.int32(), pa.binary()))))


def merged(intervals):
    """The union of [start, end) rows as maximal intervals; touching ones are joined."""
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(intervals[:, 1])
    new = np.r_[True, intervals[1:, 0] > reach[:-1]]
    first = np.flatnonzero(new)
    return np.stack([intervals[first, 0], reach[np.r_[first[1:], len(reach)] - 1]], 1)


def _removed(batches):
    names = ["rid", "spans", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows = []
            for rid, text, blob in zip(*(part.column(c).to_pylist() for c in ("rid", "text", "blob"))):
                data = text.encode()
                spans = merged(np.frombuffer(blob, np.int64).reshape(-1, 2))
                rest, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    rest.update(data[at:a])
                    at = b
                rest.update(data[at:])
                rows.append((rid, [{"start": a, "end": b} for a, b in spans.tolist()], int((spans[:, 1] - spans[:, 0]).sum()), len(spans), rest.hexdigest()))
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64(), pa.string())
            yield _batch(names, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)))


def _numbered(docs, text, id):
    """(rid, doc_id, text): rid is unique and in order of doc_id; it is the id itself where that serves.

    Otherwise rows are numbered in order of id (nulls last), then of the text's digest; rows that repeat
    an id and a text are one.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = rows.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if slim.isEmpty():
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    keyed = rows.withColumns({"none": F.col("doc_id").isNull(), "digest": F.sha2("text", 256)})
    order = ["none", "doc_id", "digest"]
    ranges = keyed.select(order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    names = stored(ranges.withColumn("rid", F.monotonically_increasing_id()), "numbers")
    same = keyed["doc_id"].eqNullSafe(names["doc_id"]) & (keyed["digest"] == names["digest"])
    return stored(keyed.join(names, same).select(names["rid"], keyed["doc_id"], keyed["text"]).dropDuplicates(["rid"]), "numbered")


def remove_repeats(docs, text="text", id="doc_id"):
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges).

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a
    smaller id, or before it in the same one; strings are judged on the input. A null text is empty; a
    text shorter than LENGTH keeps all. Null ids come last; rows with equal ids are told apart by their
    texts' digests; rows that repeat both give one row. An empty table gives none.
    """
    spark = docs.sparkSession
    docs = _numbered(docs, text, id)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 << 20)))
    hot_from = max(HOT_LEAST, int(HOT_SHARE * total / (SPREAD / 2)))
    slim = docs.select("rid", "doc_id", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("sha"))
    copies = slim.groupBy("sha", "n").agg(F.min("rid").alias("first"), F.count("*").alias("k")).where("k > 1")
    later = stored(slim.join(stored(copies, "groups"), ["sha", "n"]).where("rid <> first").select("rid"), "copies")

    blob = "bucket int, kind int, blob binary"
    votes = docs.select("rid", "text").mapInArrow(lambda b: _anchor_blobs(b, buckets), blob)
    again = stored(votes.repartition(buckets, "bucket").select("kind", "blob").mapInArrow(lambda b: _repeated(b, buckets, hot_from), "kind int, bucket int, blob binary"), "anchors")
    # at most 1 / HOT_SHARE hashes, as each stands for that share of all anchors
    hot = frozenset(h for r in again.where("kind = 2").select("blob").collect() for h in _unpack(r["blob"], np.uint64)[0].tolist())

    def regrouped(rows, width, name):
        return rows.repartition(buckets, "bucket").select("blob").mapInArrow(lambda b: _regrouped(b, width), "rid long, blob binary").withColumnRenamed("blob", name)

    lists = regrouped(again.where("kind = 0"), 1, "anchors").join(later, "rid", "left_anti")
    near = docs.select("rid", "text").join(lists, "rid").select("rid", "text", "anchors").mapInArrow(lambda b: _stretches(b, buckets, hot), blob)
    spans = near.repartition(buckets, "bucket").select("kind", "blob").mapInArrow(lambda b: _covered(b, buckets), "bucket int, blob binary")
    found = regrouped(spans, 2, "blob")
    ddl = "rid long, spans array<struct<start:bigint,end:bigint>>, n_removed long, n_spans long, kept_sha256 string"
    removed = stored(docs.select("rid", "text").join(found, "rid").select("rid", "text", "blob").mapInArrow(_removed, ddl), "removed")

    gone = later.withColumn("copy", F.lit(True))
    whole = F.coalesce(F.col("copy") & (F.col("n") >= LENGTH), F.lit(False))
    part = lambda name, all_gone, none: F.when(whole, all_gone).otherwise(F.coalesce(F.col(name), none)).alias(name)
    zero, none = F.lit(0).cast("long"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return slim.join(gone, "rid", "left").join(removed, "rid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_bytes"), part("n_removed", F.col("n").cast("long"), zero), part("n_spans", F.lit(1).cast("long"), zero),
        part("kept_sha256", F.sha2(F.lit(""), 256), F.col("sha")),
        part("spans", F.array(F.struct(zero.alias("start"), F.col("n").cast("long").alias("end"))), none),
    )
