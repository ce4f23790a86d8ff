"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact check.

A document matches an item of n words if some stretch of its words is within edit distance k of the
item, k being a fifth of n rounded down. Words are runs of letters and digits in lower case.

The CGK random walk reads a word sequence by a pointer: at step j it writes the word under the pointer
and moves on by a random bit of (step, word), so that n words take about 2n steps. Sequences at a small edit distance so
become sequences at a small Hamming distance. Each of several independent walks gives one LSH table
over a few steps sampled from all of it; their number follows from the target recall and the agreement of
coordinates measured on the items with k edits, spread out or all at the front. Windows of each size that
items have, at every word, are looked up among the items of that size, and what collides is checked
exactly by bit-parallel edit distance.

Windows that provably match nothing are not walked: k edits leave at least n - 2 - 3k of an item's
trigrams, so a window with fewer trigrams of any item can be left out without loss.

Items of fewer than LEAST_WORDS words have too few trigrams for that and allow one edit at most. One of two
pieces of such an item, or the whole of one without edits, is in every match; so these pieces are looked
up as they are, and the words about each hit are checked by the same edit distance, without loss.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from busfleet.llm._text import MARKS, Bytes, pieces, plus, utf8

#: Share of an item's words that edits may touch.
EDITS = 0.2
#: Items of fewer words are searched by their pieces, not by walks.
LEAST_WORDS = 8
SAMPLES = 2
#: Tables of each size from one walk.
TABLES = 4
TARGET = 0.9995
#: Bytes of benchmark text that one pass over the documents carries; a larger benchmark takes several.
BLOCK_BYTES = 4 << 20
#: Bytes of documents that a task works on at a time; a longer text is taken whole.
PIECE = 2_000_000


def allowed(n):
    return int(EDITS * n)


def _bit(walk, step, words):
    """A random bit of (walk, step, word)."""
    x = words * np.uint64(0x9E3779B97F4A7C15) + np.uint64((walk * 0xD1B54A32D192ED03 + step * 0x8CB92BA72F3D8DD7 + 1) % 2**64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(np.int64)


def walked(words, starts, walk, steps):
    """How far the walk's pointer has moved at each of its first steps, from each start: (steps, starts)."""
    at, most = np.array(starts), len(words) - 1
    out = np.empty((steps, len(at)), np.int16)
    for j in range(steps):
        out[j] = at - starts
        at += _bit(walk, j, words[at])
        np.minimum(at, most, out=at)
    return out


def written(words, starts, moved, n):
    """The words that a walk writes in windows of n words, at the steps of ``moved``; beyond a window 0."""
    return np.where(moved < n, words[np.minimum(starts + moved, len(words) - 1)], np.uint64(0))


def _key(coordinates):
    h = np.zeros(coordinates.shape[1], np.uint64)
    for c in coordinates:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _edited(words, k, rng):
    out = list(words)
    for _ in range(k):
        kind, place = rng.integers(3), int(rng.integers(max(len(out), 1)))
        new = np.uint64(rng.integers(1, 2**63))
        if kind == 1 or not out:
            out.insert(place, new)
        elif kind == 0:
            out[place] = new
        else:
            del out[place]
    return out


def tables_needed(items, n, rng, most_items=60, samples=200):
    """Tables for the target recall, from the chance that sampled steps agree after k random edits.

    The edits are spread over an item, or lie together at its front; the rarer agreement counts.
    """
    rates = []
    for edit in (_edited, _edited_front):
        hits = total = 0
        for words in items[:most_items]:
            twin = np.array(edit(words, allowed(n), rng), np.uint64)[:n]
            twin = np.r_[twin, np.full(n - len(twin), np.uint64(1))]
            for _ in range(-(-8 // len(items))):
                walk, at = int(rng.integers(1 << 30)), np.zeros(1, np.int64)
                own, other = (written(x, at, walked(x, at, walk, _last_step(n)), n)[:, 0] for x in (np.r_[words, 0].astype(np.uint64), np.r_[twin, 0].astype(np.uint64)))
                hits += (own == other)[_sampled_steps(n, rng, samples)].all(1).sum()
                total += samples
        rates.append(hits / total)
    p = min(max(min(rates), 0.02), 0.999)
    return max(8, math.ceil(math.log(1 - TARGET) / math.log(1 - p)))


def _edited_front(words, k, rng):
    """The item with k edits among its first k words."""
    return [*_edited(words[:k], k, rng), *words[k:]] if k else list(words)


def _last_step(n):
    """Steps are sampled before this one: a walk over n words takes about 2n steps, and its pads say nothing."""
    return max(SAMPLES, int(1.9 * n))


def _sampled_steps(n, rng, count):
    """``count`` rows of SAMPLES steps of a walk: over the whole item, the first of them before its last quarter."""
    return np.column_stack([rng.integers(0, int(1.5 * n), count), rng.integers(0, _last_step(n), (count, SAMPLES - 1))])


def _trigrams(words):
    h = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def fit(items):
    """The index of (item_id, text) rows: LSH tables for each size of items; the items' trigrams."""
    rng = np.random.default_rng(5)
    words_of, short = {}, {}
    for number, (_, text) in enumerate(items):
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = Bytes(data, np.array([0, len(data)]), split=MARKS)
        if len(words.starts):
            (words_of if len(words.starts) >= LEAST_WORDS else short)[number] = words.words()
    sizes = {}
    for number in sorted(words_of):
        sizes.setdefault(len(words_of[number]), []).append(number)
    needed = {n: tables_needed([words_of[i] for i in own], n, rng) for n, own in sizes.items()}
    # each walk serves all sizes, with TABLES tables for a size that needs more still
    walks = []
    for walk in range(-(-max(needed.values(), default=0) // TABLES)):
        tables = []
        for n, own in sorted(sizes.items()):
            if walk * TABLES >= needed[n]:
                continue
            flat = np.concatenate([*(np.r_[words_of[i], np.zeros(n, np.uint64)] for i in own), np.zeros(1, np.uint64)])
            first = np.arange(len(own)) * 2 * n
            moved = walked(flat, first, walk, _last_step(n))
            for steps in _sampled_steps(n, rng, TABLES):
                keys = _key(written(flat, first, moved[steps], n))
                order = np.argsort(keys, kind="stable")
                tables.append((n, steps, keys[order], np.array(own)[order]))
        walks.append((walk, tables))
    # of each size: the longest match, and the trigrams that any match leaves
    spans = [(n, n + allowed(n), n - 2 - 3 * allowed(n)) for n in sorted(sizes)]
    grams = {i: _trigrams(w) for i, w in words_of.items()}
    known = np.unique(np.concatenate(list(grams.values()))) if grams else np.zeros(0, np.uint64)
    sieve = np.zeros(1 << 22, bool)
    sieve[(known >> np.uint64(42)).astype(np.int64)] = True
    return {
        "ids": [i for i, _ in items], "words": {i: w.tolist() for i, w in (words_of | short).items()}, "short": _short(short), "spans": spans, "walks": walks, "grams": known,
        "of": {i: np.searchsorted(known, g).tolist() for i, g in grams.items()}, "sieve": np.packbits(sieve),
    }


def _runs(words, n):
    """A hash of each run of n words."""
    h = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _short(items):
    """By the size of a piece: the sorted hashes of the pieces, and the item and the place in it of each.

    An item that allows k edits has k + 1 pieces, so a match holds one of them unchanged.
    """
    found = {}
    for number, words in items.items():
        cuts = np.linspace(0, len(words), allowed(len(words)) + 2).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            found.setdefault(int(b - a), []).append((int(_runs(words[a:b], b - a)[0]), number, int(a)))
    out = {}
    for size, rows in found.items():
        rows.sort()
        keys, numbers, places = zip(*rows)
        out[size] = np.array(keys, np.uint64), np.array(numbers), np.array(places)
    return out


def _best(index, item, words, starts, a, b):
    """(distance, first word, end) of the item's best match about some starts within words a to b, or None."""
    pattern = index["words"][item]
    n, k = len(pattern), allowed(len(pattern))
    spans, best = [], None
    for p in starts:
        lo, hi = max(a, p - k), min(b, p + n + 2 * k)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        distance, end = search(pattern, words[lo:hi].tolist())
        if distance <= k and (best is None or distance < best[0]):
            best = (distance, lo, lo + end)
    if best:
        distance, lo, end = best
        _, back = search(pattern[::-1], words[lo:end][::-1].tolist())
        return distance, end - back, end


def _found_short(text, at, index):
    """As ``_found``, for the short items."""
    words, doc = text.words(), text.doc
    rows, items, starts = [], [], []
    for size, (keys, numbers, places) in index["short"].items():
        h = _runs(words, size)
        lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
        hit = np.flatnonzero((hi > lo) & (doc[: len(h)] == doc[size - 1 :]))
        each = (hi - lo)[hit]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo[hit], each)
        hit = np.repeat(hit, each)
        rows.append(doc[hit]), items.append(numbers[place]), starts.append(hit - places[place])
    rows, items, starts = (np.concatenate(x) for x in (rows, items, starts))
    order = np.lexsort((starts, items, rows))
    rows, items, starts = rows[order], items[order], starts[order]
    cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (items[1:] != items[:-1]), True]) if len(rows) else [0]
    for i, j in zip(cut[:-1], cut[1:]):
        row, item = int(rows[i]), int(items[i])
        a, b = np.searchsorted(doc, [row, row + 1]).tolist()
        if best := _best(index, item, words, starts[i:j].tolist(), a, b):
            yield row, item, best[0], int(text.starts[best[1]] - at[row]), int(text.ends[best[2] - 1] - at[row])


def search(pattern, text):
    """Least edit distance of the pattern to any stretch of the text, and the first end that has it.

    Bit-parallel over Python's integers; pattern and text are sequences of words.
    """
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _pairs(words, doc, last, known, index):
    """Distinct (start, item number) pairs that collide in some table, over the windows of all texts."""
    total, found = np.r_[0, np.cumsum(known)], []
    at = np.arange(len(words))
    fitting = {n: total[np.minimum(at + span - 2, last[doc])] - total[at] >= need for n, span, need in index["spans"]}
    every = np.flatnonzero(np.any(list(fitting.values()), axis=0))
    padded = np.r_[words, np.uint64(0)]
    for first in range(0, len(every), 20_000):
        starts = every[first : first + 20_000]
        own = {n: np.flatnonzero(x[starts]) for n, x in fitting.items()}
        longest = max(n for n, x in own.items() if len(x))
        for walk, tables in index["walks"]:
            moved = walked(padded, starts, walk, _last_step(longest))
            for n, steps, keys, items in tables:
                if not len(which := own[n]):
                    continue
                got = _key(written(padded, starts[which], moved[steps][:, which], n))
                lo, hi = np.searchsorted(keys, got), np.searchsorted(keys, got, "right")
                hit = np.flatnonzero(hi > lo)
                each = (hi - lo)[hit]
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo[hit], each)
                found.append(items[place] * np.int64(len(words)) + np.repeat(starts[which[hit]], each))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs % len(words), pairs // len(words)


def _found(data, at, index, sieve):
    """(row, item number, distance, first byte, end byte) of every match in some texts."""
    text = Bytes(data, at, split=MARKS)
    if index["short"] and len(text.starts):
        yield from _found_short(text, at, index)
    if len(text.starts) < 3 or not len(index["grams"]):
        return
    words, doc = text.words(), text.doc
    grams = _trigrams(words)
    hits = np.flatnonzero(sieve[(grams >> np.uint64(42)).astype(np.int64)] & (doc[:-2] == doc[2:]))
    number = np.minimum(np.searchsorted(index["grams"], grams[hits]), len(index["grams"]) - 1)
    hits, number = (x[index["grams"][number] == grams[hits]] for x in (hits, number))
    busy = np.bincount(doc[hits], minlength=text.n) >= min(need for _, _, need in index["spans"])
    keep = np.flatnonzero(busy[doc])
    if not len(keep):
        return
    # from here on only the words of texts with enough trigrams of items
    moved = np.cumsum(busy[doc]) - 1
    stay = busy[doc[hits]]
    hits, number = moved[hits[stay]], number[stay]
    words, doc = words[keep], doc[keep]
    known = np.zeros(len(words), np.int64)
    known[hits] = 1
    first, last = np.searchsorted(doc, np.arange(text.n)), np.searchsorted(doc, np.arange(text.n), "right")
    starts, items = _pairs(words, doc, last, known, index)
    order = np.lexsort((starts, items, doc[starts]))
    starts, items = starts[order], items[order]
    rows = doc[starts]
    cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (items[1:] != items[:-1]), True]) if len(rows) else [0]
    now, present = -1, set()
    for i, j in zip(cut[:-1], cut[1:]):
        row, item = int(rows[i]), int(items[i])
        a, b = int(first[row]), int(last[row])
        if row != now:
            now, present = row, set(number[np.searchsorted(hits, a) : np.searchsorted(hits, b)].tolist())
        pattern, k = index["words"][item], allowed(len(index["words"][item]))
        n = len(pattern)
        if sum(map(present.__contains__, index["of"][item])) < n - 2 - 3 * k:
            continue  # too few of this item's trigrams are anywhere in the text
        if best := _best(index, item, words, starts[i:j].tolist(), a, b):
            distance, lo, end = best
            yield row, item, distance, int(text.starts[keep[lo]] - at[row]), int(text.ends[keep[end - 1]] - at[row])


def blocks(items, id="item_id", text="text"):
    """The indexes of a benchmark, each of about BLOCK_BYTES of text at most; ties and repeats stay."""
    rows = items.select(F.col(id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        yield fit(sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])))


def _sieve(index):
    return np.unpackbits(index["sieve"]).astype(bool)


def matches(docs, items, text="text", id="doc_id"):
    """One row per document and item that match: doc_id, item_id, distance, item_words, start, end.

    start and end are the byte range of the best match in the text, the first of equally good ones.
    Documents without a match give no row; null and empty texts and items match nothing. Repeated rows and items match each. Other columns are left
    out. The documents are only scanned, once for each block of the benchmark.
    """
    docs = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = items.schema["item_id"].dataType
    schema, arrow = docs.select("doc_id").schema.add("item_id", kind), to_arrow_type(kind)
    found = None
    for index in blocks(items):

        def run(batches, index=index):
            sieve = _sieve(index)
            for batch in batches:
                for part in pieces(batch, "__text", PIECE):
                    rows = list(_found(*utf8(part.column("__text")), index, sieve))
                    cols = list(zip(*rows)) if rows else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array([index["ids"][i] for i in cols[1]], arrow),
                            pa.array(cols[2], pa.int32()), pa.array([len(index["words"][i]) for i in cols[1]], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                        ],
                        ["doc_id", "item_id", "distance", "item_words", "start", "end"],
                    )

        part = docs.mapInArrow(run, plus(schema, "distance int, item_words int, start long, end long"))
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs, items, text="text"):
    """The rows of ``docs``, with all columns, that match no item. Only scanned, never shuffled."""
    for index in blocks(items):

        def run(batches, index=index):
            sieve = _sieve(index)
            for batch in batches:
                for part in pieces(batch, text, PIECE):
                    stay = np.ones(part.num_rows, bool)
                    stay[[row for row, *_ in _found(*utf8(part.column(text)), index, sieve)]] = False
                    yield part.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
