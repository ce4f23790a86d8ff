"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) is a product of softmaxes of WAYS ways: first the word's class, then the word within its
class. Each of the most frequent words is a class; other words seen at least twice are classed by their
ending; words seen once share a class with the one unknown word, so its probability follows the context
as that of rare words does. The root chooses among the classes by ending, the class of words seen once, and
groups of WAYS frequent words, which a second softmax tells apart. Within a class a softmax chooses among
the groups of words whose counts have the same power of two, then, digit by digit, the word's place in
its group. The probabilities of all V known words and the unknown one add up to 1.

Every one of these choices has its own weights for features of the two words before: the last word, the one
before the last (a skip) and, down to the group of a word, the last two together. They are found by hashing.
The prior of a choice, which stands for a bias, is the share of the training tokens (of the words, for
digits) on each way. The table of weights follows the counted vocabulary up to ``most_bits``.

Texts are split into words once, by chunks of texts: a chunk has its own numbering of its distinct words,
so only these, not its tokens, are counted and joined with the counts of all training documents. Training
takes each training token once, in rounds of growing shares of the documents. Within a round, replicas of
about ``replica_tokens`` tokens each start from the averaged weights of the round before and make gradient
updates; a feature's weights are averaged by each replica's sum of squared gradients. Which document is in which
round and replica, and in which place, follows from a hash of the document, so the scores do not depend on
the number of cores. Scoring gathers sparse rows of the weights in numpy batches.
"""

import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from busfleet.llm._labels import held_out
from busfleet.llm._text import kept, pieces, release, stored

#: Ways of a softmax.
WAYS = 16
#: The root's ways: words seen once, groups of WAYS frequent words, classes by ending.
HEADS = 4
HEAD, TAIL = HEADS * WAYS, WAYS - 1 - HEADS
CLASSES = 1 + HEAD + TAIL
#: Counts of as many binary digits or more are one group.
MOST_POWER = WAYS + 1
#: Tokens of one gradient step.
TOKENS = 8192
RATE = 0.7
#: Rows of weights that travel together.
CHUNK_ROWS = 8192
#: Bytes of text of one chunk; a longer text is one of its own.
CHUNK_BYTES = 32 << 20
#: A document's round, by its hash modulo 16: shares of 2 and 14 sixteenths.
ROUNDS = (2, 16)
END = b"\n"  # not a word, as words have no white space


def tokens(texts):
    """The tokens of some texts: how many each has, their numbers in a row, and each number's token in UTF-8.

    Tokens are the words, with A-Z in lower case, and the end.
    """
    # the empty words at a text's ends are left out; that of one more text has the end's number
    texts = pa.concat_arrays([*texts, pa.array([""], texts[0].type)])
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    at = words.offsets.to_numpy()
    found = words.values.dictionary_encode()
    ids, distinct = found.indices.to_numpy().astype(np.uint32), found.dictionary.cast(pa.binary())
    del words, found
    end = ids[-1]
    real = ids != end
    sizes = np.diff(np.r_[0, np.cumsum(real)][at])[:-1] + 1
    out = np.full(sizes.sum(), end)
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = ids[real]
    return sizes, out, pc.if_else(pc.equal(distinct, b""), pa.scalar(END), distinct)


def _binary(sizes, numbers):
    """Arrays of uint32, of these sizes and one after the other, as a binary column; all together less than 2 GB."""
    offsets = np.r_[0, 4 * np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def split_chunks(docs, modulus, rest):
    """What tokenising leaves, by chunk, in one stored table with three kinds of rows.

    0: token, local (its number in the chunk), c (how often the chunk's training texts have it);
    1: doc_id, held_out and ids (the local numbers of a text's tokens, binary);
    2: c (the number of training tokens of the chunk).
    """
    rows = docs.select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "text")
    names = ["kind", "chunk", "token", "local", "c", "doc_id", "held_out", "ids"]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def batch(n, kind, chunk, **given):
        filled = {"kind": pa.array(np.full(n, kind, np.int32)), "chunk": pa.array(np.full(n, chunk)), **given}
        return pa.RecordBatch.from_arrays([filled.get(c, pa.nulls(n, t)) for c, t in zip(names, kinds)], names)

    def finished(held):
        chunk = int.from_bytes(os.urandom(8), "little") >> 1
        doc, apart = (pa.concat_arrays([x.column(c) for x in held]) for c in ("doc_id", "held_out"))
        sizes, ids, words = tokens([x.column("text") for x in held])
        counts = np.bincount(ids[np.repeat(~apart.to_numpy(zero_copy_only=False), sizes)], minlength=len(words))
        at = np.r_[0, np.cumsum(sizes)]
        for i in range(0, len(doc), 500):
            part = slice(i, i + 500)
            own = sizes[part]
            yield batch(len(own), 1, chunk, doc_id=doc[part], held_out=apart[part], ids=_binary(own, ids[at[i] : at[i + len(own)]]))
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield batch(len(part), 0, chunk, token=part, local=pa.array(np.arange(i, i + len(part), dtype=np.int32)), c=pa.array(counts[i : i + len(part)].astype(np.int64)))
        yield batch(1, 2, chunk, c=pa.array([int(counts.sum())], pa.int64()))

    def run(batches):
        held, size = [], 0
        for got in batches:
            for piece in pieces(got, rows=500):
                own = piece.column("text").nbytes
                if held and size + own > CHUNK_BYTES:
                    yield from finished(held)
                    held, size = [], 0
                held.append(piece)
                size += own
        if held:
            yield from finished(held)

    schema = "kind int, chunk long, token binary, local int, c long, doc_id long, held_out boolean, ids binary"
    return stored(rows.mapInArrow(run, schema), "chunks", "kind")


def _tail_class():
    return (F.lit(1 + HEAD) + F.pmod(F.crc32(F.expr("substring(token, greatest(length(token) - 2, 1), 3)")), F.lit(TAIL))).cast("int")


def statistics(vocabulary):
    """N, V and the head words: bounded results."""
    n, v = vocabulary.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    head = [bytes(r["token"]) for r in vocabulary.where("c > 1").orderBy(F.desc("c"), "token").limit(HEAD).collect()]
    return {"n": int(n or 0), "v": int(v or 0), "head": head}


def numbered(vocabulary, stats, parts):
    """(token, c, number) of the vocabulary, and its Groups.

    Known words are numbered from 0 by class, group and token; unknown ones have the number V.
    """
    of_head = F.coalesce(*(F.when(F.col("token") == F.lit(bytearray(t)), 1 + i) for i, t in enumerate(stats["head"])), F.lit(None).cast("int"))
    kind = F.when(F.col("c") < 2, 0).otherwise(F.coalesce(of_head, _tail_class()))
    rows = vocabulary.where("c > 0").withColumn("class", kind.cast("int"))
    rows = rows.withColumn("power", F.when(F.col("class") > HEAD, F.least(F.length(F.bin("c")), F.lit(MOST_POWER))).otherwise(0))
    order = ["class", "power", "token"]
    rows = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("part", F.shiftright("place", 33))
    found = rows.groupBy("class", "power", "part").agg(F.min("place").alias("first"), F.count("*").alias("words"), F.sum("c").alias("s")).collect()
    shifts, sums, at = [], {}, 0
    for r in sorted(found, key=lambda r: (r["class"], r["power"], r["part"])):
        shifts.append((r["class"], r["power"], r["part"], at - r["first"]))
        words, s = sums.get((r["class"], r["power"]), (0, 0))
        sums[r["class"], r["power"]] = words + r["words"], s + r["s"]
        at += r["words"]
    shift = vocabulary.sparkSession.createDataFrame(shifts, "class int, power int, part long, shift long")
    known = rows.join(F.broadcast(shift), ["class", "power", "part"]).select("token", "c", (F.col("place") + F.col("shift")).alias("number"))
    unknown = vocabulary.where("c = 0").select("token", "c", F.lit(stats["v"]).cast("long").alias("number"))
    return known.unionByName(unknown), [(k, *x) for (k, _), x in sums.items()]


class Groups:
    """The groups of numbered words, in order, and last the unknown word; a bounded table.

    rows: (class, words, training tokens) of each group.
    """

    def __init__(self, rows, most_bits=20):
        kinds, words, mass = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.v, self.once = int(words.sum()), int(words[kinds == 0].sum())
        self.starts = np.r_[0, np.cumsum(words), self.v + 1]
        self.kinds = np.r_[kinds, 0]
        self.words = np.r_[words, 1]
        # the root's and the frequent words' way of each class, and the logs of the tokens on each way
        kind = np.arange(CLASSES)
        self.way = np.where(kind == 0, 0, np.where(kind <= HEAD, 1 + (kind - 1) // WAYS, kind - HEAD + HEADS))
        of_kind = np.bincount(kinds, mass, CLASSES)
        of_kind[0] = max(of_kind[0], 1)  # the unknown word
        root, head = _log(np.bincount(self.way, of_kind, WAYS)), _log(of_kind[1 : HEAD + 1].reshape(HEADS, WAYS))
        # a group's place among its class's; the unknown word's group is no choice of class 0
        self.place = np.r_[np.arange(len(kinds)) - np.searchsorted(kinds, kinds), 0]
        self.several = np.r_[np.bincount(kinds, minlength=CLASSES)[kinds] > 1, False]
        shares = _log(np.zeros((CLASSES, WAYS)))
        shares[kinds, self.place[:-1]] = _log(mass)
        # the priors of the root, of frequent words, of classes and of full digits
        self.priors = np.concatenate([root[None], head, shares, FULL])
        self.priors -= np.log(np.exp(self.priors - self.priors.max(1, keepdims=True)).sum(1, keepdims=True)) + self.priors.max(1, keepdims=True)
        # digits of a place in its group, ways of each digit, and words on a way of the first
        self.digits = np.array([next(d for d in range(64) if WAYS**d >= n) for n in self.words.tolist()])
        self.base = np.array([next(b for b in range(1, WAYS + 1) if b**d >= n) for d, n in zip(self.digits.tolist(), self.words.tolist())])
        self.width = self.base ** np.maximum(self.digits - 1, 0)
        # the first digits' priors: one of each group
        self.first = len(self.priors)
        self.priors = np.concatenate([self.priors, _shared(self.words, self.width)])
        self.bits = min(max(14, math.ceil(math.log2(max(self.v, 2))) - 1), most_bits)

    def decisions(self, words):
        """(token, node, way, prior) of the choices that lead to each of some words; prior has a row of WAYS logs.

        Nodes are numbers: the root, groups of frequent words, classes (all below DIGITS), or a level and the
        first word below it. Those below DIGITS come first.
        """
        words = words.astype(np.int64)
        group = np.searchsorted(self.starts, words, "right") - 1
        kind = np.take(self.kinds, group)
        way = np.take(self.way, kind)
        out = [(np.arange(len(words)), np.zeros(len(words), np.int64), way, np.zeros(len(words), np.int64))]
        at = np.flatnonzero((kind > 0) & (kind <= HEAD))
        own = np.take(way, at)
        out.append((at, own, (np.take(kind, at) - 1) % WAYS, own))
        at = np.flatnonzero(np.take(self.several, group))
        own = np.take(kind, at)
        out.append((at, WAYS + own, np.take(self.place, np.take(group, at)), 1 + HEADS + own))
        partial, rows, level = [self.priors], len(self.priors), 0
        at = np.flatnonzero(np.take(self.digits, group))
        group, word = np.take(group, at), np.take(words, at)
        base, width = np.take(self.base, group), np.take(self.width, group)
        first, end, prior = np.take(self.starts, group), np.take(self.starts, group + 1), self.first + group  # first: the first word below a node
        while len(at):
            digit = ((word - first) / width).astype(np.int64)  # words and widths are below 2 ** 32, so that this is exact
            out.append((at, (first + 2) * DIGITS + level, digit, prior))
            first, level = first + digit * width, level + 1
            more = np.flatnonzero(width > 1)
            at, word, first, base, below, end = (np.take(x, more) for x in (at, word, first, base, width, end))
            width, prior, left = (below / base).astype(np.int64), 1 + HEADS + CLASSES + base, end - first
            part = np.flatnonzero(left < below)  # at the group's end not all ways are full
            prior[part] = rows + np.arange(len(part))
            rows += len(part)
            partial.append(_shared(left[part], width[part]))
        token, node, way, prior = (np.concatenate(x) for x in zip(*out))
        return token, node, way, np.take(np.concatenate(partial), prior, 0)


#: Nodes from this number on are digits of words' places; there are fewer levels than this.
DIGITS = 128
#: The log of a way that no word takes.
NEVER = np.float32(-1e4)


#: The prior of a digit of some base, all its ways full.
FULL = np.where(np.arange(WAYS) < np.arange(WAYS + 1)[:, None], np.float32(0), NEVER)


def _log(x):
    return np.where(x > 0, np.log(np.maximum(x, 1), dtype=np.float32), NEVER)


def _shared(left, width):
    """The logs of the shares of some words on the ways of a digit, each way but the last ones with ``width``."""
    return _log(np.clip(left[:, None] - np.arange(WAYS) * width[:, None], 0, width[:, None])) - np.log(left[:, None], dtype=np.float32)


def packed(lookups):
    """(chunk, entries): what a chunk's texts need of each of its words, many words in a row.

    entries holds, compressed, the numbers of words, the counts, and the words' local numbers in the chunk.
    """

    def run(batches):
        held, size = [], 0

        def flush():
            chunk, local, c, number = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(chunk, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(chunk[order]) != 0])
            parts = np.split(order, first[1:])
            raw = [number[i].tobytes() + c[i].tobytes() + local[i].astype(np.int32).tobytes() for i in parts]
            blobs = [len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in raw]
            return pa.RecordBatch.from_arrays([pa.array(chunk[order[first]]), pa.array(blobs, pa.binary())], ["chunk", "entries"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy() for c in ("chunk", "local", "c", "number")])
                size += batch.num_rows
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return lookups.select("chunk", "local", "c", "number").mapInArrow(run, "chunk long, entries binary")


def _entries(blobs):
    """Counts and numbers, in order of the local numbers, of a chunk's packed entries."""
    parts = []
    for blob in blobs:
        size = int.from_bytes(blob[:8], "little")
        raw, n = pa.decompress(blob[8:], size, codec="zstd", asbytes=True), size // 20
        parts.append((np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int32, n, 16 * n)))
    number, c, local = (np.concatenate(x) for x in zip(*parts))
    order = np.empty(len(local), np.int64)
    order[local] = np.arange(len(local))
    return c[order], number[order].astype(np.uint32)


def encoded(chunks, lookups, stats, parts):
    """Per text: doc_id, held_out, n_tokens, n_known, base_score and words (the numbers of its tokens, binary)."""
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    a = packed(lookups).select("chunk", "entries", null("doc", "struct<doc_id:bigint,held_out:boolean,ids:binary>"))
    b = chunks.where("kind = 1").select("chunk", null("entries", "binary"), F.struct("doc_id", "held_out", "ids").alias("doc"))
    # texts come after their chunk's words
    rows = a.unionByName(b).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("entries").isNull())
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "words"]

    def run(batches):
        chunk, held = None, []
        for batch in batches:
            texts, own = batch.column("entries").is_null().to_numpy(zero_copy_only=False), batch.column("chunk").to_numpy()
            cut = np.flatnonzero(np.r_[True, (texts[1:] != texts[:-1]) | (own[1:] != own[:-1]), True])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if own[i] != chunk:
                    chunk, held, base = own[i], [], None
                part = batch.slice(i, j - i)
                if not texts[i]:
                    held += part.column("entries").to_pylist()
                    continue
                if base is None:
                    c, number = _entries(held)
                    held, known = [], (c > 0).astype(np.int64)
                    base = np.log10((c + 0.1) / (stats["n"] + 0.1 * (stats["v"] + 1)))
                part = pa.RecordBatch.from_struct_array(part.column("doc"))
                for start in range(0, part.num_rows, 500):
                    piece = part.slice(start, 500)
                    sizes, ids = _arrays(piece.column("ids"))
                    first = np.cumsum(sizes) - sizes  # each text has its end, so none is empty
                    words = np.take(number, ids)
                    sums = np.add.reduceat(np.take(known, ids), first), np.add.reduceat(np.take(base, ids), first)
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), _binary(sizes, words)], names)

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, words binary")


def _arrays(column):
    """The lengths of some binary uint32 arrays, and all of them in a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(at) // 4, np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint32) if len(column) else np.zeros(0, np.uint32)


def context(words, starts):
    """The last word and the one before it for each token, 0 where there is none; other words from 1.

    words: numbers of some texts' tokens in a row; starts: true at each text's first token.
    """
    w = words.astype(np.int64) + 1
    last, skip = np.r_[0, w[:-1]], np.r_[0, 0, w[:-2]][: len(w)]
    last[starts] = 0
    skip[starts] = 0
    skip[np.flatnonzero(starts)[np.flatnonzero(starts) + 1 < len(w)] + 1] = 0
    return last, skip


def node_rows(node, last, skip, bits):
    """The rows of the weights of some choices: with the last word, with the one before; with both, of the nodes below DIGITS."""
    node, last, skip = (x.astype(np.uint64) for x in (node, last, skip))
    top = int(np.count_nonzero(node < DIGITS))
    node = node * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for i, seen in enumerate((last, skip, last[:top] * np.uint64(0xC2B2AE3D27D4EB4F) + skip[:top])):
        h = node[: len(seen)] + (seen * np.uint64(0x165667B19E3779F9) + np.uint64((i + 1) * 0x27D4EB2F165667C5 % 2**64))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(64 - bits)
        out.append(h.view(np.int64))
    return out


_ONES = np.ones(WAYS, np.float32)
_ROW = np.dtype((np.void, 4 * WAYS))  # a row as one item


def _logits(parts, prior):
    """Logits of some choices: the prior and the sum of their rows, within what exp can take."""
    z = prior + next(parts)
    for part in parts:
        z[: len(part)] += part
    return np.clip(z, -80, 80, out=z)


def _taken(way):
    """The places of the taken ways among all ways of some choices."""
    return np.arange(0, len(way) * WAYS, WAYS) + way


def log_taken(weights, rows, way, prior):
    """The log probability of each choice's way."""
    z = _logits((np.take(weights, r, 0) for r in rows), prior)
    taken = np.take(z, _taken(way))
    return taken - np.log(np.exp(z, out=z) @ _ONES)


def summed(g, r):
    """The distinct values of r, below 2 ** 31, and for each the sum of its rows of g."""
    order = r.astype(np.int64)
    order <<= 32
    order |= np.arange(len(r))
    order.sort()  # by value, then by place
    values = order >> 32
    first = np.flatnonzero(np.diff(values, prepend=-1))
    order &= 0xFFFFFFFF
    return values[first], np.add.reduceat(np.take(g, order, 0), first, axis=0) if len(r) else g[:0]


def update(weights, squares, rows, way, prior):
    """One AdaGrad step on the log loss of some choices."""
    if not len(way):
        return
    sizes = [len(r) for r in rows]
    row, choice = np.concatenate(rows), np.concatenate([np.arange(n) for n in sizes])
    held = np.take(weights, row, 0)
    g = _logits(iter(np.split(held, np.cumsum(sizes)[:-1])), prior)
    np.exp(g, out=g)
    g *= (1 / (g @ _ONES))[:, None]
    g.reshape(-1)[_taken(way)] -= 1
    # where each row occurs first; most occur once, and what later ones add is summed apart
    place, slot = np.arange(len(row), dtype=np.int32), np.empty(len(weights), np.int32)
    slot[row[::-1]] = place[::-1]
    first = np.take(slot, row)
    once = first == place
    own, again = np.flatnonzero(once), np.flatnonzero(~once)
    step = np.take(g, choice[own], 0)
    items = step.view(_ROW).reshape(-1)
    if len(again):
        at, more = summed(np.take(g, choice[again], 0), first[again])
        at = np.searchsorted(own, at)
        more += np.take(step, at, 0)
        items[at] = more.view(_ROW).reshape(-1)
    row = row[own]
    s = np.take(squares, row) + (step * step) @ _ONES / WAYS
    squares[row] = s
    step *= (-RATE / len(rows) / np.sqrt(s))[:, None]
    step += np.take(held, own, 0)
    np.put(weights.view(_ROW).reshape(-1), row, items)


def _token_batches(batches, most):
    """(words, starts, texts) of whole texts, with about ``most`` tokens at a time."""
    for batch in batches:
        sizes, words = _arrays(batch.column("words"))
        total, i = np.cumsum(sizes), 0
        while i < len(sizes):
            before = total[i] - sizes[i]
            j = min(max(int(np.searchsorted(total, before + most, "right")), i + 1), len(sizes))
            starts = np.zeros(total[j - 1] - before, bool)
            starts[total[i:j] - sizes[i:j] - before] = True
            yield words[before : total[j - 1]], starts, j - i
            i = j


def _steps(words, starts, groups):
    """Runs of TOKENS tokens: their place, and the tokens, rows, ways and priors of their choices."""
    last, skip = context(words, starts)
    for i in range(0, len(words), TOKENS):
        part = slice(i, i + TOKENS)
        token, node, way, prior = groups.decisions(words[part])
        yield part, token, node_rows(node, last[part][token], skip[part][token], groups.bits), way, prior


def _trained(batches, groups, start):
    """Chunks (start, rows, w, n) of the weights that a replica has changed, as float16, and their sums of squared gradients."""
    kept()
    n = 1 << groups.bits
    weights = np.zeros((n, WAYS), np.float32) if start is None else start.astype(np.float32)
    squares = np.ones(n, np.float32)
    for words, starts, _ in _token_batches(batches, 4 * TOKENS):
        for _, _, rows, way, prior in _steps(words, starts, groups):
            update(weights, squares, rows, way, prior)
    release()
    for first in range(0, n, CHUNK_ROWS):
        part = slice(first, first + CHUNK_ROWS)
        if len(own := np.flatnonzero(squares[part] > 1)):
            yield first, own.astype(np.uint16).tobytes(), weights[part][own].astype(np.float16).tobytes(), (squares[part][own] - 1).tobytes()


def _averaged(batches):
    """One row (start, rows, w) for each chunk of weights, from rows in order of chunk: averages by the sums of squares."""
    key, total, weight = None, None, None

    def finished():
        own = np.flatnonzero(weight)
        w = (total[own] / weight[own, None]).astype(np.float16)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([own.astype(np.uint16).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["start", "rows", "w"])

    for batch in batches:
        for start, rows, w, n in zip(*(batch.column(c).to_pylist() for c in ("start", "rows", "w", "n"))):
            if key != start:
                if key is not None:
                    yield finished()
                key, total, weight = start, np.zeros((CHUNK_ROWS, WAYS)), np.zeros(CHUNK_ROWS)
            rows, n = np.frombuffer(rows, np.uint16), np.frombuffer(n, np.float32).astype(float)
            total[rows] += np.frombuffer(w, np.float16).reshape(-1, WAYS) * n[:, None]
            weight[rows] += n
    if key is not None:
        yield finished()


def train(texts, groups, n_tokens, replica_tokens):
    """The weights of all choices after all rounds, as float16: what is broadcast is 32 bytes a row, 32 MB at most."""
    sc = texts.sparkSession.sparkContext
    rows = texts.select("words", F.xxhash64("doc_id", "words").alias("order")).withColumn("bucket", F.pmod(F.xxhash64("order"), F.lit(ROUNDS[-1])))
    weights, before = None, 0
    for upto in ROUNDS:
        replicas = max(1, math.ceil(n_tokens * (upto - before) / ROUNDS[-1] / replica_tokens))
        shared = sc.broadcast((groups, weights))

        def run(batches, shared=shared):
            names = ["start", "rows", "w", "n"]
            for row in _trained(batches, *shared.value):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names)

        mine = rows.where((F.col("bucket") >= before) & (F.col("bucket") < upto)).withColumn("replica", F.pmod("order", F.lit(replicas)).cast("int"))
        dealt = mine.repartitionById(replicas, F.col("replica")).sortWithinPartitions("order").select("words")
        found = dealt.mapInArrow(run, "start int, rows binary, w binary, n binary").withColumn("from", F.spark_partition_id())
        found = found.repartition("start").sortWithinPartitions("start", "from").drop("from")
        weights = np.zeros((1 << groups.bits, WAYS), np.float16) if weights is None else weights.copy()
        for r in found.mapInArrow(_averaged, "start int, rows binary, w binary").toLocalIterator():
            weights[r["start"] + np.frombuffer(r["rows"], np.uint16).astype(np.int64)] = np.frombuffer(r["w"], np.float16).reshape(-1, WAYS)
        shared.destroy()
        before = upto
    return weights


def scored(texts, groups, weights):
    """The ``encoded`` rows without arrays, with ``score``: the model's log10 probability of the text."""
    shared = texts.sparkSession.sparkContext.broadcast((groups, weights))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches):
        kept()
        groups, weights = shared.value[0], shared.value[1].astype(np.float32)
        half = math.log(0.5) if groups.once else 0.0  # words seen once, and the unknown one
        for batch in batches:
            score, at = np.zeros(batch.num_rows), 0
            for words, starts, n in _token_batches([batch], 4 * TOKENS):
                text = np.cumsum(starts) - 1
                for part, token, rows, way, prior in _steps(words, starts, groups):
                    p = log_taken(weights, rows, way, prior).astype(float)
                    own = text[part]
                    score[at : at + n] += np.bincount(own[token], p, n) + half * np.bincount(own[way[: len(own)] == 0], minlength=n)
                at += n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score / math.log(10))], [*names, "score"])

    return texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs, modulus=10, rest=0, text="text", id="doc_id", most_bits=20, replica_tokens=12_000_000):
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id modulo ``modulus`` is not ``rest``; a null id is learned
    from. A null text is empty and has the end as its one token. Repeated rows count each. Columns of
    other names are left out; an empty table gives no rows. The table of weights has a row of WAYS for
    one or two known words, but 2 ** ``most_bits`` rows at most: each replica holds it whole.
    """
    spark = docs.sparkSession
    chunks = split_chunks(docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), modulus, rest)
    counts = chunks.where("kind = 0").select("chunk", "token", "local", "c")
    vocabulary = stored(counts.groupBy("token").agg(F.sum("c").alias("c")), "vocabulary")
    stats = statistics(vocabulary)
    n_chunks = chunks.where("kind = 2").count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_chunks, 1)
    words, rows = numbered(vocabulary, stats, parts)
    groups = Groups(rows, most_bits)
    # a task's hash table has no more words than an average chunk, as there are as many tasks as chunks at least
    words = words.repartition(parts, "token").hint("shuffle_hash")
    lookups = counts.select("chunk", "token", "local").repartition(parts, "token").join(words, "token").select("chunk", "local", "c", "number")
    texts = stored(encoded(chunks, lookups, stats, parts), "encoded")
    weights = train(texts.where(~F.col("held_out")), groups, stats["n"], replica_tokens)
    return scored(texts, groups, weights).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(stats["n"]).cast("long").alias("train_tokens"), "base_score", "score")
