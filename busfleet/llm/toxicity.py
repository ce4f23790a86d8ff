"""Toxicity: a logistic classifier that is regularised by counterfactuals.

Features of a text are the presence of its words and of its words' beginnings, hashed; words are runs of
letters and digits in lower case. Features tied to a class, and all that a counterfactual changes, are
chosen on a bounded labelled sample, and their weights minimise the log loss plus ``penalty`` times the squared change of the score between each
labelled text and its counterfactual. That is the text with its identity terms swapped for others of
their group; a text without such terms gets one put in after one of its words. So a term that only names
a group, or a beginning it shares with other words, gets no weight of its own, and a neutral mention of it
raises no score.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from busfleet.llm._labels import fitted, held_out, labelled_sample
from busfleet.llm._text import MARKS, Bytes, pieces, plus, utf8

#: Names of groups of people, in lower case; a term is swapped for another of its row.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "african", "european", "american", "arab", "latino", "hispanic"),
    ("man", "woman", "male", "female"), ("men", "women"), ("gay", "lesbian", "straight", "transgender"),
    ("old", "young", "elderly"), ("blind", "deaf", "disabled"), ("immigrant", "refugee"),
    ("muslime", "christ", "jude", "hinduist", "buddhist", "atheist", "katholik", "protestant"),
    ("schwarze", "weiße", "asiate", "afrikaner", "europäer", "amerikaner", "araber"),
    ("mann", "frau"), ("männer", "frauen"), ("schwul", "lesbisch", "hetero"), ("einwanderer", "flüchtling"), ("blinde", "gehörlose", "behinderte"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique", "protestant"),
    ("noir", "blanc", "asiatique", "africain", "européen", "américain", "arabe"),
    ("homme", "femme"), ("hommes", "femmes"), ("gai", "lesbienne", "hétéro"), ("immigré", "réfugié"), ("aveugle", "sourd", "handicapé"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico", "protestante"),
    ("negro", "blanco", "asiático", "africano", "europeo", "americano", "árabe"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("homosexual", "lesbiana", "heterosexual"), ("inmigrante", "refugiado"), ("ciego", "sordo", "discapacitado"),
)
BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6)


def features(data, at):
    """Yields (buckets, words) of whole words, then of their beginnings; and the words themselves."""
    text = Bytes(data, at, split=MARKS)
    all_words = np.arange(len(text.starts))
    yield (text.hashed(text.starts, text.ends) % np.uint64(BUCKETS)).astype(np.int64), all_words, text
    for n in PREFIXES:
        own = np.flatnonzero(text.ends - text.starts > n)
        a = text.starts[own]
        yield (text.hashed(a, a + n) * np.uint64(2 * n + 1) % np.uint64(BUCKETS)).astype(np.int64), own, text


def buckets_of(data):
    """The distinct buckets of one text in UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    return np.unique(np.concatenate([b for b, *_ in features(raw, np.array([0, len(raw)]))]))


def swaps(terms):
    """{term: the other terms of its rows}, in UTF-8."""
    found = {}
    for row in terms:
        for t in row:
            found.setdefault(t.encode(), []).extend(o.encode() for o in row if o != t)
    return {t: others for t, others in found.items() if others}


def counterfactual(data, others):
    """The UTF-8 text with each identity term, as a whole word, swapped; or with one put in where it has none.

    Only the bytes of those words differ. Which term is taken follows from a hash of the text.
    """
    if not others:
        return data
    raw = np.frombuffer(data, np.uint8)
    text, pick, names = Bytes(raw, np.array([0, len(raw)]), split=MARKS), zlib.crc32(data), list(others)
    low, out, at = bytes(text.data), [], 0
    for start, end in zip(text.starts.tolist(), text.ends.tolist()):
        if low[start:end] in others:
            choice = others[low[start:end]]
            out += [data[at:start], choice[(pick + len(out)) % len(choice)]]
            at = end
    if not out:
        at = int(text.ends[pick % len(text.ends)]) if len(text.ends) else 0
        out = [data[:at], b" ", names[pick // 7 % len(names)]] + [b" "] * (at == 0)
    return b"".join(out) + data[at:]


def sampled(text, others):
    """(buckets of a text, those its counterfactual has besides, those it lacks)."""
    data = text.encode()
    own, twin = buckets_of(data), buckets_of(counterfactual(data, others))
    return own, np.setdiff1d(twin, own, assume_unique=True), np.setdiff1d(own, twin, assume_unique=True)


def fit(rows, prior, penalty=4.0, ridge=1e-4, least=4, z=4.0, rounds=300):
    """Weights from (y, buckets, added, lost) rows, the last two of the counterfactual: {bucket: weight} arrays and a bias."""
    ys = np.array([y for y, *_ in rows], float)
    if not len(ys) or ys.min() == ys.max():
        return {"bucket": np.zeros(0, np.int64), "weight": np.zeros(0), "bias": prior}
    flat, row = np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    n1, n0 = ys.sum(), (1 - ys).sum()
    pos, neg = np.bincount(flat, ys[row], BUCKETS), np.bincount(flat, 1 - ys[row], BUCKETS)
    p, q, r = pos / n1, neg / n0, (pos + neg) / len(ys)
    apart = np.abs(p - q) / np.sqrt(r * (1 - r) * (1 / n1 + 1 / n0) + 1e-12)
    changed = np.bincount(np.concatenate([x for r in rows for x in r[2:]]), minlength=BUCKETS)
    chosen = np.flatnonzero((pos + neg >= least) & (apart >= z) | (changed >= least))
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def entries(column):
        k = place[np.concatenate([r[column] for r in rows])]
        i = np.repeat(np.arange(len(rows)), [len(r[column]) for r in rows])
        return i[k >= 0], k[k >= 0]

    (i, k), (ai, ak), (li, lk) = entries(1), entries(2), entries(3)
    w, bias = np.zeros(len(chosen)), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    of = lambda i, k, x: np.bincount(k, x[i], len(chosen))
    for t in range(1, rounds + 1):
        s = np.bincount(i, w[k], len(rows)) + bias
        s2 = s + np.bincount(ai, w[ak], len(rows)) - np.bincount(li, w[lk], len(rows))
        a, b = 1 / (1 + np.exp(-s)), 1 / (1 + np.exp(-s2))
        change = 2 * penalty * (a - b)
        gb = -change * b * (1 - b)
        ga = a - ys + change * a * (1 - a) + gb  # by what text and counterfactual share
        g = np.append(of(i, k, ga) + of(ai, ak, gb) - of(li, lk, gb), ga.sum()) / len(rows)
        g[:-1] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    acting = np.zeros(len(rows), bool)
    acting[ai], acting[li] = True, True
    return {"bucket": chosen, "weight": w, "bias": float(bias + prior - np.log(n1 / n0)), "acting": float(acting.mean())}


def train(docs, labels, label="toxic", modulus=4, rest=2, per_class=4000, class_bytes=16_000_000, terms=IDENTITY_TERMS, penalty=4.0, **names):
    """The model of ``docs`` and ``labels``; its ``acting`` is the share of rows whose counterfactual differs in chosen features.

    ``per_class`` and ``class_bytes`` bound the labelled rows used of each class, and their text. Features
    are taken where the rows are; one task fits the model on them.
    """
    sample, prior = labelled_sample(docs, labels, label, modulus, rest, per_class, class_bytes, **names)

    def run(batches):
        others = swaps(terms)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                got = [sampled(t or "", others) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *(pa.array([g[k].astype(np.int32).tobytes() for g in got], pa.binary()) for k in (0, 1, 2))], ["doc_id", "y", "b_int32", "added_int32", "lost_int32"])

    rows = sample.select("doc_id", "y", "text").mapInArrow(run, plus(sample.select("doc_id", "y").schema, "b_int32 binary, added_int32 binary, lost_int32 binary"))
    return fitted(rows, lambda rows: fit(rows, prior, penalty))


def logits(data, at, weights, bias):
    """Log odds of each text: the bias and the weights of the chosen features that occur in it."""
    n = len(at) - 1
    found = []
    for buckets, word, text in features(data, at):
        hit = np.flatnonzero(weights[buckets])
        found.append(text.doc[word[hit]] * BUCKETS + buckets[hit])
    present = np.unique(np.concatenate(found))
    return np.bincount(present // BUCKETS, weights[present % BUCKETS], n) + bias


def score(docs, model, text="text", id="doc_id", modulus=4, rest=2, threshold=0.3):
    """Per row: doc_id, held_out, score (probability of class 1), predicted; empty and null texts too.

    Repeated rows are scored each; further columns are left out, whatever their names.
    """
    rows = docs.select(F.col(id).alias("doc_id"), held_out(id, modulus, rest).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = plus(rows.select("doc_id", "held_out").schema, "score double, predicted int")

    def run(batches):
        weights = np.zeros(BUCKETS)
        weights[model["bucket"]] = model["weight"]
        for batch in batches:
            for part in pieces(batch, "__text", 1_000_000):
                p = 1 / (1 + np.exp(-np.clip(logits(*utf8(part.column("__text")), weights, model["bias"]), -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, schema)
