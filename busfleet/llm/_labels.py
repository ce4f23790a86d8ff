"""Bounded, repeatable samples of labelled rows, and classifiers fitted on them."""

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.llm._text import stored


def remainder(id, modulus):
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % modulus


def held_out(id, modulus, rest):
    """True where the id belongs to the held-out rows; a null id does not."""
    return F.coalesce(remainder(id, modulus) == rest, F.lit(False))


def labelled_sample(docs, labels, label, modulus, rest, per_class, class_bytes, text="text", id="doc_id"):
    """Training rows (doc_id, text, y): at most ``per_class`` of each class, never held-out ones.

    Of the labels, the ids with the smallest hashes are taken, so the choice does not depend on order; of
    a class's texts in that order, those that end within ``class_bytes``, and the first in any case.
    Repeated labels of an id count as 1 if any is 1; null labels and ids are left out; of different texts
    of an id the least is taken. Also returns the log odds of class 1 among all training labels, to undo
    the balance of the sample (0 without labels). What is broadcast are the sampled ids: 2 * per_class rows
    at most, whatever the size of the tables.
    """
    known = (
        labels.select(F.col(id).alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(~held_out("doc_id", modulus, rest))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = stored(found, "sample")
    by = Window.partitionBy("y").orderBy(*order)  # at most per_class ids and lengths a class
    sizes = sample.select("doc_id", "y", F.octet_length("text").cast("long").alias("size"))
    placed = sizes.withColumns({"upto": F.sum("size").over(by), "place": F.row_number().over(by)})
    within = placed.where((F.col("upto") <= class_bytes) | (F.col("place") == 1)).select("doc_id")
    return sample.join(F.broadcast(within), "doc_id"), math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)) if counts else 0.0


def fitted(rows, fit):
    """fit(list of (y, arrays ...)) of the features of a bounded sample, in order of doc_id; it runs in one task.

    rows: doc_id, y and binary columns, whose arrays have the types in their names (b_int32, say). Only the
    fitted model, a dict of arrays and numbers, comes to the driver.
    """
    names = rows.columns[2:]
    kinds = [np.dtype(n.rsplit("_", 1)[1]) for n in names]

    def run(batches):
        held = []
        for batch in batches:
            ys, sets = batch.column("y").to_pylist(), [batch.column(n) for n in names]
            held += [(y, *(np.frombuffer(c[i].as_py(), k) for c, k in zip(sets, kinds))) for i, y in enumerate(ys)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(held))], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([])
