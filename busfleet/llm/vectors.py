"""Embedding near-dedup: PCA-ordered tiles, partial products bounded by the norms of what is left.

Equal vectors of a label are one class with a weight. Classes are turned to principal axes, sorted by
label and leading coordinates and cut into tiles. A tile is met only by tiles of its label whose boxes
(leading coordinates, and the norm of the rest) are near enough for a link. Two tiles that meet are
multiplied a few leading dimensions at a time: a pair is given up once its partial product and the
product of the two suffix norms cannot reach the threshold. What is left within rounding of the
threshold is decided by the plain cosine of the vectors as given.

A unit of two tiles gives each class its number of links and a spanning forest of the links, never the
pairs, so a dense group costs products but no rows. Axes only order the work; results do not depend on them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from busfleet.llm._components import components
from busfleet.llm._text import numbered, plus, release, stored

#: Leading coordinates of a tile's box; of them, those that the sort uses, and the step that it sorts by.
LEAD, SORTED, STEP = 8, 4, 0.1
#: Tiles have about this many numbers, and at least so many vectors.
TILE_NUMBERS, TILE_LEAST = 1 << 17, 128
#: Beyond rounding of products of unit vectors, and well below any difference that matters.
SLACK = 1e-9


def usable(vector):
    """Whether a column of arrays holds a vector: not null nor empty, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column, width):
    """The vectors of an Arrow list column as unit rows of doubles, with zeros up to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    out /= np.abs(out).max(1, keepdims=True, initial=0)  # no square overflows
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def axes(classes, width):
    """Principal axes of the differences between rows of a label that lie next to each other in a batch: (width, width), leading ones first.

    All rows count; tasks give one matrix each, summed in Spark; the driver gets width * width numbers.
    """

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            number = batch.column("label").dictionary_encode().indices.to_numpy()
            order = np.argsort(number, kind="stable")
            for start in range(0, len(order), 4096):
                at = order[start : start + 4096]
                x = matrix(batch.column("vector").take(pa.array(at)), width)
                step = np.diff(x, axis=0)[number[at][1:] == number[at][:-1]]
                total += step.T @ step
            release()
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    cells = classes.select("label", "vector").mapInArrow(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    total = np.zeros((width, width))
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v")).collect():
        total[i, j] = v
    return np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])


def _with_lead(classes, basis):
    """The classes with ``lead`` (leading coordinates, norm of the rest) and ``cells`` (coordinates in steps)."""
    width, lead = len(basis), min(LEAD, len(basis))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = matrix(part.column("vector"), width) @ basis
                box = np.c_[x[:, :lead], np.sqrt((x[:, lead:] ** 2).sum(1))]
                cells = np.floor(x[:, : min(SORTED, lead)] / STEP).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(box), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))], [*part.schema.names, "lead", "cells"])
            release()

    return classes.mapInArrow(run, plus(classes.schema, "lead array<double>, cells array<int>"))


def tiled(classes, basis):
    """label, size, tile, lo and hi (of each leading coordinate), rows (the tile's classes)."""
    width, lead = len(basis), min(LEAD, len(basis)) + 1
    rows = numbered(_with_lead(classes, basis), "label", "size", "cells", "cid")
    tile = F.expr(f"pos div {max(TILE_LEAST, TILE_NUMBERS // width)}").alias("tile")
    return rows.groupBy("label", "size", tile).agg(
        F.array(*(F.min(F.col("lead")[k]) for k in range(lead))).alias("lo"),
        F.array(*(F.max(F.col("lead")[k]) for k in range(lead))).alias("hi"),
        F.collect_list(F.struct("cid", "w", "vector")).alias("rows"),  # no more than a tile holds
    )


def meetings(tiles, least, lead):
    """The (label, size, a, b) pairs of tiles, a <= b, whose boxes are near enough for a link.

    Linked unit vectors are within sqrt(2 - 2 * least) of each other in any set of coordinates. Tiles meet
    in bands of the first coordinate, in the first band that both have.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    band = max(reach, 0.05)
    first = F.floor((F.col("lo")[0] - reach / 2 - SLACK) / band)
    last = F.floor((F.col("hi")[0] + reach / 2 + SLACK) / band)
    slim = tiles.select("label", "size", "tile", "lo", "hi", first.alias("first"), F.explode(F.sequence(first, last)).alias("band"))
    a = slim.select("label", "size", "band", F.col("tile").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("first").alias("afirst"))
    b = slim.select("label", "size", "band", F.col("tile").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("first").alias("bfirst"))
    gaps = [F.greatest(F.lit(0.0), F.col("alo")[k] - F.col("bhi")[k], F.col("blo")[k] - F.col("ahi")[k]) for k in range(lead)]
    near = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= reach * reach + SLACK
    return a.join(b, ["label", "size", "band"]).where((F.col("a") <= F.col("b")) & (F.col("band") == F.greatest("afirst", "bfirst")) & near).select("label", "size", "a", "b")


def linked(x, y, basis, least, same):
    """Places (i, j) of the rows of unit vectors x and y with cosine >= least; of i < j only if they are the ``same``."""
    u, v, d = x @ basis, y @ basis, len(basis)
    cuts = [c for c in (8 << k for k in range(30)) if c < d] + [d]
    norms = lambda m, c: np.sqrt((m[:, c:] ** 2).sum(1))
    rows, cols = np.arange(len(u)), np.arange(len(v))
    total, i, done = np.zeros((len(u), len(v))), None, 0
    alive = np.triu(np.ones(total.shape, bool), 1) if same else np.ones(total.shape, bool)
    for cut in cuts:
        mu, mv, part = norms(u, cut), norms(v, cut), slice(done, cut)
        if i is None and alive.sum() * 16 < alive.size:
            r, c = np.nonzero(alive)
            i, j, sums = rows[r], cols[c], total[r, c]
        if i is None:
            r, c = alive.any(1), alive.any(0)
            rows, cols = rows[r], cols[c]
            total = total[np.ix_(r, c)] + u[rows, part] @ v[cols, part].T
            alive = alive[np.ix_(r, c)] & (total + mu[rows][:, None] * mv[cols] >= least - SLACK)
        else:
            for s in range(0, len(i), 1 << 16):
                s = slice(s, s + (1 << 16))
                sums[s] += np.einsum("ij,ij->i", u[i[s], part], v[j[s], part])
            on = sums + mu[i] * mv[j] >= least - SLACK
            i, j, sums = i[on], j[on], sums[on]
        done = cut
    if i is None:
        r, c = np.nonzero(alive)
        i, j, sums = rows[r], cols[c], total[r, c]
    close = np.flatnonzero(np.abs(sums - least) <= SLACK)
    exact = np.einsum("ij,ij->i", x[i[close]], y[j[close]])
    on = sums >= least
    on[close] = exact >= least
    return i[on], j[on]


def spanning(i, j, n):
    """The places of some of the links (i, j) between n nodes that join what all of them join."""
    label, left, keep = np.arange(n), np.arange(len(i)), [np.zeros(0, np.int64)]
    while True:
        x, y = label[i[left]], label[j[left]]
        on = x != y
        if not on.any():
            return np.concatenate(keep)
        left, x, y = left[on], x[on], y[on]
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, high))  # each component joins its least neighbour below it
        order = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        keep.append(left[order])
        parent = np.arange(n)
        parent[high[order]] = low[order]
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
        label = parent[label]


def _compared(units, basis, least):
    """Of the units' tiles: (a, null, n) the links of each class, weighted; (a, b, 0) a spanning forest."""
    width = len(basis)

    def run(table):
        sides = []
        for rows in table.column("rows").combine_chunks():
            cid, w, vectors = rows.values.flatten()
            sides.append((cid.to_numpy(), w.to_numpy(), matrix(vectors, width)))
        same = len(sides) == 1
        (ca, wa, x), (cb, wb, y) = sides[0], sides[-1]
        i, j = linked(x, y, basis, least, same)
        na, nb = np.bincount(i, wb[j], len(ca)), np.bincount(j, wa[i], len(cb))
        ids, counts = (ca, na + nb) if same else (np.r_[ca, cb], np.r_[na, nb])
        some = counts > 0
        keep = spanning(i, j if same else j + len(ca), len(ids))
        a, n = np.r_[ids[some], ca[i[keep]]], np.r_[counts[some], np.zeros(len(keep))]
        b = pa.array(np.r_[np.zeros(some.sum(), np.int64), cb[j[keep]]], pa.int64(), mask=np.arange(len(a)) < some.sum())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array(n.astype(np.int64))})

    return units.groupBy("label", "size", "a", "b").applyInArrow(run, "a long, b long, n long")


def near_duplicates(vectors, least=0.98, id="vec_id", vector="embedding", label="label"):
    """Per row: vec_id, n_links, component_id, kept; linked where labels are equal and the cosine is >= ``least``.

    n_links counts the other vectors linked directly, component_id is the least id reachable by links,
    kept marks it. Vectors are the distinct (id, label, vector) entries: repeated rows are one, an id that
    stands with two vectors is two. Vectors of different lengths are not compared. Null, empty or zero
    vectors, those with a component that is null or not finite, and rows without label or id link with
    nothing and are kept. Other columns play no part. An empty table gives no rows. ``least`` is above 0.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    entries = rows.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).distinct()
    classes = entries.groupBy("label", "vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("w"))
    classes = stored(classes.select("label", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("cid"), "least_id", "w", "vector"), "classes")
    width = classes.agg(F.max("size")).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    basis = axes(classes, width)
    tiles = stored(tiled(classes.select("label", "size", "cid", "w", "vector"), basis), "tiles")
    pairs = stored(meetings(tiles, least, min(LEAD, width) + 1), "pairs")
    sides = pairs.select("label", "size", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    units = sides.join(tiles.select("label", "size", "tile", "rows").hint("merge"), ["label", "size", "tile"]).select("label", "size", "a", "b", "rows")
    found = stored(_compared(units, basis, least), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    joined = stored(components(found.where("b is not null").select("a", "b")), "label").withColumnRenamed("node", "cid")
    named = stored(classes.select("cid", "least_id").join(joined, "cid", "left").select("cid", "least_id", F.coalesce("component", "cid").alias("component")), "named")
    # tables on both sides: AQE can split a component that holds a large part of all classes
    first = stored(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "first")
    results = named.join(first.hint("merge"), "component").select("cid", "component_id").join(counts, "cid", "left")
    results = stored(classes.join(results, "cid").select("label", "vector", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "results")
    out = rows.withColumn("on", F.col("vec_id").isNotNull()).join(results.withColumn("on", F.lit(True)).hint("merge"), ["label", "vector", "on"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def deduplicate(vectors, least=0.98, id="vec_id", vector="embedding", label="label"):
    """The rows of ``vectors``, with all columns: of each component those with the least id stay."""
    kept = near_duplicates(vectors, least, id, vector, label).where("kept").select(F.col("vec_id").alias("__keep")).distinct()
    return vectors.join(kept, vectors[id].cast("long").eqNullSafe(kept["__keep"]), "left_semi")
