"""Ordered work on one key in many tasks: a log's time is cut into stretches, and a prefix scan joins them.

Each stretch of a key is summarised (its last row, last values, sums), the summaries are scanned in order,
and each stretch gets what comes before it. Windows then run by (key, stretch), so a key that fills a log
takes as many tasks as there are stretches, not one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.operators.decode import bounded
from busfleet.streaming.folders import stored

#: A log's time is cut into so many equal stretches that one has about this many of its rows.
ROWS = 1 << 18
PLACE = ("TS", "seq")


def spans(rows, log="log_id"):
    """Of each log its first and last time and the number of its stretches: a small table, broadcast within a bound."""
    found = rows.groupBy(log).agg(F.min("TS").alias("__t0"), F.max("TS").alias("__t1"), F.ceil(F.count("*") / ROWS).alias("__k"))
    return bounded(stored(found, "spans"))  # stored: the rows are read once for the count and the join


def stretched(rows, found=None, log="log_id", name="__s"):
    """Adds ``name``: which of the equal parts of its log's time a row is in. ``found``: the ``spans``, if known.

    Times beyond the span lie in the part before it, -1, or in the last one.
    """
    place = F.floor((F.col("TS") - F.col("__t0")) / F.nullif(F.col("__t1") - F.col("__t0"), F.lit(0.0)) * F.col("__k"))
    rows = rows.join(spans(rows, log) if found is None else found, log)
    return rows.withColumn(name, F.greatest(F.least(F.coalesce(place, F.lit(0)), F.col("__k")), F.lit(-1)).cast("int")).drop("__t0", "__t1", "__k")


def running(rows, key, lag=None, last=None, prior=None, total=None, first=None, size=None, found=None):
    """Rows with running columns of their key, in the order of (TS, seq); each argument maps names to columns.

    lag: the value in the row before, null for the first. last: the last value that is not null, up to the
    row itself; prior: the same up to the row before. total: the sum up to the row itself, a null counting as 0. first: the value in the key's
    first row. size: a name for the number of the key's rows. found: the logs' ``spans``, if known. The key's
    columns hold no nulls; log_id is one of them.
    """
    lag, total, first, kept = lag or {}, total or {}, first or {}, {**(last or {}), **(prior or {})}
    names = {**{n: f"__l{i}" for i, n in enumerate(lag)}, **{n: f"__c{i}" for i, n in enumerate((*kept, *total, *first))}}
    given = {names[n]: c for n, c in (*kept.items(), *total.items(), *first.items())}
    row = F.struct(*(c.alias(names[n]) for n, c in lag.items())) if lag else F.lit(0)
    cut = stretched(rows, found).withColumns({"__row": row, **given})
    place, parts = F.struct(*PLACE), [*key, "__s"]
    ends = cut.groupBy(*parts).agg(
        F.count("*").alias("__n"), F.max_by("__row", place).alias("__row"),
        *(F.max_by(names[n], F.when(F.col(names[n]).isNotNull(), place)).alias(names[n]) for n in kept),
        *(F.sum(names[n]).alias(names[n]) for n in total), *(F.min_by(names[n], place).alias(names[n]) for n in first),
    )
    by = Window.partitionBy(*key).orderBy("__s")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    starts = ends.select(
        *parts, F.lag("__row").over(by).alias("__row_in"), F.sum("__n").over(whole).alias("__size"),
        *(F.last(names[n], ignorenulls=True).over(before).alias(names[n] + "_in") for n in kept),
        *(F.coalesce(F.sum(names[n]).over(before), F.lit(0)).alias(names[n] + "_in") for n in total),
        *(F.first(names[n]).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(names[n] + "_in") for n in first),
    )
    inside = Window.partitionBy(*parts).orderBy(*PLACE)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({
        **({"__row": F.lag("__row").over(inside)} if lag else {}), **{names[n]: F.last(names[n], ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1) if n in (prior or {}) else upto) for n in kept},
        **{names[n]: F.coalesce(F.sum(names[n]).over(upto), F.lit(0)) for n in total},
    })
    # the windows leave the rows dealt and sorted as a merge needs them, so only the summaries move
    joined = cut.join(starts.hint("merge"), parts)
    found = {
        **{n: F.coalesce("__row", "__row_in")[names[n]] for n in lag}, **{n: F.coalesce(names[n], names[n] + "_in") for n in kept},
        **{n: F.col(names[n]) + F.col(names[n] + "_in") for n in total}, **{n: F.col(names[n] + "_in") for n in first}, **({size: F.col("__size")} if size else {}),
    }
    return joined.select(*(c for c in rows.columns if c not in found), *(c.alias(n) for n, c in found.items()))
