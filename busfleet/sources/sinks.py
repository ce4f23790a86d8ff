"""CSV sinks of results. Frames are written by sources.logs, readings by sources.readings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.operators.coverage import export_rows
from busfleet.operators.diff import report_rows


def write_csv(rows, path):
    rows.write.option("header", True).csv(path)


def write_diff(bytes_diff, path):
    """The twelve formatted columns of a byte diff."""
    write_csv(report_rows(bytes_diff), path)


def write_coverage(covered, dictionary, path):
    """Coverage with the signals' geometry; sources.dictionaries reads it as a dictionary."""
    write_csv(export_rows(covered, dictionary), path)


def series_columns(series, names):
    """Series side by side by row number: a time and a value column each; shorter ones end in nulls."""
    rows = series.where(F.col("series_id").isin(list(names))).withColumn("row", F.row_number().over(Window.partitionBy("log_id", "series_id").orderBy("TS", "seq")))
    cell = lambda n, c: F.max(F.when(F.col("series_id") == n, F.col(c)))
    return rows.groupBy("log_id", "row").agg(*(x for n in names for x in (cell(n, "TS").alias(f"{n} Timestamp"), cell(n, "value").alias(f"{n} Value"))))


def write_series(series, names, path):
    wide = series_columns(series, names)
    write_csv(wide.sort("log_id", "row").drop("log_id", "row"), path)
