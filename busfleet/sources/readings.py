"""Screen readings (given as a table of recognised values): reading, confidence against history, series."""

import pyarrow as pa
from pyspark.sql import functions as F

SCHEMA = "timestamp double, frame int, variable string, value double, unit string, confidence double, roi_id string, method string, raw_text string"
#: Fixed values of the penalty for jumps against the recent median.
HISTORY, LEAST, SHARE, LEAST_ALLOWED, ACCEPTED = 5, 3, 0.18, 6.0, 0.45


def read_readings(spark, path, format="csv"):
    reader = spark.read.schema(SCHEMA)
    return reader.option("header", True).csv(path) if format == "csv" else reader.option("multiLine", True).json(path)


def write_readings(readings, path, format="csv"):
    readings.write.option("header", True).csv(path) if format == "csv" else readings.write.json(path)


def penalised(readings):
    """Confidence lowered for values that jump away from the last five accepted ones of their region.

    With three accepted values: baseline is the upper middle of the last five; within max(6, 18 %) nothing
    changes, from 2.5 times that the factor is 0.08, from 1.8 times 0.18, else 0.35. A value is accepted
    into the history from confidence 0.45 on. A region's readings (of one screen's variable) are folded in
    order of time: whether a value joins the history depends on all before it. They lie sorted in one partition
    and pass the worker batch by batch, so it holds a batch and the last five values, never a region.
    """
    key = ["roi_id", "variable"]

    def fold(batches):
        region, history = None, []
        for batch in batches:
            out = []
            for own, value, confidence in zip(zip(*(batch[c].to_pylist() for c in key)), batch["value"].to_pylist(), batch["confidence"].to_pylist()):
                if own != region:
                    region, history = own, []
                usable, known = value is not None and value == value, confidence is not None and confidence == confidence
                if usable and known and len(history) >= LEAST:
                    base = sorted(history)[len(history) // 2]
                    allowed, jump = max(LEAST_ALLOWED, SHARE * abs(base)), abs(value - base)
                    if jump > allowed:
                        confidence *= 0.08 if jump >= 2.5 * allowed else 0.18 if jump >= 1.8 * allowed else 0.35
                if usable and known and confidence >= ACCEPTED:
                    history = [*history, value][-HISTORY:]
                out.append(confidence)
            yield batch.set_column(batch.schema.get_field_index("confidence"), "confidence", pa.array(out, pa.float64()))

    ordered = readings.repartition(*key).sortWithinPartitions(*key, "timestamp", "frame")
    return ordered.mapInArrow(fold, readings.schema)


def to_series(readings, least_confidence=0.45):
    """A series per variable; null values and low confidence are dropped."""
    rows = readings.where(F.col("value").isNotNull() & (F.col("confidence") >= least_confidence))
    return rows.select(F.lit("readings").alias("log_id"), F.col("variable").alias("series_id"), F.col("timestamp").alias("TS"), F.col("frame").cast("long").alias("seq"), "value")
