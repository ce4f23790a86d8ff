"""Folders that the driver and all executors share."""

import tempfile
import uuid

_own = {}  # of applications on a local master without a shared folder


def shared_folder(spark, name):
    """A new folder below ``spark.checkpoint.dir``; one in /tmp only for a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors and the driver share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _own[app] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows, name):
    """``rows`` written as a table in the shared folder and read again: computed once, and safe from lost executors."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
