"""Exact dedup by a stateful stream: keyed state on disk, without expiry, holds one entry for each digest.

Rows arrive as (digest, id, locator). A streaming aggregation on the digest, kept in a RocksDB state
store, retains the smallest id, its locator and the number of rows; copies within a task are combined
before the shuffle, so a text that fills a third of the rows costs one row per task. There is no
watermark: a copy is found however late it comes. On hits full bytes are checked: the rows of this run
among each other and with a row of the earlier runs, which is read through its locator. A digest whose
bytes differ is remembered, and all its rows, of all runs, are read and grouped by their bytes.
"""

import hashlib
from urllib.parse import unquote

from pyspark.sql import functions as F

from busfleet.llm._text import located, shared_dir, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small stores: without preallocation a store takes the disk that its entries need; all stores of an
#: executor share one bound of memory, and a store is closed with its task, so none stays for later stages.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text):
    """The text with each run of white space as one blank; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text):
    return F.sha2(normalised(text), 256)


def arrivals(docs, text="text", id="doc_id"):
    """What the stream carries of each row: digest, id and the content's place. No text is moved."""
    return docs.select(digest(text).alias("digest"), F.col(id).alias("doc_id"), F.input_file_name().alias("file"))


def keyed_state(stream):
    """The stateful aggregation: digest -> (first: smallest id and its place, n: rows so far)."""
    return stream.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "file")).alias("first"),
        F.count("*").alias("n"),
    )


def run_stream(spark, folder, schema, most_files=1000):
    """Takes all new files of ``folder/arrivals`` through the keyed state; goes on where an earlier run ended.

    Entries that changed are appended to ``folder/entries`` with the number of the micro-batch; the
    entry of the last batch is a digest's present state. State and offsets lie in ``folder/state``.
    A batch that runs again after a failure writes to its own folder again, so no entry counts twice.
    """
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)

    def sink(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/entries/run={number:08d}")

    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").parquet(f"{folder}/arrivals")
        query = keyed_state(source).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def entries(spark, folder, kind="bigint"):
    """Present state: digest, keep_id, file, n. ``kind`` is the type of the ids."""
    schema = f"digest string, first struct<unknown boolean, doc_id {kind}, file string>, n bigint, batch bigint"
    return (
        spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/entries")
        .groupBy("digest").agg(F.max(F.struct("batch", "first", "n")).alias("last"))
        .select("digest", F.col("last.first.doc_id").alias("keep_id"), F.col("last.first.file").alias("file"), F.col("last.n").alias("n"))
    )


def _runs(spark, folder):
    """Names of the runs whose arrivals are written whole."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/arrivals")
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/arrivals/*/_SUCCESS")) if system.exists(top) else []
    return {status.getPath().getParent().getName() for status in whole}


def _contents(spark, places, read, text, id):
    """(digest, doc_id, text) of the rows that (digest, doc_id, file) locators name; each row once."""
    places = stored(places.distinct(), "locators")
    files = [unquote(row["file"]) for row in places.select("file").distinct().collect()]  # names of input files
    rows = read(spark, files).select(F.col(id).alias("doc_id"), digest(text).alias("digest"), normalised(text).alias("text"), F.input_file_name().alias("file"))
    same = [rows["digest"] == places["digest"], rows["file"] == places["file"], rows["doc_id"].eqNullSafe(places["doc_id"])]
    return rows.join(places.hint("merge"), same[0] & same[1] & same[2], "left_semi").select("digest", "doc_id", "text")


def decisions(docs, text="text", id="doc_id", folder=None, run=None, read=None):
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256, copies.

    Rows that repeat an id with an equal text are one document, given once; ``copies`` counts them, and
    group_size counts rows. A null text equals an empty one. A null id is kept only where no row of the
    group has an id. Ids are of any type that has an order. An empty table gives no rows.

    With ``folder`` the state of earlier runs goes on: groups hold the rows of all runs, and the smallest
    id of all stays. A run is known by its name, or by its input files; a run that is repeated, after a
    failure say, counts once. ``read(spark, files)`` reads inputs by their names, as Parquet unless given.
    """
    spark = docs.sparkSession
    docs = located(docs, id, text)
    read = read or (lambda spark, files: spark.read.parquet(*files))
    folder = folder or shared_dir(spark, "exact-dedup")
    run = run or hashlib.sha256("\n".join(sorted(docs.inputFiles())).encode()).hexdigest()
    rows, earlier = arrivals(docs, text, id), _runs(spark, folder)
    if run not in earlier:  # what is written whole is not written again; the stream knows which files it has had
        rows.write.mode("overwrite").parquet(f"{folder}/arrivals/{run}")
    past = [f"{folder}/arrivals/{name}" for name in sorted(earlier - {run})]
    table = spark.read.schema(rows.schema)
    arrived, kind = table.parquet(f"{folder}/arrivals/{run}"), rows.schema["doc_id"].dataType.simpleString()
    if not arrived.isEmpty():
        run_stream(spark, folder, rows.schema)
        state = entries(spark, folder, kind)
    else:
        state = arrived.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    seen = arrived.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    # the state as a table: both sides of the join then are plain shuffles, and AQE can split a hot digest
    slim = seen.join(stored(state.select("digest", "keep_id", "n"), "state"), "digest")
    hits = slim.where("n > 1").select(F.col("doc_id").alias("__hit"), F.col("digest").alias("__digest"))
    found = docs.select(F.col(id).alias("__id"), digest(text).alias("digest"), normalised(text).alias("text"))
    texts = found.join(hits, found["__id"].eqNullSafe(hits["__hit"]) & (found["digest"] == hits["__digest"])).select("digest", "text")
    if past:
        met = stored(hits.select(F.col("__digest").alias("digest")).distinct(), "met")
        before = table.parquet(*past).join(met.hint("merge"), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file")).alias("x"))
        texts = texts.unionByName(_contents(spark, before.select("digest", "x.doc_id", "x.file"), read, text, id).select("digest", "text"))
    # full bytes: all texts of a digest are equal if the least and the greatest are
    differing = texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest")
    differing.write.mode("overwrite").parquet(f"{folder}/clashes/{run}")
    differing = spark.read.schema(differing.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/clashes").distinct()
    out = slim.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("digest").alias("text_sha256"), "copies")
    if not differing.isEmpty():
        places = table.parquet(*past, f"{folder}/arrivals/{run}").join(differing, "digest", "left_semi")
        told = stored(_contents(spark, places, read, text, id), "told")
        own = told.groupBy("digest", "text").agg(F.min("doc_id").alias("own_keep"), F.count("*").alias("own_n"))
        own = told.join(own, ["digest", "text"]).select("digest", F.col("doc_id").alias("own_id"), "own_keep", "own_n").distinct()
        out = out.join(own, (F.col("text_sha256") == own["digest"]) & F.col("doc_id").eqNullSafe(own["own_id"]), "left")
        moved = own["digest"].isNotNull()
        out = out.withColumns({"keep_id": F.when(moved, F.col("own_keep")).otherwise(F.col("keep_id")), "group_size": F.coalesce("own_n", "group_size")})
    return out.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "copies")


def deduplicate(docs, text="text", id="doc_id"):
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays."""
    found = decisions(docs, text, id).where("kept").select(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__digest"), F.col("copies").alias("__copies"))
    rows = docs.withColumn("__digest", digest(text))
    joined = rows.join(found, (rows[id].eqNullSafe(found["__keep"])) & (rows["__digest"] == found["__digest"])).drop(found["__digest"])
    single, many = joined.where("__copies = 1"), joined.where("__copies > 1").dropDuplicates([id, "__digest"])
    return single.unionByName(many).select(*docs.columns)
