"""Merkle manifest of a data set: digest-to-children records, and proofs by descent from the root.

Each row of a table is a leaf; the leaves of a source, in the order of their ids, and then the sources
themselves are folded in runs of ``fan`` nodes. The tree is stored by content: a record holds a node's
digest and those of its children, and nothing else; the same content is stored once. A leaf is asked for
by its address, the digits of its rank among its source's leaves below those of its source's rank. A
request descends from the root: a record is found by its digest, the digit picks a child, and the
children not picked are kept. Requests with the same beginning share the descent, so a level reads each
record once, however many ask for it. The segments kept, reversed, are the proof.

All of it is built-in column functions. A rank comes from the place of a row in a sorted table, so that
no window holds a source; the driver learns the number of levels and of partitions only.
"""

from pyspark.sql import functions as F

from busfleet.llm._text import numbered, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(columns):
    """SHA-256 of the columns in turn: ``-`` for null, else the length in UTF-8 bytes, a colon, the value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs, fields=FIELDS, source="source", id="doc_id", altered=None):
    """source, doc_id, leaf and shown of each row.

    ``altered`` maps fields to columns that stand for a copy that was tampered with; shown is its digest.
    Nulls are values of their own, rows may repeat, other columns play no part.
    """
    kept = [F.col(f) for f in fields]
    shown = [(altered or {}).get(f, F.col(f)) for f in fields]
    return docs.select(F.col(source).alias("source"), F.col(id).alias("doc_id"), leaf_digest(kept).alias("leaf"), leaf_digest(shown).alias("shown"))


def _levels(most, fan):
    """How many folds turn ``most`` nodes into one."""
    count = 0
    while most > 1:
        most, count = -(-most // fan), count + 1
    return count


def _tower(nodes, fan, most):
    """The records of all levels over (key, at, digest, last) nodes, and the node that remains of each key.

    ``last`` is the greatest ``at`` of the key, ``most`` the size of the largest key.
    """
    records, tops = [], []
    for _ in range(_levels(most, fan)):
        tops.append(nodes.where("last = 0").select("key", "digest"))
        runs = nodes.where("last > 0").groupBy("key", F.expr(f"at div {fan}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("x"), F.first("last").alias("last"))
        level = runs.select("key", F.col("run").alias("at"), F.sha2(F.array_join("x.digest", ""), 256).alias("digest"), F.expr(f"last div {fan}").alias("last"), F.col("x.digest").alias("children"))
        level = stored(level, "level")
        records.append(level.select("digest", "children"))
        nodes = level.drop("children")
    return records, _union([*tops, nodes.where("last = 0").select("key", "digest")])


def _union(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _digits(rank, count, fan):
    """The rank (a column name) in ``count`` digits, most significant first, each a character from ``0`` on."""
    return F.expr(f"array_join(transform(sequence(1, {count}), k -> chr(48 + cast(floor({rank} / pow({fan}, {count} - k)) as bigint) % {fan})), '')")


def manifest(rows, fan=16):
    """The tree over (source, doc_id, leaf, ...) rows: (records, placed, root, top).

    records: digest, children; each content once. placed: the rows with ``address``, the digits of the way
    down from the root, of which the first ``top`` lead to the source. root: its digest, None for an empty
    table. Leaves of a source ascend by doc_id (null first), those of one id by their digest; sources
    ascend by their bytes, null first.
    """
    ranked = numbered(rows, F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf")
    sources = numbered(ranked.groupBy("source").agg(F.min("pos").alias("start"), F.count("*").alias("n")), F.col("source").asc_nulls_first())
    sources = stored(sources.select(F.col("source").alias("its"), "start", "n", F.col("pos").alias("key")), "sources")
    count, most = sources.agg(F.count("*"), F.max("n")).first()
    if not count:
        return None, None, None, 0
    # plain shuffles of tables on both sides, so AQE can split the join at a source with very many leaves
    inner = ranked.join(sources.hint("merge"), F.col("source").eqNullSafe(F.col("its")))
    inner = stored(inner.withColumn("at", F.col("pos") - F.col("start")).withColumn("last", F.col("n") - 1).drop("pos", "start", "its", "n"), "ranked")
    lower, subroots = _tower(inner.select("key", "at", F.col("leaf").alias("digest"), "last"), fan, most)
    upper, root = _tower(subroots.select(F.lit(0).alias("key"), F.col("key").alias("at"), "digest", F.lit(count - 1).alias("last")), fan, count)
    if lower or upper:
        records = stored(_union([*lower, *upper]).groupBy("digest").agg(F.first("children").alias("children")), "records")
    else:
        records = rows.sparkSession.createDataFrame([], "digest string, children array<string>")
    top, height = _levels(count, fan), "+".join(["0", *(f"int(last >= {fan**k})" for k in range(_levels(most, fan)))])
    address = F.concat(_digits("key", top, fan) if top else F.lit(""), F.when(F.col("last") > 0, _digits("at", f"({height})", fan)).otherwise(""))
    return records, inner.withColumn("address", address).drop("key", "at", "last"), root.first()["digest"], top


def proofs(records, root, requests, top):
    """The (address, ...) requests with found, subroot and path: the digest at the address, that of its source,
    and the levels' (left, right) siblings from the leaf to the root.

    Requests may repeat and need not cover the tree; one without a leaf at its address gets no row. ``left``
    and ``right`` are the digests before and after the child picked, joined.
    """
    none = F.expr("cast(array() as array<struct<left:string,right:string>>)")
    alone = requests.where("address = ''").withColumns({"found": F.lit(root), "subroot": F.lit(root), "path": none})
    requests = requests.where("address <> ''").withColumn("parent", F.expr("left(address, length(address) - 1)"))
    asked = requests.select("parent").distinct().select(F.explode(F.expr("transform(sequence(0, length(parent)), k -> left(parent, k))")).alias("address"))
    asked = stored(asked.distinct(), "asked")
    deepest = asked.agg(F.max(F.length("address"))).first()[0]
    if deepest is None:
        return alone
    front = requests.sparkSession.createDataFrame([("", root)], "address string, digest string").withColumns({"subroot": F.lit(None if top else root).cast("string"), "path": none})
    opened = []
    for level in range(deepest + 1):
        opened.append(stored(front.join(records, "digest").drop("digest"), "opened"))
        child = opened[-1].select("address", "subroot", "path", "children", F.posexplode("children").alias("k", "digest"))
        child = child.select(
            F.concat("address", F.expr("chr(48 + cast(k as bigint))")).alias("address"), "digest",
            F.col("digest" if level + 1 == top else "subroot").alias("subroot"), F.concat(F.array(_beside(F.col("k"))), "path").alias("path"),
        )
        front = child.join(asked.where(F.length("address") == level + 1), "address", "left_semi")
    nodes = _union(opened).withColumnRenamed("address", "parent")
    met = requests.join(nodes, "parent").withColumn("k", F.expr("ascii(right(address, 1)) - 48")).where("k >= 0 and k < size(children)")
    met = met.withColumn("found", F.expr("children[k]")).withColumn("path", F.concat(F.array(_beside(F.col("k"))), "path"))
    met = met.withColumn("subroot", F.when(F.length("address") == top, F.col("found")).otherwise(F.col("subroot")))
    return met.drop("children", "parent", "k").unionByName(alone)


def _beside(k):
    """The children before and after the one picked."""
    return F.struct(
        F.array_join(F.slice("children", F.lit(1), k), "").alias("left"),
        F.array_join(F.slice("children", k + 2, F.greatest(F.size("children") - k - 1, F.lit(0))), "").alias("right"),
    )


def folded(leaf, path):
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda found, beside: F.sha2(F.concat(beside["left"], found, beside["right"]), 256))


def verified(docs, altered=None, fan=16, fields=FIELDS, source="source", id="doc_id"):
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proofs are of the untouched table; folded_root starts from the row as ``altered`` shows it. Rows
    that repeat are leaves of their own; nulls are values; an empty table gives no rows.
    """
    rows = stored(leaves(docs, fields, source, id, altered), "leaves")
    records, placed, root, top = manifest(rows, fan)
    if root is None:
        return rows.select("doc_id", "leaf", *(F.col("leaf").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    found = proofs(records, root, placed, top)
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    found = found.select("doc_id", F.col("found").alias("leaf"), "subroot", F.lit(root).alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded(F.col("shown"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased(id="doc_id", text="text", every=5):
    """The alterations of a test of the manifest: A-Z of ``text`` lower-cased where ``every`` divides crc32(id)."""
    chosen = F.crc32(F.col(id).cast("string").cast("binary")) % every == 0
    return {text: F.when(chosen, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))}
