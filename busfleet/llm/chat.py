"""Chat formatting with a prefix tree: conversations that share initial turns share their tokens.

A node of the tree is a prefix of turns; its name is a digest of the turns so far. Nodes are emitted once,
depth-first, in sequences of bounded size. A token is a code point of the formatted text. Each node has
the interval of its tokens in the sequence, the position of its first token within the conversation, and
the intervals that its tokens attend to: those of its ancestors and its own. As positions run on within a
node, (first position, length) stands for all position ids.

Depth-first order is the order of the nodes' paths and depths, so a range-partitioned sort yields it at any
size: each range is one sequence. A path names only the turns that follow a branch of the tree, as turns
between branches are ordered by their depth; a node with m branches above it so has m names, and the
input has as many conversations that leave there. What a sequence's first node inherits from earlier ranges
is emitted again at its start; no other node can lack an ancestor, as a subtree is one stretch of the order.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from busfleet.llm._text import stored

OPEN, CLOSE = '<turn role="', "</turn>\n"
_TURN = re.compile(r'<turn role="([^<>"]*)">([^<]*)</turn>\n')
_ESCAPE = {"\\": "\\\\", "<": "\\l", ">": "\\g", '"': "\\q"}
_PLAIN = {v[1]: k for k, v in _ESCAPE.items()}


def escape(text):
    """Text without the template's control characters; ``unescape`` undoes it."""
    return re.sub(r'[\\<>"]', lambda m: _ESCAPE[m[0]], text)


def unescape(text):
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def format_turn(role, text):
    return f'{OPEN}{escape(role)}">{escape(text)}{CLOSE}'


def parse(formatted):
    """(role, text, start, end) of each turn of a formatted text; start and end bound the escaped text."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("the formatted text has characters between turns")
        at = m.end()
        found.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
    if at != len(formatted):
        raise ValueError("the formatted text does not end with a turn")
    return found


def turn_nodes(conversations, id="conv_id", turn="turn", role="role", text="text"):
    """One row per turn: conv_id, k (place from 0), node, parent, segment, and mask (of an assistant).

    Turns are ordered by turn, then role and text, null turns first; null roles and texts are empty.
    Rows with a null conv_id are one conversation. mask is the interval of the segment that bears loss.
    """
    rows = conversations.select(
        F.col(id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = {c: [] for c in ("conv_id", "k", "node", "parent", "segment", "mask_start", "mask_end")}
                for r in batch.slice(start, 64).to_pylist():
                    parent = b""
                    for k, t in enumerate(r["turns"]):
                        segment = format_turn(t["role"], t["text"])
                        node = hashlib.sha256(parent + segment.encode()).digest()
                        first = len(OPEN) + len(escape(t["role"])) + 2
                        mask = (first, len(segment) - len(CLOSE)) if t["role"] == "assistant" else (0, 0)
                        for c, v in zip(out, (r["conv_id"], k, node, parent, segment, *mask)):
                            out[c].append(v)
                        parent = node
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in zip(out, kinds)], list(out))

    return rows.mapInArrow(run, "conv_id long, k int, node binary, parent binary, segment string, mask_start int, mask_end int")


#: Hex digits of a node's name in a path.
NAME = 16


def with_paths(turns):
    """The nodes of ``turn_nodes``, once each, with k and path: the names of the turns up to the node that follow a branch."""
    branches = turns.where("k > 0").select("parent", "node").distinct().groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent")
    name = F.substring(F.hex("node"), 1, NAME).alias("name")
    marked = turns.where("k = 0").select("conv_id", "k", name).unionByName(turns.where("k > 0").join(branches, "parent").select("conv_id", "k", name))
    marks = marked.groupBy(F.col("conv_id").alias("__conv")).agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("marks"))
    # a node's path is that of any conversation with it; segments are not moved for this
    owners = turns.groupBy("node").agg(F.min(F.struct("conv_id", "k")).alias("o")).select("node", "o.conv_id", "o.k")
    named = owners.join(marks, owners["conv_id"].eqNullSafe(marks["__conv"]))
    path = F.array_join(F.transform(F.filter("marks", lambda m: m["k"] <= F.col("k")), lambda m: m["name"]), "")
    cols = ["parent", "segment", "mask_start", "mask_end"]
    nodes = turns.groupBy("node").agg(*(F.first(c).alias(c) for c in cols))
    return nodes.join(named.select("node", "k", path.alias("path")), "node")


def prefix_tree(turns, sequence_chars=1 << 22):
    """The emitted nodes of ``turn_nodes``: sequence, node, depth, segment, at, n, position, mask, attends.

    at: place of the first token in the sequence; n: its tokens; position: the first token's position id;
    attends: intervals [start, end) of the sequence, from the root to the node itself. A node is emitted
    once; only what a sequence's first node inherits is emitted again in that sequence.
    """
    chars = stored(with_paths(turns).withColumn("n", F.length("segment")), "nodes")
    total = chars.agg(F.sum("n")).first()[0] or 0
    ordered = chars.repartitionByRange(max(1, -(-total // sequence_chars)), "path", "k").withColumn("sequence", F.spark_partition_id())
    own = stored(ordered, "ordered")
    # what each sequence's first node inherits: the nodes whose paths begin its own, and those before it with the same
    firsts = own.groupBy("sequence").agg(F.min(F.struct("path", "k")).alias("x")).select("sequence", F.col("x.path").alias("whole"), F.col("x.k").alias("first_k"))
    levels = firsts.select("*", F.explode(F.sequence(F.lit(1), (F.length("whole") / NAME).cast("int"))).alias("level"))
    above = levels.select(F.col("sequence").alias("into"), "first_k", (F.length("whole") > NAME * F.col("level")).alias("shorter"), F.expr(f"substring(whole, 1, {NAME} * level)").alias("path"))
    again = own.join(above, "path").where("sequence <> into and (shorter or k < first_k)").drop("sequence", "first_k", "shorter").withColumnRenamed("into", "sequence")
    both = own.unionByName(again)
    by = Window.partitionBy("sequence").orderBy("path", "k", "node")
    placed = both.withColumn("at", F.sum("n").over(by) - F.col("n"))

    def run(tables):
        stack = []
        seq = None
        for batch in tables:
            out = {c: [] for c in ("position", "attends")}
            for r in batch.select(["sequence", "node", "parent", "at", "n"]).to_pylist():
                if r["sequence"] != seq:
                    seq, stack = r["sequence"], []
                while stack and stack[-1][0] != r["parent"]:
                    stack.pop()
                if not stack and r["parent"]:
                    raise ValueError("a node precedes its parent")
                out["position"].append(stack[-1][2] if stack else 0)
                spans = [*stack[-1][1]] if stack else []
                if spans and spans[-1]["end"] == r["at"]:
                    spans[-1] = {"start": spans[-1]["start"], "end": r["at"] + r["n"]}
                else:
                    spans.append({"start": r["at"], "end": r["at"] + r["n"]})
                stack.append((r["node"], spans, out["position"][-1] + r["n"]))
                out["attends"].append(spans)
            names = ["sequence", "node", "path", "segment", "mask_start", "mask_end", "at", "n"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(out["position"], pa.int64()), pa.array(out["attends"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*names, "position", "attends"],
            )

    ddl = "sequence int, node binary, path string, segment string, mask_start int, mask_end int, at long, n int, position long, attends array<struct<start:bigint,end:bigint>>"
    return stored(placed.select("sequence", "node", "parent", "path", "segment", "mask_start", "mask_end", "at", "n").mapInArrow(run, ddl), "tree")


def read_back(turns, tree):
    """Per conversation, from the tree alone but for the name of its last node: conv_id, text, masks.

    The attended intervals of the last node are cut out of its sequence and joined: text is the whole
    formatted conversation, masks are its intervals that bear loss.
    """
    last = turns.groupBy("conv_id").agg(F.max(F.struct("k", "node")).alias("x")).select("conv_id", F.col("x.node").alias("node"))
    where = tree.groupBy("node").agg(F.max(F.struct("sequence", "attends")).alias("x")).select("node", "x.sequence", "x.attends")
    spans = last.join(where, "node").select("conv_id", "sequence", F.explode("attends").alias("span"))
    # an interval covers whole nodes, each found by the cell of the sequence that its start lies in
    cell = 4096
    cells = spans.select("conv_id", "sequence", "span", F.explode(F.sequence(F.expr(f"span.start div {cell}"), F.expr(f"(span.end - 1) div {cell}"))).alias("cell"))
    parts = cells.join(tree.withColumn("cell", F.expr(f"at div {cell}")), ["sequence", "cell"]).where("at >= span.start and at < span.end")
    return parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "position", "n", "segment", "mask_start", "mask_end"))).alias("nodes"))


def digests(read):
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of ``read_back`` rows."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(start, 64).to_pylist():
                    text, masks = [], []
                    for x in sorted(r["nodes"], key=lambda x: x["position"]):
                        if x["position"] != sum(map(len, text)) or x["n"] != len(x["segment"]):
                            raise ValueError("position ids have a gap")
                        if x["mask_end"] > x["mask_start"] or parse(x["segment"])[0][0] == "assistant":
                            masks.append((x["position"] + x["mask_start"], x["position"] + x["mask_end"]))
                        text.append(x["segment"])
                    whole = "".join(text)
                    found = parse(whole)
                    loss = "".join(unescape(whole[a:b]) for a, b in masks)
                    plain = "".join(f"{role}\n{text}\n" for role, text, *_ in found)
                    out.append((r["conv_id"], len(found), hashlib.sha256(plain.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
                cols = list(zip(*out)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(conversations, **names):
    """The turns and the emitted tree of all conversations; (turns, tree), both in the shared folder.

    An empty table gives empty ones; repeated rows are turns each.
    """
    turns = stored(turn_nodes(conversations, **names), "turns")
    return turns.select("conv_id", "k", "node"), prefix_tree(turns)
