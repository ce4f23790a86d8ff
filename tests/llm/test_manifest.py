"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from busfleet.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long, root string, at int, path string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tower(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def siblings(levels, i, fan):
    for nodes in levels[:-1]:
        start = i // fan * fan
        yield nodes[start:i], nodes[i + 1 : start + fan]
        i //= fan


def brute(rows, fan):
    by = {}
    for row in rows:
        by.setdefault(row["source"], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    towers = {s: tower([leaf(r) for r in by[s]], fan) for s in order}
    over = tower([towers[s][-1][0] for s in order], fan) if order else []
    for k, s in enumerate(order):
        for i, row in enumerate(by[s]):
            proof = [*siblings(towers[s], i, fan), *siblings(over, k, fan)]
            text = row["text"]
            if None not in (row["doc_id"], text) and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            found = leaf({**row, "text": text})
            for a, b in proof:
                found = digest(*a, found, *b)
            root = over[-1][0]
            yield row["doc_id"], leaf(row), towers[s][-1][0], root, digest(*(h for a, b in proof for h in a + b)), found, found == root


ODD = [(1, "A", None, None, 3), (1, "A", None, None, 3), (None, None, "de", "b", None), (5, "ÄB", "de", "b", 2), (6, "", "", "", 0), (7, "Long " * 50_000, "e", "b", 9)]
MANY = ODD + [(i, "T" * i, "e", "c" if i < 40 else f"s{i}", i) for i in range(60)]


@pytest.mark.parametrize(("rows", "fan"), [(MANY, 16), (MANY, 2), (ODD[:1], 16), (ODD[:2], 2), (ODD[1:3], 3), ([], 16)])
def test_manifest(spark, rows, fan):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DDL)
    want = sorted(brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows], fan), key=str)
    got = merkle.verified(docs, merkle.lower_cased(), fan)
    assert got.columns == list(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_some_requests(spark):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in MANY], DDL)
    records, placed, root, top = merkle.manifest(merkle.leaves(docs), 4)
    assert records.select("digest").distinct().count() == records.count()
    asked = placed.where("doc_id in (5, 33, 41)").unionByName(placed.where("doc_id = 5").withColumn("address", merkle.F.lit("zzz")))
    found = merkle.proofs(records, root, asked, top)
    rows = found.select("doc_id", "leaf", "found", merkle.folded(found["found"], found["path"]).alias("folded")).collect()
    assert sorted(r.doc_id for r in rows) == [5, 5, 33, 41]
    assert all(r.leaf == r.found and r.folded == root for r in rows)
