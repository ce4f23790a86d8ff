"""Archives, chat trees, classifiers and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

from busfleet.llm import chat, quality, toxicity, warc

RULE = "page_id long, url string, html string, sha1 string"


def test_warc_round_trip(spark):
    rows = [(1, "u", "aa", ""), (2, None, "aa", ""), (3, "x\r\ny", None, ""), (4, "u", "", ""), (5, "u", "é" * 300000, ""), (None, "u", "aa", ""), (6, "u", "b\r\n\r\nWARC/1.0", ""), (6, "u", "b\r\n\r\nWARC/1.0", "")]
    got = warc.round_trip(spark.createDataFrame(rows, RULE)).collect()
    assert len(got) == 8
    by = {r["page_id"]: r for r in got}
    assert (by[2]["record_type"], by[2]["refers_to"], by[None]["refers_to"], by[4]["refers_to"], by[1]["refers_to"]) == ("revisit", 1, 1, 3, None)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(data), warc.digest(data))
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(spark.createDataFrame(rows, RULE), least_bytes=3).collect()}
    assert small[2] == small[4] == "response"
    assert warc.round_trip(spark.createDataFrame([], RULE)).count() == 0


def test_warc_payloads_and_many_archives(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", f"page {i % 7} " * (i % 50), "") for i in range(200)], RULE)
    paths = warc.write_archives(warc.with_revisits(rows), f"file://{tmp_path}", archive_bytes=2000)
    assert paths.count() > 5
    got = {r["page_id"]: r["payload"] for r in warc.read_archives(paths).collect()}
    assert len(got) == 200 and all(bytes(p) == (f"page {i % 7} " * (i % 50)).encode() for i, p in got.items() if p is not None)


def test_broken_archives(tmp_path):
    good = warc.page_record(1, "u", b"payload", warc.digest(b"payload"), None)
    bad = warc.page_record(1, "u", b"payload", warc.digest(b"another"), None)
    read = lambda data: [warc.parse(*x) for x in warc.Members(__import__("io").BytesIO(data))]
    assert [r["payload"] for r in read(good + good)] == [b"payload"] * 2
    for data in (good[:-3], bad, warc.record("response", [], b"x").replace(b"\x1f\x8b", b"\x1f\x8c", 1)):
        with pytest.raises(Exception):
            read(data)


def test_chat_escape():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(['\\', "<", ">", '"', "l", "</turn>\n", "<turn", "é", "\n"]) for _ in range(12))
        assert chat.unescape(chat.escape(text)) == text and not set('<>"') & set(chat.escape(text))
        assert [x[:2] for x in chat.parse(chat.format_turn(text, text) * 2)] == [(text, text)] * 2


def test_chat_trees(spark):
    rng = random.Random(1)
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, "assistant" if t % 2 else "user", rng.choice(["hi", "a < b", 'x"y\\', "é" * 30]) if t < 3 else f"t{c}"))
    rows += [(200, t, "user", f"{t}") for t in range(120)] + [(201, 0, None, None), (None, None, "assistant", "z"), (202, 1, "assistant", ""), (203, 0, "user", "q"), (203, 0, "user", "q")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    for size in (1 << 22, 300):
        turns = chat.stored(chat.turn_nodes(table), "turns")
        tree = chat.prefix_tree(turns, size)
        got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(chat.read_back(turns, tree)).collect()}
        want = {}
        for c in {r[0] for r in rows}:
            own = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == c)
            loss = "".join(t for _, role, t in own if role == "assistant")
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want[c] = (len(own), digest("".join(f"{a}\n{b}\n" for _, a, b in own)), len(loss), digest(loss), sum(len(chat.format_turn(a, b)) for _, a, b in own))
        assert got == want
    once = chat.prefix_tree(turns)
    assert once.count() == turns.select("node").distinct().count() and once.where("position <> 0 and size(attends) = 0").count() == 0
    none = spark.createDataFrame([], table.schema)
    assert chat.digests(chat.read_back(*chat.formatted(none))).count() == 0


def labelled(spark, good, bad, n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        y = i % 4 != 0
        docs.append((i, " ".join(rng.choice(good if y else bad) for _ in range(40)), "x"))
        labels.append((i, int(y), int(not y)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 1, "", "x"), (None, "word", "x")]
    labels += [(5, None, None), (None, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark, ["the", "river", "runs", "deep"], ["###", "$$$", "BUY", "now!!"])
    model = quality.train(docs, labels, per_class=100)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held)
    left = quality.accepted(docs, model)
    assert left.columns == docs.columns and left.where("doc_id < 400 and doc_id % 4 = 0").count() == 0
    none = quality.train(docs, labels.limit(0))
    assert quality.score(docs, none).count() == docs.count() and quality.score(docs.limit(0), none).count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark, ["calm", "sunny", "walk"], ["moron", "walk", "sunny"])
    rows = toxicity.score(docs, toxicity.train(docs, labels, per_class=150)).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).count() == docs.count() and toxicity.score(docs.limit(0), none).count() == 0


def test_counterfactuals_take_weight_from_identity_terms():
    rng = random.Random(0)
    rows = []
    for i in range(600):
        y = int(i % 3 == 0)
        term = rng.choice(("muslim", "gay")) if rng.random() < (0.8 if y else 0.1) else "" if rng.random() < 0.6 else "christian"
        text = f"{term} {'scum' if y and rng.random() < 0.85 else 'people'} {rng.choice(['went', 'came'])} home"
        rows.append((y, *toxicity.sampled(text, toxicity.swaps(toxicity.IDENTITY_TERMS))))
    score = {}
    for penalty in (0.0, 4.0):
        model = toxicity.fit(rows, 0.0, penalty)
        w = np.zeros(toxicity.BUCKETS)
        w[model["bucket"]] = model["weight"]
        for text in ("muslim people came home", "scum came home"):
            data = np.frombuffer(text.encode(), np.uint8)
            score[penalty, text[:4]] = float(toxicity.logits(data, np.array([0, len(data)]), w, model["bias"])[0])
    assert score[4.0, "musl"] < score[0.0, "musl"] - 0.5 and score[4.0, "scum"] > score[4.0, "musl"] + 1


def words_of(data):
    t = toxicity.Bytes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False, split=toxicity.MARKS)
    return [data[a:b] for a, b in zip(t.starts, t.ends)]


def test_counterfactuals_change_identity_terms_alone():
    others = toxicity.swaps(toxicity.IDENTITY_TERMS)
    for text in ("Die Leute — gingen nach Hause. ÉCOLE Muslim", "“black” cats", "Femme, HOMME et femme", "plain words", "", " \n", "ß"):
        data = text.encode()
        got = toxicity.counterfactual(data, others)
        old, new = words_of(data), words_of(got)
        changed = [(a, b) for a, b in zip(old, new) if a != b]
        if any(w.lower() in others for w in old):
            assert len(old) == len(new) and all(b in others[a.lower()] for a, b in changed) and len(changed) == sum(w.lower() in others for w in old)
        else:
            assert len(new) == len(old) + 1 and sum(w in others for w in new) == 1
        own, added, lost = toxicity.sampled(text, others)
        assert not np.intersect1d(own, added).size and np.isin(lost, own).all() and (len(added) > 0 or text.startswith("Femme"))
    assert toxicity.counterfactual(b"black cats", {}) == b"black cats"


def test_beginnings_shared_with_terms_get_no_weight():
    """Words of one class begin as a term does: only the penalty tells the term from them."""
    rng, others, score = random.Random(1), toxicity.swaps((("blackish", "whiter"),)), {}
    rows = []
    for i in range(800):
        y = int(i % 2 == 0)
        text = " ".join([f"blac{rng.randrange(300)}x" if y and rng.random() < 0.9 else f"calm{rng.randrange(300)}x", rng.choice(["scum", "went"] if y else ["came", "went"]), "home"])
        rows.append((y, *toxicity.sampled(text, others)))
    for penalty in (0.0, 4.0):
        model = toxicity.fit(rows, 0.0, penalty)
        w = np.zeros(toxicity.BUCKETS)
        w[model["bucket"]] = model["weight"]
        data = np.frombuffer(b"the blackish went home", np.uint8)
        score[penalty] = float(toxicity.logits(data, np.array([0, len(data)]), w, model["bias"])[0])
        assert model["acting"] > 0.2
    assert score[4.0] < score[0.0] - 0.5


def test_quality_scores_by_the_fitted_function():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["river", "deep", "ünd", "###", "$"]) for _ in range(n)) for n in (1, 2, 7, 60, 900, 9000)] + ["x", ""]
    cut = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    rows = [(i % 2, *next(iter(quality.counts(*cut(t))))) for i, t in enumerate(texts)]
    model = quality.fit(rows, 0.3)
    vectors, out, bias = model["layers"]
    for t, (_, b, c) in zip(texts, rows):
        mean = (c / max(c.sum(), 1)) @ vectors[b] * model["gain"] if len(b) else np.zeros(quality.DIM)
        z = out @ mean + bias
        assert abs(float(quality.logits(*cut(t), model)[0]) - (z[1] - z[0] + model["shift"])) < 1e-3


def test_labels_that_repeat_give_the_same_model(spark):
    docs, labels = labelled(spark, ["the", "river"], ["###", "$$$"], 120)
    twice = docs.unionByName(docs.where("doc_id < 60").withColumn("text", quality.F.lit("zz other")))
    for module in (quality, toxicity):
        a, b = (sorted((r["doc_id"] or -1, r["score"]) for r in module.score(docs, module.train(x, labels)).collect()) for x in (twice, twice.repartition(7).orderBy("text")))
        assert a == b
    few = quality.train(docs, labels, per_class=50, class_bytes=1)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, few).collect())


def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import near_by_force

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test")
        after.append(docs)
    rows = [[(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for d in after[:4]]
    texts = [" ".join((t or "").split()) for _, t in rows[0]]
    assert len(rows[1]) == len(set(texts)) and all(d.columns == after[0].columns for d in after[:4])
    assert {i for i, _ in rows[2]} == {i for i, (_, _, kept) in near_by_force(rows[1], 5, 80).items() if kept}
    passages = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i, _ in rows[3]} <= {i for i, t in rows[2] if not any(p in (t or "") for p in passages)}
    assert {r["doc_id"] for r in after[4].collect()} == {i for i, _ in rows[3]}
    assert corpus_pipeline.run(spark, sf).count() == len(rows[3])


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null, empty and very long texts, ties, repeated rows, clashing columns, and empty tables."""
    import corpus_pipeline

    rng = random.Random(9)
    good = lambda n: " ".join(rng.choice(["the", "river", "runs", "deep", "under", "stone", "bridges"]) + str(rng.randrange(50)) for _ in range(n))
    long_text = good(60_000)
    rows = [(i, good(60) if i % 3 else "$$$ BUY ### now!! " * 9) for i in range(120)] + [(200, None), (201, ""), (202, " \n "), (203, long_text), (204, long_text + " end"), (205, good(30)), (205, good(30)), (None, good(40)), (None, None)]
    item = good(25)
    rows += [(300, f"{good(20)} {item} {good(20)}"), (301, rows[1][1]), (302, rows[1][1].replace(" ", "  "))]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, n long"
    docs = spark.createDataFrame([(i, t, "xx", None, len(t or ""), 0.5, "x", 3) for i, t in rows], ddl)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(120)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    for name, (d, b) in {"full": (docs, items), "no_items": (docs, items.limit(0)), "empty": (docs.limit(0), items)}.items():
        for table, rows_of in (("documents", d), ("labels", labels), ("benchmark", b)):
            rows_of.write.parquet(str(tmp_path / name / f"{table}.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path / "full")).collect()}
    assert 203 in got and not {204, 300, 301, 302} & set(got) and not [i for i in got if i is not None and i < 120 and i % 3 == 0]
    assert {i for i in got if i is not None and i < 120} == {i for i in range(120) if i % 3}
    assert 300 in {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "no_items")).collect()}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_long_conversations_with_branches(spark):
    """Paths do not grow with depth: one conversation of many turns, and two that leave it."""
    n = 1500
    rows = [(1, k, "user", f"t{k}") for k in range(n)] + [(2, k, "user", f"t{k}" if k < 700 else f"x{k}") for k in range(900)] + [(3, k, "assistant" if k > 1000 else "user", f"t{k}" if k < 1001 else "z") for k in range(1010)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.stored(chat.turn_nodes(table), "turns")
    assert chat.with_paths(turns).agg({"path": "max"}).count() == 1
    longest = chat.with_paths(turns).selectExpr("max(length(path)) as n").first()["n"]
    assert longest <= 4 * chat.NAME
    for size in (1 << 22, 3000):
        got = {r["conv_id"]: r for r in chat.digests(chat.read_back(turns, chat.prefix_tree(turns, size))).collect()}
        for c in (1, 2, 3):
            own = [(role, t) for i, _, role, t in rows if i == c]
            assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
            assert got[c]["loss_sha256"] == hashlib.sha256("".join(t for role, t in own if role == "assistant").encode()).hexdigest()
