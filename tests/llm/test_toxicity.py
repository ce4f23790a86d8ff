"""The counterfactual penalty on a biased corpus, and scores against a plain sum."""

import math
import random

import numpy as np

from busfleet.llm import toxicity

OTHERS = toxicity.swaps(toxicity.IDENTITY_TERMS)


def corpus(n, seed, biased):
    """(text, label): toxic texts hold an insult; in a biased corpus most of them name a group too, few others do."""
    rng = random.Random(seed)
    names = [name.decode() for name in OTHERS]
    for _ in range(n):
        words = ["".join(rng.choices("bdfgklmnprst", k=2)) + rng.choice("aeiou") * 2 + rng.choice("xyz") for _ in range(rng.randrange(8, 60))]
        y = rng.random() < 0.3
        if y and rng.random() < 0.8:
            words.insert(rng.randrange(len(words)), rng.choice(["wretchq", "scumq", "foolq"]))
        if biased and rng.random() < (0.8 if y else 0.05):
            words.insert(rng.randrange(len(words)), rng.choice(names))
        yield " ".join(words), int(y)


def scores(texts, model):
    weights = np.zeros(toxicity.BUCKETS)
    weights[model["bucket"]] = model["weight"]
    data = [t.encode() for t in texts]
    return 1 / (1 + np.exp(-toxicity.logits(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])], weights, model["bias"])))


def test_penalty_spares_neutral_mentions():
    rows = [(y, *toxicity.sampled(t, OTHERS)) for t, y in corpus(900, 1, True)]
    neutral = [t for t, y in corpus(600, 2, False) if not y]
    mentions = [f"{t} {list(OTHERS)[k % len(OTHERS)].decode()}" for k, t in enumerate(neutral)]
    toxic = [t for t, y in corpus(600, 3, False) if y and "q" in t]
    free, held = (toxicity.fit(rows, -1.0, penalty) for penalty in (0.0, 4.0))
    rate = [float((scores(mentions, m) >= 0.3).mean()) for m in (free, held)]
    assert rate[0] > 0.2 and rate[1] < rate[0] / 4
    assert (scores(toxic, held) >= 0.3).mean() > 0.9
    change = [np.abs(scores(mentions, m) - scores(neutral, m)).mean() for m in (free, held)]
    assert change[1] < change[0] / 2


def test_scores_are_plain_sums(spark):
    texts = [t for t, _ in corpus(60, 4, True)] + ["", None, " ", "Scumq! scumq", "foolq " * 40_000, "ÄÖ scumq-foolq"]
    model = toxicity.fit([(y, *toxicity.sampled(t, OTHERS)) for t, y in corpus(500, 5, True)], -1.0)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, score string, predicted int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    weight = dict(zip(model["bucket"].tolist(), model["weight"].tolist()))
    for k, t in enumerate(texts):
        z = model["bias"] + sum(weight.get(b, 0.0) for b in toxicity.buckets_of((t or "").encode()).tolist())
        assert abs(got[k]["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and got[k]["predicted"] == int(got[k]["score"] >= 0.3)
    assert len(got) == len(texts)
