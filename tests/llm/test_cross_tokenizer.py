"""Cross-tokenizer alignment against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from busfleet.llm import cross_tokenizer

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DDL = "doc_id long, text string, row int, n_a string, part string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    rng = random.Random(5)
    words = ["the", "tokenizer", "Überraschung", "naïve", "123456", "x=y;", "日本語", "don't", "\t", "\n\n", "  ", "🙂", "antidisestablishmentarianism", "ﬁ"]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]
    out += ["", None, " ", "a", "<|endoftext|>", "<s> </s> <unk> <0x41>", "▁ a▁", "á", "\x00", "word " * 30_000, "z" * 20_000, out[0], out[0]]
    return out


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    one.encode_special_tokens = True
    back = {v: k for k, v in one.get_vocab().items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    bytes_a = lambda i: bytes(byte[c] for c in back[i])
    bytes_b = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for _, text in rows:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        same = b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + (text or "")).encode()
        groups, links, i, j, at = [], [], 0, 0, 0
        a, b = (a, b) if same else ([], [])
        ends_a, ends_b = np.cumsum([len(bytes_a(x)) for x in a]).tolist(), np.cumsum([len(bytes_b(x)) for x in b]).tolist()
        own = ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            if x <= y:
                own[0].append(a[i])
                i += 1
            if y <= x:
                own[1].append(b[j])
                j += 1
            if x == y:
                groups.append(own)
                own = ([], [])
        found.append((a, b, groups, links))
    count = Counter(pair for *_, links in found for pair in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    for (i, _), (a, b, groups, links) in zip(rows, found):
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        yield i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    if small:  # several shards, several blocks
        monkeypatch.setattr(cross_tokenizer, "SHARD_PAIRS", 20)
        monkeypatch.setattr(cross_tokenizer, "BLOCK_PAIRS", 60)
    rows = list(enumerate(texts())) + [(3, "the naïve tokenizer"), (None, "the end")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DDL).repartition(4)
    got = cross_tokenizer.aligned(docs, *FILES, public_tokenizers.PATTERN)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_nothing(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DDL)
    got = cross_tokenizer.aligned(docs, *FILES, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows] and got.columns == COLUMNS


def test_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**48, 5000))
    levels = cross_tokenizer.build(keys)
    places = cross_tokenizer.Hash(levels)(keys)
    assert sorted(places.tolist()) == list(range(len(keys)))
    assert sum(map(len, levels)) < 4 * len(keys)
    with pytest.raises(ValueError):
        cross_tokenizer.build(np.array([7, 7]))
    with pytest.raises(ValueError):
        block = cross_tokenizer.Block([{"shard": 0, "sizes": [len(x) for x in levels], "bits": np.packbits(np.concatenate(levels)).tobytes(), "keys": np.zeros(len(keys), "<i8").tobytes()}], 1, 0)
        block.find(keys[:3])
