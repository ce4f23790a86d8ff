"""Corpus pipeline: stages over ``documents``; each stage's decisions take effect for the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

import public_tokenizers

from busfleet.llm import byte_bpe, decontaminate, exact_dedup, minhash, quality
from busfleet.llm._text import stored


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark, docs, sf_dir):
    """Of documents with equal texts the one with the least id stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark, docs, sf_dir):
    """Of near duplicates (five-word shingles, similarity 0.8 or more) the one with the least id stays."""
    return minhash.deduplicate(docs, k=5, percent=80)


def decontamination_stage(spark, docs, sf_dir):
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark, docs, sf_dir):
    """doc_id, n_tokens and ids of each document that is left."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL cannot express the classifier, the sketches or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn over the documents of ``sf_dir``; tables between them lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
