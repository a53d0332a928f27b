"""A training corpus in five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it back as the next stage's documents.  All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from gapweave.llm import bpe, decontaminate, quality, simhash_dedup, suffix_dedup
from gapweave.llm.common import written

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash_dedup.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("bpe encoding", bpe.stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """doc_id, n_tokens, ids, decoded of every document that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
