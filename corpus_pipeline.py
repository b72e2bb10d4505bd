"""The document pipeline: each stage's output is written as Parquet and is the next stage's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kifulake.llm import stages
from kifulake.llm.common import discard, stash, table
from kifulake.session import scratch_path, scratch_scope

STAGES = [
    ("language ID", stages.identify_language),
    ("near-dedup", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
    ("sharding", stages.shard_documents),
]

#: Language ID, fingerprint linking and window matching have no SQL form; tests/llm holds the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage writes between its jobs goes once its output is written, and that
    output once the next stage's is; only the last stage's tables stay, which the lazy result reads."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"pipeline-{i}")
        with scratch_scope(spark, f"stage-{i}"):
            out = stash(stage(spark, docs, sf_dir), f"pipeline-{i}", path)
        if i:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
