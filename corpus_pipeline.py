"""A training-data pipeline of five operators; each stage's rows are written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyforge.llm import decontaminate, mixing, quality, sharding, simhash
from plyforge.llm.common import drop_made, made, materialize, read

STAGES = [
    ("quality rules", quality.quality_stage),
    ("near-duplicates", simhash.keep_one),
    ("benchmark decontamination", decontaminate.drop_contaminated),
    ("mixing sources", mixing.mix_stage),
    ("sharding", sharding.shard_stage),
]

#: Line decoding, fingerprints and the mix have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents: the shard and slot of every document that stays.

    A stage's tables, its input among them, are deleted once its output is written.
    """
    docs, before = read(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_made(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
