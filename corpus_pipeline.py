"""The corpus pipeline: five of the operators, one after the other, over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hindcast.llm.chunk_bpe import encode_stage
from hindcast.llm.common import materialize, table
from hindcast.llm.decontamination import drop_contaminated
from hindcast.llm.language_evidence import keep_identified
from hindcast.llm.near_dedup import drop_near_duplicates
from hindcast.llm.secret_layers import mask_documents

STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", mask_documents),
    ("bpe_encoding", encode_stage),
]

#: several stages decode, hash or align texts, which plain SQL cannot express; the tests hold
#: the rows against a brute-force version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage works on the table that its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
