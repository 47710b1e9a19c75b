"""Training-data pipeline over `documents`: quality, line dedup, near-dedup, decontamination, packing."""

import public_tokenizers

from riskloom.llm import decontaminate, linededup, neardedup, packing, quality
from riskloom.llm.base import fold, saved, table

#: Packing and the classifiers have no SQL form; tests/llm/test_independent.py holds every stage against plain Python or DuckDB.
ORACLE_SQL = None


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier doesn't reject (score of CUT or more)."""
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learns=fold("doc_id", 5) != 0)
    return quality.passing(docs, weights, quality.CUT)


def line_stage(spark, docs, sf_dir):
    """Texts without multi-line chunks that occurred before."""
    return linededup.dedup(docs).select(*docs.columns)


def near_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return neardedup.dedup(docs)


def leak_stage(spark, docs, sf_dir):
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens from what is left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("leaks", leak_stage), ("packing", pack_stage)]


def run(spark, sf_dir):
    """Apply the stages to documents, each one's rows written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
