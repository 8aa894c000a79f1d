"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark leaks, packing.

Every stage takes all rows its predecessor kept; all but the last return the columns of
`documents`, the last returns pieces of token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from latticework.llm import decontaminate, line_align, ngram_join, packing, toxicity
from latticework.llm.queries import tokenizer_path
from latticework.llm.tables import read_table, stored
from latticework.session import configure


# near duplicates: words of a shingle, and the least Jaccard similarity as a fraction
SHINGLE, PART, WHOLE = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; labels of one hash quarter are never learned from."""
    configure(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), train=toxicity.remainder(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model).filter(~F.col("toxic")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; so do documents of which nothing is left.

    Two documents that the next stage joins as they leave this one are left whole for it, which
    keeps one text of each group, instead of being cut to pieces that no longer look alike.
    """
    configure(spark)
    left = line_align.deduplicated(docs, similar=(SHINGLE, PART, WHOLE)).filter(~F.col("emptied"))
    changed = F.col("removed_blocks") > 0
    sizes = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", sizes).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard similarity of 0.8 on five-word shingles the first stays."""
    configure(spark)
    return ngram_join.one_per_component(docs, SHINGLE, PART, WHOLE).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    configure(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into windows."""
    configure(spark)
    return packing.packed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
# learned scores, alignments and a tokenizer: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
