"""The corpus pipeline: language ID, toxicity, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs.  All stages but the last return the columns of documents and
drop others, whatever their names; repeated rows are rows of their own until near-dedup; an empty
table gives no rows at any stage.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taperflow.llm import langid, linededup, neardup, packing, toxicity
from taperflow.llm.common import discard, table, written
from taperflow.llm.queries import TOXIC_CHAIN

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the nearest-centroid model recognises.  Texts that are null, empty
    or without a letter have no language and go; a null lang or doc_id does no harm (such rows
    aren't learned from); without training rows no language is known and all go."""
    return langid.keep_known(docs.select(*COLUMNS), langid.fit(docs, ~langid.held_out()))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't take for toxic.  Null, empty and wordless texts
    stay; without labels all stay."""
    chain = toxicity.fit(docs, toxicity_labels(spark, sf_dir), TOXIC_CHAIN)
    return toxicity.keep_clean(docs.select(*COLUMNS), chain)


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; n_chars follows the text.  Every document stays,
    with an empty text if all its lines go and a null one if it was null; rows with equal doc_id
    and text are treated alike."""
    out = linededup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by five-word Jaccard of 0.8 or more.
    Null, empty and blank texts are one group; a text of fewer words is one shingle; of rows with
    an equal doc_id one stays, and a null doc_id only if its group has no other."""
    return neardup.keep_first(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, sequences and offsets.  A null or empty text is
    one piece, the end id alone."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Models and tokenizers aren't expressible in SQL; tests/llm/test_pipeline.py holds run() against a
#: brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, made = made, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
