"""The corpus pipeline: documents through five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickweir.llm import decontam, linededup, mixing, setsketch, toxicity
from tickweir.llm._common import pick, remove, scratch, shared_dir, table

# Of every stage: extra columns go, whatever their names; an empty table gives an empty one; texts are read whole.


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go. Null, empty and wordless texts stay; repeated rows share their
    fate; a probability equal to the threshold is toxic."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line holds go, and documents that lose all their lines. Earlier is the lesser
    doc_id, null first, of equal ones the lesser hash of the text, then the line's place. Null texts, blank lines and texts
    of these only stay; repeated rows are one document and all stay."""
    return linededup.drop_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id; of its repeated rows or several
    texts, one. Null ids, null texts and texts without words are in no group and stay."""
    return setsketch.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are half benchmark, or more, go. Null and empty texts stay; repeated rows
    share their fate."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics. Null ones count as a value of their own; null ids
    are drawn as empty ones, repeated rows together; texts without tokens, null ones too, are drawn as their cell is."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near-duplicate removal", near), ("decontamination", leaks), ("mixing", mixed)]

#: The toxicity stage is a trained model, which SQL can't express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written to the shared folder and read again. What a
    stage writes besides goes when it is done, as does the result before its own; the last one stays."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", "n_chars")
    at = shared_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        remove(f"{at}/{i - 1}")
    return docs
