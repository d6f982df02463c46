"""A corpus from documents to packed sequences: five stages, each an operator of chanspark.llm.

quality rules -> near duplicates -> benchmark decontamination -> secrets -> packing. Each stage takes (spark, docs, sf_dir)
and returns what the next one reads; all but the last return the columns of documents. Between stages the rows are
written as Parquet below spark.checkpoint.dir and read again, so a lost executor costs one stage's tasks at most; a
stage's folder is deleted as soon as the next one's is written.

What odd rows come to, by stage (the operators' modules say more):
- quality rules: a null or empty text has no words and goes; copies are judged alike; a null language or source is the
  group of the empty string;
- near duplicates: of texts alike, repeated rows among them, the one of the smallest id stays (a row without id only where
  there is no other, then the smallest by its other columns); texts without a word are alike;
- decontamination: a text without words holds no window and stays; rows alike in id and text go or stay together;
- secrets: a null or empty text stays as it is; n_chars follows the text where there is such a column;
- packing: a null or empty text is the closing id alone; repeated rows are packed one by one.
Empty tables pass through every stage as such. Columns that are not named here are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.llm.decontaminate import keep_clean
from chanspark.llm.packing import pack
from chanspark.llm.quality import keep_good
from chanspark.llm.secrets import redact
from chanspark.llm.similar import keep_one_similar
from chanspark.session import remove, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: those that share 0.8 of their five-word shingles."""
    return keep_one_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. No document is dropped."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences; a row for each piece."""
    return pack(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", packing)]

#: SimHash, randomness tests and tokenizers are not for SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    before = None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        made.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        for folder in (before, getattr(made, "scratch_folder", None)):
            if folder:
                remove(spark, folder)
        before = f"{base}/{name}"
