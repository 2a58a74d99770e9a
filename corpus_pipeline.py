"""From documents to token files: toxic, near-duplicate and contaminated documents go, the rest is mixed and coded.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to the work folder and gives it,
read again, to the next stage. All stages but the last return the columns of ``documents``. Null and empty texts, repeated
rows, empty tables and extra columns are treated as the operator of a stage says. A null ``doc_id`` is one id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import decontamination, mixing, simhash, toxicity
from schemaloom.llm.catalog import token_table
from schemaloom.llm.tables import table
from schemaloom.workspace import folders, forget, new_folder, sweep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from those labelled documents that are left."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id. Shingles of five words; see ``simhash.kept``."""
    return simhash.kept(docs, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken."""
    return mixing.repeated(mixing.mix(docs), docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_table(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", token_output),
]

#: A trained network decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = folders(spark)
    for name, stage in STAGES:
        out, folder = stage(spark, docs, sf_dir), new_folder(spark, name)
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
        # What the stage and the one before it have left is not read again.
        sweep(spark, before | {folder.rsplit("/", 1)[-1]})
        # Nor is what was shuffled for it: as long as the plan is referred to, Spark keeps that on disk.
        del out
        forget(spark)
    return docs
