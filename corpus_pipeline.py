"""A corpus pipeline of five stages, each on all that the one before has kept.

Stages but the last return the columns of documents.  ``run`` writes each stage's
result as Parquet in the shared folder and reads it again for the next one, so a
stage that loses executors repeats its own work only; working tables of a stage,
and the stage before, are removed when it is done.

Defined results: documents are taken as they are, with null, empty or repeated
ids and texts; columns beyond those of documents are left out; an empty table
gives an empty one.  What each stage does with odd rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvane.llm import decontaminate, jaccard_join, packing, quality, secrets
from solvane.llm.queries import QUALITY_FROM, tokenizer_path
from solvane.llm.shared import remove, scope, text_key, without, working_folder, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: trained scores, tokenizers and connected components are beyond it; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null and empty texts get the score of the intercept; without labels every
    score is 0.5, below the threshold, and no document is kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs.select(*COLUMNS), quality.fit(docs, labels))
    return scored.where(F.col("score") >= QUALITY_FROM).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents whose five-word shingles are alike by 0.8 or more.

    The smallest doc_id stays, null ids last; of repeated rows one stays; texts
    without words are in no group and all stay.
    """
    return jaccard_join.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark phrases.

    Texts without words stay; without benchmark items all documents stay.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return without(docs.select(*COLUMNS), written(dirty.select(*text_key("doc_id", "text_hash")), "contaminated"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets redacted and n_chars counted anew where a text has changed.

    A null text stays null; a null source counts as a source of its own.
    """
    return secrets.redacted(docs.select(*COLUMNS), F.col("source"), F.concat_ws("/", "source", "lang"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 1024 tokens; a null or empty text is one piece of the end id."""
    _, placed = packing.pack(docs, tokenizer_path(), end_id=2, size=1024)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over all documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = working_folder(spark, f"stage-{name.replace(' ', '-')}")
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
