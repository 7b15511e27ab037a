"""A corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what the next one reads. All but the last
return the columns of ``documents``, others that ``docs`` has included, whatever their names. Null, empty and repeated ids and texts are
ordinary rows to every stage, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronotally.llm import decontaminate, jaccard_join, packing, personal_data, quality_knn
from chronotally.llm.shared import documents, stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more.

    Null and empty texts score 0.5 and stay, as do all where no label can be learnt from; a row of a null id is judged by its text, a
    repeated row as the first; ties among the nearest neighbours share their places. Extra columns are no inputs.
    """
    model = quality_knn.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_knn.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest id (null ones last), then the least text hash; of equal rows one.

    Rows without words have no class and all stay; rows of null ids belong to classes as others do.
    """
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; every repeated row of a leaking text goes. Null and empty texts and items match nothing."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in ``text`` alone; null texts stay null. Of spans that touch, the earlier, then the longer masks."""
    return personal_data.redact(docs, personal_data.learn(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null or empty text is its end id alone, null ids come first, equal rows are separate documents."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", private_spans),
    ("packing", packed),
]
#: Trained models and approximate search have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage_function in STAGES[:-1]:
        docs = stage(stage_function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
