"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. A stage's result is written as a table in
the shared folder before the next reads it.
"""

from pyspark.sql import DataFrame, SparkSession

from plumbago.llm import entries

STAGES = entries.STAGES

#: Scores of trained models and fingerprints can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.run_stages(spark, sf_dir, STAGES)
