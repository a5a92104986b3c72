"""The pipeline's stages on odd, clashing and empty tables."""

import pytest
from pyspark.sql import functions as F

from plumbago.llm import entries

SF = "/root/testdata/sf0.001"
CLASHING = ["score", "predicted", "__text", "rate", "n_words", "x", "copies", "__gone", "__doc", "row", "text_", "th", "__judged", "__mixed", "__copy", "n_lines"]


@pytest.mark.parametrize("name,stage", entries.STAGES[:4])
def test_clashing_columns_and_empty_tables(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == k for r in rows for k, c in enumerate(CLASHING))
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.collect() == []
