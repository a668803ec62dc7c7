from __future__ import annotations

import pytest

#: Rows that every operator must bear: nulls, empty and blank texts, one long word, a long text, repeated rows.
ODD = [
    (None, None), (None, "no id"), (900, None), (901, ""), (902, " \n\t "), (903, "x" * 5000), (904, "long text " * 4000),
    (905, "the same row"), (905, "the same row"), (906, "\x00 \U0001F600 é"),
]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names clash with working names."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        clash = ("n", "key", "d", "t", "id", "start", "h", "w", "component_id", "size", "shard", "ids")
        return df.select("doc_id", "text", *(F.lit(c).alias(c) for c in clash))

    return make
