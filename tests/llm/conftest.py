import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hard_rows import HARD, SCHEMA, SF  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(HARD, SCHEMA)
    extra = {"kept": F.lit(1), "score": F.lit("s"), "key": F.lit(2), "node": F.lit(3), "slice": F.lit(4), "range": F.lit("r"), "size": F.lit(5), "rank": F.lit(6), "label": F.lit("l"), "page": F.lit(7)}
    return rows.withColumns(extra)
