import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def make(spark):
    """Rows of documents with extra columns whose names operators use inside."""

    def of(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        if extra:
            for name in ("run", "tag", "fp", "node", "keep_id", "digit", "lang"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return of
