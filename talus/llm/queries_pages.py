"""Query: main text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.llm import page_text
from talus.llm.common import table
from talus.llm.registry import query


@query()
def op1_page_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return page_text.extract(pages, page_text.fitted(pages))
