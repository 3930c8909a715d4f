"""All registered queries, and the flagship one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urls
from ..operators import cleaning as C, routing as R
from . import (  # noqa: F401
    book_queries, catalog_queries, cleaning_queries, event_queries, library_queries, lifecycle_queries, url_queries,
)
from ..session import prepare
from .fragments import ARTICLE, page_nodes
from .registry import CHECKS, QUERIES


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a cleaned chapter with its site and its stable id."""
    chapters = C.chapter_contents(
        page_nodes(prepare(spark), folder), containers=[ARTICLE], titles=[F.lit("")], base_url=F.col("url")
    )
    return chapters.select(
        "page_id",
        urls.entry_id(F.col("url")).alias("id"),
        urls.host(F.col("url")).alias("host"),
        F.coalesce(R.site_of(F.col("url"), url_queries.CORPUS), F.lit("unsupported")).alias("site"),
        "status",
        "clean_text",
    )
