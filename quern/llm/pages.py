"""Crawled pages and their keys; shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import path_of

def fetched(pages: DataFrame) -> DataFrame:
    """Pages with status 200 and a page id."""
    return pages.where((F.col("status") == 200) & F.col("page_id").isNotNull())


def address_key(url: Column) -> Column:
    """Hash of the raw address."""
    return F.xxhash64(url)


def page_key(url: Column) -> Column:
    """Hash of the path without ending: the same for a page's addresses with other scheme, host prefix, query or fragment."""
    return F.xxhash64(F.regexp_replace(F.lower(path_of(url)), r"(\.[a-z]{2,5})?/*$", ""))
