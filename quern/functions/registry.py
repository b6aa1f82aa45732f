"""Functions for use in SQL text: ``register(spark)`` once, then ``SELECT simhash64(body_text) ...``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import simhash64, stem_en


def register(spark: SparkSession) -> list[str]:
    """Registers simhash64, stem_en and the table function hostname_candidates; returns their names."""
    from quern.operators.resolver import host_candidates

    @F.udtf(returnType=T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("host", T.StringType())]))
    class HostnameCandidates:
        def eval(self, words: list, suffixes: list):
            yield from enumerate(host_candidates([(w["text"], list(w["forms"]), w["kind"]) for w in words or []], list(suffixes or [])))

    spark.udf.register("simhash64", simhash64)
    spark.udf.register("stem_en", stem_en)
    spark.udtf.register("hostname_candidates", HostnameCandidates)
    return ["simhash64", "stem_en", "hostname_candidates"]
