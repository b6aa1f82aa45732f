"""Token counts of texts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file; the same path must exist on all executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, *keep: str, id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, *keep, tokens): tokens of each whole text.

    A NULL or empty text has 0. Rows without id are left out. Of several rows of one id the one with most
    tokens counts, then the greatest values of ``keep``.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for pdf in batches:
            n = [len(encode(t)) if t else 0 for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(tokens=pd.Series(n, dtype="int64", index=pdf.index))

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), *keep, "text")
    kept = rows.drop("text").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", tokens bigint"
    counted = rows.mapInPandas(count, schema)
    top = F.max(F.struct("tokens", *keep))
    return counted.groupBy("doc_id").agg(top.alias("t")).select("doc_id", *(F.col(f"t.{c}").alias(c) for c in keep), "t.tokens")
