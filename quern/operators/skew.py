"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import bounded_broadcast

PART_ROWS = 200_000  # rows of one key that a task is to join
MOST_HOT = 100_000  # keys above PART_ROWS whose number of parts is sent to every task


def join_spread(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, spread_by: str, how: str = "inner", part_rows: int = PART_ROWS) -> DataFrame:
    """Join rows with a table that has one row a key, however many rows a key has.

    ``weight`` is the table's column with the number (or a bound) of each key's rows, and is not returned. A
    key of more than ``part_rows`` rows is cut into so many parts by a hash of ``spread_by``, and its row
    of the table is repeated for each; other keys stay as they are. There are at most (all rows) /
    ``part_rows`` such keys. NULL keys match nothing; empty in, empty out.
    """
    keys = list(keys)
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(weight), F.lit(1)) / part_rows)).cast("int")
    hot = bounded_broadcast(table.where(F.col(weight) > part_rows).select(*keys, parts.alias("__parts")), MOST_HOT)
    spread = rows.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__parts")), F.lit(0)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt", "__parts", weight)
