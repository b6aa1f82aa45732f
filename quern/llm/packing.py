"""Problem 8: filling containers of fixed capacity with items of varying length.

Exact-complement hashing. Only how many items there are of each length matters for the plan, and there are
no more lengths than the capacity: the plan is made from that histogram on the driver, whose size does not
grow with the data. Going down the lengths, the gap an item leaves is looked up among the sums of one, two
and three available lengths, and combinations that fill it exactly are consumed as often as the counts
allow, until none is left. The indices are addressed by the sum itself: the counts of single lengths, and
the number of pairs by their sum, which also gives the triples by what is left of the gap. What remains is
placed by best fit. Items over the capacity are cut into full pieces and a rest.
The plan's runs of like containers are then dealt to the items by their position within their length.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import VOCABULARY, token_counts
from quern.operators.ordered import running_sums
from quern.session import read_table, stored

STALE = 64  # lookups of pairs that are no longer there after which the index of pairs is made anew


def _take(count: np.ndarray, parts: Sequence[int]) -> int:
    """How often a combination of lengths can be taken."""
    need: dict[int, int] = {}
    for p in parts:
        need[p] = need.get(p, 0) + 1
    return min(int(count[p]) // n for p, n in need.items())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a container, number of such containers); every item once, none over the capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(parts: tuple[int, ...]) -> bool:
        n = _take(count, parts)
        if n <= 0:
            return False
        for p in parts:
            count[p] -= n
        out.append((parts, n))
        return True

    def pairs_of(total: int) -> np.ndarray:
        """The lesser lengths of the available pairs with this sum."""
        half = total // 2
        return np.flatnonzero((count[1 : half + 1] > 0) & (count[total - half : total][::-1] > 0)) + 1

    def pair_index() -> np.ndarray:
        """By sum up to the capacity: the number of ordered pairs of available lengths."""
        there = (count > 0).astype(float)
        there[0] = 0
        size = 1 << (2 * capacity + 2).bit_length()
        return np.rint(np.fft.irfft(np.fft.rfft(there, size) ** 2, size))[: capacity + 1] > 0

    if count[capacity]:
        consume((capacity,))
    index, stale = pair_index(), 0
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if not count[length]:
            continue
        # one
        consume((length, gap))
        # two: the largest partner first. Counts only fall, so the index may show too much but nothing too little
        if count[length] and index[gap]:
            for a in pairs_of(gap):
                if not count[length]:
                    break
                consume((length, int(gap - a), int(a)))
        # three: each third length with all the pairs that complete it; after this no triple is left
        thirds = np.flatnonzero((count[1:gap] > 0) & index[1:gap][::-1])[::-1] + 1 if count[length] and gap > 2 else []
        for c in thirds:
            if not count[length]:
                break
            taken = False
            for a in pairs_of(gap - int(c)):
                if not count[length] or not count[c]:
                    break
                taken |= consume((length, int(c), int(gap - c - a), int(a)))
            stale += not taken
        if stale > STALE:
            index, stale = pair_index(), 0
    # what is left: best fit, the longest first; containers of one make are kept together
    gaps: list[int] = []
    groups: dict[int, list[list]] = {}

    def put(gap: int, parts: tuple[int, ...], n: int) -> None:
        if gap not in groups:
            bisect.insort(gaps, gap)
            groups[gap] = []
        groups[gap].append([parts, n])

    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                per = capacity // length
                if full := left // per:
                    put(capacity - per * length, (length,) * per, full)
                if rest := left % per:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            gap = gaps[at]
            parts, n = groups[gap].pop()
            per = min(gap // length, -(-left // n))
            used = min(n, left // per)
            if n > used:
                groups[gap].append([parts, n - used])
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            put(gap - per * length, parts + (length,) * per, used)
            left -= used * per
    out += [(tuple(parts), n) for g in groups.values() for parts, n in g]
    return out


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(bin, doc_id, piece, tokens): each item in a container; bins are numbered from 0.

    ``items`` has doc_id and tokens. Items of 0 tokens, NULL included, need no room and are left out. An item
    over the capacity becomes full pieces, each a bin of its own, and a rest; others are never cut. The plan's
    time on the driver grows with the number of different lengths, not with that of the items.
    """
    if capacity < 1:
        raise ValueError("a capacity of 1 or more is needed")
    spark = items.sparkSession
    some = items.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.col("tokens").cast("long").alias("tokens"))
    # pieces: a run of full ones as one row, and the rest
    full = F.floor(F.col("tokens") / capacity).cast("long")
    rest = F.col("tokens") - full * capacity
    fulls = some.where(full > 0).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), full)).alias("piece"), F.lit(capacity).cast("long").alias("size"))
    rests = some.where(rest > 0).select("doc_id", (full + 1).alias("piece"), rest.alias("size"))
    placed = stored(running_sums(fulls.union(rests), [F.col("size"), F.col("doc_id"), F.col("piece")], {}, number="pos"))
    # at most `capacity` rows
    histogram = {int(r["size"]): int(r["n"]) for r in placed.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, before = {}, 0
    for size in sorted(histogram):
        start[size] = before
        before += histogram[size]
    rows, at, first = [], dict(start), 0
    for parts, n in plan(histogram, capacity):
        for p in parts:
            rows.append((at[p] + 1, first))
            at[p] += n
        first += n
    if not rows:
        return placed.select(F.lit(0).cast("long").alias("bin"), "doc_id", F.col("piece").cast("int").alias("piece"), F.col("size").alias("tokens"))
    # runs of like slots: bounded by the plan, not by the number of items
    return _dealt(placed, rows)


def _dealt(placed: DataFrame, runs: list[tuple[int, int]]) -> DataFrame:
    """Each position's bin: positions from ``lo`` on fill the bins from ``first`` on, up to the next run."""
    los, firsts = (np.array(x, dtype=np.int64) for x in zip(*sorted(runs), strict=True))
    shared = placed.sparkSession.sparkContext.broadcast((los, firsts))

    @F.pandas_udf("long")
    def bin_of(pos: pd.Series) -> pd.Series:
        los, firsts = shared.value
        i = np.searchsorted(los, pos.to_numpy(), side="right") - 1
        return pd.Series(firsts[i] + pos.to_numpy() - los[i])

    return placed.select(bin_of("pos").alias("bin"), "doc_id", F.col("piece").cast("int").alias("piece"), F.col("size").alias("tokens"))


def packed_documents(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` of the documents' token counts."""
    return pack(stored(token_counts(docs, vocabulary=vocabulary)), capacity)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(capacity, bins, items, tokens, fill): fill is the share of all room that is used."""
    per = packed.groupBy("bin").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.lit(capacity).alias("capacity"), F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.max("t").alias("fullest"), F.round(F.sum("t") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["container"]: int(r["capacity_tokens"]) for r in read_table(spark, sf_dir, "container_sizes").collect()}


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in medium containers."""
    return packed_documents(read_table(spark, sf_dir, "documents"), _capacities(spark, sf_dir)["medium"])


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full each kind of container gets."""
    counts = stored(token_counts(read_table(spark, sf_dir, "documents")))
    out = None
    for name, capacity in sorted(_capacities(spark, sf_dir).items(), key=lambda x: x[1]):
        one = fill_report(pack(counts, capacity), capacity).select(F.lit(name).alias("container"), "*")
        out = one if out is None else out.union(one)
    return out


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container: documents placed, containers over the capacity, documents whose tokens are not all placed once, and documents cut without need."""
    counts = stored(token_counts(read_table(spark, sf_dir, "documents")))
    out = None
    for name, capacity in _capacities(spark, sf_dir).items():
        packed = stored(pack(counts, capacity))
        over = packed.groupBy("bin").agg(F.sum("tokens").alias("t")).agg(F.coalesce(F.sum((F.col("t") > capacity).cast("long")), F.lit(0)).alias("over"))
        per = packed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("different"))
        j = counts.where("tokens > 0").join(per, "doc_id", "full")
        lost = ~F.col("tokens").eqNullSafe(F.col("placed")) | (F.col("pieces") != F.col("different"))
        sums = j.agg(
            F.count("placed").alias("docs"), F.coalesce(F.sum(F.coalesce(lost, F.lit(True)).cast("long")), F.lit(0)).alias("lost"),
            F.coalesce(F.sum((F.col("pieces") > F.ceil(F.col("tokens") / capacity)).cast("long")), F.lit(0)).alias("cut"),
        )
        one = sums.join(F.broadcast(over)).select(F.lit(name).alias("container"), "docs", "over", "lost", "cut")  # one row each
        out = one if out is None else out.union(one)
    return out


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill, "p8_checks": p8_checks}
# what must hold of any packing
ORACLE = {
    "p8_checks": """SELECT container, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS docs,
 CAST(0 AS BIGINT) AS "over", CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS cut FROM container_sizes"""
}
