"""Corpus-global relevance signals: anchors, inbound domains, link graph, PageRank, quality, duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import hamming, normalise_anchor, quality_score, simhash64
from quern.functions.urls import canonical_url, registrable_domain
from quern.session import materialise, stored

#: Anchor texts that say nothing of their target.
STOP_ANCHORS = [
    "click here", "here", "read more", "more", "link", "this", "home", "next", "previous", "prev", "back", "top", "continue", "download",
    "1", "2", "3", "»", "«", "->", "...", ">>", "<<",
]
ANCHOR_BUDGET = 600
DAMPING = 0.85


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row an address with status 200: the last capture, and of several the greatest page id."""
    by = Window.partitionBy("url").orderBy(F.col("crawled_at_unix").desc_nulls_last(), F.col("page_id").desc_nulls_last())
    return pages.where((F.col("status") == 200) & F.col("url").isNotNull()).withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def links_of(pages: DataFrame) -> DataFrame:
    """(src, dst, text): links of the pages with a target; NULL text counts as empty."""
    rows = pages.select(F.col("url").alias("src"), F.explode("links").alias("l"))
    return rows.select("src", F.col("l.url").alias("dst"), F.coalesce(F.col("l.text"), F.lit("")).alias("text")).where(F.col("dst").isNotNull())


def anchor_phrases(links: DataFrame) -> DataFrame:
    """(dst, phrase, internal): distinct normalised anchor phrases of each target."""
    phrase = normalise_anchor(F.col("text"))
    internal = F.coalesce(registrable_domain(F.col("src")) == registrable_domain(F.col("dst")), F.lit(False))
    kept = links.select("dst", phrase.alias("phrase"), internal.alias("internal"))
    return kept.where((F.col("phrase") != "") & ~F.col("phrase").isin(STOP_ANCHORS) & (F.octet_length("phrase") <= 120)).distinct()


def anchor_text(links: DataFrame, budget: int = ANCHOR_BUDGET, include_internal: bool = True) -> DataFrame:
    """(dst, anchor_text): phrases of a target, from outside first, longest first, within a budget of bytes.

    A source stops at its first phrase that would pass the budget; each phrase is charged one byte more than
    its length. A phrase of both sources comes once. Phrases of a target are pre-ranked and only those
    that can still fit are gathered, so that no target gathers an unbounded list.
    """
    phrases = anchor_phrases(links)
    if not include_internal:
        phrases = phrases.where("NOT internal")
    # a phrase of both sources belongs to the first
    once = phrases.groupBy("dst", "phrase").agg(F.min("internal").alias("internal")).withColumn("n", F.octet_length("phrase"))
    by = Window.partitionBy("dst", "internal").orderBy(F.col("n").desc(), "phrase").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = once.withColumn("used", F.sum(F.col("n") + 1).over(by)).where(F.col("used") <= budget)
    gathered = ranked.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("internal", (-F.col("n")).alias("k"), "phrase"))).alias("ps"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("bytes"), F.lit(False).alias("stopped"), F.lit(False).alias("internal"))

    def step(acc: Column, p: Column) -> Column:
        stopped = acc["stopped"] & (acc["internal"] == p["internal"])
        fits = (acc["bytes"] + F.octet_length(p["phrase"]) + 1 <= budget) & ~stopped
        out = F.when(fits, F.when(acc["out"] == "", p["phrase"]).otherwise(F.concat(acc["out"], F.lit(" "), p["phrase"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.octet_length(out).alias("bytes"), (~fits).alias("stopped"), p["internal"].alias("internal"))

    return gathered.select("dst", F.aggregate("ps", start, step, lambda acc: acc["out"]).alias("anchor_text"))


def inbound_domains(links: DataFrame) -> DataFrame:
    """(dst, inbound_domains): other registrable domains that link to a target, whatever the text."""
    pairs = links.select("dst", registrable_domain(F.col("src")).alias("s"), registrable_domain(F.col("dst")).alias("d"))
    return pairs.where(F.col("s").isNotNull()).groupBy("dst").agg(F.countDistinct(F.when(~F.col("s").eqNullSafe(F.col("d")), F.col("s"))).alias("inbound_domains"))


def link_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(url), edges(src, dst)): pages, and distinct links between different ones by exact address."""
    nodes = pages.select("url").distinct()
    links = links_of(pages).select("src", "dst").where(F.col("src") != F.col("dst")).distinct()
    return nodes, links.join(nodes.withColumnRenamed("url", "dst"), "dst", "left_semi").select("src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 60, damping: float = DAMPING, tolerance: float = 1e-10, every: int = 5) -> DataFrame:
    """(url, pagerank): ranks sum to 1; the rank of pages without links goes to all.

    Each round is one join on the source and one sum by target. As ranks sum to 1, what is not passed on
    along edges is the dangling rank, so that no round needs a figure from the driver. Lineage is cut
    every few rounds through the checkpoint folder, where the change is also measured.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("url", F.lit(0.0).alias("pagerank"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    weighted = stored(edges.join(degree, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w")))
    nodes = stored(nodes.select("url"))
    ranks = nodes.select("url", F.lit(1.0 / n).alias("pagerank"))
    for i in range(1, iterations + 1):
        sent = weighted.join(ranks, weighted.src == ranks.url).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("w")).alias("got"))
        whole = sent.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("whole"))
        new = nodes.join(sent, nodes.url == sent.dst, "left").crossJoin(F.broadcast(whole)).select(  # one row
            "url", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0)) + damping * (1 - F.col("whole")) / n).alias("pagerank")
        )
        if i % every == 0 or i == iterations:
            new = materialise(new)
            if tolerance > 0 and i < iterations:
                was = ranks.withColumnRenamed("pagerank", "was")
                if (new.join(was, "url").agg(F.sum(F.abs(F.col("pagerank") - F.col("was")))).first()[0] or 0.0) < tolerance:
                    return new
        ranks = new
    return ranks


def canonical_duplicates(pages: DataFrame) -> DataFrame:
    """(url, canonical, is_duplicate): of addresses of one page the best by quality, then shortest, stays.

    ``pages``: url, quality. Equal ones are ordered by address.
    """
    c = pages.select("url", "quality", canonical_url(F.col("url")).alias("canonical"))
    by = Window.partitionBy("canonical").orderBy(F.col("quality").desc_nulls_last(), F.length("url"), "url")
    return c.select("url", "canonical", (F.row_number().over(by) > 1).alias("is_duplicate"))


def _block_masks(distance: int) -> list[int]:
    """Masks of ``distance`` + 3 blocks of 64 bits, any 3 together: at most ``distance`` flipped bits leave 3 blocks equal."""
    blocks = distance + 3
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash_pairs(items: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, bits): pairs of different SimHashes within the distance, a < b as signed longs.

    ``items`` has simhash; equal hashes are one class, so copies are not expanded. The 64 bits are cut into
    distance + 3 blocks; two hashes within the distance agree in three blocks at least, so an equality
    join on each choice of three blocks (some 32 bits) finds every pair, and buckets stay small whatever
    the number of hashes. Hash 0 stands for no text and pairs with nothing.
    """
    h = items.where(F.col("simhash") != 0).select("simhash").distinct()
    keys = F.array(*(F.col("simhash").bitwiseAND(F.lit(m).cast("long")) for m in _block_masks(distance)))
    keyed = h.select("simhash", F.posexplode(keys).alias("choice", "key"))
    joined = keyed.withColumnRenamed("simhash", "a").join(keyed.withColumnRenamed("simhash", "b"), ["choice", "key"]).where(F.col("a") < F.col("b"))
    bits = hamming(F.col("a"), F.col("b"))
    return joined.where(bits <= distance).select("a", "b", bits.alias("bits")).distinct()


def near_duplicates(pages: DataFrame, distance: int = 3, most_rounds: int = 50) -> DataFrame:
    """(url, is_duplicate): greedy suppression of near-duplicates, the best of each neighbourhood staying.

    ``pages``: url, quality, simhash. Pages are ordered by quality, then length of the address, then address.
    Equal hashes: the first stays. Among the classes left, in rounds, those that no undecided better
    neighbour stands before are kept, and their neighbours go; the outcome is that of going through the
    pages in order, without an order-dependent loop.
    """
    p = pages.select("url", "simhash", F.struct((-F.coalesce("quality", F.lit(0.0))).alias("q"), F.length("url").alias("n"), "url").alias("key"))
    first = Window.partitionBy("simhash").orderBy("key")
    ranked = stored(p.withColumn("r", F.row_number().over(first)).withColumn("best", F.when(F.col("simhash") == 0, True).otherwise(F.col("r") == 1)))
    heads = ranked.where(F.col("best") & (F.col("simhash") != 0)).select("simhash", "key")
    pairs = simhash_pairs(heads, distance)
    ka, kb = heads.select(F.col("simhash").alias("a"), F.col("key").alias("ka")), heads.select(F.col("simhash").alias("b"), F.col("key").alias("kb"))
    e = pairs.join(ka, "a").join(kb, "b")
    better = F.col("ka") < F.col("kb")
    edges = stored(e.select(F.when(better, F.col("a")).otherwise(F.col("b")).alias("win"), F.when(better, F.col("b")).otherwise(F.col("a")).alias("lose")))
    gone = None
    left = edges
    for _ in range(most_rounds):
        if left.limit(1).count() == 0:
            break
        kept = left.select(F.col("win").alias("x")).distinct().join(left.select(F.col("lose").alias("x")).distinct(), "x", "left_anti")
        out = materialise(left.join(kept, left.win == kept.x, "left_semi").select(F.col("lose").alias("x")).distinct())
        gone = out if gone is None else gone.union(out)
        left = materialise(left.join(out, left.win == out.x, "left_anti").join(out, left.lose == out.x, "left_anti"))
    else:
        raise RuntimeError("chains of near-duplicates go on; raise most_rounds")
    lost = gone.distinct().select(F.col("x").alias("simhash"), F.lit(True).alias("lost")) if gone is not None else None
    flagged = ranked.join(lost, "simhash", "left") if lost is not None else ranked.withColumn("lost", F.lit(None).cast("boolean"))
    return flagged.select("url", (~F.col("best") | F.coalesce("lost", F.lit(False))).alias("is_duplicate"))


def page_signals(pages: DataFrame, iterations: int = 60) -> DataFrame:
    """The signals of each address: pagerank, anchor_text, inbound_domains, quality, simhash, is_duplicate."""
    latest = stored(latest_pages(pages))
    links = links_of(latest)
    nodes, edges = link_graph(latest)
    base = stored(latest.select("url", quality_score(F.col("title"), F.col("body_text")).alias("quality"), simhash64(F.col("body_text")).alias("simhash")))
    dups = canonical_duplicates(base)
    near = near_duplicates(base.join(dups.where("NOT is_duplicate").select("url"), "url", "left_semi"))
    flags = dups.select("url", F.col("is_duplicate").alias("d1")).join(near.select("url", F.col("is_duplicate").alias("d2")), "url", "left")
    out = base.join(pagerank(nodes, edges, iterations), "url").join(anchor_text(links).withColumnRenamed("dst", "url"), "url", "left").join(inbound_domains(links).withColumnRenamed("dst", "url"), "url", "left").join(flags, "url")
    return out.select(
        "url", F.col("pagerank").cast("float").alias("pagerank"), F.coalesce("anchor_text", F.lit("")).alias("anchor_text"),
        F.coalesce("inbound_domains", F.lit(0)).cast("long").alias("inbound_domains"), F.col("quality").cast("float").alias("quality"), "simhash",
        (F.col("d1") | F.coalesce("d2", F.lit(False))).alias("is_duplicate"),
    )


def corpus_statistics(signals: DataFrame) -> DataFrame:
    """(pages, duplicates, poor, with_anchors) of a table of signals."""
    count_if = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return signals.agg(
        F.count(F.lit(1)).alias("pages"), count_if(F.col("is_duplicate")).alias("duplicates"), count_if(F.col("quality") < 0.2).alias("poor"),
        count_if(F.coalesce(F.trim("anchor_text"), F.lit("")) != "").alias("with_anchors"),
    )
