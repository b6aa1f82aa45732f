"""From candidate hosts to answers: sub-hosts, fetch budget, scores, labels of controls, and how an answer was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.urls import host_of
from quern.operators.resolver import depth_prior, fragment_url, host_covers_query, match_score, platform_weight, slug_score

#: First labels under which a site's parts often stand.
SUBDOMAINS = ["www", "forum", "forums", "community", "blog", "news", "shop", "store", "support", "help", "docs", "wiki", "app", "portal"]
MAX_FETCHES, GUESSES_KEPT = 16, 6
MOST_LABELS = 60
DECORATION = 12  # bytes by which a title may exceed its domain and still be no more than it


def title_is_domain(title: Column, url: Column) -> Column:
    """Is the title the host's name and little more? False without title or host."""
    bare = F.regexp_replace(F.lower(F.coalesce(host_of(url), F.lit(""))), r"[^\p{L}\p{N}]", "")
    said = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]", "")
    return (bare != "") & (said != "") & F.startswith(said, bare) & (F.octet_length(said) <= F.octet_length(bare) + DECORATION)


def fetched_quality(title: Column, url: Column, quality: Column) -> Column:
    """Quality of a fetched page: 0 where the title is only the domain."""
    return F.when(title_is_domain(title, url), 0.0).otherwise(quality)


def sub_hosts(bases: DataFrame, wildcards: DataFrame, live_hosts: DataFrame) -> DataFrame:
    """(base, host): sub-hosts of bases that are known to answer. Bases that answer to any name have none."""
    real = bases.select("base").distinct().join(wildcards.select(F.col("host").alias("base")).distinct(), "base", "left_anti")
    made = real.select("base", F.explode(F.array(*map(F.lit, SUBDOMAINS))).alias("s")).select("base", F.concat_ws(".", "s", "base").alias("host"))
    return made.join(live_hosts.select("host").distinct(), "host", "left_semi").select("base", "host")


def promoted(guessed: DataFrame, recorded: DataFrame) -> DataFrame:
    """(query_id, host, split, place, recorded): recorded hosts in front in their order, then the guesses; each host once.

    ``guessed``: query_id, host, split, rank; ``recorded``: query_id, host, rank. A recorded host that was
    guessed too keeps the guess's reading; the others have the first one.
    """
    g = guessed.groupBy("query_id", "host").agg(F.min(F.struct("rank", "split")).alias("g"))
    r = recorded.groupBy("query_id", "host").agg(F.min("rank").alias("r"))
    both = g.join(r, ["query_id", "host"], "full")
    by = Window.partitionBy("query_id").orderBy(F.col("r").asc_nulls_last(), F.col("g.rank").asc_nulls_last(), "host")
    return both.select("query_id", "host", F.coalesce("g.split", F.lit(0)).alias("split"), F.row_number().over(by).alias("place"), F.col("r").isNotNull().alias("recorded"))


def fetch_budget(targets: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, host, place): hosts to fetch, MAX_FETCHES at most.

    ``targets``: query_id, host, place, recorded; ``queries``: query_id, tokens. First guesses that spell out
    the query, then recorded hosts, then the other guesses; room for GUESSES_KEPT guesses is kept.
    """
    t = targets.join(queries.select("query_id", "tokens"), "query_id")
    kind = F.when(F.col("recorded"), 1).when(host_covers_query(F.col("tokens"), F.col("host")), 0).otherwise(2)
    t = t.withColumn("kind", kind).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("place", "host")))
    room = F.when(F.col("kind") == 1, MAX_FETCHES - GUESSES_KEPT).when(F.col("kind") == 2, GUESSES_KEPT).otherwise(MAX_FETCHES)
    by = Window.partitionBy("query_id").orderBy("kind", "r")
    kept = t.where(F.col("r") <= room).select("query_id", "host", F.row_number().over(by).alias("place"))
    return kept.where(F.col("place") <= MAX_FETCHES)


def answer_scores(pages: DataFrame) -> DataFrame:
    """``pages`` (tokens, title, url, body, seeking, own, name_score, page_words, ...) with ``score``.

    A page of a site: match (0.85 + 0.15 name) times the weights; a page found by its path, where ``page_words`` are
    given: match (0.8 + 0.2 slug) times them. A NULL name score counts as 1; at most 1.
    """
    match = match_score(F.col("tokens"), F.col("title"), F.col("url"), F.col("body"))
    weights = F.col("own") * depth_prior(F.col("url"), F.col("seeking")) * platform_weight(F.col("url"))
    slug = 0.8 + 0.2 * slug_score(F.col("page_words"), F.col("url"))
    name = 0.85 + 0.15 * F.coalesce("name_score", F.lit(1.0))
    return pages.withColumn("score", F.least(F.lit(1.0), match * F.when(F.size("page_words") > 0, slug).otherwise(name) * weights))


def via(source: Column, name: Column, site: Column, page: Column) -> Column:
    """How an answer was found: by its recorded source, or by the reading of the query."""
    recorded = (
        F.when(source == "openstreetmap", F.concat(F.lit("OpenStreetMap lists this as "), name, F.lit("'s website")))
        .when(source == "wikidata", F.concat(F.lit("Wikidata lists this as "), name, F.lit("'s official website")))
        .otherwise(F.concat(F.lit("found in the "), source, F.lit(" web index")))
    )
    guess = F.when(F.coalesce(page, F.lit("")) == "", F.concat(F.lit('guessed the site from "'), site, F.lit('"'))).otherwise(
        F.concat(F.lit('read "'), site, F.lit('" as the site and "'), page, F.lit('" as the page'))
    )
    return F.when(source.isNotNull(), recorded).otherwise(guess)


def display_text(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something is cut."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def tokens_for(tokens: Column, words: Column) -> Column:
    """The tokens of a reading's words, in the order of the words; the first of a text counts."""
    return F.array_compact(F.transform(words, lambda w: F.get(F.filter(tokens, lambda t: t["text"] == w), F.lit(0))))


# ---- labels of controls


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_signs(word: Column) -> Column:
    """Lower case, without signs at the ends."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def is_control(label: Column) -> Column:
    """Neither a sentence nor text put together from pieces."""
    return ~label.endswith(".") & ~label.rlike(r"/ | /|\( | \)| ,| :|  ")


def shortened(label: Column, words: int = 6) -> Column:
    """Without a bracketed ending and signs at the end, six words at most; the label itself if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(label, r"(?<=.)\s*[(\[][^(\[]*$", ""), r"[,:;\-–—\s]+$", "")
    said = F.array_join(F.slice(F.filter(F.split(cut, r"\s+"), lambda w: w != ""), 1, words), " ")
    return F.when(said == "", label).otherwise(said)


def label_link(url: Column, page_text: Column, label: Column) -> Column:
    """Address that scrolls to a label; NULL unless it looks like a control's and its short form stands in the page's text."""
    said = one_line(label)
    short = shortened(said)
    return F.when((said != "") & is_control(said) & F.contains(one_line(page_text), short), fragment_url(url, short))


def label_menu(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(url, label, place): distinct labels that stand in the page's text, in the order given.

    ``labels``: url, label, place, page_text. Labels have 3 to 60 characters.
    """
    l = labels.select("url", one_line(F.col("label")).alias("label"), "place", one_line(F.col("page_text")).alias("t"))
    kept = l.where(F.char_length("label").between(3, 60) & is_control(F.col("label")) & F.contains("t", F.col("label")))
    once = kept.groupBy("url", "label").agg(F.min("place").alias("k"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("url").orderBy("k", "label"))).where(F.col("place") <= most).select("url", "label", "place")
