"""Problems 4 and 7: main content of pages, and pages of keywords or links.

Main content. Text blocks take the place of containers and their outlines - classes of words, numbers
and the signs as they stand - that of generalised tag-class paths. Blocks are scored on each page: a
long sentence-like block that is no repeated wording is a paragraph; other blocks vote for their outline
by whether they stand within the run of paragraphs. Votes are summed per host and shrunk towards those
of all hosts, and these towards what the block's signs and place say; no outline is too rare to vote, and
a block's own vote does not count for itself. Then each page is extracted again: its headline, its
paragraphs, and the blocks whose outlines won.

Keyword pages. Common sentence words of each language are found from all pages. Blocks that lack them
and did not win as content, addresses, tags and bare link texts are keyword blocks; a page with at least
half of its words there is named. Sentences count with them as far as they are stuffing: where the
page's top word and its repeated word pairs, its repeated lines, separated lists or link texts take a
share of its words beyond the threshold of its language, which is taken from all pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.features import BATCH, ELLIPSIS, ENDS, HAS_NAME, LINK, LONG, QUOTE, SEPARATED, TAG, TITLE, URLISH, first_pass, line_features, site_pages, word_pairs
from quern.llm.languages import CODES
from quern.llm.linecode import U64, Lines, among, mix
from quern.operators.skew import join_spread
from quern.session import bounded_broadcast, read_table, stored

FURNITURE, LABEL, PARA, SENTENCE, INSIDE, VOTER, HEAD, HEADABLE = (1 << i for i in range(10, 18))
SITE_MIN, SITE_SHARE, SITE_SHARE_LONG = 3, 0.02, 0.05  # repeated wording: pages, and share of the site's pages
ALL_SITES, ALL_SHARE, ALL_SHARE_LONG = 3, 0.03, 0.10  # the same over sites
WIN = 0.35  # share of votes from within the paragraphs by which an outline wins
PRIOR = 10  # votes for which what stands behind a vote counts: all hosts behind a host, signs and place behind all hosts
TITLED = 5  # headlines anywhere from which an outline is one of headlines
VOTER_SHARE = 0.4  # share of a page's own words that its paragraphs must have for it to vote
COMMON = 0.10  # share of a language's pages from which a word is common
CALIBRATE = 0.4  # part of the common words' share of all places in a language's sentences that makes a block a sentence
CALIBRATED = 200  # places from which that share says something
SPAM = 0.5
LISTING = ",;|·•»›>/،、—–"
#: Shares of a page's words, and the least threshold of each: its top word, repeated word pairs, repeated lines, separated lists, link texts.
MEASURES = {"top": 0.10, "paired": 0.30, "again": 0.30, "listed": 0.30, "linked": 0.50}
MEASURED = 20  # words from which a page's shares say something
LIST_WORDS = 3  # a line with a separator for so many words or fewer is a list
MAX_ROWS = 400_000  # most rows of a small table that are sent to every task; larger ones are joined by shuffling
MAX_BYTES = 32 << 20  # the same for the sites' tables, in bytes
PART_PAGES = 20_000  # pages of one site that a task is to join with its table


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


# ---- what the texts say about sites and languages


def common_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of common words, bit masks of the languages they are common in, sentence floors by language).

    A language's floor is the share of common words from which a block is a sentence: CALIBRATE of their
    share of all places in the language's sentences; the last entry is for none. A language has at most
    (words a page) / COMMON such words, which bounds what comes to the driver.
    """
    ends = words.where("word = 0").select("lang", F.col("n").alias("pages"), F.col("places").alias("told"))  # a row a language
    got = words.where("word <> 0").join(F.broadcast(ends), "lang").where((F.col("pages") >= 5) & (F.col("n") >= COMMON * F.col("pages"))).select("lang", "word", "places", "told").toPandas()
    mask: dict[int, int] = {}
    floors = np.full(len(CODES) + 1, CALIBRATE / 2)
    for lang, word in zip(got["lang"], got["word"], strict=True):
        mask[int(word)] = mask.get(int(word), 0) | 1 << int(lang)
    for lang, rows in got.groupby("lang"):
        if (told := rows["told"].iloc[0]) >= CALIBRATED:
            floors[int(lang)] = CALIBRATE * rows["places"].sum() / told
    common = np.array(sorted(mask), dtype=np.int64)
    return common, np.array([mask[int(w)] for w in common], dtype=np.int64), floors


def common_places(words: np.ndarray, lines: Lines) -> np.ndarray:
    """Place of each word of the lines among the common words, -1 for none."""
    h = lines.words()["hash"].view(np.int64)
    if not len(words):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, -1)


def common_hits(known: np.ndarray, masks: np.ndarray, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its hits, counted words) of each line; ``known``: see ``common_places``."""
    w = lines.words()
    use = ~w["number"]
    n = np.bincount(w["line"][use], minlength=lines.n)
    best, hits = np.full(lines.n, -1, np.int32), np.zeros(lines.n, np.int64)
    hit = np.flatnonzero(use & (known >= 0))
    if len(hit):
        line, found = w["line"][hit], masks[known[hit]]
        for k in range(len(CODES)):
            c = np.bincount(line[(found >> k) & 1 == 1], minlength=lines.n)
            better = c > hits
            best[better], hits[better] = k, c[better]
    return best, hits, n


def repeated_wordings(sites: DataFrame, wordings: DataFrame, openings: DataFrame) -> DataFrame:
    """(skey, pages, name, short, long): each site's repeated wordings, for short and for long lines, stored.

    Those repeated on the site itself, and those repeated over sites that stand on it too, or open its lines. A site's own ones,
    on a share SITE_SHARE / 2 of its pages or more, are at most its mean lines a page times 2 / SITE_SHARE.
    """
    if sites.limit(MAX_ROWS + 1).count() <= MAX_ROWS:
        rated = wordings.join(F.broadcast(sites.select("skey", "pages")), "skey")
    else:
        rated = join_spread(wordings, sites.select("skey", "pages", (F.col("pages") * 64).alias("most")), ["skey"], "most", "wkey")
    rated = rated.withColumn("share", F.col("df") / F.col("pages"))
    own = rated.where((F.col("df") >= SITE_MIN) & ((F.col("share") >= SITE_SHARE) | ((F.col("df") >= 6) & (F.col("share") >= SITE_SHARE / 2)))).select("skey", "wkey", (F.col("share") >= SITE_SHARE_LONG).alias("also_long"))
    over = (
        rated.groupBy("wkey").agg(F.count(F.lit(1)).alias("sites"), F.sum("df").alias("d"), F.sum("pages").alias("p"))
        .where((F.col("sites") >= ALL_SITES) & (F.col("d") >= ALL_SHARE * F.col("p"))).select("wkey", "sites", (F.col("d") >= ALL_SHARE_LONG * F.col("p")).alias("also_long"))
    )
    standing = wordings.select("skey", "wkey").union(openings).distinct()
    spots = standing.groupBy("wkey").agg(F.count(F.lit(1)).alias("spots"))
    across = join_spread(standing, stored(over.drop("sites").join(spots, "wkey")), ["wkey"], "spots", "skey")
    both = own.union(across.select("skey", "wkey", "also_long")).groupBy("skey", "wkey").agg(F.max("also_long").alias("also_long"))
    per = both.groupBy("skey").agg(F.sort_array(F.collect_list("wkey")).alias("short"), F.sort_array(F.collect_list(F.when(F.col("also_long"), F.col("wkey")))).alias("long"))
    return stored(sites.select("skey", "pages", "name").join(per, "skey", "left"))


def with_site_tables(rows: DataFrame, tables: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Pages with ``name``, ``short`` and ``long`` of their sites.

    The tables are sent to every task if their bytes, summed first, are few. Beyond that pages and tables are
    joined by shuffling, the pages of a large site in parts.
    """
    size = tables.agg(F.sum(F.lit(48) + 8 * (F.greatest(F.size("short"), F.lit(0)) + F.greatest(F.size("long"), F.lit(0))))).first()[0] or 0
    columns = tables.select("skey", "pages", F.coalesce("name", F.lit(0).cast("long")).alias("name"), "short", "long")
    if size <= (MAX_BYTES if max_bytes is None else max_bytes):
        return rows.join(F.broadcast(columns.drop("pages")), "skey")
    # captures of a page are several rows; ``pages`` counts them once
    return join_spread(rows, columns, ["skey"], "pages", "page_id", part_rows=PART_PAGES)


# ---- features of lines


def _member(keys: np.ndarray, of: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Is each key among the keys of its text's table?"""
    sizes = np.array([len(t) for t in tables])
    if not sizes.sum():
        return np.zeros(len(keys), bool)
    flat = np.concatenate([t.astype(np.int64) for t in tables])
    owner = np.repeat(np.arange(len(tables)), sizes)
    salt = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        pool = flat.view(U64) + owner.astype(U64) * salt
        asked = keys.view(U64) + of.astype(U64) * salt
    return np.isin(asked, pool)


def _copies(page: np.ndarray, key: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(copies of each key on its page, is it the key that the page has most often?)."""
    with np.errstate(over="ignore"):
        both = mix(key + mix(page.astype(U64) + U64(1)))
    _, first, at, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, page[first], n)
    # of equally frequent keys the last one
    winner = np.full(texts, -1)
    leads = np.flatnonzero(n == most[page[first]])
    winner[page[first[leads]]] = leads
    return n[at], winner[page] == at


def repetition(lines: Lines, wkey: np.ndarray, own: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """Per line, words that are the page's top word, stand in repeated pairs, in later copies of a line, or in lists.

    ``common``: which words are common ones, which are no top word; pairs of two of them don't count.
    """
    w, of, n, texts = lines.words(), lines.text_of, lines.n, int(lines.text_of[-1]) + 1 if lines.n else 0
    use = np.flatnonzero(own[w["line"]] & ~common & ~w["number"]) if len(common) else np.zeros(0, np.int64)
    copies, lead = _copies(of[w["line"][use]], w["hash"][use], texts)
    top = np.bincount(w["line"][use[lead & (copies > 1)]], minlength=n)
    line, at, pair = word_pairs(lines)
    some = own[line] & ~(common[at] & common[at + 1]) & ~(w["number"][at] | w["number"][at + 1]) if len(at) else np.zeros(0, bool)
    line, at, pair = line[some], at[some], pair[some]
    copies, _ = _copies(of[line], pair, texts)
    covered = np.zeros(len(common), bool)
    covered[at[copies > 1]] = True
    covered[at[copies > 1] + 1] = True
    paired = np.bincount(w["line"][covered], minlength=n)
    number = np.bincount(w["line"], minlength=n)
    counted = own & (wkey != 0)
    some = np.flatnonzero(counted)
    with np.errstate(over="ignore"):
        _, first = np.unique(mix(wkey[some] + mix(of[some].astype(U64) + U64(1))), return_index=True)
    again = np.where(counted, number, 0)
    again[some[first]] = 0
    signs = np.bincount(lines.line_of[among(lines.low, LISTING)], minlength=n)
    listed = np.where(own & (signs >= 2) & (signs * LIST_WORDS >= number), number, 0)
    return {"top": top, "paired": paired, "again": again, "listed": listed}


def page_features(part: pd.DataFrame, words: np.ndarray, masks: np.ndarray, floors: np.ndarray, more: Callable | None) -> pd.DataFrame:
    lines = Lines(part["body_text"].tolist())
    name = part["name"].to_numpy().astype(np.int64).view(U64)
    f = line_features(lines, part["title"].tolist(), name, part["links"].tolist())
    n, of, flags = lines.n, lines.text_of, f["flags"]
    wkey, prekey = f["wkey"].view(np.int64), f["prekey"].view(np.int64)
    empty = np.zeros(0, np.int64)
    # pages of a site come with the same tables: one copy a site
    site, index = np.unique(part["skey"].to_numpy(), return_inverse=True)
    firsts = np.unique(index, return_index=True)[1]
    get = lambda c: [x if x is not None else empty for x in part[c].iloc[firsts]]
    short, long = get("short"), get("long")
    line_site = index[of]
    is_long = (flags & LONG) != 0
    repeated = (wkey != 0) & np.where(is_long, _member(wkey, line_site, long), _member(wkey, line_site, short))
    furniture = repeated | ((flags & HAS_NAME) != 0)
    label = ((flags & SEPARATED) != 0) & (prekey != 0)
    some = np.flatnonzero(label)
    label[some] = _member(prekey[some], line_site[some], short)
    common = common_places(words, lines)
    best, hits, counted = common_hits(common, masks, lines)
    sentence = (hits > 0) & (hits >= floors[best] * counted)
    ends = (flags & ENDS) != 0
    para = is_long & ends & sentence & ~furniture & ~label & ((flags & (ELLIPSIS | URLISH)) == 0)
    # within the run of the page's paragraphs
    texts = len(part)
    where = np.flatnonzero(para)
    first, last = np.full(texts, n), np.full(texts, -1)
    np.minimum.at(first, of[where], where)
    np.maximum.at(last, of[where], where)
    row = np.arange(n)
    inside = (row > first[of]) & (row < last[of])
    inked = lines.inked > 0
    own = np.bincount(of, weights=np.where(inked & ~furniture & ~label & ((flags & ELLIPSIS) == 0), f["words"], 0), minlength=texts)
    told = np.bincount(of, weights=np.where(para, f["words"], 0), minlength=texts)
    voter = (told >= VOTER_SHARE * own) & (last >= 0)
    # the headline: the title's first line, or else the last line of words before the first paragraph
    titled = np.flatnonzero(((flags & TITLE) != 0))
    head = np.full(texts, n)
    np.minimum.at(head, of[titled], titled)
    able = np.flatnonzero(inked & ~furniture & ~label & ((flags & (ELLIPSIS | URLISH)) == 0) & (row < first[of]) & (head[of] == n) & (f["words"] >= 4))
    maybe = np.full(texts, -1)
    np.maximum.at(maybe, of[able], able)
    for bit, on in ((FURNITURE, furniture), (LABEL, label), (PARA, para), (SENTENCE, sentence), (INSIDE, inside), (VOTER, voter[of]), (HEAD, (row == head[of]) & (last[of] >= 0)), (HEADABLE, row == maybe[of])):
        flags[on] |= bit
    plain = inked & ~furniture & ~label & ((flags & ELLIPSIS) == 0)
    spoken = np.zeros((texts, len(CODES)), np.int64)
    known = np.flatnonzero(plain & (best >= 0))
    np.add.at(spoken, (of[known], best[known]), hits[known])
    lang = np.where(spoken.any(axis=1), spoken.argmax(axis=1), -1)
    keep = np.flatnonzero(inked)
    out = {
        "page_id": part["page_id"].to_numpy()[of[keep]], "skey": part["skey"].to_numpy()[of[keep]], "line_no": lines.line_no[keep].astype(np.int32),
        "path": f["path"][keep].view(np.int64), "flags": flags[keep].astype(np.int32), "words": f["words"][keep].astype(np.int32),
        "lang": lang[of[keep]].astype(np.int32),
    }
    out |= {k: v[keep].astype(np.int32) for k, v in repetition(lines, f["wkey"], plain, common >= 0).items()}
    if more is not None:
        out |= more(lines, keep, para, plain)
    return pd.DataFrame(out)


def featured(pages: DataFrame, more: Callable | None = None, more_schema: str = "") -> DataFrame:
    """(page_id, skey, line_no, path, flags, words, lang, top, paired, again, listed, ...): each non-blank line of the fetched pages, stored.

    ``lang`` is the language of most common words on the page, -1 for none; for the others see ``repetition``.
    ``more(lines, kept, paragraphs, plain)`` adds columns for the kept line numbers, whose types ``more_schema``
    gives; ``plain`` are lines that are no furniture.
    """
    sites, wordings, openings, counted = first_pass(pages)
    shared = pages.sparkSession.sparkContext.broadcast(common_words(counted))
    rows = with_site_tables(site_pages(pages, "links"), repeated_wordings(sites, wordings, openings))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), BATCH):
                yield page_features(pdf.iloc[start : start + BATCH], *shared.value, more)

    columns = rows.select("page_id", "skey", "title", "name", "short", "long", "links", "body_text")
    schema = f"page_id {kind}, skey bigint, line_no int, path bigint, flags int, words int, lang int, top int, paired int, again int, listed int" + (f", {more_schema}" if more_schema else "")
    return stored(columns.mapInPandas(run, schema))


# ---- votes and decisions


def _signs(flags: Column) -> Column:
    return flags.bitwiseAND(QUOTE | ENDS | SEPARATED | LONG | TAG | URLISH)


def outline_votes(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((skey, path, lines, own_n, own_yes, n, yes, heads), (signs, sign_vote)): votes of hosts and of all hosts.

    ``usable``: the lines whose outlines are asked for. Lines of pages that tell their article mostly in
    paragraphs vote; titles count as ``heads`` only.
    """
    flags = F.col("flags")
    votes, title, inside = has(flags, VOTER), has(flags, TITLE), has(flags, INSIDE)
    count = lambda c: F.sum(c.cast("long"))
    per = stored(usable.groupBy("skey", "path").agg(
        F.count(F.lit(1)).alias("lines"), count(votes & ~title).alias("own_n"), count(votes & ~title & inside).alias("own_yes"), count(votes & title).alias("own_heads")
    ))
    every = per.groupBy("path").agg(F.sum("own_n").alias("n"), F.sum("own_yes").alias("yes"), F.sum("own_heads").alias("heads"), F.count(F.lit(1)).alias("hosts"))
    table = join_spread(per.drop("own_heads"), stored(every), ["path"], "hosts", "skey")
    signs = usable.groupBy(_signs(flags).alias("signs")).agg(((count(votes & ~title & inside) + 1) / (count(votes & ~title) + 2)).alias("sign_vote"))
    return stored(table), signs


def decided(rows: DataFrame) -> DataFrame:
    """Rows of ``featured`` with ``won`` and ``content``: is the line part of the page's own article?"""
    flags = F.col("flags")
    usable = flags.bitwiseAND(FURNITURE | LABEL | ELLIPSIS | URLISH | PARA) == 0
    asked = rows.where(usable)
    votes, signs = outline_votes(asked)
    f = join_spread(asked, votes, ["skey", "path"], "lines", "page_id").withColumn("signs", _signs(flags)).join(F.broadcast(signs), "signs")  # at most 64 rows
    # a line's own vote is left out; behind the votes stand its signs if its place speaks for it
    voted = (has(flags, VOTER) & ~has(flags, TITLE)).cast("int")
    yes = voted * has(flags, INSIDE).cast("int")
    behind = F.when(has(flags, INSIDE) | has(flags, QUOTE), F.col("sign_vote")).otherwise(0.0)
    everywhere = (F.col("yes") - yes + PRIOR * behind) / (F.col("n") - voted + PRIOR)
    vote = (F.col("own_yes") - yes + PRIOR * everywhere) / (F.col("own_n") - voted + PRIOR)
    f = f.withColumn("won", vote >= WIN)
    heading = has(flags, HEAD) | (has(flags, HEADABLE) & (F.col("heads") >= TITLED))
    told = f.select(*rows.columns, "won", (F.col("won") | heading).alias("content"))
    rest = rows.where(~usable).select(*rows.columns, F.lit(False).alias("won"), (has(flags, PARA) | has(flags, HEAD)).alias("content"))
    return told.union(rest)


def measure_limits(sums: DataFrame) -> DataFrame:
    """(lang, *_limit): shares of a page's words that are beyond the usual in its language.

    The upper quartile of all pages and three times the distance of the quartiles, at least MEASURES.
    Shares are counted in thousandths, so exact quartiles need at most 1001 values a language.
    """
    quartiles = {m: F.percentile(F.round(F.col(m) * 1000 / F.col("own")), F.array(F.lit(0.25), F.lit(0.75))) for m in MEASURES}
    got = sums.where(F.col("own") >= MEASURED).groupBy("lang").agg(*(q.alias(m) for m, q in quartiles.items()))
    return got.select("lang", *(F.greatest(F.lit(least), (4 * F.col(m)[1] - 3 * F.col(m)[0]) / 1000).alias(f"{m}_limit") for m, least in MEASURES.items()))


def spam_scores(lines: DataFrame) -> DataFrame:
    """(page_id, share, spam, paragraphs), word counts by kind, and each page's measures with their limits.

    Measures are words that are the page's top word (``top``), stand in repeated word pairs (``paired``), in later
    copies of a line (``again``), in separated lists (``listed``), in bare link texts (``linked``), or in blocks
    without the common words of sentences (``bare``); ``own`` are all words beside furniture. Kinds: sentences; article blocks by outline; furniture aside; texts that could be references; keywords.
    """
    flags = F.col("flags")
    words = F.greatest("words", F.lit(1))
    sentence = has(flags, SENTENCE)
    aside = flags.bitwiseAND(FURNITURE | LABEL | ELLIPSIS) != 0
    marked_up = has(flags, URLISH) | (has(flags, TAG) & ~sentence)
    kind = (
        F.when(has(flags, PARA), 0)
        .when(aside & ~marked_up, 4)
        .when(has(flags, TITLE), 4)
        .when(marked_up, 3)
        .when(sentence & has(flags, ENDS), 0)
        .when(F.col("won"), 1)
        .when(sentence, 2)
        .otherwise(3)
    )
    plain = flags.bitwiseAND(FURNITURE | LABEL | ELLIPSIS) == 0
    linked = F.when(plain & has(flags, LINK) & ~has(flags, PARA), words).otherwise(0)
    k = lines.withColumn("kind", kind).withColumn("linked", linked)
    total = lambda v: F.sum(F.when(F.col("kind") == v, words).otherwise(0))
    told = F.col("kind") <= 1
    sums = k.groupBy("page_id").agg(
        F.max("lang").alias("lang"), F.sum(F.when(plain, words).otherwise(0)).alias("own"), F.sum(F.when(plain & ~sentence, words).otherwise(0)).alias("bare"), *(F.sum(m).alias(m) for m in MEASURES),
        *(F.sum(F.when(told, F.col(m)).otherwise(0)).alias(f"{m}_told") for m in MEASURES), F.sum(F.when(F.col("kind") == 2, F.col("linked")).otherwise(0)).alias("linked_references"),
        total(0).alias("sentence_words"), total(1).alias("article_words"), total(2).alias("reference_words"), total(3).alias("keyword_words"),
        F.sum((F.col("kind") == 3).cast("int")).alias("keyword_lines"), F.sum(has(flags, PARA).cast("int")).alias("paragraphs"),
    )
    # texts of bare links among keywords and addresses are of their kind; beside an article they are furniture
    sums = stored(sums)
    sums = sums.join(F.broadcast(measure_limits(sums)), "lang", "left")  # a row a language
    beyond = {m: (F.col("own") >= MEASURED) & (F.col(m) > F.coalesce(f"{m}_limit", F.lit(least)) * F.col("own")) for m, least in MEASURES.items()}
    bare = F.when((F.col("keyword_lines") >= 3) | (F.col("sentence_words") == 0), F.col("reference_words")).when(beyond["linked"], F.col("linked_references")).otherwise(0)
    # a song repeats its word pairs too; stuffing has one word in excess besides
    stuffed = F.greatest(
        F.when(beyond["top"], F.greatest("top_told", F.when(beyond["paired"], F.col("paired_told")))),
        *(F.when(beyond[m], F.col(f"{m}_told")) for m in ("again", "listed", "linked")), F.lit(0),
    )
    bad = F.col("keyword_words") + bare + stuffed
    whole = F.col("keyword_words") + bare + F.col("sentence_words") + F.col("article_words")
    return sums.withColumn("share", F.when(whole > 0, bad / whole).otherwise(0.0)).withColumn("spam", (F.col("share") >= SPAM) & (bad >= 8))


def without_spam(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows of pages that are no keyword pages."""
    return rows.join(scores.where("spam").select("page_id"), "page_id", "left_anti")


def keyword_pages(pages: DataFrame) -> DataFrame:
    """(page_id, share): pages of keywords, bare links or tags. Pages without words are none."""
    return spam_scores(decided(featured(pages))).where("spam").select("page_id", "share")


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no): lines that are not part of the page's article, on all pages but keyword pages.

    Blank lines are no lines; a page without a paragraph has no article and yields all its lines; a page id
    that occurs in several rows gives the lines of each.
    """
    lines = stored(decided(featured(pages)))
    scores = stored(spam_scores(lines))
    without = scores.where("paragraphs = 0").select("page_id", F.lit(True).alias("no_article"))
    rest = without_spam(lines.select("page_id", "line_no", "content"), scores).join(without, "page_id", "left")
    return rest.where(~F.col("content") | F.col("no_article").isNotNull()).select("page_id", "line_no").distinct()


def page_measures(pages: DataFrame) -> DataFrame:
    """(page_id, lang, words, *_share, *_limit, keyword_share, spam): what each page with words is judged by.

    ``lang`` is a code, NULL where no common word stands. Shares are of the page's words beside furniture, 0 where
    there are none; a limit is NULL where no page of the language has enough words to take it from.
    """
    s = spam_scores(decided(featured(pages)))
    shares = [F.round(F.when(F.col("own") > 0, F.col(m) / F.col("own")).otherwise(0.0), 6).alias(f"{m}_share") for m in (*MEASURES, "bare")]
    code = F.when(F.col("lang") >= 0, F.element_at(F.array(*map(F.lit, CODES)), F.col("lang") + 1))
    limits = [F.round(f"{m}_limit", 6).alias(f"{m}_limit") for m in MEASURES]
    return s.select("page_id", code.alias("lang"), F.col("own").alias("words"), *shares, *limits, F.round("share", 6).alias("keyword_share"), "spam")


def p7_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of each page."""
    return page_measures(read_table(spark, sf_dir, "crawled_pages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are mostly keywords, bare link texts or tags."""
    return keyword_pages(read_table(spark, sf_dir, "crawled_pages")).select("page_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not part of the page's own article."""
    return furniture_lines(read_table(spark, sf_dir, "crawled_pages"))


QUERIES = {"p4_found": p4_found, "p7_found": p7_found, "p7_measures": p7_measures}
ORACLE: dict[str, str] = {}
