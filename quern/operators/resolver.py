"""Resolving navigational queries to sites and pages; liveness, fetched pages and sitemaps are input relations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.urls import host_of, registrable_domain, slug_tokens, url_depth
from quern.operators.best_hits import csr, expand
from quern.session import shuffle_width

#: Category words, those of organisations, filler, and spellings in common use for each other.
GENERIC = [
    "school", "college", "university", "institute", "academy", "campus", "hospital", "clinic", "pharmacy", "nursing", "forum", "forums", "board",
    "community", "blog", "wiki", "news", "official", "website", "web", "site", "page", "homepage", "home", "online", "higher", "secondary",
    "primary", "public", "central", "national", "ltd", "limited", "pvt", "private", "inc", "corp", "company", "co", "radio", "station", "channel",
    "tv", "fm", "department", "office", "bureau", "council",
]
ORGANISATION = [
    "school", "college", "university", "institute", "academy", "campus", "hospital", "clinic", "pharmacy", "nursing", "forum", "forums", "board",
    "community", "wiki", "radio", "station", "channel", "department", "office", "bureau", "council",
]
STOP = ["the", "of", "in", "at", "on", "for", "a", "an", "to", "is", "com", "www"]
EQUIVALENTS = {
    "saint": "st", "mount": "mt", "fort": "ft", "doctor": "dr", "mister": "mr", "sister": "sr", "father": "fr", "and": "n", "first": "1st",
    "second": "2nd", "international": "intl", "technology": "tech", "government": "govt", "university": "univ", "association": "assn",
}
#: Settlement kinds whose names count as places.
PLACE_KINDS = ["country", "state", "city", "town", "suburb", "borough", "quarter"]
MAX_SITE_TOKENS, MAX_HOSTS, MAX_PROBES, MAX_READINGS = 3, 240, 300, 6
DEPTH_PRIOR = [1.0, 0.8, 0.65, 0.5]
ANSWER_FLOOR, PAGE_FLOOR, QUALITY_FLOOR = 0.4, 0.35, 0.35
TITLE, BODY, HOST, HOST_WORD = 1, 2, 4, 8  # where a word of a query stands
QUERY_BLOCK = 4096  # queries whose pairs with pages are held at once
LABEL = (3, 40)

Token = "struct<text:string,forms:array<string>,kind:string>"


def forms_for(text: Column) -> Column:
    """Spellings of a word: itself, its equivalent, and with or without a final s."""
    both = {**EQUIVALENTS, **{v: k for k, v in EQUIVALENTS.items()}}
    other = F.create_map(*(F.lit(x) for kv in both.items() for x in kv))[text]
    n = F.length(text)
    stem = F.when(text.endswith("s"), F.when((n >= 4) & ~text.endswith("ss"), F.substring(text, F.lit(1), n - 1))).when(n >= 3, F.concat(text, F.lit("s")))
    return F.array_distinct(F.array_compact(F.array(text, other, stem)))


def tokens_of(query: Column, place_names: Column) -> Column:
    """Tokens of a query with spellings and kind: Stop, Generic, Place or Distinctive."""
    words = F.transform(F.split(F.lower(query), r"[^\p{L}\p{M}\p{N}']+"), lambda w: F.replace(w, F.lit("'"), F.lit("")))
    kind = lambda w: F.when(w.isin(STOP), "Stop").when(w.isin(GENERIC), "Generic").when(F.array_contains(place_names, w), "Place").otherwise("Distinctive")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(w.alias("text"), forms_for(w).alias("forms"), kind(w).alias("kind")))


def place_words(gazetteer: DataFrame) -> DataFrame:
    """One row, ``place_names``: names of countries down to town quarters."""
    g = gazetteer.where(F.col("kind").isin(PLACE_KINDS)).select(F.lower("name").alias("n")).distinct()
    return g.agg(F.sort_array(F.collect_set("n")).alias("place_names"))


def tokenised(queries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``queries`` (query_id, q) with ``tokens``."""
    return queries.crossJoin(F.broadcast(place_words(gazetteer))).withColumn("tokens", tokens_of(F.col("q"), F.col("place_names"))).drop("place_names")  # one row


def splits(tokens: Column) -> Column:
    """Readings (site, page) of a query: all of it, its first 1 to 3 words, its last 1 to 3; distinct, in that order."""
    w = F.transform(F.filter(tokens, lambda t: t["kind"] != "Stop"), lambda t: t["text"])
    n = F.size(w)
    none = F.array().cast("array<string>")
    cut = lambda site, page: F.struct(site.alias("site"), page.alias("page"))
    whole = F.array(cut(w, none))
    most = F.least(F.lit(MAX_SITE_TOKENS), n - 1)
    steps = F.when(most >= 1, F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    first = F.transform(steps, lambda k: cut(F.slice(w, F.lit(1), k), F.slice(w, k + 1, n)))
    last = F.transform(steps, lambda k: cut(F.slice(w, n - k + 1, k), F.slice(w, F.lit(1), n - k)))
    return F.when(n == 0, F.array().cast("array<struct<site:array<string>,page:array<string>>>")).otherwise(F.array_distinct(F.concat(whole, first, last)))


def host_candidates(words: Sequence[tuple[str, Sequence[str], str]], suffixes: Sequence[str]) -> list[str]:
    """Hosts that a site of these (text, forms, kind) words may have, the likeliest first, at most MAX_HOSTS.

    Words of the identifying kind (distinctive, else places) always stand in the name; up to four others may.
    Readings with fewer category words, more places and fewer words come first. Names are the words joined,
    then initials of two words or more with a category among them, then the words with hyphens.
    """
    kinds = {k for *_, k in words}
    core = "Distinctive" if "Distinctive" in kinds else "Place" if "Place" in kinds else None
    if core is None:
        return []
    fixed = [i for i, w in enumerate(words) if w[2] == core]
    free = [i for i, w in enumerate(words) if w[2] not in (core, "Stop")][:4]
    masks = [sorted([*fixed, *extra]) for r in range(len(free) + 1) for extra in combinations(free, r)]
    count = lambda m, kind: sum(words[i][2] == kind for i in m)
    masks.sort(key=lambda m: (count(m, "Generic"), -count(m, "Place"), len(m)))
    out: dict[str, None] = {}

    def add(label: str) -> None:
        if LABEL[0] <= len(label) <= LABEL[1] and label.replace("-", "").isascii() and label.replace("-", "").isalnum():
            for s in suffixes:
                out.setdefault(f"{label}.{s}")

    for m in masks:
        for spelled in product(*(list(words[i][1])[:2] for i in m)):
            add("".join(spelled))
    for m in masks:
        if len(m) >= 2 and count(m, "Generic"):
            initials = "".join(words[i][0][0] for i in m)
            if len(initials) >= 3:
                add(initials)
    for m in masks:
        if len(m) >= 2:
            for spelled in product(*(list(words[i][1])[:2] for i in m)):
                add("-".join(spelled))
    return list(out)[:MAX_HOSTS]


def hostname_candidates(readings: DataFrame) -> DataFrame:
    """(query_id, split, rank, host) of readings: query_id, split, tokens (of the site), suffixes."""
    kind = readings.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, s, ts, suffixes in zip(pdf["query_id"], pdf["split"], pdf["tokens"], pdf["suffixes"], strict=True):
                words = [(t["text"], list(t["forms"]), t["kind"]) for t in ts]
                rows += [(q, s, r, h) for r, h in enumerate(host_candidates(words, list(suffixes)))]
            yield pd.DataFrame(rows, columns=["query_id", "split", "rank", "host"])

    return readings.select("query_id", "split", "tokens", "suffixes").mapInPandas(run, f"query_id {kind}, split int, rank int, host string")


def probe_plan(candidates: DataFrame, readings: int = MAX_READINGS) -> DataFrame:
    """Candidates to probe: quotas by reading (of n readings the i-th has max(8, 300 (n - i) / sum)), then 300 a query.

    A host that several readings propose keeps its best place.
    """
    c = candidates.where(F.col("split") < readings)
    n = c.groupBy("query_id").agg(F.max("split").alias("last")).select("query_id", (F.col("last") + 1).alias("n"))
    c = c.join(n, "query_id")
    quota = F.greatest(F.lit(8), F.floor(F.lit(MAX_PROBES) * (F.col("n") - F.col("split")) / (F.col("n") * (F.col("n") + 1) / 2)))
    c = c.where(F.col("rank") < quota)
    best = c.groupBy("query_id", "host").agg(F.min(F.struct("split", "rank")).alias("k"))
    by = Window.partitionBy("query_id").orderBy("k.split", "k.rank", "host")
    return best.withColumn("place", F.row_number().over(by)).where(F.col("place") <= MAX_PROBES).select("query_id", "host", F.col("k.split").alias("split"), F.col("k.rank").alias("rank"), "place")


def live(candidates: DataFrame, live_hosts: DataFrame) -> DataFrame:
    """Candidates whose host is known to answer."""
    return candidates.join(live_hosts.select("host").distinct(), "host", "left_semi")


def word_set(text: Column) -> Column:
    """Distinct lower-case words, apostrophes dropped."""
    words = F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("'"), F.lit("")), r"[^\p{L}\p{M}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def match_score(tokens: Column, title: Column, url: Column, body: Column) -> Column:
    """How well a page is what the tokens name, 0 to 1.

    Share of distinctive and place words in the title (0.85), the body's first 8000 characters (0.1) and, as a
    bonus, the host (0.25); times 0.25 if a named place is nowhere, and times 0.7 to 1 by the category words.
    """
    t, host, b = word_set(title), F.coalesce(host_of(url), F.lit("")), word_set(F.substring(body, 1, 8000))
    in_title = lambda x: F.arrays_overlap(x["forms"], t)
    in_host = lambda x: F.exists(x["forms"], lambda f: F.contains(host, f))
    in_body = lambda x: F.arrays_overlap(x["forms"], b)
    anywhere = lambda x: in_title(x) | in_host(x) | in_body(x)
    identifying = F.filter(tokens, lambda x: x["kind"].isin("Distinctive", "Place"))
    n = F.size(identifying)
    share = lambda test: F.size(F.filter(identifying, test)) / n
    base = F.least(F.lit(1.0), 0.85 * share(in_title) + 0.1 * share(in_body) + 0.25 * share(in_host))
    place = F.when(F.forall(F.filter(tokens, lambda x: x["kind"] == "Place"), anywhere), 1.0).otherwise(0.25)
    generic = F.filter(tokens, lambda x: x["kind"] == "Generic")
    kind = F.when(F.size(generic) == 0, 1.0).otherwise(0.7 + 0.3 * F.size(F.filter(generic, anywhere)) / F.size(generic))
    return F.when(n == 0, 0.0).otherwise(base * place * kind)


def name_match(tokens: Column, name: Column) -> Column:
    """coverage² (0.6 + 0.4 precision) of a recorded name: share of the query's words in it, and of its words in the query."""
    w = word_set(name)
    asked = F.filter(tokens, lambda t: t["kind"] != "Stop")
    coverage = F.size(F.filter(asked, lambda t: F.arrays_overlap(t["forms"], w))) / F.size(asked)
    every = F.flatten(F.transform(asked, lambda t: t["forms"]))
    precision = F.size(F.filter(w, lambda x: F.array_contains(every, x))) / F.size(w)
    return F.when((F.size(asked) == 0) | (F.size(w) == 0), 0.0).otherwise(coverage * coverage * (0.6 + 0.4 * precision))


def host_covers_query(tokens: Column, host: Column) -> Column:
    """Two identifying words or more, each in the host in some spelling."""
    i = F.filter(tokens, lambda x: x["kind"].isin("Distinctive", "Place"))
    return (F.size(i) >= 2) & F.forall(i, lambda x: F.exists(x["forms"], lambda f: F.contains(host, f)))


def depth_prior(url: Column, site_seeking: Column) -> Column:
    """Lesser weight for deeper pages where a site is sought."""
    return F.when(site_seeking, F.element_at(F.array(*map(F.lit, DEPTH_PRIOR)), F.least(url_depth(url), F.lit(3)) + 1)).otherwise(1.0)


def slug_score(words: Column, url: Column) -> Column:
    """How well an address' path says the words: coverage² (0.6 + 0.4 concision), 1.25 times as a phrase, at most 1."""
    slug = slug_tokens(url)
    n = F.size(words)
    hits = F.size(F.filter(words, lambda w: F.array_contains(slug, w) | F.array_contains(slug, F.concat(w, F.lit("s"))) | F.array_contains(F.transform(slug, lambda s: F.concat(s, F.lit("s"))), w)))
    coverage = hits / n
    concision = F.least(F.lit(1.0), n / F.size(slug))
    phrase = F.contains(F.concat(F.lit(" "), F.array_join(slug, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    return F.when((n == 0) | (F.size(slug) == 0), 0.0).otherwise(F.least(F.lit(1.0), coverage * coverage * (0.6 + 0.4 * concision) * F.when(phrase & (n > 1), 1.25).otherwise(1.0)))


def best_pages(queries: DataFrame, urls: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, url, score, rank): addresses whose path says a query's words; ``queries``: query_id, words.

    Queries and addresses meet through shared path words, not all pairs.
    """
    words = queries.select("query_id", "words", F.explode(F.array_distinct(F.flatten(F.transform("words", lambda w: F.array(w, F.concat(w, F.lit("s")), F.regexp_replace(w, "s$", "")))))).alias("w"))
    slugs = urls.select("url").distinct().select("url", F.explode(F.array_distinct(slug_tokens(F.col("url")))).alias("w"))
    met = slugs.join(words, "w").select("query_id", "words", "url").distinct()
    scored = met.withColumn("score", F.round(slug_score(F.col("words"), F.col("url")), 6)).where(F.col("score") >= PAGE_FLOOR)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.length("url"), "url")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("query_id", "url", "score", "rank")


def front_doors(answers: DataFrame) -> DataFrame:
    """(query_id, url, score): one answer a registrable domain.

    Where all are front pages the shortest host stays, else the best page; it takes the best score. Equal
    ones are ordered by score, length and address.
    """
    a = answers.select("query_id", "url", "score", registrable_domain(F.col("url")).alias("domain"), (url_depth(F.col("url")) > 0).alias("deep"), F.length(host_of(F.col("url"))).alias("n"))
    group = Window.partitionBy("query_id", "domain")
    a = a.withColumn("any_deep", F.max("deep").over(group)).withColumn("best", F.max("score").over(group))
    order = [F.when(F.col("any_deep"), -F.col("score")).otherwise(F.col("n").cast("double")), F.col("score").desc(), F.length("url"), "url"]
    r = a.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "domain").orderBy(*order))).where("r = 1")
    return r.select("query_id", "url", F.col("best").alias("score"))


def interleaved(first: DataFrame, second: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, host, place): two ranked lists in turn, each host once, at most ``most``. Inputs: query_id, host, rank from 0."""
    both = first.select("query_id", "host", (F.col("rank") * 2).alias("k")).union(second.select("query_id", "host", (F.col("rank") * 2 + 1).alias("k")))
    once = both.groupBy("query_id", "host").agg(F.min("k").alias("k"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "host"))).where(F.col("place") <= most).select("query_id", "host", "place")


def _rounded(values: np.ndarray) -> np.ndarray:
    """Rounded to six digits as ``F.round`` does, halves up; scores have few different values."""
    some, at = np.unique(values, return_inverse=True)
    return np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in some])[at]


class _Tokens:
    """Tokens of all queries by number, and where their spellings lead."""

    def __init__(self, rows: Sequence):
        numbers: dict[tuple, int] = {}
        listed = [[numbers.setdefault((t["text"], tuple(t["forms"]), t["kind"]), len(numbers)) for t in r["tokens"]] for r in rows]
        kinds = np.array([k for *_, k in numbers], dtype=object)
        self.count, self.place, self.generic = len(numbers), kinds == "Place", kinds == "Generic"
        self.identifying = self.place | (kinds == "Distinctive")
        forms = sorted({f for _, fs, _ in numbers for f in fs})
        self.form = {f: i for i, f in enumerate(forms)}
        self.form_tokens = csr([(self.form[f], i) for (_, fs, _), i in numbers.items() for f in fs], len(forms))
        asked = [sorted(i for i in own if self.identifying[i] or self.generic[i]) for own in listed]
        self.sizes = np.array([len(x) for x in asked], dtype=np.int64)
        self.query_tokens = np.r_[0, np.cumsum(self.sizes)], np.array([i for x in asked for i in x], dtype=np.int64)  # a word said twice counts twice
        self.organisation = np.array([any(t["text"] in ORGANISATION for t in r["tokens"]) for r in rows], dtype=bool)
        self.blocks = []  # queries of each identifying token, a block of queries at a time
        for first in range(0, len(rows), QUERY_BLOCK):
            pairs = [(i, q) for q in range(first, min(first + QUERY_BLOCK, len(rows))) for i in asked[q] if self.identifying[i]]
            self.blocks.append(csr(pairs, self.count))


def _answers_of_sites(t: _Tokens, pages: pa.Table, limit: int) -> list[tuple[np.ndarray, ...]]:
    """(query, score, length, url) arrays: each query's best answers among whole sites."""
    rows = []
    for column, bit in (("title", TITLE), ("host_words", HOST_WORD), ("body", BODY)):
        col = pages.column(column).combine_chunks()
        at = pc.index_in(col.flatten(), value_set=pa.array(list(t.form), pa.string()))
        hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        rows.append((pc.list_parent_indices(col).to_numpy(zero_copy_only=False)[hit], at.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64), bit))
    hosts = pages.column("host").to_pylist()
    parts = {h: [t.form[x] for x in {h[i:j] for i in range(len(h)) for j in range(i + 1, len(h) + 1)} if x in t.form] for h in set(hosts)}
    inside = [(p, f) for p, h in enumerate(hosts) for f in parts[h]]
    rows.append((np.array([p for p, _ in inside], dtype=np.int64), np.array([f for _, f in inside], dtype=np.int64), HOST))
    key, flag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for page, form, bit in rows:
        at, token = expand(form, t.form_tokens)
        key.append(page[at].astype(np.int64) * t.count + token)
        flag.append(np.full(len(at), bit))
    key, at = np.unique(np.concatenate(key), return_inverse=True)
    flags = np.zeros(len(key), np.int64)
    np.bitwise_or.at(flags, at, np.concatenate(flag))
    url, length, host_length = np.array(pages.column("url").to_pylist(), dtype=object), pages.column("length").to_numpy(), pages.column("host_length").to_numpy()
    deep, weight = pages.column("deep").to_numpy(), pages.column("weight").to_numpy()
    site = np.unique(np.array(pages.column("domain").to_pylist(), dtype=object), return_inverse=True)[1]
    place = np.empty(len(url), np.int64)
    place[np.lexsort((np.argsort(np.argsort(url)), length))] = np.arange(len(url))  # shorter ones first, then by address
    n_pages, found = max(1, len(url)), []
    meets = (flags & (TITLE | HOST_WORD)) > 0
    for block in t.blocks:
        at, q = expand((key % t.count)[meets], block)
        pair = np.unique(q * n_pages + (key // t.count)[meets][at])
        if not len(pair):
            continue
        q, p = pair // n_pages, pair % n_pages
        at, token = expand(q, t.query_tokens)
        want = p[at] * t.count + token
        pos = np.minimum(np.searchsorted(key, want), len(key) - 1)
        got = np.where(key[pos] == want, flags[pos], 0)
        many = lambda mask: np.bincount(at[mask], minlength=len(pair))  # noqa: B023, E731
        own, generic, some = t.identifying[token], t.generic[token], (got & (TITLE | HOST | BODY)) > 0
        n, g = many(own), many(generic)
        share = lambda bit: many(own & ((got & bit) > 0)) / n  # noqa: B023, E731
        base = np.minimum(1.0, 0.85 * share(TITLE) + 0.1 * share(BODY) + 0.25 * share(HOST))
        known = np.where(many(t.place[token] & ~some) == 0, 1.0, 0.25)
        kind = np.where(g == 0, 1.0, 0.7 + 0.3 * many(generic & some) / np.maximum(g, 1))
        score = _rounded(base * known * kind * np.where(t.organisation[q], weight[p], 1.0))
        group = np.unique(q * n_pages + site[p], return_inverse=True)[1]
        any_deep = np.bincount(group, weights=deep[p]) > 0
        top = np.zeros(len(any_deep))
        np.maximum.at(top, group, score)
        order = np.lexsort((place[p], -score, np.where(any_deep[group], -score, host_length[p]), group))
        first = order[np.r_[True, group[order][1:] != group[order][:-1]]]  # one answer a site, as in front_doors
        q, p, score = q[first], p[first], top[group[first]]
        ok = score >= ANSWER_FLOOR
        found.append(_best_answers(q[ok], score[ok], length[p[ok]], url[p[ok]], limit))
    return found


def _best_answers(q: np.ndarray, score: np.ndarray, length: np.ndarray, url: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((np.argsort(np.argsort(url)), length, -score, q))
    q, score, length, url = q[order], score[order], length[order], url[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < limit
    return q[near], score[near], length[near], url[near]


def resolve(queries: DataFrame, fetched: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, url, score, rank): answers among fetched pages for tokenised queries.

    ``queries``: query_id, tokens, a row a query, held by the driver; ``fetched``: url, title, body, quality. A page
    is considered if its title or host shares an identifying word with the query. A page's words are looked up
    once for all queries; its score is ``match_score`` times ``depth_prior``. The pages of a registrable domain
    come to one task, which gives the best ``limit`` sites of each query, so pairs of queries and pages are
    neither moved nor stored.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", "tokens").collect()
    t = _Tokens(asked)
    pages = fetched.where(F.col("url").isNotNull() & (F.coalesce("quality", F.lit(1.0)) >= QUALITY_FLOOR))
    host, u = F.coalesce(host_of(F.col("url")), F.lit("")), F.col("url")
    narrow = pages.select(
        "url", F.coalesce(registrable_domain(u), F.lit("")).alias("domain"), host.alias("host"), word_set(F.col("title")).alias("title"), F.array_distinct(F.split(host, r"[.\-]")).alias("host_words"),
        word_set(F.substring("body", 1, 8000)).alias("body"), F.length(u).cast("long").alias("length"), F.coalesce(F.length(host_of(u)), F.lit(-1)).cast("double").alias("host_length"),
        F.coalesce(url_depth(u) > 0, F.lit(False)).alias("deep"), depth_prior(u, F.lit(True)).cast("double").alias("weight"),
    )
    words = pa.array(list(t.form), pa.string())
    types = narrow.schema.simpleString()[len("struct<") : -1]

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only words that are asked for go on."""
        for b in batches:
            for c in ("title", "host_words", "body"):
                col, i = b.column(b.schema.get_field_index(c)), b.schema.get_field_index(c)
                hit = pc.is_in(col.flatten(), value_set=words)
                row = pc.list_parent_indices(col).filter(hit).to_numpy(zero_copy_only=False)
                ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
                b = b.set_column(i, c, pa.ListArray.from_arrays(ends, col.flatten().filter(hit)))
            yield b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found = None, []
        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            same = pc.equal(table.column("domain"), table.column("domain")[-1]).to_numpy() if len(table) else np.zeros(0, bool)
            cut = len(table) - int(same.sum())  # the last site may go on
            if cut:
                found += _answers_of_sites(t, table.slice(0, cut).combine_chunks(), limit)
            rest = table.slice(cut)
            if len(found) > 50:
                found = [_best_answers(*(np.concatenate(x) for x in zip(*found, strict=True)), limit)]
        if rest is not None and len(rest):
            found += _answers_of_sites(t, rest.combine_chunks(), limit)
        if found:
            q, score, length, url = _best_answers(*(np.concatenate(x) for x in zip(*found, strict=True)), limit)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.float64()), pa.array(length, pa.int64()), pa.array(url, pa.string())], names=["q", "score", "length", "url"])

    sites = narrow.mapInArrow(lookup, types).repartition(shuffle_width(spark), "domain").sortWithinPartitions("domain")
    answers = sites.mapInArrow(run, "q int, score double, length long, url string")
    known = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    by = Window.partitionBy("q").orderBy(F.col("score").desc(), "length", "url")
    best = answers.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    return best.join(known, "q").select("query_id", "url", "score", "rank")


def fragment_url(url: Column, text: Column) -> Column:
    """Address that scrolls to a text: all but letters, digits and ``. _ ~`` percent-encoded."""
    e = F.url_encode(text)
    for a, b in (("+", "%20"), ("-", "%2D"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#:~:text="), e)


def label_score(wanted: Column, label: Column) -> Column:
    """coverage² (0.55 + 0.45 concision) of a control's label."""
    w = word_set(label)
    n = F.size(wanted)
    coverage = F.size(F.filter(wanted, lambda t: F.arrays_overlap(t["forms"], w))) / n
    return F.when((n == 0) | (F.size(w) == 0), 0.0).otherwise(coverage * coverage * (0.55 + 0.45 * F.least(F.lit(1.0), n / F.size(w))))


def looks_like_question(query: Column) -> Column:
    """Ends with ? or begins with a question word."""
    openers = "what|who|when|where|why|how|which|whose|is|are|was|were|do|does|did|can|could|should|would|will|has|have|had"
    return F.trim(query).endswith("?") | F.lower(F.trim(query)).rlike(rf"^({openers})\b")


def parse_plan(reply: Column) -> Column:
    """Plan in a model's reply: the outermost JSON object, or an array of steps; NULL without."""
    step = "struct<find:string,instruction:string,url_hint:string>"
    whole = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), f"struct<start_url:string,steps:array<{step}>>")
    bare = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), f"array<{step}>")
    return F.when(F.size(whole["steps"]) > 0, whole).when(F.size(bare) > 0, F.struct(F.lit(None).cast("string").alias("start_url"), bare.alias("steps")))


# ---- suffixes, site seeking, platforms, controls on a page

#: General suffixes, the fallback country, and countries whose sites stand below second-level names.
GENERAL_SUFFIXES = ["com", "org", "net", "edu"]
DEFAULT_COUNTRY, MIN_STEERING_POPULATION = "in", 50_000
SUFFIXES = {
    "in": ["in", "co.in", "ac.in", "edu.in", "org.in", "res.in"], "gb": ["co.uk", "org.uk", "ac.uk", "uk"], "uk": ["co.uk", "org.uk", "ac.uk", "uk"],
    "us": ["us", "edu"], "au": ["com.au", "org.au", "edu.au"], "br": ["com.br", "br"], "jp": ["jp", "co.jp", "ac.jp"], "ru": ["ru", "su"],
    "za": ["co.za", "za"], "ng": ["ng", "com.ng", "edu.ng"], "nz": ["co.nz", "org.nz", "ac.nz"], "cn": ["cn", "com.cn", "edu.cn"],
    "kr": ["kr", "co.kr", "ac.kr"], "id": ["id", "co.id", "ac.id"], "pk": ["pk", "com.pk", "edu.pk"], "bd": ["bd", "com.bd", "edu.bd"],
    "lk": ["lk", "com.lk"], "np": ["np", "com.np", "edu.np"],
}
#: Fixed values: (min_lat, max_lat, min_lon, max_lon, country) for places without a country; the first that holds counts.
COUNTRY_BOXES = [(6.0, 36.0, 68.0, 98.0, "in"), (41.0, 78.0, 19.0, 180.0, "ru"), (49.5, 61.0, -8.5, 2.0, "gb"), (-45.0, -10.0, 112.0, 154.0, "au"), (24.0, 50.0, -125.0, -66.0, "us")]
#: Platforms whose pages about something are not its own site.
PLATFORMS = [
    "instagram.com", "facebook.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "youtu.be", "tiktok.com", "pinterest.com", "reddit.com",
    "wikipedia.org", "wikiwand.com", "fandom.com", "justdial.com", "indiamart.com", "sulekha.com", "yelp.com", "pissedconsumer.com",
    "complaintsboard.com", "trustpilot.com", "consumercomplaints.in", "mouthshut.com", "sitejabber.com", "collegedunia.com", "shiksha.com",
    "careers360.com", "getmyuni.com", "liveonlineradio.net", "radioguide.fm", "onlineradiobox.com",
]
PLATFORM_WEIGHT, OWN_SITE_WEIGHT = 0.6, 1.25
#: Weights of the elements whose text may name a control.
CONTROL_WEIGHTS = {"a": 1.0, "button": 1.0, "summary": 1.0, "label": 0.95, "h1": 0.9, "h2": 0.9, "h3": 0.8, "h4": 0.8}


def country_for(lat: Column, lon: Column) -> Column:
    """Country of a position by coarse boxes; NULL outside them."""
    out = F.lit(None).cast("string")
    for a, b, c, d, cc in reversed(COUNTRY_BOXES):
        out = F.when(lat.between(a, b) & lon.between(c, d), cc).otherwise(out)
    return out


def suffixes_for(country: Column) -> Column:
    """Suffixes of a country: listed ones, else its code if that is two letters; none otherwise."""
    table = F.create_map(*(x for k, v in SUFFIXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(table[country], F.when(country.rlike("^[a-z]{2}$"), F.array(country)), F.array().cast("array<string>"))


def query_suffixes(queries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(query_id, suffixes): general suffixes, then those of the country of the most populous place a query names.

    Places under 50 000 people do not steer; without one the fallback country counts. Equal populations go by country.
    """
    words = queries.select("query_id", F.explode(F.filter("tokens", lambda t: t["kind"] == "Place")).alias("t")).select("query_id", F.col("t.text").alias("key"))
    g = gazetteer.where(F.col("kind").isin(PLACE_KINDS) & (F.col("population") >= MIN_STEERING_POPULATION))
    g = g.select(F.lower("name").alias("key"), "population", F.coalesce(F.nullif(F.lower("country"), F.lit("")), country_for(F.col("lat"), F.col("lon"))).alias("cc")).where("cc IS NOT NULL")
    best = words.join(g, "key").groupBy("query_id").agg(F.max(F.struct("population", "cc"))["cc"].alias("cc"))
    out = queries.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", F.array_distinct(F.concat(F.array(*map(F.lit, GENERAL_SUFFIXES)), suffixes_for(F.coalesce("cc", F.lit(DEFAULT_COUNTRY))))).alias("suffixes"))


def site_seeking(tokens: Column, entity_name: Column) -> Column:
    """Is a site sought, not a page of one? With an entity's name: no distinctive word is outside it; without: a word names an organisation."""
    name = word_set(entity_name)
    outside = F.exists(tokens, lambda t: (t["kind"] == "Distinctive") & ~F.arrays_overlap(t["forms"], name))
    return F.when(entity_name.isNull(), F.exists(tokens, lambda t: t["text"].isin(ORGANISATION))).otherwise(~outside)


def platform_weight(url: Column) -> Column:
    return F.when(registrable_domain(url).isin(PLATFORMS), PLATFORM_WEIGHT).otherwise(1.0)


def own_site_weight(url: Column, domains: Column) -> Column:
    return F.when(F.array_contains(domains, registrable_domain(url)), OWN_SITE_WEIGHT).otherwise(1.0)


def answer_score(match: Column, name_score: Column, own: Column, depth: Column, platform: Column) -> Column:
    """match (0.85 + 0.15 name) times the weights, at most 1."""
    return F.least(F.lit(1.0), match * (0.85 + 0.15 * name_score) * own * depth * platform)


def control_words(tokens: Column, host: Column, entity_name: Column) -> Column:
    """Tokens that say what is wanted on a site: not its name, place or kind of organisation."""
    h, n = F.lower(F.coalesce(host, F.lit(""))), F.lower(F.coalesce(entity_name, F.lit("")))
    return F.filter(tokens, lambda t: t["kind"].isin("Distinctive", "Generic") & ~t["text"].isin(ORGANISATION) & ~F.exists(t["forms"], lambda f: F.contains(h, f) | F.contains(n, f)))


def control_labels(pages: DataFrame) -> DataFrame:
    """(url, label, weight): distinct texts of 3 to 60 characters of links, buttons, labels and headings of (url, html)."""
    from quern.sources.web import HTMLParser

    class Labels(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, float, list[str]]] = []
            self.found: dict[str, float] = {}

        def handle_starttag(self, tag, attrs):
            weight = CONTROL_WEIGHTS.get(tag, 1.0 if dict(attrs).get("role") in ("button", "tab", "menuitem", "link") else None)
            if weight is not None:
                self.open.append((tag, weight, []))

        def handle_data(self, data):
            for *_, parts in self.open:
                parts.append(data)

        def handle_endtag(self, tag):
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
            if at is not None:
                _, weight, parts = self.open.pop(at)
                text = " ".join("".join(parts).split())
                if 3 <= len(text) <= 60 and not text.endswith("."):
                    self.found[text] = max(weight, self.found.get(text, 0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, html in zip(pdf["url"], pdf["html"], strict=True):
                p = Labels()
                p.feed(html or "")
                rows += [(url, k, v) for k, v in p.found.items()]
            yield pd.DataFrame(rows, columns=["url", "label", "weight"])

    return pages.select("url", "html").mapInPandas(run, "url string, label string, weight double")


def highlights(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, url, label, score, fragment): the control of a page that a query wants.

    ``wanted``: query_id, url, words (tokens); ``pages``: url, html. Scores of 0.5 or less are none; equal
    ones go by label.
    """
    j = control_labels(pages).join(wanted, "url").withColumn("score", F.round(label_score(F.col("words"), F.col("label")) * F.col("weight"), 6)).where("score > 0.5")
    by = Window.partitionBy("query_id", "url").orderBy(F.col("score").desc(), "label")
    top = j.withColumn("r", F.row_number().over(by)).where("r = 1")
    return top.select("query_id", "url", "label", "score", fragment_url(F.col("url"), F.col("label")).alias("fragment"))
