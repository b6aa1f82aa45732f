"""Features of page lines shared by main-content extraction, language labels and keyword pages.

Two passes over the texts, both in numpy. The first counts on how many pages of a site each wording
stands, finds the site's name - the capitalised word pair that most of its repeated lines share - and
counts the words of sentences by language. The second, knowing a site's name and repeated wordings and
each language's common words, gives each line its flags and each page its paragraphs; what follows works
on these narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import registrable_domain
from quern.llm.languages import CODES, declared
from quern.llm.linecode import U64, Lines, among, mix
from quern.llm.pages import fetched, page_key
from quern.session import stored

BATCH = 200
PARAGRAPH = 80  # characters of a full paragraph
HAS_NAME, LONG, ENDS, ELLIPSIS, TITLE, LINK, URLISH, TAG, SEPARATED, QUOTE = (1 << i for i in range(10))
HELD = 1_000_000  # (language, word) counts that a task keeps before it passes them on
_SEPARATORS = "»›>|:–—•·/"
_STOPS = np.array([ord(c) for c in ".!?।॥。…"], dtype=np.uint32)
_CLOSING = np.array([ord(c) for c in "\"'”’»)“"], dtype=np.uint32)
_TAGS = np.array([ord(c) for c in "#+"], dtype=np.uint32)


def site_pages(pages: DataFrame, *more: str) -> DataFrame:
    """Fetched pages with their keys: page_id, body_text, title, skey, pkey and ``more``.

    A page whose address has no host forms a site of its own.
    """
    site = F.coalesce(registrable_domain(F.col("url")), F.col("page_id").cast("string"))
    return fetched(pages).select(
        "page_id", F.coalesce("body_text", F.lit("")).alias("body_text"), F.coalesce("title", F.lit("")).alias("title"),
        F.xxhash64(site).alias("skey"), F.coalesce(page_key(F.col("url")), F.col("page_id")).alias("pkey"), *more,
    )


def word_pairs(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, index of the first word, hash) of each pair of words next to each other in a line."""
    w = lines.words()
    if len(w["line"]) < 2:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(U64)
    at = np.flatnonzero(w["line"][1:] == w["line"][:-1])
    with np.errstate(over="ignore"):
        return w["line"][at], at, mix(w["hash"][at] * U64(3) + w["hash"][at + 1])


class _WordCounts:
    """Partial counts of words by language over the rows of a task: pages with the word, and places in sentences.

    ``rows`` and ``full`` pass on all that is held, so that sums over the parts are exact.
    """

    def __init__(self):
        self.kept: list[np.ndarray] = []
        self.held = 0

    @staticmethod
    def _merge(parts: list[np.ndarray]) -> np.ndarray:
        got = np.concatenate(parts, axis=1)
        order = np.lexsort((got[1], got[0]))
        got = got[:, order]
        new = np.flatnonzero(np.concatenate(([True], (got[:2, 1:] != got[:2, :-1]).any(axis=0))))
        return np.vstack([got[:2, new], np.add.reduceat(got[2:], new, axis=1)])

    def add(self, lines: Lines, lang: np.ndarray, good: np.ndarray, sentence: np.ndarray) -> None:
        """``lang``: of each text, -1 for none; ``good``: lines whose words count; ``sentence``: those whose places count."""
        w = lines.words()
        use = good[w["line"]] & ~w["number"] & (lang[lines.text_of[w["line"]]] >= 0) if len(w["line"]) else np.zeros(0, bool)
        of, word, told = lines.text_of[w["line"][use]], w["hash"][use], sentence[w["line"][use]]
        if not len(of):
            return
        # distinct words of each page, with their places
        with np.errstate(over="ignore"):
            order = np.argsort(mix(word + mix(of.astype(U64) + U64(1))))
        of, word, told = of[order], word[order], told[order]
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (of[1:] != of[:-1]))))
        places = np.add.reduceat(told.astype(np.int64), new)
        of, word = of[new], word[new].view(np.int64)
        ends = np.zeros((4, len(CODES)), np.int64)  # word 0: all pages and places
        ends[0] = np.arange(len(CODES))
        ends[2] = np.bincount(lang[np.unique(of)], minlength=len(CODES))
        ends[3] = np.bincount(lang[of], weights=places, minlength=len(CODES))
        self.kept.append(self._merge([np.vstack([lang[of], word, np.ones(len(of), np.int64), places]), ends[:, ends[2] > 0]]))
        self.held += self.kept[-1].shape[1]
        if self.held > HELD:
            self.kept = [self._merge(self.kept)]
            self.held = self.kept[0].shape[1]

    def full(self) -> bool:
        return self.held > HELD // 2 and len(self.kept) == 1

    def rows(self) -> pd.DataFrame:
        """Pages with a word, and its places in sentences, as rows of the first pass."""
        if not self.kept:
            return pd.DataFrame()
        got = self._merge(self.kept)
        self.kept, self.held = [], 0
        return _rows(1, got[0], got[2], got[1], got[3])


def _rows(kind: int, skey: np.ndarray, pkey: np.ndarray, wkey: np.ndarray, places: np.ndarray | int = 0, names: list | None = None, notice: np.ndarray | bool = False) -> pd.DataFrame:
    """Rows of the first pass; kind 0: lines, 1: words by language, 3: openings of lines."""
    return pd.DataFrame({"kind": np.int32(kind), "skey": skey, "pkey": pkey, "wkey": wkey, "places": places, "names": names if names is not None else np.full(len(skey), None, dtype=object), "notice": notice})


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = _WordCounts()
    for pdf in batches:
        for start in range(0, len(pdf), BATCH):
            part = pdf.iloc[start : start + BATCH]
            # the title follows the text as its last line
            lines = Lines([b + "\n" + t.replace("\n", " ") for b, t in zip(part["body_text"], part["title"], strict=True)])
            title = np.append(lines.text_of[1:] != lines.text_of[:-1], True)
            told = (lines.length >= PARAGRAPH) & sentence_ends(lines) & ~title
            counts.add(lines, part["lang"].to_numpy().astype(np.int64), told | title, told)
            if counts.full():
                yield counts.rows()
            wkey, count = lines.letters()
            w = lines.words()
            line, at, pair = word_pairs(lines)
            # candidates for the site's name: two capitalised (or all upper-case) words in a short line
            names = w["lead_upper"][at] & w["lead_upper"][at + 1] & ~w["number"][at] & (np.bincount(w["line"], minlength=lines.n)[line] <= 25)
            line, pair = line[names], pair[names].view(np.int64)
            copyright_ = np.zeros(lines.n, bool)
            copyright_[lines.line_of[np.flatnonzero(lines.flat == 0xA9)]] = True
            keep = np.flatnonzero((count > 0) & ~title)
            if not len(keep):
                continue
            lo, hi = np.searchsorted(line, keep, "left"), np.searchsorted(line, keep, "right")
            of = lines.text_of[keep]
            yield _rows(0, part["skey"].to_numpy()[of], part["pkey"].to_numpy()[of], wkey[keep].view(np.int64), 0, [pair[a:b] for a, b in zip(lo, hi, strict=True)], copyright_[keep])
            before = lines.letters_before(first_separator(lines)).view(np.int64)
            some = np.flatnonzero((before != 0) & ~title)
            if not len(some):
                continue
            skey, before = part["skey"].to_numpy()[lines.text_of[some]], before[some]
            with np.errstate(over="ignore"):
                _, once = np.unique(mix(before.view(U64) + mix(skey.view(U64))), return_index=True)
            yield _rows(3, skey[once], np.zeros(len(once), np.int64), before[once])
    if len(got := counts.rows()):
        yield got


def first_pass(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sites, wordings, openings, words): (skey, pages, name), (skey, wkey, df), (skey, wkey) and (lang, word, n, places), stored.

    Openings are what stands before the first separator of a line.
    ``n``: pages of the language with the word in a sentence or title; ``places``: its places in sentences.
    Word 0 stands for all pages and places of the language. All counts are exact.
    """
    names_of = declared(F.col("lang"))
    code = F.when(F.size(names_of) == 1, F.coalesce(F.array_position(F.array(*map(F.lit, CODES)), names_of[0]).cast("int") - 1, F.lit(-1))).otherwise(-1)
    rows = site_pages(pages, "lang").withColumn("lang", code)
    found = rows.select("skey", "pkey", "lang", "title", "body_text").mapInPandas(_first, "kind int, skey bigint, pkey bigint, wkey bigint, places bigint, names array<bigint>, notice boolean")
    # one row a wording and page; the words' partial counts pass through the same exchange
    per = found.groupBy("kind", "skey", "wkey", "pkey").agg(F.count(F.lit(1)).alias("c"), F.sum("places").alias("places"), F.min("names").alias("names"), F.max("notice").alias("notice"))
    n = F.when(F.col("kind") == 0, F.lit(1)).otherwise(F.col("pkey") * F.col("c"))
    words = stored(per.groupBy("kind", "skey", "wkey").agg(F.sum(n).alias("df"), F.sum("places").alias("places"), F.min("names").alias("names"), F.max("notice").alias("notice")))
    site_words = words.where("kind = 0")
    # repeated lines count most; where a site has few pages, the pair that most of its short lines share
    again = F.when(F.col("notice"), 3).when(F.col("df") >= 2, 1).otherwise(0)
    votes = (
        site_words.where(F.size("names") > 0)
        .select("skey", F.explode("names").alias("name"), again.alias("v"), "df")
        .groupBy("skey", "name").agg(F.struct(F.sum("v").alias("again"), F.count(F.lit(1)).alias("lines"), F.sum("df").alias("places")).alias("v"))
        .where((F.col("v.again") >= 2) | ((F.col("v.lines") >= 3) & (F.col("v.places") >= 4)))
        .groupBy("skey").agg(F.max(F.struct("v", "name"))["name"].alias("name"))
    )
    counts = rows.select("skey", "pkey").distinct().groupBy("skey").agg(F.count(F.lit(1)).alias("pages"))
    sites = stored(counts.join(votes, "skey", "left"))
    counted = words.where("kind = 1").select(F.col("skey").cast("int").alias("lang"), F.col("wkey").alias("word"), F.col("df").alias("n"), "places")
    return sites, site_words.select("skey", "wkey", "df"), words.where("kind = 3").select("skey", "wkey"), counted


def first_separator(lines: Lines) -> np.ndarray:
    """Where the first separator after the start of each line stands; -1 for none."""
    sep = np.flatnonzero(among(lines.low, _SEPARATORS))
    seg = lines.line_of[sep]
    inside = sep > lines.first[seg]
    sep, seg = sep[inside], seg[inside]
    where = np.full(lines.n, -1, np.int64)
    if len(sep):
        edge = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        where[seg[edge]] = sep[edge]
    return where


def sentence_ends(lines: Lines) -> np.ndarray:
    """Lines that end with a full stop or its like, perhaps within a closing quote."""
    last = lines.flat[np.maximum(lines.last, 0)]
    before = lines.flat[np.maximum(lines.last - 1, 0)]
    return (lines.inked > 1) & (np.isin(last, _STOPS) | (np.isin(last, _CLOSING) & np.isin(before, _STOPS)))


def line_features(lines: Lines, titles: list[str], names: np.ndarray, links: list | None = None) -> dict[str, np.ndarray]:
    """Features of all lines; ``names``: the site-name hash of each text, 0 for none."""
    wkey, letters = lines.letters()
    w = lines.words()
    n = lines.n
    line, at, pair = word_pairs(lines)
    name_of = names[lines.text_of]
    is_name = (pair == name_of[line]) & (name_of[line] != 0)
    flags = np.zeros(n, np.int64)
    flags[line[is_name]] |= HAS_NAME
    flags[lines.length >= PARAGRAPH] |= LONG
    inked = lines.inked > 0
    last = lines.flat[np.maximum(lines.last, 0)]
    first = lines.flat[np.minimum(lines.first, len(lines.flat) - 1)]
    flags[sentence_ends(lines)] |= ENDS
    flags[inked & (last == 0x2026)] |= ELLIPSIS
    flags[inked & np.isin(first, np.array([ord(c) for c in "“\"„‘'"], dtype=np.uint32))] |= QUOTE
    tag = inked & np.isin(first, _TAGS)
    # text before the first separator that follows a letter
    where = first_separator(lines)
    prekey = lines.letters_before(where)
    flags[where >= 0] |= SEPARATED
    # the title
    t = Lines([x.replace("\n", " ") for x in titles])
    tkey, tletters = t.letters()
    same = (tkey[lines.text_of] == wkey) & (tletters[lines.text_of] >= 3)
    flags[same] |= TITLE
    # addresses, and lines that are a link's text
    colon = np.flatnonzero(lines.flat[:-2] == 58) if len(lines.flat) > 2 else np.zeros(0, np.int64)
    colon = colon[(lines.flat[colon + 1] == 47) & (lines.flat[colon + 2] == 47)]
    flags[lines.line_of[colon]] |= URLISH
    bare = np.bincount(lines.line_of[lines.flat == 46], minlength=n)
    spaces = np.bincount(lines.line_of[lines.flat == 32], minlength=n)
    words = np.bincount(w["line"], minlength=n)
    flags[inked & (bare >= 1) & (spaces == 0) & (words >= 2) & ~np.isin(last, _STOPS)] |= URLISH
    if links is not None:
        texts = [[(x["text"] or "").replace("\n", " ") for x in ls] if ls is not None else [] for ls in links]
        lt = Lines([x for ls in texts for x in ls] or [""])
        lkey, lletters = lt.letters()
        of = np.repeat(np.arange(len(texts)), [len(x) for x in texts]) if any(texts) else np.zeros(0, np.int64)
        pool = mix(lkey[: len(of)] + mix(of.astype(U64)))[lletters[: len(of)] >= 3]
        flags[(letters >= 3) & np.isin(mix(wkey + mix(lines.text_of.astype(U64))), pool)] |= LINK
    flags[tag] |= TAG
    return {"wkey": wkey, "letters": letters, "prekey": prekey, "path": lines.outline(), "flags": flags, "words": words}
