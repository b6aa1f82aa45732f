"""Problem 2: languages of pages and of stretches of mixed pages.

Rank-order profiles: a language's profile is its most frequent letter trigrams (with word edges) in order;
a text is compared by the out-of-place distance of its own most frequent trigrams. Profiles are fitted on a
bounded sample of pages by their declared labels, which are often wrong; paragraphs nearest to another
language's profile are then left out and the profiles fitted again. Names (capitalised words) and numbers
carry no language and are not counted. The confidence is the margin of the nearest profile over the next,
0 to 1.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.content import PARA, decided, featured, has, spam_scores, without_spam
from quern.llm.features import BATCH, site_pages
from quern.llm.languages import CODES, declared
from quern.llm.linecode import U64, Lines, mix
from quern.llm.pages import fetched
from quern.session import read_table, stored

SAMPLE_PAGES = 120  # pages a declared language from which profiles are fitted
PROFILE = 400  # trigrams of a profile, and of a text that are compared
ROUNDS = 3


def trigrams(lines: Lines, chosen: np.ndarray, group: np.ndarray | None = None, names: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, trigram, rank) of the most frequent trigrams of the chosen lines, the most frequent at rank 0.

    ``group``: ascending numbers of what the lines belong to, in place of the lines themselves. ``names``:
    count capitalised words too.
    """
    w = lines.words()
    use = np.flatnonzero(chosen[w["line"]] & (~w["lead_upper"] | names) & ~w["number"]) if len(w["line"]) else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if not len(use):
        return none, none.astype(U64), none
    start, size = w["start"][use], w["end"][use] - w["start"][use] + 1  # a space before each word
    at = np.cumsum(size) - size
    codes = lines.lower[np.arange(int(size.sum())) + np.repeat(start - 1 - at, size)]
    codes[at] = 32
    line = np.repeat(w["line"][use] if group is None else group[w["line"][use]], size)
    # the batch's characters by number, so that text and trigram are one whole number, which sorts fastest
    present = np.zeros(int(codes.max()) + 1, bool)
    present[codes] = True
    letters = np.flatnonzero(present).astype(U64)
    bits = len(letters).bit_length()
    char = (np.cumsum(present) - 1)[codes]
    # the space before the next word ends a word as well
    same = np.flatnonzero((line[:-2] == line[2:]) & (codes[1:-1] != 32))
    of, gram = line[same], char[same] << 2 * bits | char[same + 1] << bits | char[same + 2]
    if not len(gram):
        return none, none.astype(U64), none
    if int(of.max()).bit_length() + 3 * bits < 64:
        both = np.sort(of << 3 * bits | gram)
        new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        of, gram = both[new] >> 3 * bits, both[new] & ((1 << 3 * bits) - 1)
    else:
        key = np.lexsort((gram, of))
        of, gram = of[key], gram[key]
        new = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1]))))
        of, gram = of[new], gram[new]
    count = np.diff(np.append(new, len(same)))
    low = (1 << bits) - 1
    gram = letters[gram >> 2 * bits] << U64(42) | letters[gram >> bits & low] << U64(21) | letters[gram & low]
    gram = gram[_by_count(of, count, mix(gram))]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    keep = rank < PROFILE
    return of[keep], gram[keep], rank[keep]


def _by_count(of: np.ndarray, count: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """``np.lexsort((tie, -count, of))`` for hashes ``tie``: one sort of a number that begins with text and count."""
    most = int(count.max())
    bits = most.bit_length() + int(of.max()).bit_length()
    if bits <= 40:
        key = (of.astype(U64) << U64(most.bit_length()) | (most - count).astype(U64)) << U64(64 - bits) | tie >> U64(bits)
        order = np.argsort(key)
        key = key[order]
        if (key[1:] != key[:-1]).all():
            return order
    return np.lexsort((tie, -count, of))


def _characters(gram: np.ndarray) -> tuple[np.ndarray, ...]:
    """The three characters of each trigram."""
    return tuple((gram >> U64(shift) & U64(0x1FFFFF)).astype(np.int64) for shift in (42, 21, 0))


class Profiles:
    """Ranks of trigrams in each language's profile."""

    def __init__(self, per_language: dict[int, np.ndarray]):
        self.codes = sorted(per_language)
        self.grams = np.unique(np.concatenate([per_language[k] for k in self.codes])) if self.codes else np.zeros(0, U64)
        # the last column is for trigrams of no profile; a missing rank is PROFILE or more from any other
        self.ranks = np.full((len(self.codes), len(self.grams) + 1), 2 * PROFILE, np.int32)
        for j, k in enumerate(self.codes):
            self.ranks[j, np.searchsorted(self.grams, per_language[k])] = np.arange(len(per_language[k]))
        # a trigram's column in two steps: its first two characters' number, then the third
        a, b, c = _characters(self.grams)
        self.number = np.zeros(int(max(a.max(), b.max(), c.max())) + 2 if len(a) else 1, np.int64)
        known = np.unique(np.concatenate((a, b, c)))
        self.number[known] = np.arange(1, len(known) + 1)
        self.pairs, self.thirds = np.zeros((len(known) + 1, len(known) + 1), np.int32), np.zeros((1, len(known) + 1), np.int32)
        if len(a):
            a, b, c = self.number[a], self.number[b], self.number[c]
            pair, at = np.unique(a * (len(known) + 1) + b, return_inverse=True)
            self.pairs.flat[pair] = np.arange(1, len(pair) + 1)
            self.thirds = np.full((len(pair) + 1, len(known) + 1), len(self.grams), np.int32)
            self.thirds[at + 1, c] = np.arange(len(self.grams))

    def columns(self, gram: np.ndarray) -> np.ndarray:
        """Column of each trigram in ``ranks``, the last one for unknown trigrams."""
        a, b, c = (self.number[np.minimum(x, len(self.number) - 1)] for x in _characters(gram))
        n = self.pairs.shape[1]
        return self.thirds.ravel()[self.pairs.ravel()[a * n + b].astype(np.int64) * n + c]

    def nearest(self, lines: Lines, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, confidence) of each line; -1 and 0 where not chosen or without trigrams."""
        return self.place(*trigrams(lines, chosen), lines.n)

    def place(self, of: np.ndarray, gram: np.ndarray, rank: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` from the ranked trigrams of ``texts`` texts."""
        best, sure = np.full(texts, -1, np.int32), np.zeros(texts)
        if not len(of) or not len(self.grams):
            return best, sure
        # the trigrams of a text stand together
        at, rank = self.columns(gram), rank.astype(np.int32)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        some, n = of[first], np.diff(np.append(first, len(of)))
        far = np.empty((len(some), len(self.codes)))
        for j, ranks in enumerate(self.ranks):
            far[:, j] = np.add.reduceat(np.minimum(np.abs(ranks[at] - rank), PROFILE), first)
        far /= n[:, None] * PROFILE
        order = np.argsort(far, axis=1, kind="stable")
        d1 = far[np.arange(len(far)), order[:, 0]]
        d2 = far[np.arange(len(far)), order[:, 1]] if far.shape[1] > 1 else np.ones(len(far))
        best[some] = np.array(self.codes, np.int32)[order[:, 0]]
        sure[some] = np.clip((d2 - d1) / np.maximum(d2, 1e-9), 0, 1)
        return best, sure


def fit_profiles(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Profiles:
    """Profiles from at most ``sample_pages`` pages a declared language, chosen by a hash of the id."""
    names = declared(F.col("lang"))
    rows = site_pages(pages, "lang").where((F.size(names) == 1) & names[0].isin(CODES) & (F.length("body_text") >= 400))
    rows = rows.groupBy("page_id").agg(F.min(names[0]).alias("code"))
    by = Window.partitionBy("code").orderBy(F.xxhash64("page_id"), "page_id")
    chosen = rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= sample_pages).select("page_id", "code")
    # at most sample_pages rows a language come to the driver; of rows with one id the greatest text
    got = site_pages(pages).join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.max(F.struct("body_text", "code")).alias("x")).orderBy("page_id").select("x.*").toPandas()
    label = got["code"].map({c: i for i, c in enumerate(CODES)}).to_numpy(dtype=np.int64)
    # long lines of the sample as sets of ranked trigrams
    batches = []
    for at in range(0, len(got), BATCH):
        lines = Lines(got["body_text"].iloc[at : at + BATCH].tolist())
        use = lines.length >= 80
        batches.append((*trigrams(lines, use), label[at : at + BATCH][lines.text_of]))
    trusted = [np.ones(len(want), bool) for *_, want in batches]
    profiles = Profiles({})
    for _ in range(ROUNDS):
        per = {}
        for k in range(len(CODES)):
            parts = [gram[(want[of] == k) & good[of]] for (of, gram, _, want), good in zip(batches, trusted, strict=True)]
            mine = np.concatenate(parts) if parts else np.zeros(0, U64)
            if len(mine):
                g, n = np.unique(mine, return_counts=True)
                per[k] = g[np.lexsort((mix(g), -n))][:PROFILE]
        profiles = Profiles(per)
        trusted = [profiles.place(of, gram, rank, len(want))[0] == want for of, gram, rank, want in batches]
    return profiles


def labelled_lines(pages: DataFrame, whole: bool) -> DataFrame:
    """``featured`` lines with plang, sure and, if ``whole``, ptext, psure.

    ``plang`` and ``sure``: language and confidence of a paragraph, -1 and 0 elsewhere. ``ptext`` and ``psure``: the
    same of all lines of a page without paragraphs together, on each of its lines: the lines that are
    no furniture, or all lines where these hold no trigram.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit_profiles(pages))

    def languages(lines: Lines, keep: np.ndarray, paragraphs: np.ndarray, plain: np.ndarray) -> dict[str, np.ndarray]:
        profiles = shared.value
        best, sure = profiles.nearest(lines, paragraphs)
        if not whole:
            return {"plang": best[keep], "sure": sure[keep]}
        texts = int(lines.text_of[-1]) + 1 if lines.n else 0
        ptext, psure = np.full(texts, -1, np.int32), np.zeros(texts)
        bare = np.bincount(lines.text_of[paragraphs], minlength=texts) == 0
        for chosen in (plain, np.ones(lines.n, bool)):
            if not (ask := chosen & (bare & (ptext < 0))[lines.text_of]).any():
                break
            for names in (False, True):  # names tell only where there is nothing else
                got, how = profiles.place(*trigrams(lines, ask, lines.text_of, names), texts)
                new = (ptext < 0) & (got >= 0)
                ptext[new], psure[new] = got[new], how[new]
        return {"plang": best[keep], "sure": sure[keep], "ptext": ptext[lines.text_of[keep]], "psure": psure[lines.text_of[keep]]}

    return featured(pages, languages, "plang int, sure double" + (", ptext int, psure double" if whole else ""))


def labelled_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, words, plang, sure): the paragraphs of the articles with their languages; no keyword pages."""
    lines = labelled_lines(pages, False)
    scores = stored(spam_scores(decided(lines.drop("plang", "sure"))))
    return without_spam(lines.where(has(F.col("flags"), PARA) & (F.col("plang") >= 0)).select("page_id", "line_no", "words", "plang", "sure"), scores)


def code_name(k):
    return F.element_at(F.array(*map(F.lit, CODES)), k + 1)


def page_segments(pages: DataFrame) -> DataFrame:
    """(page_id, segment, first_line, last_line, lang, confidence): stretches of an article in one language.

    Consecutive paragraphs of the same language form a stretch; its confidence is their mean, weighted by
    words. Pages without a paragraph and keyword pages have none.
    """
    kept = labelled_paragraphs(pages)
    page = Window.partitionBy("page_id").orderBy("line_no")
    starts = kept.withColumn("new", (F.col("plang") != F.lag("plang", 1, -1).over(page)).cast("int"))
    runs = starts.withColumn("segment", F.sum("new").over(page).cast("int"))
    return runs.groupBy("page_id", "segment").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), code_name(F.first("plang")).alias("lang"),
        F.round(F.sum(F.col("sure") * F.col("words")) / F.sum("words"), 6).alias("confidence"),
    )


def wrong_labels(pages: DataFrame) -> DataFrame:
    """(page_id, lang, confidence): languages of the articles whose declared label is missing or not exactly theirs.

    The label is right in any notation if it names exactly the languages of the article's paragraphs.
    """
    kept = labelled_paragraphs(pages)
    each = kept.groupBy("page_id", "plang").agg((F.sum(F.col("sure") * F.col("words")) / F.sum("words")).alias("confidence"))
    each = each.select("page_id", code_name(F.col("plang")).alias("lang"), "confidence")
    sets = each.groupBy("page_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    labels = pages.where((F.col("status") == 200) & F.col("page_id").isNotNull()).select("page_id", declared(F.col("lang")).alias("names")).distinct()
    wrong = sets.join(labels, "page_id").where(F.col("langs") != F.col("names")).select("page_id").distinct()
    return each.join(wrong, "page_id")


def page_labels(pages: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, basis): the languages of every fetched page.

    A page with paragraphs has one row for each of their languages (basis "paragraphs"), whatever kind of page it
    is; another the language of its lines together ("lines"); one without letters a NULL language and
    confidence ("none"). Confidences are means weighted by words. Of several rows of one id all lines count.
    """
    lines = labelled_lines(pages, True)
    told = lines.where(has(F.col("flags"), PARA) & (F.col("plang") >= 0)).groupBy("page_id", F.col("plang").alias("k")).agg((F.sum(F.col("sure") * F.col("words")) / F.sum("words")).alias("c"))
    other = lines.where(F.col("ptext") >= 0).groupBy("page_id").agg(F.max(F.struct("psure", "ptext")).alias("x"))
    named = told.select("page_id", "k", "c", F.lit(1).alias("b"))
    other = other.join(told.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.col("x.ptext").alias("k"), F.col("x.psure").alias("c"), F.lit(2).alias("b"))
    got = named.union(other)
    rest = fetched(pages).select("page_id").distinct().join(got, "page_id", "left")
    return rest.select("page_id", F.when(F.col("k") >= 0, code_name(F.col("k"))).alias("lang"), F.round("c", 6).alias("confidence"), F.when(F.col("b") == 1, "paragraphs").when(F.col("b") == 2, "lines").otherwise("none").alias("basis"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the pages whose declared language is missing or wrong."""
    return wrong_labels(read_table(spark, sf_dir, "crawled_pages")).select("page_id", "lang").distinct()


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each article by language, with confidence."""
    return page_segments(read_table(spark, sf_dir, "crawled_pages"))


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fetched page with its languages and their confidence."""
    return page_labels(read_table(spark, sf_dir, "crawled_pages"))


QUERIES = {"p2_found": p2_found, "p2_segments": p2_segments, "p2_pages": p2_pages}
ORACLE: dict[str, str] = {}
