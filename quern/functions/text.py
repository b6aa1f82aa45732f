"""Text functions as column expressions, and the two that need code of their own (SimHash, stemming)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{M}\p{N}]+"  # combining marks belong to the word

#: Phrases of parked and placeholder pages.
PARKED_MARKERS = [
    "domain for sale", "buy this domain", "this domain is for sale", "domain name is for sale", "domain name is available",
    "this domain is available", "domain is available", "available for purchase", "is for sale", "inquire about this domain",
    "the domain name you are looking for", "this web page is parked", "resources and information", "this website is for sale",
    "this domain may be for sale", "premium domain", "high value and premium domain", "domain name for sale", "parked domain",
    "please access via the domain name", "under construction", "coming soon", "website is coming soon", "default web page",
    "apache2 ubuntu default page", "welcome to nginx", "index of /", "account suspended", "bandwidth limit exceeded",
]


def collapse(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise_anchor(text: Column) -> Column:
    return F.lower(collapse(text))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits of 40 bytes at most; NULL gives none."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1), lambda w: F.octet_length(w) <= 40)


def normalise_name(name: Column) -> Column:
    """Lower case, anything but letters and digits to one space: the key of the gazetteer."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; none where there are fewer."""
    count = F.size(words) - (n - 1)
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def quality_score(title: Column, body: Column) -> Column:
    """0 (junk) to 1: parked pages 0; thin, untitled and repetitive ones less than 1. NULL counts as empty."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    low_t, head = F.lower(F.trim(t)), F.lower(F.substring(b, 1, 600))
    parked = F.exists(F.array(*map(F.lit, PARKED_MARKERS)), lambda m: F.contains(F.lower(t), m) | F.contains(head, m))
    n = F.char_length(F.trim(b))
    words = F.filter(F.split(F.lower(b), r"\s+"), lambda w: w != "")
    count = F.size(words)
    variety = F.size(F.array_distinct(words)) / count
    length = F.when(n < 200, 0.25).when(n < 600, 0.6).otherwise(1.0)
    titled = F.when(low_t == "", 0.5).when((low_t == "untitled") | low_t.startswith("http"), 0.7).otherwise(1.0)
    varied = F.when((n > 400) & (count > 50), F.when(variety < 0.12, 0.3).when(variety < 0.25, 0.7).otherwise(1.0)).otherwise(1.0)
    return F.when(parked, F.lit(0.0)).otherwise(F.least(F.lit(1.0), length * titled * varied))


_FNV_OFFSET, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)  # fixed values of FNV-1a


def fnv1a(data: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each byte string, all at once by byte position."""
    out = np.full(len(data), _FNV_OFFSET, dtype=np.uint64)
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    if not len(data) or not sizes.max():
        return out
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
    ends = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right")
    h = out[order]
    with np.errstate(over="ignore"):
        for i, k in enumerate(ends):
            h[:k] = (h[:k] ^ flat[starts[:k] + i].astype(np.uint64)) * _FNV_PRIME
    out[order] = h
    return out


def simhash_of(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's word trigrams, each counted as often as it occurs; 0 without words."""
    words = [w for x in (text or "").split() if (w := _bare(x).lower())]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = fnv1a([g.encode("utf-8", "surrogatepass") for g in grams])
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(majority).tobytes(), "big")


def _bare(word: str) -> str:
    i, j = 0, len(word)
    while i < j and not word[i].isalnum():
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    return word[i:j]


@F.pandas_udf(T.LongType())
def simhash64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash as the bit pattern of a long."""
    for s in batches:
        yield pd.Series([x - (1 << 64) if x >> 63 else x for x in map(simhash_of, s)], dtype="int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# ---- English stemmer (Porter2, from its published description)

_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words the algorithm lists apart.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("ization", "ize"),
    ("izer", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"),
    ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"),
    ("lessli", "less"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in "aeiouy" and w[i - 1] in "aeiouy":
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    if r1 < len(w):
        return False
    if len(w) == 2:
        return w[0] in "aeiouy" and w[1] not in "aeiouy"
    return len(w) > 2 and w[-1] not in "aeiouywxY" and w[-2] in "aeiouy" and w[-3] not in "aeiouy"


def stem(word: str) -> str:
    """Porter2 stem of a lower-case English word; other text passes through its rules unharmed."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiouy") else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    vowel = lambda s: any(c in "aeiouy" for c in s)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    for end in ("eedly", "eed"):
        if w.endswith(end):
            w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif _short(w, r1):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, new in sorted(_STEP2, key=lambda x: -len(x[0])):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for end, new in sorted(_STEP3, key=lambda x: -len(x[0])):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1], r1))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_en(words: pd.Series) -> pd.Series:
    """Stem of each word; apply it to a distinct vocabulary."""
    return words.map(lambda w: stem(w) if w is not None else None)
