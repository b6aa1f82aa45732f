"""Names of languages: declared values as found, and the codes of this project."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-letter code, three-letter codes and English name of the languages that occur.
LANGUAGES = {
    "en": ["en", "eng", "english"],
    "hi": ["hi", "hin", "hindi"],
    "mr": ["mr", "mar", "marathi"],
    "ta": ["ta", "tam", "tamil"],
    "fr": ["fr", "fra", "fre", "french"],
    "de": ["de", "deu", "ger", "german"],
    "es": ["es", "spa", "spanish"],
    "pt": ["pt", "por", "portuguese"],
}
CODES = list(LANGUAGES)


def declared(lang: Column) -> Column:
    """Sorted distinct two-letter codes of a declared value; an unknown name gives ``?``; NULL or blank none.

    Codes with a country, three-letter codes, English names, any case, and lists are understood;
    ``und``, ``unknown`` and ``x-default`` name nothing.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(lang, F.lit(""))), r"[,;/|\s]+|\band\b"), lambda p: p != "")
    base = F.transform(parts, lambda p: F.regexp_extract(p, "^([a-z]+)", 1))
    named = F.filter(base, lambda b: ~b.isin("und", "unknown", "x", "none", "null", "n", ""))
    table = F.create_map(*(F.lit(x) for code, names in LANGUAGES.items() for n in names for x in (n, code)))
    return F.array_sort(F.array_distinct(F.transform(named, lambda b: F.coalesce(table[b], F.lit("?")))))
