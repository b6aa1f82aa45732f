"""URL functions as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under which registrable names have three labels.
PUBLIC_SECOND_LEVEL = ["co", "com", "net", "org", "gov", "ac", "edu", "res"]
#: Query parameters that only track visitors.
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "ref", "referrer", "source",
]
#: File names that stand for their folder.
INDEX_FILES = ["index.html", "index.htm", "index.php", "default.aspx"]

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)"


def host(url: Column) -> Column:
    """Lower-case host; NULL where there is none."""
    h = F.lower(F.regexp_extract(F.trim(url), _AUTHORITY, 1))
    return F.when(h != "", h)


def host_of(url: Column) -> Column:
    """Lower-case host without leading ``www.``; NULL where there is none."""
    return F.regexp_replace(host(url), r"^(www\.)+", "")


def registrable_domain(url: Column) -> Column:
    """Last two labels of the host, or three below a public second level; one label stays as it is."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    take = F.when((n >= 3) & F.get(labels, n - 2).isin(PUBLIC_SECOND_LEVEL), 3).otherwise(F.least(n, F.lit(2)))
    return F.when(host(url).isNotNull(), F.array_join(F.slice(labels, n - take + 1, take), "."))


def path_of(url: Column) -> Column:
    """Path without query and fragment; empty where there is none."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """One spelling for the addresses of one page.

    https, host without www., no port, no fragment, no tracking parameters, the others decoded and
    sorted, no index file, no trailing slash. Text without scheme and host is lower-cased and loses
    its trailing slashes; NULL stays NULL.
    """
    h = F.regexp_replace(host(url), r"^www\.", "")
    path = path_of(url)
    index = "(" + "|".join(x.replace(".", r"\.") for x in INDEX_FILES) + ")$"
    path = F.regexp_replace(F.regexp_replace(path, index, ""), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    named = F.transform(
        pairs,
        lambda p: F.struct(decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(named, lambda p: ~p["k"].isin(TRACKING_PARAMETERS)))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    full = F.concat(F.lit("https://"), h, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    return F.when(h.isNotNull(), F.regexp_replace(full, "/+$", "")).otherwise(F.lower(F.regexp_replace(url, "/+$", "")))


def url_depth(url: Column) -> Column:
    """Number of non-empty path segments."""
    return F.size(F.filter(F.split(path_of(url), "/"), lambda s: s != ""))


def url_to_text(url: Column) -> Column:
    """Words of an address without scheme, www and file endings."""
    words = F.split(F.translate(url, "/.-_?&=:", " " * 8), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin("https", "http", "www", "html", "php", "index")), " ")


def slug_tokens(url: Column) -> Column:
    """Lower-case path words of two characters or more that are not numbers."""
    words = F.split(F.lower(path_of(url)), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))


def shard_for_url(url: Column, shards: int) -> Column:
    """Stable shard number of an address."""
    return F.pmod(F.xxhash64(url), F.lit(shards)).cast("int")


def looks_like_host(text: Column) -> Column:
    """label.tld of letters, digits, dots and hyphens whose last label has two letters or more."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"), F.lit(False))
