"""Readers of pages: JSON lines, HTML, web archives and their index, robots files and sitemaps."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
PAGE = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("body_text", T.StringType()), T.StructField("links", T.ArrayType(LINK)),
    T.StructField("crawled_at_unix", T.LongType()), T.StructField("status", T.IntegerType()),
])
SIGNALS = "url string, pagerank float, anchor_text string, inbound_domains long, quality float, simhash long, is_duplicate boolean"
#: Elements whose text is not visible.
HIDDEN = ("script", "style", "noscript", "template")
DEFAULT_CRAWL_DELAY_MS = 500


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON lines: malformed and blank lines are left out, only status 200 is kept."""
    return spark.read.schema(PAGE).option("mode", "DROPMALFORMED").json(path).where("status = 200 AND url IS NOT NULL")


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals from JSON lines; a malformed line is an error. Of one address the last line counts, by file name and place."""
    rows = spark.read.schema(SIGNALS).option("mode", "FAILFAST").json(path)
    rows = rows.withColumn("__f", F.col("_metadata.file_path")).withColumn("__b", F.col("_metadata.file_block_start")).withColumn("__n", F.monotonically_increasing_id())
    by = Window.partitionBy("url").orderBy(F.col("__f").desc(), F.col("__b").desc(), F.col("__n").desc())
    return rows.where(F.col("url").isNotNull()).withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r", "__f", "__b", "__n")


def write_signals(signals: DataFrame, path: str) -> None:
    """Signals as JSON lines; what was there is replaced."""
    signals.select("url", "pagerank", "anchor_text", "inbound_domains", "quality", "simhash", "is_duplicate").write.mode("overwrite").json(path)


def write_handoff(links: DataFrame, path: str, shards: int, own: int) -> None:
    """Addresses (url) that belong to other shards, as text, one folder a target shard."""
    from quern.functions.urls import shard_for_url

    to = links.where("url IS NOT NULL").select("url").distinct().withColumn("target_shard", shard_for_url(F.col("url"), shards))
    to.where(F.col("target_shard") != own).write.mode("append").partitionBy("target_shard").text(path)


def write_table(table: DataFrame, path: str, append: bool = False, partition_by: str | None = None) -> None:
    """An index, gazetteer, tile or POI table as Parquet: replaced as a whole, or appended to."""
    writer = table.write.mode("append" if append else "overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' AND NOT startswith(url, '#')")


def write_pages(pages: DataFrame, path: str, shards: int) -> None:
    """Appends pages as JSON lines, one folder a shard."""
    from quern.functions.urls import shard_for_url

    pages.withColumn("shard", shard_for_url(F.col("url"), shards)).write.mode("append").partitionBy("shard").json(path)


class _Page(HTMLParser):
    def __init__(self, base: str, hidden: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.base, self.hidden, self.depth = base, hidden, 0
        self.title: list[str] = []
        self.text: list[str] = []
        self.links: set[tuple[str, str]] = set()
        self.in_title = self.in_head = False
        self.href: str | None = None
        self.label: list[str] = []

    def _close_link(self) -> None:
        if self.href is not None:
            self.links.add((self.href, " ".join("".join(self.label).split())))
        self.href, self.label = None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self.depth += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "a":
            self._close_link()
            href = dict(attrs).get("href")
            if href:
                try:
                    url = urldefrag(urljoin(self.base, href.strip()))[0]
                except ValueError:
                    return
                if url.startswith(("http://", "https://")):
                    self.href = url

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.depth = max(0, self.depth - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False
        elif tag == "a":
            self._close_link()

    def handle_data(self, data):
        if self.depth:
            return
        if self.in_title:
            self.title.append(data)
        elif not self.in_head:
            if t := data.strip():
                self.text.append(t)
            if self.href is not None:
                self.label.append(data)


def parse_html(url: str, html: str | None, hidden: tuple[str, ...] = HIDDEN) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, visible text, sorted distinct links) of a page, however untidy its markup."""
    p = _Page(url or "", hidden)
    p.feed(html or "")
    p.close()
    p._close_link()
    return " ".join("".join(p.title).split()), " ".join(" ".join(p.text).split()), sorted(p.links)


def pages_from_html(rows: DataFrame, hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    """(url, title, body_text, links) of rows with url and html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_html(u, h, hidden) for u, h in zip(pdf["url"], pdf["html"], strict=True)]
            yield pd.DataFrame({"url": pdf["url"], "title": [g[0] for g in got], "body_text": [g[1] for g in got], "links": [[{"url": u, "text": t} for u, t in g[2]] for g in got]})

    return rows.select("url", "html").mapInPandas(run, "url string, title string, body_text string, links array<struct<url:string,text:string>>")


def parse_archive_record(data: bytes | None) -> tuple[int, str]:
    """(status, payload) of one archive record, gzipped (several members too) or plain; status 200 if unclear."""
    raw = data or b""
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            return 0, ""
    parts = raw.decode("utf-8", "replace").split("\r\n\r\n", 2)
    if len(parts) < 3:
        return 0, ""
    words = parts[1].split("\r\n")[0].split()
    return (int(words[1]) if len(words) > 1 and words[1].isdigit() else 200), parts[2]


def pages_from_archive(records: DataFrame) -> DataFrame:
    """(url, status, title, body_text, links) of records (url, content): archive records with a visible text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, data in zip(pdf["url"], pdf["content"], strict=True):
                status, html = parse_archive_record(data)
                title, text, links = parse_html(url, html)
                rows.append((url, status, title, text, [{"url": u, "text": t} for u, t in links]))
            yield pd.DataFrame(rows, columns=["url", "status", "title", "body_text", "links"])

    schema = "url string, status int, title string, body_text string, links array<struct<url:string,text:string>>"
    return records.select("url", "content").mapInPandas(run, schema).where("body_text <> ''")


CDX = "url string, status string, mime string, languages string, filename string, offset string, length string"


def select_blocks(index: DataFrame, prefixes: list[str]) -> DataFrame:
    """Blocks of a sparse index (line_no, surt, file, offset, length) that may hold a prefix: matching ones and each one's predecessor.

    The index is sorted, and the predecessor is found by an equality join on the line number, so that no window
    runs over the whole table.
    """
    match = F.lit(False)
    for p in prefixes:
        match = match | F.col("surt").startswith(p)
    hits = index.where(match).select("line_no")
    wanted = hits.union(hits.select(F.col("line_no") - 1)).distinct()
    return index.join(wanted, "line_no", "left_semi").where((F.coalesce("file", F.lit("")) != "") & (F.col("length") > 0))


def parse_cdx(lines: DataFrame, prefixes: list[str]) -> DataFrame:
    """(surt, ts, url, status, mime, filename, offset, length) of index lines with a prefix; broken JSON is left out."""
    parts = F.split("value", " ", 3)
    rows = lines.select(F.get(parts, F.lit(0)).alias("surt"), F.get(parts, F.lit(1)).alias("ts"), F.from_json(F.get(parts, F.lit(2)), CDX).alias("j"))
    match = F.lit(False)
    for p in prefixes:
        match = match | F.col("surt").startswith(p)
    out = rows.where(match & F.col("j.url").isNotNull())
    return out.select("surt", "ts", "j.url", "j.status", F.coalesce("j.mime", F.lit("")).alias("mime"), "j.filename", F.expr("try_cast(j.offset AS bigint)").alias("offset"), F.expr("try_cast(j.length AS bigint)").alias("length"))


def fetchable(records: DataFrame) -> DataFrame:
    """Records with status 200, an HTML or unstated type and a byte range."""
    return records.where((F.col("status") == "200") & (F.contains(F.col("mime"), F.lit("html")) | (F.col("mime") == "")) & F.col("offset").isNotNull() & F.col("length").isNotNull())


def slice_estimate(blocks: DataFrame, sample: DataFrame) -> DataFrame:
    """(blocks, pages, fetchable_pages, bytes): a slice's size from its blocks and the records of a sampled one."""
    s = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
    ok = fetchable(sample).agg(F.count(F.lit(1)).alias("ok"))
    b = blocks.agg(F.count(F.lit(1)).alias("blocks"))
    one = b.crossJoin(s).crossJoin(ok)  # three single rows
    return one.select("blocks", (F.col("blocks") * F.col("n")).alias("pages"), (F.col("blocks") * F.col("ok")).alias("fetchable_pages"), F.round(F.col("blocks") * F.col("ok") * F.col("mean")).cast("long").alias("bytes"))


def robots(body: Column, agent: str) -> Column:
    """struct(disallow, crawl_delay_ms, sitemaps) of a robots file for an agent.

    The last user-agent line decides what the lines below it belong to; names are compared without case.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\r?\n"), lambda s: F.trim(F.regexp_replace(s, "#.*$", ""))), lambda s: F.contains(s, F.lit(":")))
    pairs = F.transform(lines, lambda s: F.struct(F.lower(F.trim(F.regexp_extract(s, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(s, "^[^:]*:(.*)$", 1)).alias("v")))
    start = F.struct(
        F.lit(False).alias("on"), F.array().cast("array<string>").alias("disallow"), F.lit(DEFAULT_CRAWL_DELAY_MS).cast("long").alias("delay"), F.array().cast("array<string>").alias("sitemaps")
    )

    def step(acc: Column, p: Column) -> Column:
        k, v = p["k"], p["v"]
        on = F.when(k == "user-agent", (v == "*") | (F.lower(v) == agent.lower())).otherwise(acc["on"])
        seconds = v.try_cast("double")
        return F.struct(
            on.alias("on"), F.when((k == "disallow") & on & (v != ""), F.concat(acc["disallow"], F.array(v))).otherwise(acc["disallow"]).alias("disallow"),
            F.when((k == "crawl-delay") & on & seconds.isNotNull(), (seconds * 1000).cast("long")).otherwise(acc["delay"]).alias("delay"),
            F.when((k == "sitemap") & (v != ""), F.concat(acc["sitemaps"], F.array(v))).otherwise(acc["sitemaps"]).alias("sitemaps"),
        )

    return F.aggregate(pairs, start, step, lambda a: F.struct(a["disallow"].alias("disallow"), a["delay"].alias("crawl_delay_ms"), a["sitemaps"].alias("sitemaps")))


def allowed(rules: Column, path: Column) -> Column:
    """No disallowed path begins the path."""
    return ~F.exists(rules["disallow"], lambda r: path.startswith(r))


def sitemap_locations(body: Column) -> Column:
    """Addresses of a sitemap or sitemap index, entities undone, distinct and sorted."""
    locs = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)

    def plain(x: Column) -> Column:
        for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    return F.array_sort(F.array_distinct(F.filter(F.transform(locs, plain), lambda u: u != "")))


def sitemap_urls(documents: DataFrame, most: int = 60_000) -> DataFrame:
    """(host, url): addresses of each host's sitemaps (host, url, body), one level of index followed; distinct before the cut."""
    is_index = F.contains("body", F.lit("<sitemapindex"))
    d = documents.select("host", "url", "body", is_index.alias("idx"), sitemap_locations(F.col("body")).alias("locs"))
    children = d.where("idx").select("host", F.explode("locs").alias("url"))
    named = d.where("NOT idx").join(children, ["host", "url"], "left_semi")
    roots = d.where("NOT idx").join(d.where("idx").select("host").distinct(), "host", "left_anti")
    urls = named.union(roots).select("host", F.explode("locs").alias("url")).distinct()
    by = Window.partitionBy("host").orderBy("url")
    return urls.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).drop("r")


def crawl_frontier(links: DataFrame, visited: DataFrame, rules: DataFrame) -> DataFrame:
    """(url): new addresses that robots rules (host, rules) allow; hosts without rules allow all."""
    from quern.functions.urls import host, path_of

    new = links.select("url").where("url IS NOT NULL").distinct().join(visited.select("url").distinct(), "url", "left_anti").withColumn("host", host(F.col("url")))
    j = new.join(rules, "host", "left")
    return j.where(F.col("rules").isNull() | allowed(F.col("rules"), path_of(F.col("url")))).select("url")
