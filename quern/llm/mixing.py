"""Problem 9: drawing documents from several sources to target shares of all tokens.

Soft-membership mixing. Documents with a source belong to it; for the others a naive Bayes classifier over
hashed words and word shapes, fitted on a bounded sample of labelled rows, gives the posterior of each
source. Every document has a rate, the expected number of its copies, between 0 and its source's cap.
Posteriors are whole numbers of GRID parts, so that documents with one posterior have one rate: their
tokens are summed once over all documents, and what is fitted are these groups. A rate is the posterior
times one weight a source, cut to its range; the weights are fitted by Newton steps on the residuals of the
sources, with a slight pull to 0 that spreads what the caps leave unreached. All sums are of whole numbers, so that
neither the split of the groups nor where they are summed changes a rate. Rates become whole copies by systematic
sampling along source and length, which keeps both shares and lengths.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tokens import VOCABULARY, token_counts
from quern.operators.ordered import running_sums
from quern.operators.skew import join_spread
from quern.session import read_table, stored

SAMPLE_DOCS = 500  # labelled documents a source on which the classifier is fitted
BUCKETS = 1 << 15
GRID = 64  # parts of a posterior
TOLERANCE = 1e-6  # of all tokens
UNIT = 1_000_000_000  # parts of a rate
PULLS = [10.0**-i for i in range(2, 10)]  # of a source's tokens a unit of its weight, one fit after another
STEPS = 16  # parts of a Newton step that are tried at once, each half the one before
MAX_GROUPS = 200_000  # groups of documents with one posterior that are summed on the driver; more are summed in tasks, with the same sums
ROUNDS = dict.fromkeys((True, False), 100)  # most rounds, on the driver and in tasks alike; a fit that needs more gives a warning
LEVEL = 0.002  # error of a source's tokens that is let be


def source_name(source: Column) -> Column:
    """Trimmed lower-case source; NULL where blank."""
    s = F.lower(F.trim(source))
    return F.when(s != "", s)


def features(text: str) -> np.ndarray:
    """Hashed words, and shapes of line openings and signs, of a whole text."""
    words = re.findall(r"\w+", text.lower())
    shapes = []
    for line in text.split("\n"):
        shape = re.sub(r"\w+", "w", re.sub(r"\d+", "0", line.strip()[:24]))
        shapes.append("^" + re.sub(r"(.)\1+", r"\1", shape)[:8])
    signs = ["|" + s for s in re.findall(r"[^\w\s]+", text)]
    return np.array([zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in words + shapes * 3 + signs], dtype=np.int64)


class Classifier:
    """Multinomial naive Bayes whose evidence is damped by the text's length."""

    def __init__(self, texts: list[str], labels: np.ndarray, classes: int):
        counts = np.full((classes, BUCKETS), 0.1)
        prior = np.zeros(classes)
        for text, k in zip(texts, labels, strict=True):
            f = features(text)
            if len(f):
                counts[k] += np.bincount(f, minlength=BUCKETS) / np.sqrt(len(f))
            prior[k] += 1
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))
        # a class without a labelled text is no one's
        self.prior = np.where(prior > 0, np.log(np.maximum(prior, 1) / max(1.0, prior.sum())), -1e9)

    def posterior(self, text: str) -> np.ndarray:
        f = features(text)
        score = self.prior.copy()
        if len(f):
            score = score + self.log[:, f].sum(axis=1) / np.sqrt(len(f))
        e = np.exp(score - score.max())
        return e / e.sum()


def fit_classifier(docs: DataFrame, sources: list[str], sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """From at most ``sample_docs`` labelled documents a source, chosen by a hash of the id."""
    named = docs.where(F.col("text").isNotNull()).select("doc_id", source_name(F.col("source")).alias("source")).where(F.col("source").isin(sources)).groupBy("doc_id").agg(F.min("source").alias("source"))
    by = Window.partitionBy("source").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = named.withColumn("r", F.row_number().over(by)).where(F.col("r") <= sample_docs).select("doc_id", F.col("source").alias("label"))
    # at most sample_docs rows a source come to the driver; of rows with one id the greatest text
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "label")).alias("x")).orderBy("doc_id").select("x.text", "x.label").where(F.col("text").isNotNull()).toPandas()
    index = {s: i for i, s in enumerate(sources)}
    return Classifier(got["text"].tolist(), got["label"].map(index).to_numpy(dtype=np.int64), max(1, len(sources)))


def in_parts(posterior: np.ndarray) -> np.ndarray:
    """A posterior in whole GRID parts that add up, the largest remainders rounded up."""
    whole = np.floor(posterior * GRID)
    order = np.argsort(-(posterior * GRID - whole), kind="stable")
    whole[order[: int(round(GRID - whole.sum()))]] += 1
    return whole.astype(np.int32)


def memberships(docs: DataFrame, sources: list[str], model: Classifier | None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, k, source, tokens, parts): ``parts`` is the posterior in whole GRID parts: of a known source all parts, of the others the model's.

    ``source`` of an unlabelled document is its most probable one. Documents of a source that is not among
    ``sources`` belong to none and are left out, as are documents without tokens.
    """
    counted = token_counts(docs.withColumn("label", source_name(F.col("source"))), "label", vocabulary=vocabulary).where("tokens > 0")
    index = F.array_position(F.array(*map(F.lit, sources)), F.col("label")).cast("int") - 1
    counted = stored(counted.withColumn("k", F.when(F.col("label").isNull(), -1).otherwise(index)))
    width = len(sources)
    known = counted.where((F.col("label").isNotNull()) & (F.col("k") >= 0)).select(
        "doc_id", "k", "tokens", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col("k"), GRID).otherwise(0)).alias("parts")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            post = [shared.value.posterior(t) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(k=np.array([int(p.argmax()) for p in post], dtype=np.int32), parts=[in_parts(p) for p in post])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where(source_name(F.col("source")).isNull() & F.col("text").isNotNull()).groupBy("doc_id").agg(F.max("text").alias("text"))
    unlabelled = counted.where("label IS NULL").select("doc_id", "tokens").join(texts, "doc_id").mapInPandas(predict, f"doc_id {kind}, tokens bigint, k int, parts array<int>").select("doc_id", "k", "tokens", "parts")
    both = known.union(unlabelled)
    return both.select("doc_id", "k", F.element_at(F.array(*map(F.lit, sources)), F.col("k") + 1).alias("source"), "tokens", "parts")


def _rates(parts: np.ndarray, cap: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rates in UNITs: the posteriors times the weights, cut to 0 .. cap. The sum is in the sources' order, whatever the rows."""
    x = np.zeros(len(parts))
    for j, w in enumerate(weights):
        x += parts[:, j] * (w / GRID)
    return np.rint(np.clip(x, 0.0, cap) * UNIT).astype(np.int64)


def _parts(pdf: pd.DataFrame, width: int) -> np.ndarray:
    return np.stack(pdf["parts"].to_numpy()).astype(np.int64) if len(pdf) else np.zeros((0, width), np.int64)


def _sums(parts: np.ndarray, tokens: np.ndarray, cap: np.ndarray, tried: list[np.ndarray]) -> dict[tuple[int, int, int], int]:
    """Whole sums over groups by (trial, row, column), for each trial of weights.

    Row -1: tokens drawn of each source, in parts of GRID and UNIT. Row i: the slope of source i, in parts of GRID squared: tokens of
    the groups whose rate is not cut. Trial -1: each source's tokens at the caps.
    """
    whole = lambda x, y: (int((x * (y >> 16)).sum()) << 16) + int((x * (y & (1 << 16) - 1)).sum())  # noqa: E731 - within 64 bits
    out = {(-1, -1, j): whole(parts[:, j] * cap, tokens) for j in range(parts.shape[1])}
    for k, weights in enumerate(tried):
        x = _rates(parts, cap, weights)
        free = np.where((x > 0) & (x < cap * UNIT), tokens, 0)
        for j in range(parts.shape[1]):
            # rates in two halves, so that products stay within 64 bits
            high, low = x >> 20, x & (1 << 20) - 1
            out[k, -1, j] = (whole(parts[:, j] * high, tokens) << 20) + whole(parts[:, j] * low, tokens)
            for i in range(j + 1):
                out[k, i, j] = whole(parts[:, i] * parts[:, j], free)
    return out


def fit_rates(groups: DataFrame, shares: np.ndarray, caps: np.ndarray, total: float | None = None, max_groups: int | None = None) -> tuple[DataFrame, float, float]:
    """((k, parts, rate), total tokens, largest residual as a share of them).

    ``groups``: k, parts, tokens - the tokens of all documents of a posterior. ``rate`` is in units of 1e-9. ``total`` is
    the number of tokens to draw; by default the most for which every source that has documents can give its
    share within its cap. A total that the caps can't reach leaves a residual, and a warning.
    """
    spark, width = groups.sparkSession, len(shares)
    most = MAX_GROUPS if max_groups is None else max_groups
    here = groups.limit(most + 1).count() <= most
    table = groups.select("k", "parts", "tokens").toPandas() if here else None
    whole_caps = caps.astype(np.int64)

    def of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _parts(pdf, width), pdf["tokens"].to_numpy(dtype=np.int64), whole_caps[pdf["k"].to_numpy(dtype=np.int64)]

    def sums(tried: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(tokens at the caps, tokens of each source by trial, slopes by trial)."""
        if here:
            found = _sums(*of(table), tried)
        else:

            def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    got = _sums(*of(pdf), tried)
                    yield pd.DataFrame([(*key, Decimal(n)) for key, n in got.items()], columns=["t", "i", "j", "n"])

            rows = groups.select("k", "parts", "tokens").mapInPandas(part, "t int, i int, j int, n decimal(38,0)").groupBy("t", "i", "j").agg(F.sum("n")).collect()
            found = {(t, i, j): int(n) for t, i, j, n in rows}
        at = lambda t, i, j: found.get((t, min(i, j), max(i, j)), 0)
        row = lambda t, unit: np.array([at(t, -1, j) / unit for j in range(width)])
        slopes = [np.array([[at(t, i, j) / GRID**2 for j in range(width)] for i in range(width)]) for t in range(len(tried))]
        return row(-1, GRID), [row(t, GRID * UNIT) for t in range(len(tried))], slopes

    weights = np.zeros(width)
    room, (got,), _ = sums([weights])
    possible = (room > 0) & (shares > 0)
    if not possible.any():
        return groups.select("k", "parts", F.lit(0).cast("long").alias("rate")), 0.0, 0.0
    if total is None:
        total = float((room[possible] / shares[possible]).min())
    mass = np.where(room > 0, room / np.maximum(caps, 1e-9), 1.0)  # tokens a unit of rate brings
    wanted = shares * total
    # from the start in which each source would be given alone; at weight 0 all rates are cut
    weights = np.where(room > 0, wanted / mass, 0.0)
    _, (got,), (slope,) = sums([weights])
    stage = 0
    for _ in range(ROUNDS[here]):
        residual = np.where(room > 0, got - wanted, 0.0)
        if float(np.abs(residual).max()) <= TOLERANCE * total:
            break
        # near enough to the least for this pull: on to the next, or as near as the caps allow
        while stage < len(PULLS) and float(np.abs(residual + PULLS[stage] * mass * weights).max()) <= max(TOLERANCE, PULLS[stage] / 10) * total:
            stage += 1
        if stage == len(PULLS):
            break
        pull = PULLS[stage] * mass
        step = -np.linalg.solve(slope + np.diag(pull), residual + pull * weights)
        # the longest part of the step that does not lead beyond the least along it
        tried = [weights + step / 2**i for i in range(STEPS)]
        _, gots, slopes = sums(tried)
        along = [float((np.where(room > 0, g - wanted, 0.0) + pull * w) @ step) for g, w in zip(gots, tried, strict=True)]
        first = float((residual + pull * weights) @ step)
        at = next((i for i, a in enumerate(along) if a <= -1e-3 * first), STEPS - 1)
        weights, got, slope = tried[at], gots[at], slopes[at]
    error = float(np.abs(np.where(room > 0, got - wanted, 0.0)).max()) / total if total > 0 else 0.0
    if error > 10 * TOLERANCE:
        warnings.warn(f"the target shares are missed by up to {error:.2%} of {total:.0f} tokens", stacklevel=2)

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(rate=_rates(_parts(pdf, width), whole_caps[pdf["k"].to_numpy(dtype=np.int64)], weights))

    if here:
        rates = spark.createDataFrame(next(rated(iter([table[["k", "parts"]]]))), "k int, parts array<int>, rate bigint")
    else:
        rates = groups.select("k", "parts").mapInPandas(rated, "k int, parts array<int>, rate bigint")
    return rates, total, error


def draw(docs: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, copies, tokens): documents drawn so that sources have their target shares of all tokens.

    ``targets``: source, target_share, max_repeats; NULL and negative shares count as 0, repeated sources are
    summed. ``total``: tokens to draw, see ``fit_rates``. No document is drawn more often than its source's cap. A
    source without documents gives nothing; the others keep their proportions. Empty in, empty out.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("s"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("m"))
    # the table of targets: one row a source
    rows = wanted.where("source IS NOT NULL").groupBy("source").agg(F.sum("s").alias("s"), F.max("m").alias("m")).orderBy("source").collect()
    sources = [r["source"] for r in rows]
    if not sources:
        return spark.createDataFrame([], f"doc_id {kind}, source string, copies int, tokens bigint")
    shares, caps = np.array([r["s"] for r in rows], dtype=float), np.array([r["m"] for r in rows], dtype=float)
    members = stored(memberships(docs, sources, fit_classifier(docs, sources), vocabulary))
    groups = stored(members.groupBy("k", "parts").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    fitted, _, _ = fit_rates(groups, shares, caps, total)
    rates = join_spread(members, stored(fitted.join(groups.drop("tokens"), ["k", "parts"])), ["k", "parts"], "docs", "doc_id")
    cum = running_sums(rates.drop("parts"), [F.col("source"), F.col("tokens"), F.col("doc_id")], {"upto": F.col("rate")})
    unit = F.lit(1_000_000_000).cast("long")
    half = F.lit(500_000_000).cast("long")
    copies = F.floor((F.col("upto") + half) / unit) - F.floor((F.col("upto") - F.col("rate") + half) / unit)
    cap_of = F.element_at(F.array(*(F.lit(int(c)) for c in caps)), F.col("k") + 1)
    drawn = stored(cum.select("doc_id", "source", copies.cast("int").alias("copies"), "tokens", cap_of.alias("cap"), (F.col("rate") * F.col("tokens") / 1e9).alias("expected")))
    return levelled(drawn).where("copies > 0").select("doc_id", "source", "copies", "tokens")


def levelled(drawn: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Copies changed by one until each source's tokens are within LEVEL of the expected ones, or no change brings them nearer.

    Few long texts can hold much of a source. A source that is over gives back the longest text that is over half
    its error and brings it nearer; one that is under takes the copy that brings it nearest, if that halves its
    error. Otherwise texts no longer than half the error are given back or taken in random order, up to that
    error, which halves it at least; or, where there are none, the one copy that brings it nearest.
    """
    for j in range(most_rounds):
        error = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("got"), F.sum("expected").alias("want"))
        error = error.select("source", (F.col("got") - F.col("want")).cast("long").alias("error"), "want").collect()  # a row a source
        off = {r["source"]: int(r["error"]) for r in error if abs(r["error"]) > max(1.0, LEVEL * r["want"])}
        if not off:
            break
        e = F.create_map(*(F.lit(x) for s, e in off.items() for x in (s, e)))[F.col("source")]
        able = drawn.where(e.isNotNull() & F.when(e > 0, F.col("copies") > 0).otherwise(F.col("copies") < F.col("cap")))
        after = F.abs(F.abs(e) - F.col("tokens"))
        longest = F.max(F.when((e > 0) & (F.col("tokens") * 2 > e) & (after < e), F.struct("tokens", "doc_id")))["doc_id"]
        near = able.groupBy("source").agg(longest.alias("long"), F.min(F.struct(after.alias("after"), "doc_id")).alias("x"), F.max((F.col("tokens") * 2 <= F.abs(e)).cast("int")).alias("fine")).collect()  # a row a source
        one = {}
        for r in near:
            size, best = abs(off[r["source"]]), r["x"]["after"]
            if r["long"] is not None:
                one[r["source"]] = r["long"]
            elif (off[r["source"]] < 0 and best * 2 <= size) or (not r["fine"] and best < size):
                one[r["source"]] = r["x"]["doc_id"]
        many = [r["source"] for r in near if r["source"] not in one and r["fine"]]
        if not one and not many:
            break
        sign = F.when(e > 0, -1).otherwise(1)
        # rows of one document are one row here
        step = drawn.where(F.col("doc_id").isin(list(one.values()))).select("doc_id", sign.alias("step")) if one else None
        if many:
            pick = able.where(F.col("source").isin(many) & (F.col("tokens") * 2 <= F.abs(e))).select("doc_id", "source", "tokens", F.xxhash64("doc_id", F.lit(j)).alias("h"))
            summed = running_sums(pick, [F.col("source"), F.col("h"), F.col("doc_id")], {"upto": F.col("tokens")})
            before = summed.groupBy("source").agg(F.min(F.col("upto") - F.col("tokens")).alias("base"))
            more = summed.join(F.broadcast(before), "source").where(F.col("upto") - F.col("base") <= F.abs(e)).select("doc_id", sign.alias("step"))
            step = more if step is None else step.union(more)
        drawn = stored(drawn.join(step, "doc_id", "left").withColumn("copies", (F.col("copies") + F.coalesce("step", F.lit(0))).cast("int")).drop("step"))
    return drawn


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, share, most_copies): shares reached by source."""
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    per = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = drawn.agg(F.sum(F.col("copies") * F.col("tokens")).alias("whole"))
    out = wanted.join(F.broadcast(per), "source", "left").join(F.broadcast(whole))  # a row a source; one row
    return out.select(
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def p9_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to the target shares."""
    return draw(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the draw reaches."""
    targets = read_table(spark, sf_dir, "mix_targets")
    return share_report(stored(draw(read_table(spark, sf_dir, "documents"), targets)), targets)


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: is the draw within its caps, and is the share reached within half a hundredth of the target?

    Targets count in proportion among the sources that have documents with text.
    """
    docs, targets = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets")
    report = share_report(stored(draw(docs, targets)), targets)
    there = docs.where(F.length("text") > 0).select(source_name(F.col("source")).alias("source")).distinct().where("source IS NOT NULL")
    able = report.join(F.broadcast(there), "source", "left_semi").agg(F.sum("target_share").alias("able"))  # one row
    rows = report.join(F.broadcast(there.withColumn("there", F.lit(1))), "source", "left").join(F.broadcast(able))
    due = F.when(F.col("there") == 1, F.col("target_share") / F.col("able")).otherwise(0.0)
    return rows.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("share") - due) <= 0.005).alias("share_reached"))


QUERIES = {"p9_draw": p9_draw, "p9_shares": p9_shares, "p9_checks": p9_checks}
# what must hold of any draw
ORACLE = {"p9_checks": "SELECT lower(trim(source)) AS source, true AS within_cap, true AS share_reached FROM mix_targets"}
