"""The best BM25 hits of many queries without all hits of all queries.

Only the words that are asked for leave a document's text, as counts. A query's words that stand in many
documents (its base, which many queries share) are summed once a base, and of a base only the documents go on
that can be among the best of some query: a document without any of a query's other words has its base's
score, so it is beaten wherever k others beat it within the base. Documents with another word of the query
all go on. The words of the queries and their document counts are held by the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import stem as stem_word
from quern.functions.text import tokens
from quern.operators.ranking import BOOSTS, K1, B, Weights
from quern.session import stored

FIELDS = tuple(BOOSTS)
COMMON_DOCS = 1000  # documents from which on a word belongs to the base
PAIRS = 2_000_000  # pairs of documents and bases or queries held at once
STEMS = 1_000_000  # stems a worker remembers
MARGIN = 2e-6  # blended scores are ranked by six digits


def csr(pairs: Sequence[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(pointers, values): the values of each key below n, in order."""
    a = np.array(sorted(set(pairs)), dtype=np.int64).reshape(-1, 2)
    return np.searchsorted(a[:, 0], np.arange(n + 1)), a[:, 1]


def expand(keys: np.ndarray, csr: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position in keys, value) for every value of every key."""
    first, count = csr[0][keys], csr[0][keys + 1] - csr[0][keys]
    at = np.repeat(np.arange(len(keys)), count)
    return at, csr[1][np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]


class Asked:
    """The words of some queries; ``terms``: query_id, term, plain, as of ``query_terms``."""

    def __init__(self, terms: DataFrame, stem: bool):
        rows = sorted((r.query_id, r.plain, r.term) for r in terms.where("query_id IS NOT NULL").collect())
        self.stem, self.id_type = stem, terms.schema["query_id"].dataType.simpleString()
        self.words = sorted({w for r in rows for w in r[1:]})
        at = {w: i for i, w in enumerate(self.words)}
        units = {p: (i, t) for i, (p, t) in enumerate(sorted({r[1:] for r in rows}))}
        self.units, self.ids = len(units), sorted({r[0] for r in rows})
        number = {q: i for i, q in enumerate(self.ids)}
        self.query_units = csr([(number[q], units[p][0]) for q, p, _ in rows], len(self.ids))
        n = len(FIELDS)  # the address takes the word as typed, the other fields its stem
        self.code_units = csr([(n * at[p if f == "url" else t] + k, u) for p, (u, t) in units.items() for k, f in enumerate(FIELDS)], n * len(self.words))


def asked_counts(rows: DataFrame, keys: Sequence[str], named: Mapping[str, Column], asked: Asked) -> DataFrame:
    """(*keys, len_*, codes, tfs): words of each named field, and how often each asked word stands in it.

    A code is 4 times the number of the word plus the number of the field.
    """
    words, fields, n, stemming = asked.words, list(named), len(FIELDS), asked.stem
    wide = rows.select(*keys, *(tokens(c).alias(f"len_{f}") for f, c in named.items()))
    stems: dict[str, str] = {}

    def stems_of(flat: pa.Array) -> pa.Array:
        d = flat.dictionary_encode()
        if len(stems) > STEMS:
            stems.clear()
        out = []
        for w in d.dictionary.to_pylist():
            if (s := stems.get(w)) is None:
                s = stems[w] = stem_word(w)
            out.append(s)
        return pa.array(out, pa.string()).take(d.indices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(words, pa.string())
        for b in batches:
            lens, found = [], []
            for f in fields:
                col = b.column(b.schema.get_field_index(f"len_{f}"))
                lens.append(pc.list_value_length(col).cast(pa.int32()))
                flat = col.flatten()
                at = pc.index_in(stems_of(flat) if stemming and f != "url" else flat, value_set=table)
                hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                row = pc.list_parent_indices(col).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
                found.append(row * (n * len(words)) + n * at.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64) + FIELDS.index(f))
            key, tf = np.unique(np.concatenate(found), return_counts=True)
            ends = np.searchsorted(key, np.arange(b.num_rows + 1) * max(1, n * len(words)))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (key % max(1, n * len(words)), tf)]
            cols = [b.column(b.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, *lens, *lists], names=[*keys, *(f"len_{f}" for f in fields), "codes", "tfs"])

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return wide.mapInArrow(run, f"{types}, {', '.join(f'len_{f} int' for f in named)}, codes array<int>, tfs array<int>")


def front(x: np.ndarray, y: np.ndarray, k: int, dx: float, dy: float) -> np.ndarray:
    """Which may be among the k greatest of a x + y for some a, where differences of dx in x or dy in y tell.

    All that may are marked, and some others.
    """
    order = np.argsort(-x, kind="stable")
    xs, ys, keep = x[order], y[order], np.zeros(len(x), bool)
    kth = lambda v: np.partition(v, len(v) - k)[len(v) - k] if len(v) >= k else -np.inf
    a, size = 0, max(32, 2 * k)
    while a < len(x):
        clear = np.searchsorted(-xs, -(xs[a] + dx), side="right")
        part = ys[a : a + size]
        keep[order[a : a + size]] = (part > kth(ys[:a]) - dy) & (part > kth(ys[:clear]))
        a, size = a + size, 2 * size
    return keep


def _best_of_base(score: np.ndarray, gate: np.ndarray, priors: np.ndarray, doc: np.ndarray, full: np.ndarray, k: int, dx: float) -> np.ndarray:
    """Positions of the documents of a base that may be among the k best of a query, those with all its words also by themselves."""
    kept = []
    for some in ([np.arange(len(score))] if full.all() or not full.any() else [np.arange(len(score)), np.flatnonzero(full)]):
        if not priors.shape[1]:
            kept.append(some[np.lexsort((np.argsort(np.argsort(doc[some])), -score[some]))[:k]])
            continue
        mark = np.zeros(len(some), bool)
        mark[np.argmax(score[some])] = True  # scores are taken against the query's best
        x = score[some] * gate[some]
        for j in range(priors.shape[1]):
            mark |= front(x, priors[some, j], k, dx, MARGIN)
        kept.append(some[mark])
    return np.unique(np.concatenate(kept))


def best_hits(docs: DataFrame, asked: Asked, k: int, weights: Sequence[Weights] = (), common: int | None = None, boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """(query_id, doc, score, strict): hits of ``ranking.bm25`` among which are all of the k best of each query.

    ``docs``: doc, len_title, len_anchor, len_url, len_body, codes, tfs (as of ``asked_counts``, stored, as it is
    read several times). Without ``weights`` the k best are those of the score, equal ones by document. With
    weights, ``docs`` also has gate and priors (the blend's sum without text, times gate, under each weight);
    then the k best by the blended score rounded to six digits, under each weight, and the best score of each
    query are among them, equal ones by any order.
    """
    spark, n, units = docs.sparkSession, len(FIELDS), asked.units
    lens = [f"len_{f}" for f in FIELDS]
    total = docs.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in lens)).first()
    count = max(total.n, 1)
    avg, boost = np.array([total[c] / count for c in lens]), np.array([float(boosts.get(f, 0.0)) for f in FIELDS])
    df = np.zeros(n * max(1, len(asked.words)))
    for r in docs.select(F.explode("codes").alias("c")).groupBy("c").count().collect():
        df[r.c] = r["count"]
    idf = np.where(df > 0, np.log(1 + (total.n - df + 0.5) / (df + 0.5)), 0.0)
    used = np.tile(boost > 0, len(df) // n)
    at, unit = expand(np.arange(n * len(asked.words)), asked.code_units)
    met = np.bincount(unit, weights=(df * used)[at], minlength=units)  # a word's documents at most
    most = np.bincount(unit, weights=(np.tile(boost, len(df) // n) * idf * (K1 + 1))[at], minlength=units)  # its score at most
    many = met > (COMMON_DOCS if common is None else common)
    of_query = lambda q: asked.query_units[1][asked.query_units[0][q] : asked.query_units[0][q + 1]]
    bases: dict[tuple[int, ...], int] = {}
    table, rare, top = [], [], 0.0
    for q in range(len(asked.ids)):
        own = of_query(q)
        base = tuple(own[many[own]])
        table.append((q, asked.ids[q], len(own), bases.setdefault(base, len(bases)) if base else -1))
        rare += [(u, q) for u in own[~many[own]]]
        top = max(top, float(most[own].sum()))
    size = np.array([len(b) for b in bases], dtype=np.int64)
    unit_bases, unit_queries = csr([(u, i) for b, i in bases.items() for u in b], units), csr(rare, units)
    code_units, query_units, queries = asked.code_units, asked.query_units, max(1, len(asked.ids))
    dx = MARGIN * top / low if weights and (low := min(w.text for w in weights)) > 0 else np.inf

    def blocks(row: np.ndarray, pairs: np.ndarray) -> Iterator[slice]:
        """Entries of whole rows with PAIRS pairs at most, or one row."""
        sums, starts = np.cumsum(pairs), np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        a = 0
        while a < len(row):
            limit = np.searchsorted(sums, (sums[a - 1] if a else 0) + PAIRS, side="right")
            later = starts[np.searchsorted(starts, a, side="right") :]
            b = later[max(0, np.searchsorted(later, limit, side="right") - 1)] if len(later) and limit < len(row) else len(row)
            yield slice(a, b)
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = defaultdict(list)
        for b in batches:
            get = lambda c, b=b: b.column(b.schema.get_field_index(c))
            doc = np.array(get("doc").to_pylist(), dtype=object)
            codes = get("codes")
            row = pc.list_parent_indices(codes).to_numpy(zero_copy_only=False).astype(np.int64)
            code, tf = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), get("tfs").flatten().to_numpy(zero_copy_only=False)
            length = np.stack([get(c).to_numpy(zero_copy_only=False) for c in lens], axis=1).astype(float)
            f, ok = code % n, used[code]
            row, code, tf, f = row[ok], code[ok], tf[ok], f[ok]
            s = boost[f] * idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row, f] / avg[f]))
            at, unit = expand(code, code_units)
            key = row[at] * units + unit
            order = np.lexsort((f[at], key))
            key, w = key[order], s[at][order]
            if not len(key):
                continue
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, w = key[start], np.add.reduceat(w, start)
            row, unit = key // units, key % units
            gate, priors = np.ones(b.num_rows), np.zeros((b.num_rows, 0))
            if weights:
                gate, priors = get("gate").to_numpy(zero_copy_only=False), get("priors").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(weights))
            for part in blocks(row, np.diff(unit_bases[0])[unit]):
                at, base = expand(unit[part], unit_bases)
                pair = row[part][at] * len(size) + base
                order = np.argsort(pair, kind="stable")  # words stay in order, so equal documents have equal sums
                pair, v = pair[order], w[part][at][order]
                if not len(pair):
                    continue
                start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                score, words = np.add.reduceat(v, start), np.diff(np.r_[start, len(pair)])
                r, base = pair[start] // len(size), pair[start] % len(size)
                order = np.argsort(base, kind="stable")
                r, base, score, words = r[order], base[order], score[order], words[order]
                for own in np.split(np.arange(len(base)), np.flatnonzero(base[1:] != base[:-1]) + 1):
                    i = own[_best_of_base(score[own], gate[r[own]], priors[r[own]], doc[r[own]], words[own] == size[base[own[0]]], k, dx)]
                    found[int(base[i[0]])].append((doc[r[i]], score[i], words[i], gate[r[i]], priors[r[i]]))
            for part in blocks(row, np.diff(unit_queries[0])[unit]):
                at, q = expand(unit[part], unit_queries)
                pair = np.unique(row[part][at] * queries + q)
                if not len(pair):
                    continue
                r, q = pair // queries, pair % queries
                at, u = expand(q, query_units)
                want = r[at] * units + u
                pos = np.minimum(np.searchsorted(key, want), len(key) - 1)
                hit = key[pos] == want
                score, words = np.bincount(at[hit], weights=w[pos[hit]], minlength=len(pair)), np.bincount(at[hit], minlength=len(pair))
                yield rows(q, np.full(len(q), -1), doc[r], score, words, np.ones(len(q)), np.zeros((len(q), 0)))
        for base, parts in found.items():
            d, score, words, gate, priors = (np.concatenate(x) for x in zip(*parts, strict=True))
            i = _best_of_base(score, gate, priors, d, words == size[base], k, dx)
            yield rows(np.full(len(i), -1), np.full(len(i), base), d[i], score[i], words[i], gate[i], priors[i])

    def rows(q, base, doc, score, words, gate, priors) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(q) + 1) * priors.shape[1], pa.int32())
        cols = [pa.array(q, pa.int32()), pa.array(base, pa.int32()), pa.array(doc, pa.string()), pa.array(score, pa.float64()), pa.array(words, pa.int32()), pa.array(gate, pa.float64())]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, pa.array(priors.ravel(), pa.float64()))], names=["q", "base", "doc", "score", "n", "gate", "priors"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The same choice among what the tasks found for a base."""
        base = int(pdf["base"].iloc[0])
        priors = np.array(pdf["priors"].tolist(), dtype=float).reshape(len(pdf), len(weights))
        i = _best_of_base(pdf["score"].to_numpy(), pdf["gate"].to_numpy(), priors, pdf["doc"].to_numpy(dtype=object), pdf["n"].to_numpy() == size[base], k, dx)
        return pdf.iloc[i][["base", "doc", "score", "n"]]

    wanted = docs.select("doc", *lens, "codes", "tfs", *(["gate", "priors"] if weights else []))
    # stored, as it is read twice
    some = stored(wanted.mapInArrow(run, "q int, base int, doc string, score double, n int, gate double, priors array<double>"))
    known = spark.createDataFrame(table, f"q int, query_id {asked.id_type}, m int, base int")
    shared = some.where("base >= 0").groupBy("base").applyInPandas(merge, "base int, doc string, score double, n int")
    hits = some.where("q >= 0").select("q", "doc", "score", "n").union(known.select("q", "base").join(shared, "base").select("q", "doc", "score", "n"))
    # a document with other words of the query comes from both, once with the score of the base only
    once = hits.groupBy("q", "doc").agg(F.max("score").alias("score"), F.max("n").alias("n")).join(known.drop("base"), "q")
    strict = F.max(F.col("n") == F.col("m")).over(Window.partitionBy("query_id"))
    return once.withColumn("strict", strict).where((F.col("n") == F.col("m")) | ~F.col("strict")).select("query_id", "doc", "score", "strict")
