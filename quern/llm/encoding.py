"""Problem 10: text garbled by a wrong character decoding.

Pairs. All adjacent character pairs with a character beyond ASCII are counted over the whole
corpus, apart for pairs in coherent words (letters of one script, signs only at the edges, no case
flip at a letter beyond ASCII). A pair's score is its negative pointwise mutual information: the
joint count from coherent words against what the characters' frequencies lead one to expect. A
pair that coherent words never show scores high however common the garbling is.

Runs. In each text the maximal scoring segments of these scores are the improbable runs.

Mappings. Only inside runs inverse mappings are tried: back to bytes by a wrongly used code page
and on to UTF-8, again if the result is still garbled, and latin-1 to cp1252 for stray controls. A
mapping holds if every multi-byte sequence is well formed; one whose bytes were partly lost
restores what is there and leaves U+FFFD for the lost letter. A sequence whose second byte, a hard space,
became a plain one is completed. Lost letters count only within improbable runs, by the scores of their pairs.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ensure_checkpoint_dir, read_table, stored

#: Code pages by which UTF-8 is often misread, the commonest first.
CODE_PAGES = ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "iso8859-15", "cp1254", "koi8-r"]
MAX_PAIRS = 4_000_000  # pairs that are sent to every Python worker (16 bytes each); more are a file that an executor's workers map
UNSEEN, EXPECTED = 0.02, 0.5  # smoothing of joint and expected counts
ASCII_SCORE = -1.0
BIAS = 1.0  # pairs count as improbable from this negative information on
_LOST = "�"
_OPENING = np.array([ord(c) for c in "¿¡"], dtype=np.uint32)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point of the basic plane: kind, script, case.

    kind: 0 space, 1 letter or mark, 2 digit, 3 ASCII sign, quote or dash, 4 other sign, 5 control or U+FFFD.
    """
    n = 0x10000
    kind, script, case = np.full(n, 4, np.int8), np.zeros(n, np.int8), np.zeros(n, np.int8)
    scripts: dict[str, int] = {}
    for cp in range(n):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if ch in " \t\n\r":
            kind[cp] = 0
        elif cat == "Cc" or ch in "�\xad":
            kind[cp] = 5
        elif cat[0] in "LM" and ch not in "ªºµˆ˜":
            kind[cp] = 1
            script[cp] = scripts.setdefault(unicodedata.name(ch, "? ").split(" ")[0], len(scripts) % 120 + 1) if cat[0] == "L" else 0
            case[cp] = {"Lu": 1, "Ll": 2}.get(cat, 0)
        elif cat == "Nd":
            kind[cp] = 2
        elif cp < 128 or cat in ("Pi", "Pf", "Pd") or ch in "¿¡…" or (cat == "Po" and cp >= 0x500 and not 0x2000 <= cp < 0x2070):
            kind[cp] = 3
    return kind, script, case


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line break, and where each text starts."""
    flat = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return flat, np.concatenate(([0], np.cumsum(lengths)))


def _coherent(flat: np.ndarray) -> np.ndarray:
    """For each position: does the space-delimited word around it look whole?"""
    kind_t, script_t, case_t = _classes()
    low = np.minimum(flat, 0xFFFF)
    kind, script, case = kind_t[low], script_t[low], case_t[low]
    beyond = flat > 127
    bad = kind == 5
    nxt = np.zeros(len(flat), bool)
    if len(flat) > 1:
        a, b = slice(None, -1), slice(1, None)
        letter = kind == 1
        mixed = letter[a] & letter[b] & (script[a] != script[b]) & (script[a] > 0) & (script[b] > 0)
        flip = (case[a] == 2) & (case[b] == 1) & (beyond[a] | beyond[b])
        sign = (beyond[a] & beyond[b]) & (((kind[a] == 4) & (kind[b] != 0)) | ((kind[b] == 4) & (kind[a] != 0)))
        # a letter before an opening sign
        opening = letter[a] & np.isin(flat[b], _OPENING)
        nxt[a] = mixed | flip | sign | opening
    bad |= nxt
    bad[1:] |= nxt[:-1]
    word = np.cumsum(kind == 0)
    spoilt = np.bincount(word, weights=bad, minlength=int(word[-1]) + 1 if len(word) else 1) > 0
    return ~spoilt[word]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts: kind 0 characters (code, n), kind 1 pairs (code, coherent n)."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        for at in range(0, len(texts), 500):
            flat, _ = _codes(texts[at : at + 500])
            if len(flat) < 2:
                continue
            chars = np.bincount(np.minimum(flat, 0x10FFFF))
            used = np.flatnonzero(chars)
            yield pd.DataFrame({"kind": np.int32(0), "code": used.astype(np.int64), "n": chars[used].astype(np.int64)})
            beyond = flat > 127
            at_pair = np.flatnonzero(beyond[:-1] | beyond[1:])
            if not len(at_pair):
                continue
            good = at_pair[_coherent(flat)[at_pair]]
            pair = (flat[good].astype(np.int64) << 21) | flat[good + 1].astype(np.int64)
            codes, n = np.unique(pair, return_counts=True)
            yield pd.DataFrame({"kind": np.int32(1), "code": codes, "n": n.astype(np.int64)})


def pair_counts(docs: DataFrame) -> DataFrame:
    """(kind, code, n): character and coherent pair counts over all texts, partially summed in Python."""
    rows = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select("text")
    return rows.mapInPandas(_count, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


class PairScores:
    """Scores of character pairs; positive where a pair is improbable."""

    def __init__(self, chars: dict[int, int], pairs: np.ndarray, counts: np.ndarray):
        """``pairs`` ascending."""
        self.tried: dict[str, tuple[str, str] | None] = {}  # short runs come again and again
        self.pairs, self.counts = pairs, counts
        self.total = float(max(1, sum(chars.values())))
        top = max(chars, default=0) + 1
        self.freq = np.zeros(top + 1)
        for code, n in chars.items():
            self.freq[code] = n

    def joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How often coherent words show each pair, but for once: a pair is no evidence for itself."""
        key = (a.astype(np.int64) << 21) | b.astype(np.int64)
        if not len(self.pairs):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, np.maximum(self.counts[at] - 1.0, 0.0), 0.0)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Score of each pair beyond ASCII."""
        joint = self.joint(a, b)
        known = len(self.freq) - 1
        expect = self.freq[np.minimum(a, known)] * self.freq[np.minimum(b, known)] / self.total
        return -np.log((joint + UNSEEN) / (expect + EXPECTED))


def improbable_runs(flat: np.ndarray, scores: PairScores) -> list[tuple[int, int]]:
    """Maximal scoring segments [start, end) over the pair scores of one text."""
    beyond = flat > 127
    at = np.flatnonzero(beyond[:-1] | beyond[1:])
    if not len(at):
        return []
    s = np.clip(scores.of(flat[at], flat[at + 1]) - BIAS, -4.0, 4.0)
    s[(flat[at] <= 32) | (flat[at + 1] <= 32)] = np.minimum(s[(flat[at] <= 32) | (flat[at + 1] <= 32)], 0.5)
    if not (s > 0).any():
        return []
    runs: list[tuple[int, int]] = []
    total = best = 0.0
    start = end = -1
    last = -1
    for p, v in zip(at.tolist(), s.tolist(), strict=True):
        if start >= 0:
            total += ASCII_SCORE * (p - last - 1)  # the ASCII pairs between
        if start < 0 or total <= 0 or total < best - 8:
            if start >= 0 and best > 0:
                runs.append((start, end))
            start, total, best = -1, 0.0, 0.0
        if start < 0:
            if v <= 0:
                last = p
                continue
            start, total, best = p, 0.0, 0.0
        total += v
        if total > best:
            best, end = total, p + 2
        last = p
    if start >= 0 and best > 0:
        runs.append((start, end))
    return runs


class _Back(dict):
    """Translation to bytes as characters; what a code page lacks becomes U+001A."""

    def __missing__(self, code: int) -> int:
        return code if code < 128 else 0x1A


@lru_cache(maxsize=16)
def _to_byte(page: str) -> _Back:
    """Characters of a code page by byte; bytes it leaves undefined stand for their control."""
    table = _Back()
    for byte in range(128, 256):
        try:
            table[ord(bytes([byte]).decode(page))] = byte
        except UnicodeDecodeError:
            pass
    for byte in range(128, 160):
        table.setdefault(byte, byte)
    if page in ("cp1252", "cp1254", "iso8859-15"):  # soft hyphens and hard spaces survive as themselves
        table.setdefault(0xA0, 0xA0)
        table.setdefault(0xAD, 0xAD)
    return table


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")
_PIECE = re.compile(_SEQUENCE.pattern + rb"|(?P<cut>[\xe1-\xef][\x80-\xbf]|\xe0[\xa0-\xbf]|[\xf0-\xf4][\x80-\xbf]{1,2})")


def _undo(run: str, page: str) -> tuple[str, int, int] | None:
    """(restored, whole sequences, broken sequences) of a run misread by a code page; None if it can't be."""
    data = run.translate(_to_byte(page)).encode("latin-1")
    if b"\x1a" not in data:
        try:
            text = data.decode("utf-8")
            return (text, len(run) - len(text), 0) if len(text) < len(run) else None
        except UnicodeDecodeError:
            pass
    out, last, whole, broken = [], 0, 0, 0
    for m in _PIECE.finditer(data):
        start, end = m.span()
        out.append(run[last:start])
        if m["cut"] is None:
            out.append(m.group().decode("utf-8"))
            whole += 1
        else:
            out.append(_LOST)
            broken += 1
            end += end < len(run) and run[end] == _LOST
        last = end
    if not whole and not broken:
        return None
    out.append(run[last:])
    return "".join(out), whole, broken


def _plausible(text: str, scores: PairScores) -> float:
    """Sum of the positive pair scores: how improbable a text still is."""
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(flat) < 2:
        return 0.0
    keep = (flat[:-1] > 127) | (flat[1:] > 127)
    return float(np.maximum(scores.of(flat[:-1][keep], flat[1:][keep]), 0).sum()) if keep.any() else 0.0


def restore_run(run: str, scores: PairScores) -> tuple[str, str] | None:
    """(restored text, mapping) of an improbable run, or None if no inverse mapping holds."""
    if run not in scores.tried:
        if len(run) > 60 or len(scores.tried) > 50_000:
            return _restore(run, scores)
        scores.tried[run] = _restore(run, scores)
    return scores.tried[run]


def _restore(run: str, scores: PairScores) -> tuple[str, str] | None:
    before = _plausible(run, scores)
    best: tuple[float, str, str] | None = None
    for page in CODE_PAGES:
        got = _undo(run, page)
        if got is None or (got[1] == 0 and not (got[2] and _unseen(run, scores))):
            continue
        text, lossy, names = got[0], got[2], page
        for _ in range(2):  # garbled more than once
            again = max((x + (p,) for p in CODE_PAGES[:6] if (x := _undo(text, p)) and x[1] > x[2]), key=lambda x: (x[1] - x[2], -len(x[0])), default=None)
            if again is None or _plausible(again[0], scores) >= _plausible(text, scores):
                break
            text, lossy, names = again[0], lossy + again[2], f"{names}+{again[3]}"
        left = _plausible(text, scores) + 3.0 * lossy + 2.0 * len(_CONTROLS.findall(text))
        if best is None or left < best[0]:
            best = (left, text, names)
        if left <= 0.05 * before:
            break
    if best and best[0] < (before if _LOST not in best[1] else 0.7 * before):
        return best[1], best[2]
    if _CONTROLS.search(run):
        if all(ord(c) < 256 for c in run):
            return run.encode("latin-1").decode("cp1252", "replace"), "latin-1>cp1252"
        return _CONTROLS.sub(_LOST, run), "lost"
    return None


_CONTROLS = re.compile("[\x80-\x9f]")


def _unseen(run: str, scores: PairScores) -> bool:
    """A cut sequence alone is taken for garbling only if coherent words show none of its inner pairs."""
    flat = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a, b = flat[:-1], flat[1:]
    both = (a > 127) & (b > 127)
    return bool(both.any() and (scores.joint(a[both], b[both]) == 0).all())


_LEADING = re.compile(r"(?<![^\s(\"'“«])[ÃÂ](?=[\s,.;:!?]|$)")


def _completed(text: str, start: int, end: int, scores: PairScores) -> tuple[int, int, str, str] | None:
    """A first byte that stands alone in a run, whose second one, a hard space, became a plain one or none."""
    m = _LEADING.search(text, max(0, start - 1), min(len(text), end + 1))
    if m is None or m.start() < start:
        return None
    fixed = (text[m.start()] + "\xa0").encode("latin-1").decode("utf-8").replace("\xa0", "")
    edge = slice(max(0, m.start() - 1), m.start()), slice(m.end(), m.end() + 1)
    around = lambda x: text[edge[0]] + x + text[edge[1]]
    if _plausible(around(fixed), scores) >= _plausible(around(m.group()), scores):
        return None
    # the hard space, if it is still there as a plain one before another
    after = m.end() + text.startswith("  ", m.end())
    return m.start(), after, fixed, "cp1252+space"


def examine(text: str, flat: np.ndarray, scores: PairScores) -> tuple[bool, str, list[tuple[int, int, str, str]]]:
    """(garbled, restored text, runs as (start, end, restored, mapping)) of one text."""
    found: list[tuple[int, int, str, str]] = []
    for start, end in improbable_runs(flat, scores):
        # to the edges of the beyond-ASCII stretch
        while start > 0 and ord(text[start - 1]) > 127:
            start -= 1
        while end < len(text) and ord(text[end]) > 127:
            end += 1
        if found and start < found[-1][1]:
            continue
        if got := restore_run(text[start:end], scores):
            found.append((start, end, *got))
        elif _LOST in text[start:end]:
            found.append((start, end, text[start:end], "lost"))
        elif got := _completed(text, start, end, scores):
            found.append(got)
    out, last = [], 0
    for start, end, fixed, _ in found:
        out += [text[last:start], fixed]
        last = end
    out.append(text[last:])
    return bool(found), "".join(out), found


class PairFile:
    """Sorted pairs and their counts in one file that Spark hands to each executor; its workers share the mapped pages."""

    def __init__(self, pairs: DataFrame):
        spark = pairs.sparkSession
        self.n = pairs.count()
        self.path = f"{ensure_checkpoint_dir(spark)}/quern-pairs-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
        for column in ("code", "n"):  # one after the other; a part at a time is here
            part: list[int] = []
            for row in pairs.orderBy("code").select(column).toLocalIterator():
                part.append(row[0])
                if len(part) == 1 << 18:
                    out.write(bytearray(np.array(part, dtype=np.int64).tobytes()))
                    part = []
            out.write(bytearray(np.array(part, dtype=np.int64).tobytes()))
        out.close()
        spark.sparkContext.addFile(self.path)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.memmap(SparkFiles.get(self.path.rsplit("/", 1)[1]), dtype=np.int64, mode="r")
        return both[: self.n], both[self.n :]


def garbled_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, restored, runs, lost, mappings): documents with garbled stretches and their restored text.

    Statistics come from all texts; NULL and blank texts, and rows without id, are never garbled. Rows
    are examined as they are, so a repeated row gives the same row again, once. ``lost`` says that
    letters could not be brought back. The pair table depends on the alphabets, not on the number of
    documents; one of more than MAX_PAIRS rows is shared as a file.
    """
    spark = docs.sparkSession
    table = stored(pair_counts(docs))
    # characters: no more than Unicode has
    got = table.where("kind = 0").select("code", "n").toPandas()
    chars = dict(zip(got["code"].tolist(), got["n"].tolist(), strict=True))
    pairs = table.where("kind = 1").select("code", "n")
    if pairs.limit(MAX_PAIRS + 1).count() > MAX_PAIRS:
        held = PairFile(pairs)
    else:
        few = pairs.toPandas().sort_values("code")
        held = (few["code"].to_numpy(), few["n"].to_numpy())
    shared = spark.sparkContext.broadcast((chars, held))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, held = shared.value
        scores = PairScores(chars, *(held.arrays() if isinstance(held, PairFile) else held))
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                if text.isascii():
                    continue
                flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                garbled, fixed, runs = examine(text, flat, scores)
                if garbled:
                    rows.append((key, fixed, len(runs), _LOST in fixed or any(r[3] == "lost" for r in runs), sorted({r[3] for r in runs})))
            yield pd.DataFrame(rows, columns=["key", "restored", "runs", "lost", "mappings"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).alias("key"), "text")
    found = rows.mapInPandas(search, f"key {kind}, restored string, runs int, lost boolean, mappings array<string>")
    return found.withColumnRenamed("key", id_col)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a garbled stretch."""
    return garbled_documents(read_table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their restored text."""
    return garbled_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
ORACLE: dict[str, str] = {}
