"""Fingerprints that show where a fixed-length window may occur twice.

A window's fingerprint is the least hash of the short grams within it. Equal windows have
equal fingerprints wherever they stand, so a window whose fingerprint is found once only
occurs once. Neighbouring windows mostly share theirs: about two per window length have
to be shuffled, and texts travel only where a fingerprint was found again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import Scratch, parts_for, tidied

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Units (words or bytes) that are hashed at once.
UNITS = 1_000_000

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Rolling:
    """Rabin-Karp hashes of every window of given lengths over one array of unit hashes."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.up, down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * down[:n], out=self.sums[1:], dtype=np.uint64)

    def windows(self, width: int) -> np.ndarray:
        """Hashes of units[i : i + width], for each i."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.up[:n] if n > 0 else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """min(a[i : i + width]) for each i."""
    size, cur = 1, a
    while 2 * size <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = width - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def fingerprints(units: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, Rolling]:
    """For documents laid end to end: the starts of whole windows, and the fingerprint of each."""
    rolling = Rolling(units)
    if len(units) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rolling
    least = sliding_min(mixed(rolling.windows(gram)), width - gram + 1)
    lengths = np.diff(ends, prepend=0)
    counts = np.maximum(lengths - width + 1, 0)
    first = np.repeat(ends - lengths, counts)
    starts = first + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts, least[starts].view(np.int64), rolling


def anchors(units: np.ndarray, ends: np.ndarray, width: int, gram: int) -> list[np.ndarray]:
    """By document: the hash of each gram that is the fingerprint of some window, as often as it stands there."""
    least = np.zeros(len(units), np.uint64)  # of places where no whole window starts: below every hash but 0
    starts, prints, rolling = fingerprints(units, ends, width, gram)
    least[starts] = prints.view(np.uint64)
    h = mixed(rolling.windows(gram))
    reach = width - gram + 1
    # the greatest fingerprint of the windows that hold the gram at p, which start at p - reach + 1 to p
    greatest = ~sliding_min(~np.concatenate((np.zeros(reach - 1, np.uint64), least[: len(h)])), reach) if len(h) else h
    at = np.flatnonzero(greatest == h)
    return np.split(h[at].view(np.int64), np.searchsorted(at, ends)[:-1])


def runs_of(starts: np.ndarray, prints: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one fingerprint, as indices (first, end exclusive), of ``most`` windows at most."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (prints[1:] != prints[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    if most:
        end = np.append(first[1:], len(starts))
        cuts = -(-(end - first) // most)
        at = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first = np.repeat(first, cuts) + at * most
    return first, np.append(first[1:], len(starts))


def laid(sizes: list[int], units: int = UNITS) -> Iterator[tuple[int, int]]:
    """Slices of a list of documents with about ``units`` units each."""
    first = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > units:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): rows with one key are copies of one row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.withColumn("key", F.xxhash64("doc_id", "text"))


def same_row(a: DataFrame, b: DataFrame):
    return (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _zip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts are shuffled as compressed bytes, at two thirds of what the shuffle's own codec gives."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for pdf in tidied(batches):
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "z": [pack(t.encode()) if isinstance(t, str) else None for t in pdf["text"]]})


def unzipped(column) -> list[bytes]:
    """UTF-8 texts of a column of compressed ones; empty for null."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(z) if z is not None else b"" for z in column]


#: A value that more than one row in so many has is heavy, if there are so many tasks that it matters.
HEAVY = 1000


def _frequent(most: int):
    """Values that may be heavy with lower bounds of their counts, after Misra and Gries, with ``most`` counters; and the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, counts, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for pdf in tidied(batches):
            rows += len(pdf)
            own, n = np.unique(pdf["v"].to_numpy(np.int64), return_counts=True)
            values, where = np.unique(np.concatenate((values, own)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n)), len(values)).astype(np.int64)
            if len(values) > most:
                counts -= np.partition(counts, -most - 1)[-most - 1]
                values, counts = values[counts > 0], counts[counts > 0]
        if rows:
            yield pd.DataFrame({"v": [*values.tolist(), None], "n": [*counts.tolist(), rows]}, dtype="Int64")

    return run


def heavy(rows: DataFrame, column: str, scratch: Scratch, name: str) -> list[int]:
    """Values of ``column`` that have more than half of a task's share of the rows (or one in HEAVY), and perhaps others.

    A task keeps twice as many counters as there can be such values, and what it takes from each is less than one row in
    so many. So a heavy value is left with at least as many rows; at most 2 * HEAVY numbers are.
    """
    most = 2 * min(HEAVY, max(100, 2 * parts_for(rows)))
    found = rows.select(F.col(column).alias("v")).mapInPandas(_frequent(most), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    found = scratch.keep(found, name)
    total = found.filter("v IS NULL").agg(F.sum("n")).first()[0] or 0
    if total < 100 * HEAVY:
        return []
    return [r["v"] for r in found.filter((F.col("v").isNotNull()) & (F.col("n") > total / most)).select("v").collect()]


def spread_join(rows: DataFrame, few: DataFrame, on: list[str], column: str, values: list[int], *by: str) -> DataFrame:
    """``rows`` joined with ``few``, which has a row for each key. Rows with one of the heavy ``values`` are dealt out by ``by``, and meet copies of their partner."""
    if not values:
        return rows.join(few, on)
    salts, is_heavy = min(parts_for(rows), 256), F.col(column).isin(values)
    left = rows.withColumn("_salt", F.when(is_heavy, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0))
    right = few.withColumn("_salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def once(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """``rows`` (doc_id, key, ...) with one of those that are in ``copied`` (doc_id, key) more than once."""
    if copied.isEmpty():
        return rows
    other = copied.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    same = (rows["key"] == other["_key"]) & rows["doc_id"].eqNullSafe(other["_id"])
    return rows.join(other, same, "left_anti").unionByName(rows.join(other, same, "left_semi").dropDuplicates(["doc_id", "key"]))


def candidates(docs: DataFrame, scratch: Scratch, first_pass: Callable, count_name: str, repeated) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with a fingerprint that was found again.

    ``first_pass`` maps batches of (doc_id, text, key) to (doc_id, key, <count_name>, sha,
    prints); ``repeated`` tells from the ids that a fingerprint has, as an aggregate,
    whether it is one of those. Returns what the first pass told of every document, and (doc_id,
    key, z, prints) of the documents in question: z as ``unzipped`` takes it, prints being
    those found again. A row that is there several times is there once in the latter; (doc_id, key) of
    such rows come last.
    """
    schema = f"doc_id long, key long, {count_name} long, sha string, prints array<long>"
    told = scratch.keep(docs.mapInPandas(first_pass, schema), "prints")
    copied = scratch.keep(told.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("doc_id", "key"), "copied")
    each = told.select("doc_id", "key", F.explode("prints").alias("print"))
    again = lambda rows: rows.groupBy("print").agg(repeated(F.col("doc_id")).alias("again")).filter("again").select("print")
    found = spread_join(each.select("key", "print"), again(each), ["print"], "print", heavy(each, "print", scratch, "heavy-prints"), "key")
    # should two keys ever agree, a document gets prints of another one: they find nothing in it
    found = found.groupBy("key").agg(F.collect_set("print").alias("prints"))
    texts = docs.select("doc_id", "text", "key").mapInPandas(_zip, "doc_id long, key long, z binary")
    some = scratch.keep(once(texts.join(found, "key"), copied), "candidates").select("doc_id", "key", "z", "prints")
    slim = scratch.keep(told.drop("prints"), "told")
    scratch.drop("prints", "heavy-prints")
    return slim, some, copied


def spans_of(covered: np.ndarray) -> np.ndarray:
    """Maximal runs of True, as rows (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def covered_by(n: int, starts, ends) -> np.ndarray:
    """Which of n units lie in a span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.asarray(starts, np.int64), 1)
    np.add.at(steps, np.asarray(ends, np.int64), -1)
    return np.cumsum(steps[:-1]) > 0
