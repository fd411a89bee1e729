"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Packing depends only on lengths, and there are at most ``capacity`` of them. So Spark
counts pieces by length, the driver packs the counts (a table bounded by the capacity,
whatever the input), and each piece then finds its place from its rank among the pieces
of its length. No piece, document or group is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import ready, tidied
from quarry.llm.tokens import default_path, loaded

#: Documents that a worker encodes at once.
BATCH = 256


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """Pieces of a document's ids: (place of the first id, ids of at most ``capacity``)."""
    return [(k // 4, ids[k : k + 4 * capacity]) for k in range(0, len(ids), 4 * capacity)]


def fewest_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The best of a few runs of ``best_two_fit`` that replace pieces only in gaps above a share of the capacity.

    Closing small gaps can use up short pieces that long ones need later.
    """
    runs = [best_two_fit(counts, capacity, slack) for slack in (0, capacity // 256, capacity // 64, capacity // 16, capacity)]
    return min(runs, key=lambda bins: sum(times for _, times in bins))


def best_two_fit(counts: dict[int, int], capacity: int, slack: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """Bins for ``counts`` (pieces by length), as (lengths from the largest, bins alike).

    A bin takes the longest piece that is left, then again the longest that fits. Then
    its smallest piece gives way to two unpacked pieces that together fill the gap and
    the smallest piece's place more tightly, as long as there are such two and the gap is over ``slack``. The choice
    depends only on which lengths are left, so a bin repeats until one of them runs out.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] += n
    bins: list[tuple[tuple[int, ...], int]] = []
    while (there := np.flatnonzero(left)).size:
        own = Counter()
        room = capacity
        while room and (k := np.searchsorted(there, room, side="right")):
            length = int(there[k - 1])
            if left[length] > own[length]:
                n = min(int(left[length] - own[length]), room // length)
                own[length] += n
                room -= n * length
            there = there[: k - 1] if left[length] <= own[length] else there[:k]
        while room > slack:
            small = min(x for x, n in own.items() if n)
            free = left.copy()
            for x, n in own.items():
                free[x] -= n
            have = np.flatnonzero(free)
            gap = room + small
            have = have[have < gap]
            if not have.size:
                break
            at = np.searchsorted(have, gap - have, side="right") - 1
            # the second piece: the longest that fits beside the first; of the same length only if two are left
            same = (at >= 0) & (have[np.maximum(at, 0)] == have) & (free[have] < 2)
            at = np.where(same, at - 1, at)
            total = np.where(at >= 0, have + have[np.maximum(at, 0)], 0)
            k = int(total.argmax())
            if total[k] <= small:
                break
            own[small] -= 1
            own[int(have[k])] += 1
            own[int(have[at[k]])] += 1
            room = gap - int(total[k])
        own = +own
        times = min(int(left[x]) // n for x, n in own.items())
        for x, n in own.items():
            left[x] -= n * times
        bins.append((tuple(sorted(own.elements(), reverse=True)), times))
    return bins


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces of this length in a bin, first bin, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    first = 0
    for lengths, times in bins:
        offset = 0
        for x, n in Counter(lengths).items():
            out.setdefault(x, []).append((seen[x], n, first, offset))
            seen[x] += n * times
            offset += n * x
        first += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in out.items()}


def _tokenise(path: str, capacity: int, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, ranks, bpe = TaskContext.get().partitionId(), Counter(), loaded(path)
        for pdf in tidied(batches):
            for k in range(0, len(pdf), BATCH):
                some = pdf.iloc[k : k + BATCH]
                rows = []
                for doc_id, ids in zip(some["doc_id"], bpe.ids([t if isinstance(t, str) else "" for t in some["text"]]), strict=True):
                    for piece, (start, own) in enumerate(cut_pieces(ids + end, capacity)):
                        n = len(own) // 4
                        rows.append((doc_id, piece, start, n, zlib.crc32(own), part, ranks[n]))
                        ranks[n] += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def pack(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every document in sequences of at most ``capacity`` ids.

    A document is its ids and then ``end_id``; null text counts as empty, so it is
    ``end_id`` alone. Only documents longer than ``capacity`` are cut. Rows: doc_id,
    piece (int), start, length, ids_crc32 (check sum of the ids as little-endian unsigned
    32-bit numbers), sequence_id, offset. Repeated rows and null ids are packed like
    any other row; further columns are ignored; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = slim.mapInPandas(_tokenise(tokenizer or default_path(), capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long").checkpoint()
    # ranks are within a partition: where each partition's ranks begin, by length
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(fewest_bins(counts, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            rank, length = (pdf["base"] + pdf["rank"]).to_numpy(), pdf["length"].to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                rows = table[int(x)]
                lo, n, first, at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1].T
                sequence[own] = first + (rank[own] - lo) // n
                offset[own] = at + (rank[own] - lo) % n * x
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return pieces.join(base, ["length", "part"]).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_ids(docs: DataFrame, placed: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, ids (array<int>). ``doc_id`` must be unique here."""
    ready(docs.sparkSession)
    path, end = tokenizer or default_path(), np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for pdf in tidied(batches):
            for k in range(0, len(pdf), BATCH):
                some = pdf.iloc[k : k + BATCH]
                rows = [(d, i, np.frombuffer(own, "<i4")) for d, ids in zip(some["doc_id"], bpe.ids([t if isinstance(t, str) else "" for t in some["text"]]), strict=True) for i, (_, own) in enumerate(cut_pieces(ids + end, capacity))]
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = slim.mapInPandas(run, "doc_id long, piece int, ids array<int>")
    rows = own.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
