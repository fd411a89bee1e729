"""Exact substring dedup on bytes by blockwise suffix sorting with a difference cover.

Fingerprints (see winnow) leave the windows that may repeat. Those that share one are a
suffix bucket: they meet in one task, as short contexts of the text around them, and
buckets are sorted a bounded block at a time. Suffixes are sorted by their first
``PERIOD`` bytes; ties are resolved by ranks, computed beforehand, of a sample of suffixes
that stand at the residues of a difference cover. Neighbours in that order that agree in
a whole window are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm import winnow
from quarry.llm.common import Scratch, parts_for, tidied

WINDOW = 200
GRAM = 64
PERIOD = 32
#: Windows of one context, at most; a longer run is cut.
RUN = 512
#: Bytes of contexts that are sorted at once.
BLOCK = 1_500_000
#: A bucket with more different contexts than this is split by further bytes, and its parts are sorted.
HOT_CONTEXTS = 1_000
#: Into how many more stretches of a window each split tells the places of the fingerprint apart.
STEP = 4
#: Hashes of the byte values.
_BYTE = winnow.mixed(np.arange(1, 257, dtype=np.uint64) * winnow.BASE)


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` is one of two of them: 0..r-1 and the multiples of r."""
    r = int(np.ceil(np.sqrt(period)))
    return sorted({*range(r), *range(0, period, r)})


class Block:
    """Bytes of contexts, laid end to end so that their anchors stand at multiples of ``PERIOD``."""

    def __init__(self, contexts: list[bytes], shifts: np.ndarray, depth: int):
        sizes = np.array([len(c) for c in contexts])
        room = -(-sizes // PERIOD) * PERIOD + PERIOD
        at = np.cumsum(np.append(0, room))
        self.begin = at[:-1] + -shifts % PERIOD
        self.depth = depth
        self.size = int(at[-1])
        text = np.zeros(self.size + depth + 3 * PERIOD, np.uint8)
        whole = np.frombuffer(b"".join(contexts), np.uint8)
        text[np.arange(len(whole)) + np.repeat(self.begin - (np.cumsum(sizes) - sizes), sizes)] = whole
        self.text = text
        self.eight = np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))  # eight bytes from each place

    def key(self, at: np.ndarray) -> np.ndarray:
        return self.eight[at].astype(np.uint64)

    def ranks(self, residues: list[int], suffixes: np.ndarray) -> np.ndarray:
        """Ranks, by the first ``depth`` bytes at least, of the places at ``residues`` within ``depth`` bytes of a suffix; 0 elsewhere."""
        inside = np.zeros(PERIOD, bool)
        inside[residues] = True
        near = np.zeros(self.size + self.depth + 1, np.int64)
        near[: self.size] += np.bincount(suffixes, minlength=self.size)
        near[self.depth :] -= np.bincount(suffixes, minlength=self.size + 1)
        sample = np.flatnonzero((np.cumsum(near[: self.size]) > 0) & np.tile(inside, self.size // PERIOD + 1)[: self.size])
        rank = np.zeros(len(self.text) + 4 * self.depth, np.int64)
        full = len(residues) == PERIOD
        step = 8 if full else PERIOD
        order = np.lexsort([self.key(sample + k) for k in range(step - 8, -1, -8)])
        new = np.zeros(len(sample), bool)
        for k in range(0, step, 8):
            own = self.key(sample + k)[order]
            new[1:] |= own[1:] != own[:-1]
        while True:
            rank[sample[order]] = np.cumsum(new) + 1
            if step >= self.depth or not len(sample):
                return rank
            both = (rank[sample] << 32) | rank[sample + step]
            order = np.argsort(both, kind="stable")
            new = np.concatenate(([False], np.diff(both[order]) != 0))
            step *= 2

    def repeated(self, suffixes: np.ndarray, bucket: np.ndarray, cover: list[int] | None = None) -> np.ndarray:
        """Which suffixes agree in their first ``depth`` bytes with another one of their bucket."""
        out = np.zeros(len(suffixes), bool)
        if len(suffixes) < 2:
            return out
        cover = difference_cover(PERIOD) if cover is None else cover
        rank = self.ranks(cover, suffixes)
        ahead = np.array([min((c - r) % PERIOD for c in cover) for r in range(PERIOD)])
        residue = suffixes % PERIOD
        tie = rank[suffixes + ahead[residue]]
        keys = [self.key(suffixes + k) for k in range(PERIOD - 8, -1, -8)]
        order = np.lexsort([tie, *keys, bucket])
        alike = bucket[order][1:] == bucket[order][:-1]
        for k in keys:
            own = k[order]
            alike &= own[1:] == own[:-1]
        if len(cover) < PERIOD:
            # A tie between different residues has no common place in the cover at the distance used
            # here; such buckets (periodic texts) are sorted again, with every residue in the sample.
            own = residue[order]
            odd = np.unique(bucket[order][1:][alike & (own[1:] != own[:-1])])
            again = np.isin(bucket, odd)
            if again.any():
                out[again] = self.repeated(suffixes[again], bucket[again], list(range(PERIOD)))
                alike &= ~np.isin(bucket[order][1:], odd)
        pairs = np.flatnonzero(alike)
        a, b = suffixes[order[pairs]], suffixes[order[pairs + 1]]
        for k in [*range(PERIOD, self.depth - 7, 8), self.depth - 8]:
            same = self.key(a + k) == self.key(b + k)
            pairs, a, b = pairs[same], a[same], b[same]
        out[order[pairs]] = True
        out[order[pairs + 1]] = True
        return out


def _utf8(texts) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def _laid(pdf: pd.DataFrame, window: int, gram: int):
    texts = winnow.unzipped(pdf["z"])
    for a, b in winnow.laid([len(t) for t in texts]):
        whole = b"".join(texts[a:b])
        ends = np.cumsum([len(x) for x in texts[a:b]])
        starts, prints, _ = winnow.fingerprints(_BYTE[np.frombuffer(whole, np.uint8)], ends, window, gram)
        yield pdf.iloc[a:b], whole, ends, starts, prints


def _first_pass(window: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            for a, b in winnow.laid([len(t) if isinstance(t, str) else 0 for t in pdf["text"]]):
                some = pdf.iloc[a:b]
                raw = _utf8(some["text"])
                own = winnow.anchors(_BYTE[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum([len(x) for x in raw]), window, gram)
                yield pd.DataFrame({"doc_id": some["doc_id"], "key": some["key"], "n_bytes": [len(x) for x in raw], "sha": [hashlib.sha256(x).hexdigest() for x in raw], "prints": own})

    return run


def _places(window: int, gram: int):
    """A row for each run of windows with a repeated fingerprint; copies of a context have one name."""
    name = xxhash.xxh3_128_digest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            for some, whole, ends, starts, prints in _laid(pdf, window, gram):
                first, last = winnow.runs_of(starts, prints, RUN)
                at, size = starts[first], last - first + window - 1
                doc = np.searchsorted(ends, at, side="right")
                edges = np.searchsorted(doc, np.arange(len(some) + 1))
                keep = np.concatenate([np.isin(prints[first[a:b]], known) for a, b, known in zip(edges[:-1], edges[1:], some["prints"], strict=True)])
                at, size, doc, kept = at[keep], size[keep], doc[keep], prints[first[keep]]
                names = [name(whole[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                begin = np.concatenate(([0], ends[:-1]))
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy()[doc], "key": some["key"].to_numpy()[doc], "start": (at - begin[doc]).astype(np.int32), "windows": (size - window + 1).astype(np.int32), "print": kept, "name": names})

    return run


def _cut_out(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            texts = winnow.unzipped(pdf["z"])
            rows = [(w["print"], w["name"], text[w["start"] : w["start"] + w["windows"] + window - 1], w["n"]) for text, wanted in zip(texts, pdf["wanted"], strict=True) for w in wanted]
            yield pd.DataFrame(rows, columns=["print", "name", "bytes", "n"])

    return run


def _anchors(contexts: list[bytes], prints: np.ndarray, gram: int) -> np.ndarray:
    """Where in each context the first gram with its fingerprint begins."""
    sizes = np.array([len(c) for c in contexts])
    h = winnow.mixed(winnow.Rolling(_BYTE[np.frombuffer(b"".join(contexts), np.uint8)]).windows(gram)).view(np.int64)
    found = np.flatnonzero(h == np.repeat(prints, sizes)[: len(h)])
    begin = np.cumsum(sizes) - sizes
    return found[np.searchsorted(found, begin)] - begin


def _sorted_blocks(window: int, gram: int):
    """Sorted rows (bucket, print, name, bytes, n) to the runs of repeated windows of each context, a block at a time."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        contexts, prints = [r[2] for r in rows], np.array([r[4] for r in rows], np.int64)
        block = Block(contexts, _anchors(contexts, prints, gram), window)
        counts = np.array([len(c) - window + 1 for c in contexts])
        owner = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        hit = block.repeated(block.begin[owner] + offset, bucket[owner])
        hit &= np.array([r[3] for r in rows])[owner] == 1  # copies of a context are repeats as a whole
        first = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (offset[1:] == 0))))
        last = np.flatnonzero(hit & np.concatenate((~hit[1:] | (offset[1:] == 0), [True])))
        names = [r[1] for r in rows]
        return pd.DataFrame({"name": [names[k] for k in owner[first].tolist()], "a": offset[first], "b": offset[last] + 1})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        sizes: list[int] = []
        last: list[tuple] = []  # rows of the bucket that is being read

        def hold(bucket: list[tuple]) -> None:
            """A single context, if it has copies or one window only, has nothing to be sorted for."""
            if len(bucket) > 1 or (bucket[0][3] == 1 and len(bucket[0][2]) > window):
                held.extend(bucket)
                sizes.append(sum(len(r[2]) for r in bucket))

        for pdf in tidied(batches):
            for row in zip(pdf["bucket"], pdf["name"], pdf["bytes"], pdf["n"], pdf["print"], strict=True):
                if last and row[0] != last[0][0]:
                    hold(last)
                    last = []
                    if sum(sizes) >= BLOCK:
                        yield solve(held)
                        held.clear()
                        sizes.clear()
                last.append(row)
        if last:
            hold(last)
        if held:
            yield solve(held)

    return run


PIECES = "print long, top binary, start int, bucket long, name binary, bytes binary, n int"


def _split(window: int, gram: int, parts: int):
    """Contexts to pieces of neighbouring windows whose fingerprint stands in one of ``parts`` stretches of the window.

    Equal windows have their fingerprint's first gram in one place, so they are in pieces of one
    stretch, and agree in the bytes around it that all windows of the stretch have: these
    bytes name the bucket. Rows (print, top, start, bytes, n), where ``bytes`` begin ``start`` windows into context ``top``.
    """
    places = window - gram + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            out = []
            for own, top, start, context, n in zip(pdf["print"], pdf["top"], pdf["start"], pdf["bytes"], pdf["n"], strict=True):
                h = winnow.mixed(winnow.Rolling(_BYTE[np.frombuffer(context, np.uint8)]).windows(gram)).view(np.int64)
                there, offsets = np.flatnonzero(h == own), np.arange(len(context) - window + 1)
                at = there[np.searchsorted(there, offsets)]
                part = (at - offsets) * parts // places
                first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (at[1:] != at[:-1]))))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(offsets)], strict=True):
                    k, p = int(part[a]), int(at[a])
                    low, high = -(-k * places // parts), -(-(k + 1) * places // parts) - 1  # the fingerprint's places in the stretch
                    shared, piece = context[p - low : p + window - high], context[a : b + window - 1]
                    out.append((own, top, start + a, xxhash.xxh3_64_intdigest(shared, k) - 2**63, xxhash.xxh3_128_digest(piece), piece, n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return run


RUNS = "name binary, a int, b int"


def repeated_runs(contexts: DataFrame, scratch: Scratch, window: int, gram: int) -> DataFrame:
    """(name, a, b): windows a to b, end exclusive, of a context (print, name, bytes, n) repeat in another context with its print or in itself.

    A bucket of too many contexts is split by the bytes around the fingerprint, again and again
    if need be; in the last split all windows of a bucket are equal, so that they are one context.
    """

    def hot_of(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("contexts"))
        return scratch.keep(sizes.filter(F.col("contexts") > HOT_CONTEXTS).select("bucket"), name)

    def solved(rows: DataFrame, hot: DataFrame) -> DataFrame:
        plain = rows.join(hot, "bucket", "left_anti").repartition(parts_for(rows), "bucket").sortWithinPartitions("bucket", "name")
        return plain.select("bucket", "print", "name", "bytes", "n").mapInPandas(_sorted_blocks(window, gram), RUNS)

    rows = contexts.withColumn("bucket", F.col("print"))
    hot, parts, places = hot_of(rows, "hot"), 1, window - gram + 1
    out = solved(rows, hot)
    left = rows.join(hot, "bucket", "left_semi").select("print", F.col("name").alias("top"), F.lit(0).alias("start"), "bytes", "n")
    while not hot.isEmpty():
        parts = min(STEP * parts, places)
        pieces = scratch.keep(left.mapInPandas(_split(window, gram, parts), PIECES), f"pieces-{parts}")
        rows = scratch.keep(pieces.groupBy("bucket", "name").agg(F.sum("n").cast("int").alias("n"), F.first("print").alias("print"), F.first("bytes").alias("bytes")), f"named-{parts}")
        hot = hot_of(rows, f"hot-{parts}")
        whole = rows.filter("n > 1").select("name", F.lit(0).alias("a"), (F.octet_length("bytes") - (window - 1)).alias("b"))
        runs = scratch.keep(solved(rows, hot).unionByName(whole).groupBy("name").agg(F.collect_list(F.struct("a", "b")).alias("runs")), f"runs-{parts}")
        back = pieces.select("name", "top", "start").join(runs, "name").select("top", "start", F.explode("runs").alias("r"))
        out = out.unionByName(back.select(F.col("top").alias("name"), (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")))
        left = pieces.join(hot, "bucket", "left_semi").select("print", "top", "start", "bytes", "n")
    return out


def removal_spans(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, key, n_bytes, spans (byte positions, end exclusive) and kept_sha256.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else,
    in the same document included. Null text is empty. Repeated rows are copies of one
    another, so all that is long enough goes from each.
    """
    scratch = Scratch(docs.sparkSession)
    rows = winnow.keyed(docs, id_col, text_col)
    told, some, copied = winnow.candidates(rows, scratch, _first_pass(window, gram), "n_bytes", lambda i: F.count(F.lit(1)) > 1)
    # copies of whole rows: all their windows repeat
    copies = copied.select("doc_id", "key", F.array(F.struct(F.lit(0).alias("a"), F.lit(-1).alias("b"))).alias("runs"))
    places = scratch.keep(some.mapInPandas(_places(window, gram), "doc_id long, key long, start int, windows int, print long, name binary"), "places")
    first = F.min(F.struct("doc_id", "key", "start", "windows", "print")).alias("x")
    names = scratch.keep(places.groupBy("name").agg(first, F.count(F.lit(1)).cast("int").alias("n")).select("name", "n", "x.*"), "names")
    # contexts are needed of buckets with several, or with one that may repeat a window within itself
    sizes = names.groupBy("print").agg(F.count(F.lit(1)).alias("contexts"), F.max("n").alias("most"), F.max("windows").alias("windows"))
    needed = scratch.keep(sizes.filter("contexts > 1 OR (most = 1 AND windows > 1)").select("print"), "needed")
    wanted = names.join(needed, "print").groupBy("doc_id", "key").agg(F.collect_list(F.struct("print", "name", "start", "windows", "n")).alias("wanted"))
    texts = some.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "z")
    of_row = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    contexts = scratch.keep(texts.join(wanted, of_row).select("z", "wanted").mapInPandas(_cut_out(window), "print long, name binary, bytes binary, n int"), "contexts")
    runs = repeated_runs(contexts, scratch, window, gram)
    whole = names.filter("n > 1").select("name", F.lit(0).alias("a"), F.col("windows").alias("b"))
    repeats = scratch.keep(runs.unionByName(whole).groupBy("name").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "repeats")
    gone = places.join(repeats, "name").select("doc_id", "key", F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"]).alias("b"))).alias("runs"))
    gone = gone.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("runs")).alias("runs")).unionByName(copies)
    gone = scratch.keep(gone.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("runs")).alias("runs")), "gone")
    scratch.drop("places", "names", "contexts", "repeats")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            spans, shas = [], []
            for text, found in zip(winnow.unzipped(pdf["z"]), pdf["runs"], strict=True):
                runs = np.array([(r["a"], r["b"] if r["b"] >= 0 else max(0, len(text) - window + 1)) for r in found], np.int64).reshape(-1, 2)
                runs = runs[runs[:, 1] > runs[:, 0]]
                own = winnow.spans_of(winnow.covered_by(len(text), runs[:, 0], runs[:, 1] + window - 1))
                digest, at = hashlib.sha256(), 0
                for a, b in own:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                spans.append([{"start": int(a), "end": int(b)} for a, b in own])
                shas.append(digest.hexdigest())
            yield pd.DataFrame({"_id": pdf["doc_id"], "_key": pdf["key"], "spans": spans, "cut_sha": shas})

    changed = texts.join(gone, of_row).select("doc_id", "key", "z", "runs").mapInPandas(cut, "_id long, _key long, spans array<struct<start:int,end:int>>, cut_sha string")
    out = told.join(changed, (told["key"] == changed["_key"]) & told["doc_id"].eqNullSafe(changed["_id"]), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return scratch.finish(out.select("doc_id", "key", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256")))


def remove_bytes(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` as the bytes (binary) outside ``found``'s spans."""
    spans = found.dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    joined = docs.withColumn("_key0", F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).join(spans, (F.col("_key0") == F.col("_key")) & F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            out = []
            for text, own in zip(pdf["_raw"], pdf["_spans"], strict=True):
                parts, at = [], 0
                for s in own if own is not None else ():
                    parts.append(text[at : s["start"]])
                    at = s["end"]
                out.append(b"".join([*parts, text[at:]]))
            yield pdf.drop(columns=["_raw", "_spans"]).assign(**{text_col: out})

    rest = [c for c in docs.columns if c != text_col]
    slim = joined.select(*rest, raw.alias("_raw"), "_spans")
    from pyspark.sql.types import BinaryType, StructField, StructType

    return slim.mapInPandas(cut, StructType([*[docs.schema[c] for c in rest], StructField(text_col, BinaryType())]))
