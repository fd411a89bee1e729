"""Substring dedup on words: Rabin-Karp hashes of fixed-length windows, counted in Spark.

Windows that cannot repeat are left out beforehand by fingerprints (see winnow), without
loss. Hashes of the rest meet by value; a window goes if a smaller document id has it, and
neighbouring windows merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm import winnow
from quarry.llm.common import Scratch, tidied

WINDOW = 50
#: Words of the grams whose least hash is a window's fingerprint.
GRAM = 16
#: Word hashes kept by a worker.
CACHE_WORDS = 200_000

_HASHES: dict[bytes, int] = {}


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Those of many rows of short lists are kept for the next call."""
    digest = xxhash.xxh3_64_intdigest
    if len(_HASHES) > CACHE_WORDS:
        _HASHES.clear()
    _HASHES.update({w: digest(w) for w in set(words) if w not in _HASHES})
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _laid(pdf: pd.DataFrame, window: int, gram: int):
    """Slices of a batch, of texts or compressed ones: (rows, words of each, document ends, window starts, fingerprints, hashes)."""
    texts = winnow.unzipped(pdf["z"]) if "z" in pdf else [t.encode() if isinstance(t, str) else b"" for t in pdf["text"]]
    for a, b in winnow.laid([len(t) // 4 for t in texts]):
        some = pdf.iloc[a:b]
        words = [t.split() for t in texts[a:b]]
        ends = np.cumsum([len(w) for w in words])
        units = np.concatenate([hashes(w) for w in words]) if len(words) else np.zeros(0, np.uint64)
        starts, prints, rolling = winnow.fingerprints(units, ends, window, gram)
        yield some, words, ends, starts, prints, rolling, units


def _first_pass(window: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            for some, words, ends, starts, prints, _, _ in _laid(pdf, window, gram):
                first, _ = winnow.runs_of(starts, prints)
                own = np.searchsorted(starts[first], ends)
                cut = np.split(prints[first], own[:-1])
                yield pd.DataFrame({"doc_id": some["doc_id"], "key": some["key"], "n_words": [len(w) for w in words], "sha": [_sha(w) for w in words], "prints": [np.unique(x) for x in cut]})

    return run


def _windows(window: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            for some, _, ends, starts, prints, rolling, units in _laid(pdf, window, gram):
                doc = np.searchsorted(ends, starts, side="right")
                keep = np.zeros(len(starts), bool)
                edges = np.searchsorted(doc, np.arange(len(some) + 1))
                for k, known in enumerate(some["prints"]):
                    a, b = edges[k], edges[k + 1]
                    keep[a:b] = np.isin(prints[a:b], known)
                at, doc = starts[keep], doc[keep]
                begin = np.concatenate(([0], ends[:-1]))
                check = winnow.Rolling(winnow.mixed(units)).windows(window)
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].to_numpy()[doc],
                        "key": some["key"].to_numpy()[doc],
                        "start": (at - begin[doc]).astype(np.int32),
                        "h": rolling.windows(window)[at].view(np.int64),
                        "g": (check[at] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    }
                )

    return run


def removal_spans(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, key, n_words, spans (word positions, end exclusive) and kept_sha256.

    A word goes if it lies in a window of ``window`` words of its document that also starts
    in a document with a smaller id. kept_sha256 is of the kept words, joined by one space.
    Null text has no words; rows with a null id neither lose words nor make others lose
    theirs; repeated rows are judged alike.
    """
    scratch = Scratch(docs.sparkSession)
    rows = winnow.keyed(docs, id_col, text_col)
    told, some, _ = winnow.candidates(rows, scratch, _first_pass(window, gram), "n_words", lambda i: F.min(i) < F.max(i))
    windows = scratch.keep(some.mapInPandas(_windows(window, gram), "doc_id long, key long, start int, h long, g int"), "windows")
    least = lambda rows: rows.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h", "g", "lo")
    later = winnow.spread_join(windows, least(windows), ["h", "g"], "h", winnow.heavy(windows, "h", scratch, "heavy-windows"), "key", "start")
    gone = scratch.keep(later.filter("doc_id > lo").groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts")), "gone")
    scratch.drop("windows", "heavy-windows")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            spans, shas = [], []
            for text, starts in zip(winnow.unzipped(pdf["z"]), pdf["starts"], strict=True):
                words = text.split()
                out = winnow.covered_by(len(words), starts, np.asarray(starts) + window)
                spans.append([{"start": int(a), "end": int(b)} for a, b in winnow.spans_of(out)])
                shas.append(_sha([w for w, x in zip(words, out.tolist(), strict=True) if not x]))
            yield pd.DataFrame({"_id": pdf["doc_id"], "_key": pdf["key"], "spans": spans, "cut_sha": shas})

    changed = some.select("doc_id", "key", "z").join(gone, ["doc_id", "key"]).mapInPandas(cut, "_id long, _key long, spans array<struct<start:int,end:int>>, cut_sha string")
    out = told.join(changed, (told["key"] == changed["_key"]) & told["doc_id"].eqNullSafe(changed["_id"]), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return scratch.finish(out.select("doc_id", "key", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256")))


def remove_words(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words outside ``found``'s spans, joined by one space; other texts stay as they are."""
    spans = found.filter(F.size("spans") > 0).dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    words = F.array_remove(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), "")
    kept = F.array_join(F.filter(words, lambda w, i: ~F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["end"]))), " ")
    joined = docs.join(spans, (key == F.col("_key")) & F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNotNull(), kept).otherwise(F.col(text_col))).select(*docs.columns)
