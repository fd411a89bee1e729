"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the items' normalised words and is bounded: items are dealt
into blocks of some ``BLOCK_WORDS`` words, each with an automaton of its own, and every
document streams through all of them. Documents are never shuffled.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quarry.llm.common import Scratch, ready, shield, tidied
from quarry.operators.joins import broadcast_if_small

#: Words of items in one automaton (about 500 bytes each), on average.
BLOCK_WORDS = 200_000
#: Blocks, and so automata and Python workers of a task, in one pass over the documents; more take further passes, which write only hits.
PASS_BLOCKS = 4
#: Hits of several passes are broadcast if their files have no more bytes.
SMALL = 4_000_000
#: Bytes of word characters map to themselves, A-Z to a-z, the rest to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def norm_words(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, as UTF-8; none for null."""
    return text.encode().translate(_TABLE).split() if isinstance(text, str) else []


class SuffixAutomaton:
    """All word sequences of the items, by state; what occurs is told item by item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.least = min((min(len(words), window) for _, words in coded), default=0)
        n = len(self.next)
        self.items: list[set[str]] = [set() for _ in range(n)]  # of states that hold a window
        self.whole: list[list[tuple[int, str]]] = [[] for _ in range(n)]  # short items that end here: (words, item)
        for i, words in coded:
            state = 0
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.items[self._up(state)].add(i)
            if len(words) < window:
                self.whole[state].append((len(words), i))
        self.up = [self._up(s) for s in range(n)]
        # short items that are suffixes of all that a state holds
        self.inner: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.inner[s] = self.inner[self.link[s]] + self.whole[self.link[s]]

    def _up(self, state: int) -> int:
        """The suffix state that holds the last ``window`` words."""
        while self.length[self.link[state]] >= self.window and state:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` that ends the sequences which are one word longer than ``state``'s."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (known := self.next[last].get(word)) is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        own = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = own
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[own] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return own

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Spans of hit words (rows of start and end) and the items with occurring windows."""
        found: set[str] = set()
        ends: list[tuple[int, int]] = []
        if not self.least:
            return np.zeros((0, 2), np.int64), found
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue  # shorter than any window
            state = size = 0
            for at, w in enumerate(codes[a:b].tolist(), a + 1):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if w in self.next[state]:
                    state = self.next[state][w]
                    size += 1
                if size >= self.window:
                    found |= self.items[self.up[state]]
                    ends.append((at - self.window, at))
                for short, item in self.inner[state]:
                    found.add(item)
                    ends.append((at - short, at))
                for short, item in self.whole[state]:
                    if size >= short:
                        found.add(item)
                        ends.append((at - short, at))
        return merge(np.array(ends, np.int64).reshape(-1, 2)), found


def merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of spans that overlap or touch."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    upto = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > upto[:-1]))
    return np.stack((spans[first, 0], upto[np.concatenate((first[1:], [True]))]), axis=1)


def pieces(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """(i, t, n): items, those of over ``block_words`` words in pieces that overlap so far that each window is in one."""
    words = F.split(F.col(text_col).cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"), words.alias("w")).filter("t IS NOT NULL")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)), F.lit(block_words))
    cut = F.transform(starts, lambda k: F.array_join(F.slice("w", k, block_words + window - 1), " "))
    each = own.select("i", F.explode(F.when(F.size("w") <= block_words + window, F.array("t")).otherwise(cut)).alias("t"), F.least(F.size("w"), F.lit(block_words)).alias("n"))
    return each


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of about ``block_words`` words, a block at a time."""
    own = pieces(items, id_col, text_col, window, block_words)
    n = math.ceil((own.agg(F.sum("n")).first()[0] or 0) / block_words)
    if n > 1:  # read once, and then a folder for each block
        own = Scratch(items.sparkSession).keep(own.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int")), "items", by="block")
    for k in range(n):
        rows = (own.filter(F.col("block") == k) if n > 1 else own).select("i", "t").collect()
        yield [(r["i"], norm_words(r["t"])) for r in rows]


_BUILT: dict[str, SuffixAutomaton] = {}


ADDED = ("n_words", "hit_spans", "hit_items")


def _streamed(docs: DataFrame, items: DataFrame | None, names: dict, last=None) -> DataFrame:
    """``docs`` with what is hit, after all blocks of items; ``last`` maps local frames of that to frames like ``docs``.

    ``last`` runs in the same pass as the last block: a task has one Python worker for each block.
    """
    ready(docs.sparkSession)
    window, text_col = names["window"], names["text_col"]
    out = docs.drop(*ADDED)
    plain = out.schema
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<struct<start:int,end:int>>"), "hit_items": F.array().cast("array<string>")})

    def streamed(block: list[tuple[str, list[bytes]]], key: str, after):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = SuffixAutomaton(block, window)
            automaton = _BUILT[key]
            for pdf in tidied(batches):
                counts, spans, found = [], [], []
                for text, old, known in zip(pdf[text_col], pdf["hit_spans"], pdf["hit_items"], strict=True):
                    words = norm_words(text)
                    own, there = automaton.scan(words)
                    if len(old) and len(own):
                        own = merge(np.concatenate([own, [(x["start"], x["end"]) for x in old]]))
                    counts.append(len(words))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in own] if len(own) else old)
                    found.append(sorted(there.union(known)) if there else known)
                pdf = pdf.assign(n_words=counts, hit_spans=spans, hit_items=found)
                yield after(pdf) if after else pdf

        return run

    parts = blocks(items, names["item_id_col"], names["item_text_col"], window, names["block_words"]) if items is not None else iter(())
    some = list(itertools.islice(parts, PASS_BLOCKS)) or [[]]
    following = next(parts, None)

    def scanned(df: DataFrame, some: list, after) -> DataFrame:
        for k, block in enumerate(some):
            own = after if k + 1 == len(some) else None
            df = df.mapInPandas(streamed(block, uuid.uuid4().hex, own), plain if own else df.schema)
        return df

    if following is None:
        return scanned(out, some, last)
    # Each further pass reads the texts again and writes only what it hits: documents themselves are never written.
    scratch, found, k = Scratch(docs.sparkSession), [], 0
    text = F.col(text_col).cast("string")
    slim = out.select(text.alias(text_col), *ADDED)
    while some:
        hits = scanned(slim, some, None).filter(F.size("hit_items") > 0).select(F.xxhash64(text_col).alias("_hash"), F.sha2(text_col, 256).alias("_text"), "hit_spans", "hit_items")
        found.append(scratch.keep(hits.dropDuplicates(["_text"]), f"hits-{k}"))
        some = [following, *itertools.islice(parts, PASS_BLOCKS - 1)] if following is not None else []
        following, k = next(parts, None), k + 1
    every = reduce(DataFrame.unionByName, found).groupBy("_hash", "_text").agg(F.flatten(F.collect_list("hit_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("_items"))
    every = broadcast_if_small(scratch.keep(every, "hits"), SMALL)
    rest, back = shield(docs.drop(*ADDED), text_col)
    joined = rest.join(every, (F.xxhash64(text) == F.col("_hash")) & (F.sha2(text, 256) == F.col("_text")), "left").drop("_hash", "_text")
    schema = rest.schema if last else T.StructType([*rest.schema.fields, *[out.schema[c] for c in ADDED]])

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            spans = [merge(np.array([(x["start"], x["end"]) for x in own], np.int64).reshape(-1, 2)) if own is not None else () for own in pdf["_spans"]]
            pdf = pdf.assign(n_words=[len(norm_words(t)) for t in pdf[text_col]], hit_spans=[[{"start": int(a), "end": int(b)} for a, b in own] for own in spans], hit_items=[sorted(own) if own is not None else [] for own in pdf["_items"]])
            pdf = pdf.drop(columns=["_spans", "_items"])
            yield last(pdf) if last else pdf

    return joined.mapInPandas(told, schema).withColumnsRenamed(back)


def _names(window: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str, block_words: int) -> dict:
    return locals()


def contamination(docs: DataFrame, items: DataFrame | None, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, end exclusive) and hit_items.

    A window is ``window`` consecutive words of an item, or a whole shorter item. Null
    texts have no words; null item ids count as ''. Repeated rows are judged each; without
    items nothing is hit. Input columns of the added names give way.
    """
    return _streamed(docs, items, _names(window, id_col, text_col, item_id_col, item_text_col, block_words))


def decontaminate(docs: DataFrame, items: DataFrame | None, *, min_span: int = 10, max_coverage: float = 0.5, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without spans of ``min_span`` or more hit words or of whole shorter items, and without documents that are mostly hit.

    A span of fewer than ``window`` words is made of whole items, and goes whatever ``min_span`` is.
    A document goes if more than ``max_coverage`` of its words are hit, or if nothing but
    hit spans was in it. A span's text goes from its first word's first character to its
    last word's last one. Columns stay as they are; documents that are not hit keep their text.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, stays = [], []
        for text, n, spans in zip(pdf[text_col], pdf["n_words"], pdf["hit_spans"], strict=True):
            spans = [(x["start"], x["end"]) for x in spans]
            hit = sum(b - a for a, b in spans)
            if hit:
                text = cut_spans(text, [s for s in spans if not window <= s[1] - s[0] < min_span])
            texts.append(text)
            stays.append(not hit or (hit <= max_coverage * n and bool(norm_words(text))))
        return pdf.assign(**{text_col: texts})[np.array(stays, bool)].drop(columns=list(ADDED))

    return _streamed(docs, items, _names(window, id_col, text_col, item_id_col, item_text_col, block_words), cut)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words."""
    raw = text.encode()
    plain = raw.translate(_TABLE)
    starts, ends, at = [], [], 0
    for w in plain.split():
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()
