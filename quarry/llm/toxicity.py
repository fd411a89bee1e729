"""Toxicity classifier that counterfactual copies keep indifferent to identity terms.

A logistic model on words and word prefixes. Features are chosen by Spark over the
labelled sample; the driver then sees only chosen features of at most ``MAX_ROWS`` labelled
rows. Sentences that mention an identity group are copied with another group of their kind
in its place, and the squared change of the score's logit is part of the loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import ready, tidied

#: Labelled rows that the model is fitted on, about, at most: a documented bound. More are sampled by a hash of their id.
MAX_ROWS = 20_000
#: Features of the model, at most.
MAX_FEATURES = 20_000
#: A feature must be in so many labelled documents, and so much more often in toxic ones.
MIN_DOCS, MIN_LIFT = 4, 2.0
PREFIXES = (4, 5, 6)
L1, L2, COUNTERFACTUAL = 2e-5, 1e-5, 1.0
STEPS, RATE = 300, 0.1
CACHE_WORDS = 400_000
#: Terms by kind and language; the terms of one row stand for groups of one kind.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("muslime", "christen", "juden", "hindus"),
    ("frauen", "männer"),
    ("schwule", "lesben", "heterosexuelle"),
    ("ausländer", "flüchtlinge", "deutsche"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("femmes", "hommes"),
    ("immigrés", "réfugiés", "étrangers"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("mujeres", "hombres"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
_SWAP = {w: row[(k + 1) % len(row)] for row in IDENTITY for k, w in enumerate(row)}
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if isinstance(text, str) else set()


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


def of_words(own: set[str]) -> set[str]:
    return {f for w in own for f in features(w)}


def swapped(text: str | None) -> list[tuple[set[str], set[str]]]:
    """For each sentence with identity terms: its words, and those with each term swapped."""
    if not isinstance(text, str):
        return []
    low = text.lower()
    if not any(w in low for w in _SWAP):
        return []
    out = []
    for s in _SENTENCE.findall(low):
        own = set(_WORD.findall(s))
        if own & _SWAP.keys():
            out.append((own, {_SWAP.get(w, w) for w in own}))
    return out


class Model:
    """Weights by feature. ``score`` is the probability of label 1 for a set of words."""

    def __init__(self, names: list[str], bias: float):
        self.index = {f: k for k, f in enumerate(names)}
        self.weights, self.bias = np.zeros(len(names)), bias
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def codes(self, own: set[str]) -> list[int]:
        """Chosen features of a set of words, each once."""
        cache, index, out = self.cache, self.index, set()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in own:
            got = cache.get(w)
            if got is None:
                got = cache[w] = tuple(index[f] for f in features(w) if f in index)
            if got:
                out.update(got)
        return sorted(out)

    def score(self, own: set[str]) -> float:
        z = self.bias + sum(self.weights[k] for k in self.codes(own))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def fit(self, rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], counterfactual: float = COUNTERFACTUAL, weights: np.ndarray | None = None, pair_weights: np.ndarray | None = None) -> Model:
        """Proximal Adam on log loss, and on squared logit changes between ``pairs``; rows and pairs count as often as their weights say."""
        n, dims = len(rows), len(self.weights)
        if not n or not dims:
            return self
        often = np.ones(n) if weights is None else np.asarray(weights, float)
        pair_often = np.ones(len(pairs)) if pair_weights is None else np.asarray(pair_weights, float)
        often, pair_often = often / often.sum(), pair_often / max(pair_often.sum(), 1)
        row, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.array([k for r in rows for k in r], np.int64)
        p_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
        p_col = np.array([k for a, b in pairs for k in (*a, *b)], np.int64)
        p_sign = np.array([s for a, b in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
        w, b = self.weights, self.bias
        m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
        for step in range(1, STEPS + 1):
            z = b + np.bincount(row, w[col], n)
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * often
            g, gb = np.bincount(col, error[row], dims) + L2 * w, error.sum()
            if len(pairs):
                change = np.bincount(p_row, p_sign * w[p_col], len(pairs)) * (2 * counterfactual * pair_often)
                g += np.bincount(p_col, p_sign * change[p_row], dims)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            up, down = 1 - 0.9**step, 1 - 0.99**step
            scale = RATE / (np.sqrt(v / down) + 1e-6)
            w = w - scale * m / up
            w = np.sign(w) * np.maximum(np.abs(w) - L1 * scale, 0)
            b -= RATE * (mb / up) / (np.sqrt(vb / down) + 1e-6)
        self.weights, self.bias = w, float(b)
        return self


def fit(docs: DataFrame, labels: DataFrame, *, train: Column | None = None, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, counterfactual: float = COUNTERFACTUAL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled documents. ``train``: which rows of ``labels`` may be used.

    Null labels are not used; of several labels of a document the largest holds. Without
    labels the model gives a low score to all.
    """
    ready(docs.sparkSession)
    known = labels.filter(train) if train is not None else labels
    known = known.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    toxic = toxic or 0
    # at most max_rows rows of 20 bytes, give or take a few: a proven bound
    sample = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(total, 1))) + (total <= max_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            yield pd.DataFrame({"label": pdf["label"], "names": [sorted(of_words(words(t))) for t in pdf["text"]]})

    rate = toxic / max(total, 1)
    counts = texts.mapInPandas(each, "label int, names array<string>").select("label", F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t"))
    chosen = counts.filter((F.col("n") >= MIN_DOCS) & (F.col("t") >= MIN_LIFT * rate * F.col("n")))
    score = (F.col("t") - rate * F.col("n")) / F.sqrt(rate * F.col("n") + 1e-9)
    names = [r["name"] for r in chosen.orderBy(score.desc(), "name").limit(max_features).select("name").collect()]
    names = list(dict.fromkeys([*names, *[f for w in _SWAP for f in features(w)]]))
    model = Model(names, float(np.log((toxic + 0.5) / (total - toxic + 4.5))))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            yield pd.DataFrame({"label": pdf["label"], "a": [model.codes(words(t)) for t in pdf["text"]], "b": None})
            pairs = [(set(model.codes(a)), set(model.codes(b))) for t in pdf["text"] for a, b in swapped(t)]
            if pairs:
                yield pd.DataFrame({"label": None, "a": [sorted(a - b) for a, b in pairs], "b": [sorted(b - a) for a, b in pairs]})

    # Rows that are alike count as one with a weight, so repeated ids add nothing. Of a pair only what the swap changes
    # matters to its loss: features of identity terms, so there are as many as sets of terms in a sentence, whatever the texts' length.
    kept = texts.mapInPandas(coded, "label int, a array<int>, b array<int>").groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(kept.collect(), key=lambda r: (r["label"] is None, r["label"], r["a"], r["b"] or []))
    rows, pairs = [r for r in found if r["label"] is not None], [r for r in found if r["label"] is None]
    return model.fit([r["a"] for r in rows], np.array([r["label"] for r in rows], float), [(r["a"], r["b"]) for r in pairs], counterfactual, np.array([r["n"] for r in rows]), np.array([r["n"] for r in pairs]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and score, the probability of label 1. Null and empty texts get the model's bias; repeated rows are scored each."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for pdf in tidied(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [own.score(words(t)) for t in pdf["text"]]})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, score double")
