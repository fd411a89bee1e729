"""Language-model scores from a causal self-attention model trained in numpy on subword ids.

A word is its subword ids, an end is one more word. Before each word the model attends over
the words before it, each embedded as the sum of its subwords' vectors, and gives the class
of the word's first subword. What is left of the word follows counts: its own count among
words with that first subword (absolute discounting), and below that the counts of subword
pairs. All three multiply to one distribution over words.

Subword vectors are the leading singular vectors of the counts of what follows a subword.
The attention is trained by synchronous gradient steps: a step is the summed gradient over
one share of the training documents, shares are taken by a hash of the document, and every
training document is in one of them. So the result does not depend on how rows are
dealt, but for rounding.

Counts cover every training document and grow with the corpus: documents are held in
chunks of bounded size; a chunk sends each of its words and subword pairs once, and gets
each total back once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm import winnow
from quarry.llm.common import Scratch, crc_mod, parts_for, tidied, words_of
from quarry.llm.tokens import default_path

VOCABULARY, END = 50_257, 50_256
#: Classes of first subwords: the most frequent ones, and bins of the rest.
SINGLE, BINS = 104, 24
CLASSES = SINGLE + BINS
WIDTH, HEAD = 24, 16
#: Words that a window scores, and the words before them that it sees as well.
BLOCK, CONTEXT = 32, 32
KEYS = BLOCK + CONTEXT
#: Windows that are worked on at once.
WINDOWS = 48
#: Rows of the products over classes that are worked on at once.
PART = 128
#: Characters of a chunk of documents, about.
CHUNK = 4_000_000
#: Bytes of text for each bucket of word counts: some 4 bytes in 10 are sent.
BUCKET_TEXT = 64_000_000
CACHE_WORDS = 800_000
#: Training: steps, each over its own share of the training documents.
ROUNDS = 8
RATE = 0.08
ALPHA, SHRINK = 0.05, 20.0
#: Vectors of subwords are of spread 1 in each direction, and held within this.
LIMIT = 4.0
#: Ids in a block of the table of what follows each id.
ROWS = 4096
#: Subwords of a word that are summed for many words at once.
FEW = 12


class Subwords:
    """Ids of lower-case words, each with a space before it, so that one id in each word begins with a space."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.start = np.zeros(65_536, bool)
        self.start[[i for b, i in ranks.items() if b[:1] == b" "] + [END]] = True
        self.cache: dict[bytes, bytes] = {}

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: encoded in rows of many, and cut where an id begins with a space."""
        out: list[bytes] = []
        for k in range(0, len(words), 500):
            row = words[k : k + 500]
            text = " " + b" ".join(row).decode()
            ids = np.asarray(self.encode(text), np.uint16)
            cuts = np.append(np.flatnonzero(self.start[ids]), len(ids)) * 2
            if len(cuts) == len(row) + 1 and len(text.split()) == len(row):  # else a word holds other white space
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            else:
                out += [np.asarray(self.encode(" " + w.decode()), np.uint16).tobytes() for w in row]
        return out

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as unsigned 16-bit numbers."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache, new = {}, words
        self.cache.update(zip(new, self._words(new), strict=True))
        return [*map(self.cache.__getitem__, words)]


class Numbers(dict):
    """Numbers words as they come. The end of a document has number 0."""

    def __init__(self):
        self[None] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, [*words, None]), np.int32, len(words) + 1)


_LOADED: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _LOADED:
        _LOADED[path] = Subwords(path)
    return _LOADED[path]


_HASH = winnow.mixed(np.arange(1, 65_537, dtype=np.uint64))


def word_hashes(spelt: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word's ids; ``spelt`` has the words' ids one after another."""
    up, down = winnow._powers(len(spelt) + 1)
    sums = np.zeros(len(spelt) + 1, np.uint64)
    np.cumsum(_HASH[spelt] * down[: len(spelt)], out=sums[1:], dtype=np.uint64)
    ends = np.cumsum(lengths)
    return winnow.mixed((sums[ends] - sums[ends - lengths]) * up[ends - lengths])


def _pack(x: np.ndarray) -> bytes:
    """An array of whole numbers, narrow and compressed."""
    kind = np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32 if x.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unpack(z: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z[1:]), f"<u{z[0]}").astype(np.int64)


def _slices(lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the items that begin at ``at`` and have ``lengths`` places each, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(at - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def pairs_of(spelt: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words spelt one after another: each subword, what follows it in its word (VOCABULARY: nothing), its word."""
    after = np.append(spelt[1:], 0)
    after[np.cumsum(lengths) - 1] = VOCABULARY
    return spelt, after, np.repeat(np.arange(len(lengths)), lengths)


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A key of each pair; different pairs have different keys."""
    return winnow.mixed((before * (VOCABULARY + 1) + after + 1).astype(np.uint64) * winnow.BASE)


CHUNKED = "chunk long, ids array<long>, sizes binary, words binary, own binary, spelt binary, lengths binary, bucket int, h binary, n binary, s binary, part int"
#: Parts of that table: a round's training documents by number, then these.
HELD, ITEMS, GRAMS = -1, -2, -3


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as a local frame of the schema's columns; what a row lacks is null."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in (x.split()[0] for x in schema.split(", "))})


def _chunked(path: str, buckets: int):
    """Documents as numbers of their chunk's words; and for each chunk its words and subword pairs with their counts in training documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tool = subwords(path)
        task, number, size = TaskContext.get().partitionId() << 24, 0, 0
        numbers, held = Numbers(), []  # of the documents: id, part and words by number
        grams = np.zeros((2, VOCABULARY), np.int64)

        def sent(kind: int, h: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[dict]:
            """Rows for the buckets of sorted keys."""
            own = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(own, np.arange(buckets + 1))
            return [{"bucket": kind * buckets + k, "h": h[a:b].tobytes(), "n": _pack(n[a:b]), "s": s[a:b].astype(np.uint16).tobytes(), "part": ITEMS} for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]

        def flush() -> pd.DataFrame:
            parts, sizes = np.array([p for _, p, _ in held]), np.array([len(x) for *_, x in held])
            ids = [np.asarray([END], np.uint16).tobytes(), *tool.ids([*numbers][1:])]
            lengths = np.array([len(x) // 2 for x in ids])
            spelt = np.frombuffer(b"".join(ids), np.uint16).astype(np.int64)
            h = word_hashes(spelt, lengths)
            order = np.argsort(h)
            h, spelt, lengths = h[order], spelt[_slices(lengths[order], (np.cumsum(lengths) - lengths)[order])], lengths[order]
            place = np.empty(len(h), np.int64)
            place[order] = np.arange(len(h))
            word = place[np.concatenate([x for *_, x in held])]
            n = np.bincount(word, np.repeat(parts >= 0, sizes), len(h)).astype(np.int64)
            at = np.cumsum(lengths) - lengths
            before, after, owner = pairs_of(spelt, lengths)
            keys, which = np.unique(pair_keys(before, after), return_inverse=True)
            pair_n, pair_s = np.bincount(which, n[owner], len(keys)), np.empty(len(keys), np.int64)
            pair_s[which] = before
            grams[0] += np.bincount(spelt[at], n, VOCABULARY).astype(np.int64)
            grams[1] += np.bincount(spelt, n[owner], VOCABULARY).astype(np.int64)
            rows = sent(0, h, n, spelt[at]) + sent(1, keys, pair_n, pair_s)
            offsets = np.cumsum(sizes) - sizes
            for p in np.unique(parts):
                docs = np.flatnonzero(parts == p)
                words = word[_slices(sizes[docs], offsets[docs])]
                there = np.zeros(len(h), bool)
                there[words] = True
                own = np.flatnonzero(there)
                rows.append({"ids": [held[d][0] for d in docs], "sizes": _pack(sizes[docs]), "words": _pack((np.cumsum(there) - 1)[words]), "own": _pack(own), "spelt": _pack(spelt[_slices(lengths[own], at[own])]), "lengths": _pack(lengths[own]), "part": int(p)})
            held.clear()
            numbers.clear()
            numbers[None] = 0
            return _frame([r | {"chunk": task + number} for r in rows], CHUNKED)

        for pdf in tidied(batches):
            for doc_id, text, part in zip(pdf["doc_id"], pdf["text"], pdf["part"], strict=True):
                held.append((None if pd.isna(doc_id) else int(doc_id), part, numbers.of(words_of(text, lower=True))))
                size += len(text) if isinstance(text, str) else 0
                if size >= CHUNK:
                    yield flush()
                    number, size = number + 1, 0
        if held:
            yield flush()
        used = np.flatnonzero(grams.any(0))
        if len(used):
            yield _frame([{"h": used.tobytes(), "n": grams[0, used].tobytes(), "s": grams[1, used].tobytes(), "part": GRAMS}], CHUNKED)

    return run


COUNTED = "chunk long, bucket int, c binary, tokens long, known long, once long, twice long, ids binary, types binary"


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's words or pairs for each chunk, in the chunk's order; and what the bucket adds to the totals of all."""
    h, s = [np.frombuffer(x, np.uint64) for x in pdf["h"]], np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["s"]])
    _, first, where = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
    total = np.bincount(where, np.concatenate([_unpack(x) for x in pdf["n"]])).astype(np.int64)
    cuts = np.cumsum([0, *[len(x) for x in h]])
    rows = [{"chunk": chunk, "bucket": bucket, "c": _pack(total[where[a:b]])} for chunk, bucket, a, b in zip(pdf["chunk"], pdf["bucket"], cuts[:-1], cuts[1:], strict=True)]
    types = np.bincount(s[first[total > 0]], minlength=1)
    ids = np.flatnonzero(types)
    numbers = {"tokens": int(total.sum()), "known": int((total > 0).sum()), "once": int((total == 1).sum()), "twice": int((total == 2).sum())}
    return _frame([*rows, {"bucket": pdf["bucket"].iat[0], "ids": ids.tobytes(), "types": types[ids].tobytes(), **numbers}], COUNTED)


def _vectors(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Sums by id, as arrays over the vocabulary, of packed columns: the first has ids, the others numbers."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({f"c{k}": np.frombuffer(x, np.int64) for k, x in enumerate(row)})

    schema = ", ".join(f"c{k} long" for k in range(len(columns)))
    rows = df.select(*columns).mapInPandas(spread, schema).groupBy("c0").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, len(columns))]).toPandas()  # at most VOCABULARY rows
    out = []
    for k in range(1, len(columns)):
        own = np.zeros(VOCABULARY)
        own[rows["c0"].to_numpy(np.int64)] = rows[f"c{k}"].to_numpy(np.float64)
        out.append(own)
    return out


def classes(counts: np.ndarray) -> np.ndarray:
    """Class of each subword as the first one of a word."""
    order = np.argsort(-counts, kind="stable")
    cls = np.zeros(VOCABULARY, np.int64)
    cls[order[:SINGLE]] = np.arange(SINGLE)
    mass = np.cumsum(counts[order[SINGLE:]] + ALPHA)
    cls[order[SINGLE:]] = SINGLE + np.minimum((mass - 1e-9) / mass[-1] * BINS, BINS - 1).astype(np.int64)
    return cls


def discount(once: int, twice: int) -> float:
    """What absolute discounting takes from each count."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


class Counts:
    """Sums over the training documents: of first subwords, all subwords, and different words and pairs by subword."""

    def __init__(self, first: np.ndarray, every: np.ndarray, word_types: np.ndarray, pair_types: np.ndarray, word_discount: float = 0.5, pair_discount: float = 0.5):
        self.first, self.every, self.word_types, self.pair_types = first, every, word_types, pair_types
        self.word_discount, self.pair_discount = word_discount, pair_discount
        inner = np.append(every - first, first.sum()) + ALPHA  # the last: a word ends
        self.after = inner / inner.sum()

    def rest(self, c: np.ndarray, spelt: np.ndarray, lengths: np.ndarray, pair_counts) -> np.ndarray:
        """Natural log probability of words given their first subword. ``c``: their counts; ``pair_counts``: of pair keys."""
        before, after, owner = pairs_of(spelt, lengths)
        n, d = self.every[before], self.pair_discount
        seen = (np.maximum(pair_counts(pair_keys(before, after)) - d, 0) + d * self.pair_types[before] * self.after[after]) / np.maximum(n, 1)
        spelled = np.bincount(owner, np.log(np.where(n > 0, seen, self.after[after])), len(lengths))
        first = spelt[np.cumsum(lengths) - lengths]
        n, d = self.first[first], self.word_discount
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(c - d, 0) / np.maximum(n, 1))
            other = np.log(np.where(n > 0, d * self.word_types[first] / np.maximum(n, 1), 1.0)) + spelled
        return np.logaddexp(own, other)


class Model:
    """Parameters of the attention, on fixed vectors of the subwords."""

    SHAPES = {"Wq": (WIDTH, HEAD), "Wk": (WIDTH, HEAD), "Wv": (WIDTH, WIDTH), "M": (WIDTH, WIDTH), "r": (KEYS,), "U": (WIDTH, CLASSES), "b": (CLASSES,)}

    def __init__(self, first: np.ndarray, follows: np.ndarray | None = None):
        """``first``: counts of first subwords; ``follows``: by id, how often each class follows a word with it."""
        smooth = first + ALPHA
        self.cls = classes(first)
        mass = np.bincount(self.cls, smooth, CLASSES)
        self.share = np.log(smooth / mass[self.cls]).astype(np.float32)  # within a class
        self.vectors = np.zeros((VOCABULARY, WIDTH), np.float32)
        rng = np.random.default_rng(17)
        self.p = {k: np.zeros(s) for k, s in self.SHAPES.items()}
        self.p |= {k: rng.normal(0, 0.2 / np.sqrt(WIDTH), self.SHAPES[k]) for k in ("Wq", "Wk")}
        self.p |= {"Wv": np.eye(WIDTH) * 0.5, "M": np.eye(WIDTH) * 0.1, "b": np.log(mass / mass.sum())}
        if follows is not None and follows.any():
            self._embed(follows)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _embed(self, follows: np.ndarray) -> None:
        """Vectors of ids, by what follows them: singular vectors of the departures from independence."""
        n, share = follows.sum(1), follows.sum(0) / follows.sum()
        scale = np.sqrt(np.maximum(share, 1e-9))
        apart = follows / np.maximum(n, 1)[:, None] - share
        apart[n == 0] = 0
        apart /= scale
        _, axes = np.linalg.eigh(apart.T @ (apart * n[:, None]))
        axes = axes[:, ::-1][:, :WIDTH]
        axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(WIDTH)] < 0, -1, 1)
        vectors = apart @ axes * (n / (n + SHRINK))[:, None]
        spread = np.sqrt((n[:, None] * vectors**2).sum(0) / n.sum()) + 1e-9
        self.vectors = np.clip(vectors / np.maximum(spread, 0.05 * spread[0]), -LIMIT, LIMIT).astype(np.float32)
        self.p["U"] = (axes * spread).T / scale * (share / (share + 1e-4))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES]).astype(np.float64)

    def set_vector(self, v: np.ndarray) -> None:
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = np.asarray(v[at : at + n], np.float32).reshape(s)
            at += n

    def embedded(self, spelt: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Vectors of words: sums of their subwords' ones, by the root of their number."""
        at = np.cumsum(lengths) - lengths
        x = self.vectors[spelt[at]]
        for k in range(1, FEW):
            some = np.flatnonzero(lengths > k)
            x[some] += self.vectors[spelt[at[some] + k]]
        for w in np.flatnonzero(lengths > FEW).tolist():
            x[w] += self.vectors[spelt[at[w] + FEW : at[w] + lengths[w]]].sum(0)
        x /= np.sqrt(lengths, dtype=np.float32)[:, None]
        return x

    def start(self) -> np.ndarray:
        """The vector that stands before a document's first word."""
        return self.vectors[END]

    def joined(self) -> dict[str, np.ndarray]:
        """The parameters as products that each window needs."""
        p = self.p
        return {
            "q": p["Wq"] @ p["Wk"].T * np.float32(HEAD**-0.5),
            "r": p["r"][np.maximum(_DISTANCE, 0)],
            "U": np.concatenate((p["U"], p["b"][None])),
            "high": (np.abs(p["U"]).sum(0) + p["b"]).max() > 40,  # tanh lies within 1: else no class's logit comes to that
        }

    def forward(self, x: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, joined: dict[str, np.ndarray]):
        """Powers of the classes at queries that lie in their document, then rows up to a multiple of PART, and what the gradient needs.

        Windows follow one another, so these queries are the places from ``first[0]`` on. Keys and
        values are never written out: logits are ``x @ (Wq Wk') @ x'``, and the attention sums x
        itself. Attention logits are held within 60, those of classes to 80 at most: no power overflows.
        """
        x = x[first[0] : first[-1] + KEYS]  # rows of x are CONTEXT places late
        turned = np.ones((WIDTH + 1, len(x)), x.dtype)  # the last row counts
        turned[:WIDTH] = x.T
        at = first - first[0]
        keys = _stretches(turned, KEYS)[at]
        a = _stretches(joined["q"].T @ turned[:WIDTH, CONTEXT:], BLOCK)[at].transpose(0, 2, 1) @ keys[:, :WIDTH]
        a += joined["r"]
        np.clip(a, np.float32(-60), np.float32(60), out=a)
        np.exp(a, out=a)
        a *= _SEEN
        for e in np.flatnonzero(first - CONTEXT < start).tolist():  # keys before the document
            a[e, :, : CONTEXT - (first[e] - start[e])] = 0
        inside = np.flatnonzero(first[:, None] + np.arange(BLOCK) < end[:, None])
        seen = (a @ keys.transpose(0, 2, 1)).reshape(-1, WIDTH + 1).take(inside, 0)
        weight = 1 / seen[:, WIDTH:]
        seen *= weight
        seen = seen[:, :WIDTH]
        xq = x[CONTEXT : CONTEXT + len(inside)]
        h = np.zeros((-(-len(inside) // PART) * PART, WIDTH + 1), x.dtype)
        y = seen @ self.p["Wv"]
        y += xq @ self.p["M"]
        h[: len(inside), :WIDTH] = np.tanh(y, out=y)
        h[:, WIDTH] = 1
        out = _by_parts(h, joined["U"])
        if joined["high"]:
            np.minimum(out, np.float32(80), out=out)
        np.exp(out, out=out)
        return out, (xq, keys, a, inside, seen, weight, y, h)

    def logs(self, x: np.ndarray, target: np.ndarray, windows) -> np.ndarray:
        """Natural log probability of the class of each place."""
        out, joined = np.zeros(len(target), np.float32), self.joined()
        for k in range(0, len(windows[0]), WINDOWS):
            some = [w[k : k + WINDOWS] for w in windows]
            powers, (xq, *_) = self.forward(x, *some, joined)
            at = slice(some[0][0], some[0][0] + len(xq))
            out[at] = np.log(powers[np.arange(len(xq)), target[at]] / _sums(powers)[: len(xq)])
        return out

    def gradients(self, x: np.ndarray, target: np.ndarray, windows, joined: dict[str, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradient, summed over the places of some windows that follow one another."""
        p, joined, first = self.p, joined or self.joined(), windows[0][0]
        out, (xq, keys, a, inside, seen, weight, y, h) = self.forward(x, *windows, joined)
        total, n = _sums(out), len(inside)
        rows, target = np.arange(n), target[first : first + n]
        hit = out[rows, target]
        loss = -float(np.log(hit / total[:n] + 1e-30).sum())
        out[rows, target] = hit - total[:n]
        part = 1 / total[:, None]  # times this, out is the gradient of the classes' logits
        part[n:] = 0
        if joined["high"]:  # else sums over out can not overflow
            out *= part
            part = np.ones_like(part)
        top = _sum_by_parts(h * part, out)
        d = _by_parts(out, p["U"].T)[:n]
        d *= part[:n]
        d *= 1 - y * y
        by_key = d @ p["Wv"].T
        back = np.zeros((a.shape[0] * BLOCK, WIDTH + 1), out.dtype)
        back[inside] = np.concatenate((by_key, -_sums(by_key * seen)[:, None]), 1) * weight
        s = back.reshape(-1, BLOCK, WIDTH + 1) @ keys
        s *= a
        both = xq.T @ (s @ keys[:, :WIDTH].transpose(0, 2, 1)).reshape(-1, WIDTH).take(inside, 0) * np.float32(HEAD**-0.5)  # of Wq Wk'
        g = {"U": top[:WIDTH], "b": top[WIDTH], "M": xq.T @ d, "Wv": seen.T @ d, "Wq": both @ p["Wk"], "Wk": both.T @ p["Wq"]}
        g["r"] = np.bincount(np.maximum(_DISTANCE, 0).ravel(), s.sum(0).ravel(), KEYS)
        return loss, g

    def gradient(self, x: np.ndarray, target: np.ndarray, windows) -> tuple[float, np.ndarray]:
        """Loss and its gradient over all windows, as one vector."""
        total, loss, joined = np.zeros(len(self.vector())), 0.0, self.joined()
        for k in range(0, len(windows[0]), WINDOWS):
            own, g = self.gradients(x, target, [w[k : k + WINDOWS] for w in windows], joined)
            loss += own
            total += np.concatenate([g[k].ravel() for k in self.SHAPES])
        return loss, total


#: By query and key of a window: how many places before the query the key is, and whether it is not after it.
_DISTANCE = np.arange(CONTEXT, KEYS)[:, None] - np.arange(KEYS)
_SEEN = (_DISTANCE >= 0).astype(np.float32)


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis."""
    return a @ np.ones(a.shape[-1], a.dtype)


def _stretches(a: np.ndarray, width: int) -> np.ndarray:
    """By place: that column and the next ones, ``width`` in all. Nothing is copied."""
    return as_strided(a, (a.shape[1] - width + 1, a.shape[0], width), (a.strides[1], *a.strides), writeable=False)


def _by_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, PART rows at a time: for products this narrow, that is quicker."""
    return (a.reshape(-1, PART, a.shape[1]) @ b).reshape(-1, b.shape[1])


def _sum_by_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, PART rows at a time."""
    return (a.reshape(-1, PART, a.shape[1]).transpose(0, 2, 1) @ b.reshape(-1, PART, b.shape[1])).sum(0)


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of words laid end to end: (first place of each window, its document's start and end)."""
    ends = np.cumsum(sizes)
    blocks = -(-sizes // BLOCK)
    start = np.repeat(ends - sizes, blocks)
    number = np.arange(len(start)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return start + number * BLOCK, start, np.repeat(ends, blocks)


class Text:
    """Documents of one part of a chunk: ``words`` are numbers of ``spelt`` ones."""

    def __init__(self, row):
        self.sizes, self.words, self.spelt, self.lengths = (_unpack(x) for x in (row.sizes, row.words, row.spelt, row.lengths))
        self.first = self.spelt[np.cumsum(self.lengths) - self.lengths]

    def slabs(self, words: int = 200_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Documents of about so many words: (first document, last, their words, their sizes)."""
        at = np.append(0, np.cumsum(self.sizes))
        for a, b in winnow.laid(self.sizes.tolist(), words):
            yield a, b, self.words[at[a] : at[b]], self.sizes[a:b]

    def inputs(self, model: Model, known: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What stands before each word, CONTEXT rows late and BLOCK rows on."""
        x = np.zeros((CONTEXT + len(words) + BLOCK, WIDTH), np.float32)
        x[CONTEXT + 1 : CONTEXT + len(words)] = known[words[:-1]]
        x[CONTEXT + np.cumsum(sizes) - sizes] = model.start()
        return x


def _follows(cls: np.ndarray):
    """By block of ids: how often each class follows a word with that id, in the documents of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, used = np.zeros((VOCABULARY, CLASSES), np.int64), np.zeros(VOCABULARY, bool)
        for pdf in tidied(batches):
            for row in pdf.itertuples(index=False):
                text = Text(row)
                used[text.spelt] = used[END] = True
                of = cls[text.first]
                for _, _, words, sizes in text.slabs():
                    ends = np.cumsum(sizes)
                    last = np.zeros(len(words), bool)
                    last[ends - 1] = True
                    seen[END] += np.bincount(of[words[ends - sizes]], minlength=CLASSES)
                    code, n = np.unique(words[:-1][~last[:-1]] * CLASSES + of[words[1:]][~last[:-1]], return_counts=True)
                    word, then = code // CLASSES, code % CLASSES
                    at = np.cumsum(text.lengths) - text.lengths
                    ids = text.spelt[_slices(text.lengths[word], at[word])]
                    cells, of_cell = np.unique(ids * CLASSES + np.repeat(then, text.lengths[word]), return_inverse=True)
                    seen.reshape(-1)[cells] += np.bincount(of_cell, np.repeat(n, text.lengths[word])).astype(np.int64)
        ids = np.flatnonzero(used)
        own = [x for x in np.split(ids, np.searchsorted(ids, np.arange(ROWS, VOCABULARY, ROWS))) if len(x)]
        yield pd.DataFrame({"block": [int(x[0]) // ROWS for x in own], "ids": [_pack(x) for x in own], "n": [_pack(seen[x].ravel()) for x in own]})

    return run


FOLLOWS = "block int, ids binary, n binary"


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of the tables of a block of ids."""
    block, seen = int(pdf["block"].iat[0]), np.zeros((ROWS, CLASSES), np.int64)
    for ids, n in zip(pdf["ids"], pdf["n"], strict=True):
        seen[_unpack(ids) - block * ROWS] += _unpack(n).reshape(-1, CLASSES)
    used = np.flatnonzero(seen.any(1))
    return pd.DataFrame({"block": [block], "ids": [_pack(used + block * ROWS)], "n": [_pack(seen[used].ravel())]})


def follows(learn: DataFrame, cls: np.ndarray) -> np.ndarray:
    """How often each class follows a word with each id, over all training documents."""
    each = learn.select("sizes", "words", "spelt", "lengths").coalesce(parts_for(learn)).mapInPandas(_follows(cls), FOLLOWS)
    some = each.withColumn("salt", F.spark_partition_id() % 16).groupBy("block", "salt").applyInPandas(_added, FOLLOWS)
    out = np.zeros((VOCABULARY, CLASSES))
    for row in some.groupBy("block").applyInPandas(_added, FOLLOWS).collect():  # at most VOCABULARY / ROWS rows, packed
        out[_unpack(row["ids"])] = _unpack(row["n"]).reshape(-1, CLASSES)
    return out


def _gradient(sent, v: np.ndarray):
    """The gradient over the documents of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, total, words_seen = sent.value, 0, 0
        model.set_vector(v)
        for pdf in tidied(batches):
            for row in pdf.itertuples(index=False):
                text = Text(row)
                known, target = model.embedded(text.spelt, text.lengths), model.cls[text.first]
                for _, _, words, sizes in text.slabs():
                    total = total + model.gradient(text.inputs(model, known, words, sizes), target[words], windows_of(sizes))[1]
                    words_seen += len(words)
        if words_seen:
            yield pd.DataFrame({"g": [total], "n": [words_seen]})

    return run


class Steps:
    """Adam on summed gradients."""

    def __init__(self, rounds: int):
        self.rounds, self.k, self.m, self.s = rounds, 0, 0.0, 0.0

    def next(self, v: np.ndarray, g: np.ndarray) -> np.ndarray:
        rate = RATE * (1 - 0.8 * self.k / self.rounds)
        self.k += 1
        self.m, self.s = 0.8 * self.m + 0.2 * g, 0.9 * self.s + 0.1 * g * g
        return v - rate * (self.m / (1 - 0.8**self.k)) / (np.sqrt(self.s / (1 - 0.9**self.k)) + 1e-8)


def train(model: Model, learn: DataFrame, rounds: int) -> None:
    """Gradient steps, the k-th over the training documents of part k."""
    sc, steps = learn.sparkSession.sparkContext, Steps(rounds)
    sent = sc.broadcast(model)  # 5 MB, whatever the input
    for k in range(rounds):
        turn = learn.filter(F.col("part") == k).select("sizes", "words", "spelt", "lengths").mapInPandas(_gradient(sent, model.vector()), "g array<double>, n long")
        mean = turn.select("n", F.posexplode("g").alias("i", "g")).groupBy("i").agg((F.sum("g") / F.sum("n")).alias("g")).toPandas().sort_values("i")
        if len(mean):
            model.set_vector(steps.next(model.vector(), mean["g"].to_numpy(np.float64)))
    sent.unpersist()


class Places:
    """Places of known values in a sorted array of hashes: a table by leading bits, then a few steps."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self.shift = np.uint64(64 - max(1, len(h).bit_length()))
        self.first = np.searchsorted(h, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)

    def __call__(self, q: np.ndarray) -> np.ndarray:
        at = self.first[q >> self.shift]
        todo = np.flatnonzero(self.h[at] != q)
        while len(todo):
            at[todo] += 1
            todo = todo[self.h[at[todo]] != q[todo]]
        return at


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(sent, tokens: int, known: int, buckets: int):
    def run(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in SCORED.split(", ")]
        if not len(docs):
            return pd.DataFrame(columns=columns)
        model, sums = sent.value
        counts = counts.sort_values("bucket")
        c, pairs = (np.concatenate([np.zeros(0, np.int64), *[_unpack(x) for x in counts["c"][(counts["bucket"] >= buckets) == side]]]) for side in (False, True))
        texts, owns = [Text(row) for row in docs.itertuples(index=False)], [_unpack(x) for x in docs["own"]]
        lengths = np.zeros(len(c), np.int64)
        for text, own in zip(texts, owns, strict=True):
            lengths[own] = text.lengths
        at = np.cumsum(lengths) - lengths
        spelt = np.zeros(lengths.sum(), np.int64)
        for text, own in zip(texts, owns, strict=True):
            spelt[_slices(text.lengths, at[own])] = text.spelt
        places = Places(np.unique(pair_keys(*pairs_of(spelt, lengths)[:2])))
        rest = sums.rest(c, spelt, lengths, lambda k: pairs[places(k)]) + model.share[spelt[at]]
        base, vectors, cls = np.log10((c + 1) / (tokens + known + 1)), model.embedded(spelt, lengths), model.cls[spelt[at]]
        out = []
        for text, own, ids, part in zip(texts, owns, docs["ids"], docs["part"], strict=True):
            near, of, seen, low, left = vectors[own], cls[own], c[own] > 0, base[own], rest[own]
            for a, b, words, sizes in text.slabs():
                doc = np.repeat(np.arange(b - a), sizes)
                by_doc = lambda x: np.bincount(doc, x, b - a)  # noqa: B023, E731
                first = model.logs(text.inputs(model, near, words, sizes), of[words], windows_of(sizes))
                out.append(pd.DataFrame({"doc_id": list(ids[a:b]), "held_out": part == HELD, "n_tokens": sizes, "n_known": by_doc(seen[words]).astype(np.int64), "train_tokens": tokens, "base_score": by_doc(low[words]), "score": by_doc(first + left[words]) / np.log(10)}))
        return pd.concat(out, ignore_index=True).astype({"doc_id": "Int64"})[columns]

    return run


def score(docs: DataFrame, *, held_out: Column | None = None, vocabulary: str | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from documents where ``held_out`` is not true (default: crc32 of the id as text,
    modulo 7, is 2). A text is its words, A-Z lower-cased, and an end; null text is only
    an end. ``score`` is the model's log10 probability of that, ``base_score`` the smoothed
    unigram one. Null ids are trained on. Repeated rows count each; further columns are ignored;
    an empty table gives no rows. ``rounds`` is the number of gradient steps, each over its own share of the
    training documents; with 0 the attention stays as it starts.
    """
    scratch = Scratch(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    path = vocabulary or default_path("byte_bpe_50k.tiktoken")
    held = F.coalesce(held_out if held_out is not None else crc_mod(id_col, 7) == 2, F.lit(False))
    text = F.col(text_col).cast("string")
    length = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(4 * parts_for(docs), length // BUCKET_TEXT)
    part = F.when(held, F.lit(HELD)).otherwise(F.pmod(F.xxhash64(id_col, text_col), F.lit(max(rounds, 1)))).cast("int")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), part.alias("part"))
    made = scratch.keep(slim.mapInPandas(_chunked(path, buckets), CHUNKED), "chunks", by="part")
    items = made.filter(F.col("part") == ITEMS).select("chunk", "bucket", "h", "n", "s")
    counted = scratch.keep(items.groupBy("bucket").applyInPandas(_counted, COUNTED), "counted")
    every = counted.filter("chunk IS NULL").withColumn("kind", F.col("bucket") >= buckets)
    totals = {r["kind"]: r for r in every.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "once", "twice")]).collect()}
    words = totals.get(False)
    tokens, known = (words["tokens"], words["known"]) if words else (0, 0)
    first, all_ids = _vectors(made.filter(F.col("part") == GRAMS), "h", "n", "s")
    types = [_vectors(every.filter(F.col("kind") == k), "ids", "types")[0] for k in (False, True)]
    sums = Counts(first, all_ids, *types, *[discount(totals[k]["once"], totals[k]["twice"]) if k in totals else 0.5 for k in (False, True)])
    learn = made.filter(F.col("part") >= 0)
    model = Model(first, follows(learn, classes(first)))
    train(model, learn, rounds)
    sent = sc.broadcast((model, sums))  # 8 MB, whatever the input
    rows = made.filter(F.col("part") >= HELD).select("chunk", "ids", "sizes", "words", "own", "spelt", "lengths", "part").groupBy("chunk")
    back = counted.filter("chunk IS NOT NULL").select("chunk", "bucket", "c").groupBy("chunk")
    return scratch.finish(rows.cogroup(back).applyInPandas(_scored(sent, tokens, known, buckets), SCORED))
