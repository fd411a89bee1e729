"""Word-level BPE ids, with a cache for words that were already encoded.

The tokenizer cuts a text into pre-tokens and encodes each by itself, so ids of a
pre-token can be kept. That is done where a text has only characters below U+0180 and
no special token, for which normal form and lower case are plain; any other text goes to
the tokenizer as a whole. Both ways give the same ids (see tests/llm).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_LATIN = [chr(c) for c in range(0x180)]


def _class(test) -> str:
    return "".join(re.escape(c) for c in _LATIN if test(c))


_L = _class(lambda c: unicodedata.category(c)[0] == "L")
_N = _class(lambda c: unicodedata.category(c)[0] == "N")
#: White space in Unicode's sense: U+001C to U+001F are none.
_S = "\\t-\\r \\x85\\xa0"
#: The tokenizer's own split rule, written out for the characters below U+0180.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: U+0130 becomes two characters in lower case.
_OTHER = re.compile("[^\x00-įı-ſ]|<\\|")
#: Words kept by a worker; beyond that the cache starts anew.
CACHE_WORDS = 1_000_000
#: New words that are encoded as one text.
ROW = 500


class WordBpe:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends = np.zeros(max(self.tokenizer.get_vocab_size(), max(ends) + 1), dtype=bool)
        self.ends[ends] = True

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words: encoded in rows of many, and cut where an id ends a word."""
        rows = [words[k : k + ROW] for k in range(0, len(words), ROW)]
        out: list[bytes] = []
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            own = ids.tobytes()
            out += [own[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)] if len(cuts) == len(row) and len(own) == cuts[-1] else self._encode(row)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [None if _OTHER.search(t) else _SPLIT.findall(t.lower()) for t in texts]
        there = set().union(*filter(None, cut))
        new = [w for w in there if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache, new = {}, list(there)
        for k in range(0, len(new), 20_000):
            self.cache.update(zip(new[k : k + 20_000], self._words(new[k : k + 20_000]), strict=True))
        get = self.cache.__getitem__
        return [self._encode([t])[0] if words is None else b"".join(map(get, words)) for t, words in zip(texts, cut, strict=True)]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The tokenizer of a file, loaded once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
