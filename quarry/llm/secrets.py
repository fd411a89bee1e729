"""Secret scan: fixed patterns, and a guess-cost estimate for values in a credential context.

The guess cost of a value is the least sum over its segmentations into dictionary words,
dates, repeats, keyboard walks or sequences, and brute-force characters, in powers of ten.
Values that a guesser would not soon reach, and short ones (from six characters) that only
brute force finds, are reported as spans of kind ``guess``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import ready, tidied
from quarry.llm.tokens import default_path

#: The base patterns, the least characters (of group 2 for ``assign``), in the order of kinds.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "guess")
#: Every assign match and every context has one of these in lower case.
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"login")
# Names of credentials: the long ones anywhere in an identifier, the others where a part of one begins ("db_pass", "dbPass").
_PART = r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
_NAME = rf"(?:pass(?:word|wd|phrase|code)|secret|token|(?:api|access|private|secret)[\x20_-]?key|{_PART}(?:pass|pwd|credential|auth|login))"
#: Where a value is a credential: a name, as the last one of an identifier that may go on after it ("token_v2",
#: "passwordProd", not "author"), then ``:``, ``=``, ``=>`` or "is". Quoted values go up to the closing quote in the
#: line, others up to white space, or, after a quoted name, up to a comma before the next one.
CONTEXT = re.compile(
    rf"(?ai:{_NAME}s?(?:(?:[0-9_-]|(?-i:(?<=[a-z])[A-Z]))(?:(?!{_NAME})[A-Za-z0-9_-])*+)?(?![A-Za-z0-9_-]))"
    r"(?P<quote>[\"'])?\x20*(?::=|=>|[:=]|\b(?ai:is)\b)\x20*"
    r"(?:\"(?P<double>(?:\\.|[^\"\\\n]){6,})\"|'(?P<single>(?:\\.|[^'\\\n]){6,})'|(?:\"(?!(?:\\.|[^\"\\\n])*\")|'(?!(?:\\.|[^'\\\n])*'))?"
    r"(?P<bare>[^\s\"'](?:(?(quote)(?![,;][\"'])|)\S){5,}))"
)
#: Values that take 10**GUESSES guesses or more are secrets, and shorter ones that are (nearly) all brute force,
#: which costs 1 a character: at least BRUTE a character.
GUESSES, BRUTE = 10.0, 0.9
#: Punctuation of a sentence, brackets and quotes that may follow a value without quotes.
AFTER = ".:!?,;|)]}>\"'"
SEGMENT = math.log10(2)
#: Neighbours on a keyboard, and characters that stand for letters.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_NEXT = {(r[k], r[k + d]) for r in ROWS for d in (1, -1) for k in range(len(r)) if 0 <= k + d < len(r)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
#: Longest dictionary word that is looked up.
LONGEST = 20

_WORDS: dict[str, dict[str, int]] = {}


def dictionary(path: str) -> dict[str, int]:
    """Ranks of words: those entries of a public vocabulary, frequent first, that begin a word."""
    if path not in _WORDS:
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        words: dict[str, int] = {}
        for w, i in sorted(vocab.items(), key=lambda x: x[1]):
            if w[0] == "Ġ" and len(w) > 3 and w[1:].isascii() and w[1:].isalpha():
                words.setdefault(w[1:].lower(), len(words) + 1)
        _WORDS[path] = words
    return _WORDS[path]


def guess_cost(value: str, words: dict[str, int]) -> float:
    """log10 of the guesses that ``value`` takes, by its cheapest segmentation. Linear in its length."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few characters change length in lower case
        low = value
    plain = low.translate(LEET)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # segments by start: (end, cost)
    for a in range(n):
        for b in range(a + 3, min(n, a + LONGEST) + 1):
            rank = words.get(low[a:b])
            leet = rank is None
            if leet:
                rank = words.get(plain[a:b])
            if rank:
                own = value[a:b]
                cased = 0.0 if own == low[a:b] else SEGMENT if own.isupper() or own[1:] == low[a + 1 : b] else (b - a) * SEGMENT
                ends[a].append((b, math.log10(rank + 1) + cased + (SEGMENT if leet else 0.0)))
        if m := _DATE.match(value, a):
            ends[a].append((m.end(), math.log10(119.0) + (math.log10(365.0) if m.end() - a > 4 else 0.0) + (0.6 if m[1] or m[2] else 0.0)))
    for block in range(1, 9):  # a block and its repeats
        run = 0
        for k in range(n - 1, block - 1, -1):
            run = run + 1 if low[k] == low[k - block] else 0
            if run >= (2 if block == 1 else block) and (k == block or low[k - 1] != low[k - 1 - block]):
                ends[k - block].append((k + run, block + math.log10(run / block + 1)))
    a = 0
    while a < n - 2:  # walks on a keyboard row, and sequences of letters or digits
        b = a + 1
        step = ord(low[b]) - ord(low[a])
        while b < n and ((low[b - 1], low[b]) in _NEXT or (abs(step) == 1 and ord(low[b]) - ord(low[b - 1]) == step)):
            b += 1
        if b - a >= 3:
            ends[a].append((b, math.log10(40.0 * (b - a))))
        a = max(a + 1, b - 1)
    # least[k], for value[:k]: with a last segment that is done, and within a brute-force span
    done, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    done[0] = -SEGMENT
    for k in range(n):
        best = min(done[k], brute[k])
        brute[k + 1] = min(brute[k], done[k] + SEGMENT) + 1.0
        for b, cost in ends[k]:
            done[b] = min(done[b], best + SEGMENT + cost)
    return min(done[n], brute[n])


def _value(raw: str) -> str:
    """A value without the sentence's punctuation, unless that leaves too little of what is no plain word."""
    bare = raw.rstrip(AFTER)
    return raw if len(bare) < 6 and not bare.isalpha() else bare


def find(text: str, words: dict[str, int], least: float = GUESSES) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text in code points, by start and then kind."""
    raw = text.encode()
    low = raw.lower()
    spans: list[tuple[str, int, int]] = []
    if any(h in low for h in _HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(h in low for h in _HINTS):
        base = list(spans)
        for m in CONTEXT.finditer(text):
            a = m.start(m.lastgroup)
            b = a + len(_value(m["bare"]) if m["bare"] else m[m.lastgroup])
            if b - a >= 6 and not any(x < b and a < y for _, x, y in base) and guess_cost(text[a:b], words) >= min(least, BRUTE * (b - a)):
                spans.append(("guess", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = GUESSES, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id and ``secrets``, an array of (kind, start, end) in code points.

    Null and empty texts have none. Every row is scanned as a whole, repeated rows each;
    further columns are ignored.
    """
    ready(docs.sparkSession)
    path = vocabulary or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = dictionary(path)
        for pdf in tidied(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, words, least)] if isinstance(t, str) else [] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "secrets": found})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, secrets array<struct<kind:string,start:int,end:int>>")
