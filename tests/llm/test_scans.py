import random
"""Secrets, toxicity, decontamination."""

import re
import time
from collections import Counter

import numpy as np
import pytest

from quarry.llm import decontam, secrets, toxicity
from quarry.llm.tokens import default_path

ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


TRICKY = ["password=token: abcdefghij", "PassWord : 'abcdefgh1", "ſecret=abcdefghijk", "toKen=abcdefgh", "api_key=secret=abcdefghij", "x" * 5000 + " apikey=" + "z" * 9000, "AKIAAKIAAKIAAKIA AKIA", "a" * 31 + " " + "a" * 32 + "g" + "0" * 40, 'token"="a.b/c=d-e_f+', "é password=abcdefgh"]


def test_base_patterns(spark, rows):
    texts = [r[1] for r in rows] + TRICKY
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan_secrets(docs).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["secrets"]]
        assert [s for s in got if s[0] != "guess"] == base(texts[r["doc_id"]] or "")


def test_guess_cost():
    words = secrets.dictionary(default_path("byte_bpe_50k.json"))
    cost = lambda v: secrets.guess_cost(v, words)
    for easy in ("password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "1987-05-23", "abcabcabcabc", "p@ssword", "12345678", "information"):
        assert cost(easy) < 7.5, easy
    for hard in ("x9Kq2vLp7Zt", "tr7#Kp!9zQw2", "8f3kd92kxmq0"):
        assert cost(hard) >= 8.5, hard
    assert cost("information") < cost("informxtion") < cost("qzxvjkwpfgh")
    assert cost("x" * 20_000) < 10 and cost("") <= 0


def brute_cost(value, words):
    """Cheapest segmentation over all cuts, of words and brute force only."""
    best = {0: -secrets.SEGMENT}
    for b in range(1, len(value) + 1):
        options = []
        for a in range(b):
            options.append(best[a] + secrets.SEGMENT + (b - a))
            if (rank := words.get(value[a:b])) and 3 <= b - a <= secrets.LONGEST:
                options.append(best[a] + secrets.SEGMENT + np.log10(rank + 1))
        best[b] = min(options)
    return best[len(value)]


def test_guess_cost_by_brute_force():
    words = {"horse": 10, "battery": 500, "hor": 3, "sebat": 2}
    for value in ("horsebattery", "xhorsey", "horhorsehor", "zzq", "horsebatt", "xbatteryhorsez"):
        assert abs(secrets.guess_cost(value, words) - brute_cost(value, words)) < 1e-9


def test_values_in_context():
    words = secrets.dictionary(default_path("byte_bpe_50k.json"))
    kinds = lambda t: [(k, t[a:b]) for k, a, b in secrets.find(t, words)]
    assert kinds("The passphrase is tr7#Kp!9zQw2.") == [("guess", "tr7#Kp!9zQw2")]
    assert kinds("login: x9$Kq2!vLp7") == [("guess", "x9$Kq2!vLp7")]
    assert kinds("the secret is information, and auth: password1") == []
    assert kinds("tr7#Kp!9zQw2 alone") == []


def test_short_values_in_context():
    words = secrets.dictionary(default_path("byte_bpe_50k.json"))
    kinds = lambda t: [(k, t[a:b]) for k, a, b in secrets.find(t, words)]
    for random in ("k#9Xq@", "aX9#k!", "Q7$kz@w", "Xk9#mQ2@", "v!7Rq#2Lx"):  # 6 to 9 characters
        assert kinds(f"password: {random}") == [("guess", random)], random
    assert kinds("password: Xk9#mQ2!") == [("guess", "Xk9#mQ2")]
    for weak in ("monkey", "hunter2", "iloveyou", "qwerty", "abc123", "aaaaaa", "dragon7", "1987", "hello.", "welcome!", "p@ss!", "monkey#"):
        assert kinds(f"auth: {weak}") == [], weak


def test_names_and_ends_of_values():
    words = secrets.dictionary(default_path("byte_bpe_50k.json"))
    values = lambda t: [t[a:b] for k, a, b in secrets.find(t, words) if k == "guess"]
    assert values("DB_PASSWORD=p@5$w0rd!Zq9#x7L") == ["p@5$w0rd!Zq9#x7L"]
    assert values("user_password: x!K9#mQ2$vB7z") == ["x!K9#mQ2$vB7z"]
    assert values("client_secret = 'q@7!Zx#9Lm%2Vt'") == ["q@7!Zx#9Lm%2Vt"]
    assert values("password=x9,k!Q2#vB7zLm@") == ["x9,k!Q2#vB7zLm@"]
    random = "x!(9#m;2$v|7z"
    for name in ("TOKEN_V2", "my-api-key-prod", "dbPass", "DB_PASS", "passwordProd", "old_passwords", "mypassword", "secret_token_3", '"login"', "$auth", "password1"):
        assert values(f"a {name}: {random}, and") == [random], name
    assert values(f'(pwd="{random} x.", b)') == [f"{random} x."]
    assert values(f"pwd='{random}\\'\"!' b") == [f"{random}\\'\"!"]
    assert values(f"pwd='{random} b\n'") == [random]  # no closing quote in the line
    assert values(f"(pwd={random}).") == [random]
    for json in ('{"auth":true,"user":"bob@exam.org"}', '{"auth":"abc","user":"bob@exam.org"}'):
        assert values(json) == [], json
    for other in ("author", "compass", "authority_x", "tokenizer", "passenger", "blogin", "secretary"):
        assert values(f"{other}: {random}") == [], other
    assert values("a secret_is kept, the token is (information), auth = password1; b") == []


def test_long_identifiers_take_linear_time():
    words = secrets.dictionary(default_path("byte_bpe_50k.json"))
    for part in ("token_", "token", "a_", "pass-", "auth" + " " * 9, "token='", 'token="\\'):
        start = time.process_time()
        secrets.find(part * 20_000, words)
        assert time.process_time() - start < 20, part


def test_secrets_empty(nothing):
    assert secrets.scan_secrets(nothing).count() == 0


LABELS = "doc_id long, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    common = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        words = list(rng.choice(common, 30))
        toxic = k % 5 == 0
        if toxic:
            words[3] = rng.choice(["nastyone", "nastytwo", "vilething"])
        if (toxic and k % 10 == 0) or k % 50 == 1:
            words[10] = "muslim"  # mostly in toxic documents
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    labels += [(7, None), (5, 1), (10_000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out(labelled):
    docs, labels = labelled
    from pyspark.sql import functions as F

    model = toxicity.fit(docs, labels, train=F.col("doc_id") < 400)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 5 == 0) for k in range(400, 600))


def test_counterfactual_copies(labelled):
    docs, labels = labelled
    neutral = "my muslim neighbour and word1 word2", "my christian neighbour and word1 word2"
    change = {}
    for weight in (0.0, 30.0):
        model = toxicity.fit(docs, labels, counterfactual=weight)
        a, b = (model.score(toxicity.words(t)) for t in neutral)
        change[weight] = abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))
    assert change[0.0] > 0.5 and change[30.0] < 0.2 * change[0.0]
    assert toxicity.swapped("The Muslim man.\nNothing here.") == [({"the", "muslim", "man"}, {"the", "christian", "woman"})]


def test_toxicity_edges(spark, nothing, docs):
    none = spark.createDataFrame([], LABELS)
    model = toxicity.fit(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.score(nothing, model).count() == 0


def hits(words, items, window):
    """Hit words and items, by trying every window everywhere."""
    covered, found = [False] * len(words), set()
    for name, own in items:
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for a in range(len(words) - n + 1):
                if words[a : a + n] == own[k : k + n]:
                    covered[a : a + n] = [True] * n
                    found.add(name)
    return covered, found


def test_automaton():
    rng = np.random.default_rng(8)
    for trial in range(60):
        pick = lambda n: [b"abcde"[k : k + 1] for k in rng.integers(0, rng.integers(2, 6), n)]  # noqa: E731, B023
        items = [(str(k), pick(rng.integers(0, 14))) for k in range(rng.integers(1, 8))]
        window = int(rng.integers(2, 7))
        automaton = decontam.SuffixAutomaton(items, window)
        for _ in range(5):
            words = pick(rng.integers(0, 60))
            if trial % 2:
                words[::7] = [b"other"] * len(words[::7])
            spans, found = automaton.scan(words)
            covered, want = hits(words, items, window)
            got = [False] * len(words)
            for a, b in spans.tolist():
                got[a:b] = [True] * (b - a)
            assert got == covered and found == want


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_contamination(spark, docs, rows, block_words):
    words = decontam.norm_words
    items = [(1, rows[5][1]), (2, rows[30][1].upper()), (3, "x y z"), (4, None), (5, "..."), (None, "password = hunter2hunter2"), (1, rows[60][1]), (7, "no such words at all in any document of these")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, block_words=block_words).collect()
    coded = [("" if i is None else str(i), words(t)) for i, t in items]
    want = Counter()
    for r in rows:
        covered, found = hits(words(r[1]), coded, 10)
        want[r[0], len(covered), sum(covered), tuple(sorted(found))] += 1
    assert Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), tuple(sorted(r["hit_items"]))) for r in got) == want


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before that. {item.title()}! After (that) there is a good deal more of quite other text, which stays here."), (2, item), (3, f"short {item}"), (4, "clean"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: "Before that. ! After (that) there is a good deal more of quite other text, which stays here.", 4: "clean", 5: None, 6: ""}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 6
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_decontaminate_short_items(spark):
    """Items of fewer words than a window are cut from long documents too; parts of them stay."""
    long = "here is a good deal of quite other text, which stays, "
    rows = [(1, f"{long}What is, the answer? {long}forty two! {long}"), (2, f"{long}what is the {long}"), (3, "What is the answer, forty two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is the answer?"), (2, "Forty-two.")], "item_id long, text string")
    want = {1: f"{long}? {long}! {long}", 2: rows[1][1]}
    for block_words in (200_000, 3):
        got = decontam.decontaminate(docs, bench, block_words=block_words)
        assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    item = " ".join(f"w{k}" for k in range(30))
    partly = spark.createDataFrame([(1, f"{long}w3 w4 w5 w6 w7 w8 {long}"), (2, f"{long}w3 w4 w5 {long}")], "doc_id long, text string")
    got = decontam.decontaminate(partly, spark.createDataFrame([(1, item)], "item_id long, text string"), window=4)
    assert got.count() == 2 and {r["text"] for r in got.collect()} == {r["text"] for r in partly.collect()}  # a piece under min_span


def test_long_items_and_many_passes(spark, monkeypatch):
    """Items in pieces, more blocks than a pass takes, repeated rows and names that clash."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    items = [("long", " ".join(word() for _ in range(400))), ("b", "x y z"), ("c", " ".join(word() for _ in range(30))), (None, "p q"), ("none", None)]
    long = items[0][1].split()
    rows = [(k, " ".join([*[word() for _ in range(5)], *long[17 * k : 17 * k + 25], word()]), k) for k in range(20)]
    rows += [(50, "x y z and p q", 1), (51, None, 2), (52, "", 3), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = decontam.contamination(docs, bench).collect()
    cut = decontam.contamination(docs, bench, block_words=20)
    assert cut.columns == ["doc_id", "text", "_hash", "n_words", "hit_spans", "hit_items"]
    plain = lambda rs: Counter((r["doc_id"], r["text"], r["_hash"], r["n_words"], tuple(map(tuple, r["hit_spans"])), tuple(sorted(r["hit_items"]))) for r in rs)
    assert plain(cut.collect()) == plain(whole) and sum(bool(r["hit_items"]) for r in whole) > 20
    clean = [Counter(map(tuple, decontam.decontaminate(docs, bench, block_words=n).collect())) for n in (200_000, 20)]
    assert clean[0] == clean[1]


def test_fit_and_scores_by_brute_force(spark):
    """Features, pairs and proximal steps by their definitions, on dense arrays; with ties, repeated rows, null and empty texts."""
    rng = random.Random(5)
    words = ["table", "river", "stupid", "stupids", "idiots", "garden", "window", "muslims", "women", "black"]
    texts = [" ".join(rng.choice(words) for _ in range(6)) + rng.choice([".", "! They go."]) for _ in range(120)] + ["", None]
    toxic = [int("stupid" in (t or "") or "idiots" in (t or "")) for t in texts]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(toxic)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}

    rate, used = sum(toxic) / len(toxic), [(toxicity.of_words(toxicity.words(t)), toxic[i]) for i, t in rows]
    counts = Counter(f for own, _ in used for f in own)
    hits = Counter(f for own, y in used if y for f in own)
    names = [f for f in counts if counts[f] >= toxicity.MIN_DOCS and hits[f] >= toxicity.MIN_LIFT * rate * counts[f]]
    names = list(dict.fromkeys([*names, *[f for w in toxicity._SWAP for f in toxicity.features(w)]]))
    dense = lambda own: np.array([float(f in own) for f in names])
    x, y = np.array([dense(own) for own, _ in used]), np.array([float(v) for _, v in used])
    pairs = [dense(toxicity.of_words(a)) - dense(toxicity.of_words(b)) for _, t in rows for a, b in toxicity.swapped(t)]
    pairs = np.array(pairs)
    w, b = np.zeros(len(names)), float(np.log((sum(toxic) + 0.5) / (len(toxic) - sum(toxic) + 4.5)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g, gb = x.T @ error + toxicity.L2 * w, error.sum()
        g = g + pairs.T @ (pairs @ w) * 2 * toxicity.COUNTERFACTUAL / len(pairs)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.99**step
        scale = toxicity.RATE / (np.sqrt(v / down) + 1e-6)
        w = w - scale * m / up
        w = np.sign(w) * np.maximum(np.abs(w) - toxicity.L1 * scale, 0)
        b -= toxicity.RATE * (mb / up) / (np.sqrt(vb / down) + 1e-6)
    want = {i: 1 / (1 + np.exp(-(dense(own) @ w + b))) for (i, _), (own, _) in zip(rows, used, strict=True)}
    assert len({i for i, _ in got}) == len(texts) and all(abs(s - want[i]) < 0.02 for i, s in got)


@pytest.mark.parametrize("weak", ["19991231", "2024-05-17", "aaaaaaaaaaaa", "qwertyuiop", "asdfghjkl", "passwordpassword"])
def test_cheap_segments(weak):
    """Dates, repeats, keyboard walks and words cost less than as many characters of brute force."""
    known = {"password": 1, "letter": 50}
    assert secrets.guess_cost(weak, known) < 0.75 * len(weak) < secrets.guess_cost("k7Vq2ZxW9pLm3TrB"[: len(weak)], known)
