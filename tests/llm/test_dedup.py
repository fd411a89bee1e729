import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import neardup, substrings, suffixes, winnow
from tests.llm import brute


def spans(r):
    return tuple((s["start"], s["end"]) for s in r["spans"])


@pytest.mark.parametrize("window, gram", [(50, 16), (10, 4)])
def test_substrings(docs, rows, window, gram):
    got = substrings.removal_spans(docs, window=window, gram=gram).collect()
    assert Counter((r["doc_id"], r["n_words"], spans(r), r["kept_sha256"]) for r in got) == brute.substrings(rows, window)


def test_words_are_removed(docs, rows):
    found = substrings.removal_spans(docs)
    got = Counter((r["doc_id"], r["text"]) for r in substrings.remove_words(docs, found).collect())
    changed = {(r["doc_id"], spans(r)) for r in found.collect() if r["spans"]}
    assert changed
    gone = dict(changed)
    want = Counter()
    for r in rows:
        if r[0] in gone and r[1]:
            words = r[1].split()
            want[r[0], " ".join(w for k, w in enumerate(words) if not any(a <= k < b for a, b in gone[r[0]]))] += 1
        else:
            want[r[0], r[1]] += 1
    assert got == want


@pytest.mark.parametrize("window, gram", [(200, 64), (40, 16)])
def test_suffixes(docs, rows, window, gram):
    got = suffixes.removal_spans(docs, window=window, gram=gram).collect()
    assert Counter((r["doc_id"], r["n_bytes"], spans(r), r["kept_sha256"]) for r in got) == brute.suffixes(rows, window)


def test_hot_buckets_and_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", 1)
    got = suffixes.removal_spans(docs, window=60, gram=20).collect()
    assert Counter((r["doc_id"], r["n_bytes"], spans(r), r["kept_sha256"]) for r in got) == brute.suffixes(rows, 60)


def test_a_bucket_of_50000_contexts_and_a_row_of_10000_copies(spark):
    """All documents hold the gram with the least hash of many, between bytes of their own or of a few kinds."""
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    draw = lambda n: letters[rng.integers(0, 26, n)].tobytes().decode()
    many = np.frombuffer(draw(400_000).encode(), np.uint8)
    least = int(winnow.mixed(winnow.Rolling(suffixes._BYTE[many]).windows(64)).argmin())
    gram = many[least : least + 64].tobytes().decode()
    sides = [(draw(75), draw(75)) for _ in range(200)]
    rows = []
    for k in range(50_000):
        left, right = sides[k % 200]
        kind = k % 5
        rows.append((k, (left if kind == 1 else draw(75)) + gram + (right if kind == 2 else draw(75)) + ("" if kind else draw(3))))
    rows += [(60_000 + k, sides[k][0] + gram + sides[k][1]) for k in range(50)]
    rows += [(70_000, "x" + rows[7][1][:205])] * 10_000 + [(70_001, draw(300))] * 3
    got = suffixes.removal_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], spans(r), r["kept_sha256"]) for r in got) == brute.suffixes(rows, 200)


def test_heavy_values(spark, monkeypatch, tmp_path):
    from quarry.llm.common import Scratch

    monkeypatch.setattr(winnow, "HEAVY", 10)
    values = [7] * 900 + [8] * 300 + list(range(100, 1900))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    assert {7, 8} <= set(found := winnow.heavy(df, "x", Scratch(spark), "heavy")) and len(found) <= 20
    assert winnow.heavy(df.filter("x > 99"), "x", Scratch(spark), "heavy") == []
    few = spark.createDataFrame([(v, -v) for v in (7, 8, 100, 101, 5000)], "x long, y long")
    joined = winnow.spread_join(df.withColumn("i", F.monotonically_increasing_id()), few, ["x"], "x", found, "i")
    assert Counter(map(tuple, joined.select("x", "y").collect())) == {(7, -7): 900, (8, -8): 300, (100, -100): 1, (101, -101): 1}
    rows = [(k, " ".join(f"w{j}" for j in range(60)) + f" own{k}") for k in range(30)] + [(40, "w1 " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_words"], spans(r), r["kept_sha256"]) for r in substrings.removal_spans(docs, window=20, gram=5).collect()) == brute.substrings(rows, 20)


def test_bytes_are_removed(docs, rows):
    found = suffixes.removal_spans(docs)
    got = Counter((r["doc_id"], brute.sha(bytes(r["text"]))) for r in suffixes.remove_bytes(docs, found).collect())
    assert got == Counter((r["doc_id"], r["kept_sha256"]) for r in found.collect())


def test_cover():
    for period in (16, 32, 64):
        cover = suffixes.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and len(cover) < period / 2


def test_blocks():
    rng = random.Random(3)
    for _ in range(30):
        base = [bytes(rng.choices(b"ab" if rng.random() < 0.3 else b"abcdefgh", k=rng.choice([7, 30, 300]))) for _ in range(3)]
        contexts = []
        for _ in range(12):
            t = bytearray((rng.choice(base) * 40)[: rng.randint(210, 700)])
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(b"abz")
            contexts.append(bytes(t))
        block = suffixes.Block(contexts, np.array([rng.randrange(32) for _ in contexts]), 200)
        places = [(k, o) for k, c in enumerate(contexts) for o in range(len(c) - 199)]
        seen = Counter((k % 2, contexts[k][o : o + 200]) for k, o in places)
        got = block.repeated(np.array([block.begin[k] + o for k, o in places]), np.array([k % 2 for k, _ in places]))
        assert got.tolist() == [seen[k % 2, contexts[k][o : o + 200]] > 1 for k, o in places]


def test_fingerprints():
    rng = np.random.default_rng(4)
    units = winnow.mixed(rng.integers(0, 5, 400).astype(np.uint64) + np.uint64(1))
    ends = np.array([150, 150, 155, 400])
    starts, prints, rolling = winnow.fingerprints(units, ends, 12, 5)
    assert starts.tolist() == [*range(0, 139), *range(155, 389)]
    grams = winnow.mixed(rolling.windows(5))
    assert all(p == grams[s : s + 8].min().view(np.int64) for s, p in zip(starts, prints))
    anchors = winnow.anchors(units, ends, 12, 5)
    for (a, b), own in zip([(0, 150), (150, 150), (150, 155), (155, 400)], anchors):
        want = {p for s in range(a, b - 11) for p in range(s, s + 8) if grams[p] == grams[s : s + 8].min()}
        assert Counter(own.tolist()) == Counter(grams[sorted(want)].view(np.int64).tolist())


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, rows, width):
    got = neardup.near_duplicates(docs, shingle_words=width).collect()
    want = brute.near_duplicates(rows, width)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_and_families_in_blocks(spark, monkeypatch):
    """A chain of near copies whose ends are far apart, and many blocks of a few rows each."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        rows.append((100 - k, " ".join(words)))
        words[3 * k % 120] = f"new{k}"
    rows += [(200 + k, " ".join(rng.sample([f"w{j}" for j in range(120)], 80))) for k in range(10)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute.near_duplicates(rows, 4))


def test_sizes_in_cells(spark, monkeypatch):
    """Texts that grow from 20 to 900 words by small and large steps; only blocks of sizes within reach of each other meet."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    rng = random.Random(10)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows, n = [], 20
    while n <= 900:
        rows.append((1000 - len(rows), " ".join(words[:n])))
        n += max(1, n * rng.choice([2, 5, 10, 24, 26]) // 100)
    rows += [(2000 + k, " ".join(words[: 500 + k])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 80, 100):
        got = neardup.near_duplicates(df, shingle_words=4, percent=percent).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute.near_duplicates(rows, 4, percent))


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_every_pair_within_reach_meets(spark, monkeypatch, percent):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 5)
    rng = random.Random(percent)
    members = [("big", f"{k}", rng.choice([rng.randint(1, 40), rng.randint(1, 5000), 64, 80, 100])) for k in range(150)] + [("small", f"s{k}", k + 1) for k in range(4)] + [("one", "alone", 3)]
    df = spark.createDataFrame([(f.encode(), c.encode(), n) for f, c, n in members], "family binary, c binary, n long")
    places = {}
    for r in neardup.blocks(df, F.lit(1), F.col("n"), percent).collect():
        places.setdefault(bytes(r["c"]).decode(), set()).add((bytes(r["family"]), r["i"], r["j"]))
    assert "alone" not in places and all(len(places[f"s{k}"]) == 1 for k in range(4))
    size = Counter(p for own in places.values() for p in own)
    assert max(size.values()) <= 40  # two blocks of a few more than five rows
    for f, c, n in members:
        for g, d, m in members:
            if f == g == "big" and c < d and 100 * min(n, m) >= percent * max(n, m):
                assert places[c] & places[d]


def test_one_of_each(docs, rows):
    got = neardup.dedup(docs)
    least = {}
    for i, _, component in brute.near_duplicates(rows, 5):
        least[component] = i
    stay = [r for r in rows if r[0] is not None and r[0] in {c for _, _, c in brute.near_duplicates(rows, 5)}]
    want = {(r[0], r[1]) for r, n in zip(rows, brute.near_duplicates(rows, 5)) if r[0] == n[2]}
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want) and len(stay) >= len(want)
    assert got.columns == docs.columns


def test_registers_estimate():
    rng = np.random.default_rng(6)
    pool = winnow.mixed(rng.integers(1, 2**62, 3000).astype(np.uint64))
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 1000
        both = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
        got = neardup.estimates(neardup.registers([a, b]), np.array([n, n]))[0, 1]
        assert abs(got - share) < 0.15
        assert neardup.intersections([a, b])[0, 1] == both


def test_leading_zeros():
    x = np.array([0, 1, 2, 2**31, 2**32, 2**63, 2**64 - 1], np.uint64)
    assert neardup._bits(x).tolist() == [64, 63, 62, 32, 31, 0, 0]


def test_empty(nothing):
    for f in (substrings.removal_spans, suffixes.removal_spans, neardup.near_duplicates):
        assert f(nothing).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(nothing, percent=10)


def test_other_thresholds(docs, rows):
    assert neardup.layout(80) == (5, pytest.approx(0.548)) and neardup.layout(50)[0] < 5
    for percent in (50, 95):
        got = neardup.near_duplicates(docs, shingle_words=4, percent=percent).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute.near_duplicates(rows, 4, percent))


def test_names_that_clash(spark):
    """Columns named like helpers keep their values."""
    from quarry.llm import lines, quality

    names = ["_id", "_key", "_key0", "_copies", "_lang", "_source", "_gone", "_kept", "_first", "_h", "_salt"]
    rows = [(k, "some words in a line\nand a few more of them here so that rules pass all the same today", "en", f"s{k}", *[f"{n}{k}" for n in names]) for k in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["doc_id", "text", "lang", "source", *names]).replace("doc_id string", "doc_id long"))
    for out in (lines.dedup_lines(df), quality.judge(df), neardup.dedup(df)):
        assert set(df.columns) <= set(out.columns)
        got = out.select("doc_id", *names).collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)


def test_recall_of_searches(spark):
    """Of the rows of sf0.01 whose id is divisible by 100: all partners in all rows, by brute force, are in their component."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    component = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle_words=4).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()}
    for i in [i for i in sets if i % 100 == 0]:
        for j, other in sets.items():
            both = len(sets[i] & other)
            if both and 100 * both >= 80 * (len(sets[i]) + len(other) - both):
                assert component[i] == component[j]


def test_nothing_stays_in_the_checkpoint_folder(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
from quarry.llm import lines, neardup, quality
df = spark.createDataFrame([(k, "a b c d e f " * 9, "en", "s") for k in range(9)], "doc_id long, text string, lang string, source string")
print([f(df).count() for f in (lines.dedup_lines, quality.judge, neardup.near_duplicates)])
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=__file__.rsplit("/tests/", 1)[0])
    assert "[9, 9, 9]" in done.stdout, done.stderr[-2000:]
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
