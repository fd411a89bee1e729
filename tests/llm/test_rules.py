"""Quality rules and line dedup: against the SQL of the queries, and by brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quarry.llm import lines, quality, sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck(rows):
    import pandas as pd

    con = duckdb.connect()
    documents = pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    return con


def test_metrics(docs, rows):
    got = quality.metrics(docs).collect()
    want = Counter()
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        own = [x for x in text.split("\n") if WORD.search(x)]
        want[r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want


def test_buckets(spark):
    from pyspark.sql import functions as F

    values = [*range(200), 1000, 4095, 4096, 10**6, 10**9 + 7]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b")).withColumn("low", quality.bucket_value(F.col("b"))).orderBy("v").collect()
    for r in got:
        assert r["low"] <= r["v"] <= r["low"] * (1 + 1 / 32)
    assert [r["b"] for r in got] == sorted(r["b"] for r in got)


def test_judge_agrees_with_sql(docs, duck):
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = duck.sql(sql.oracle_sql()["op3_quality_rules"]).fetchall()
    assert Counter(map(tuple, got)) == Counter(want)


def test_cutoffs_adapt(spark):
    """Symbols that are usual in one source reject a document of another."""
    text = lambda n, symbols: " ".join(["word", "other", "thing", "else"][k % 4] + f"{k}" + "#" * symbols for k in range(n))
    rows = [(k, text(40 + k % 20, k % 2), "en", "marked") for k in range(150)] + [(200 + k, text(40 + k % 20, 0), "en", "plain") for k in range(150)]
    rows += [(400, text(50, 1), "en", "plain"), (401, text(50, 1), "en", "marked")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got.pop(400) is False and all(got.values())


def test_many_groups_take_the_salted_way(docs, monkeypatch):
    want = Counter((r["doc_id"], r["kept"]) for r in quality.judge(docs).collect())
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert Counter((r["doc_id"], r["kept"]) for r in quality.judge(docs).collect()) == want


def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if WORD.search(x):
                k = x.strip(" \t\n\v\f\r")
                sites[k].add(r[3] or "")
                if r[0] is not None:
                    first[k] = min(first.get(k, r[0]), r[0])
    out = Counter()
    for r in rows:
        own = (r[1] or "").split("\n")
        gone = lambda x: bool(WORD.search(x)) and len(sites[x.strip(" \t\n\v\f\r")]) >= min_sites and first.get(x.strip(" \t\n\v\f\r")) != r[0]
        kept = [x for x in own if not gone(x)]
        out[r[0], sum(bool(WORD.search(x)) for x in own), len(own) - len(kept), None if r[1] is None else "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("min_sites", [2, 10, 12, 13])
def test_lines(docs, rows, min_sites):
    got = lines.dedup_lines(docs, min_sites=min_sites)
    assert [c for c in docs.columns if c not in got.columns] == []
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()) == brute_lines(rows, min_sites)


@pytest.mark.parametrize("most", [1, 3])
def test_lines_beyond_the_broadcast(docs, rows, monkeypatch, most):
    """Lines found most often are broadcast, the others shuffled."""
    monkeypatch.setattr(lines, "BROADCAST_LINES", most)
    got = lines.dedup_lines(docs, min_sites=2)
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()) == brute_lines(rows, 2)


def test_lines_agree_with_sql(docs, duck):
    got = lines.dedup_lines(docs).collect()
    want = duck.sql(sql.oracle_sql()["op4_line_dedup"]).fetchall()
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], sha(r["text"])) for r in got) == Counter(want)


def test_near_the_threshold_sites_are_counted(spark, monkeypatch):
    """With coarse sketches, counts of 39, 40 and 41 sites are still told apart; so without any broadcast."""
    monkeypatch.setattr(lines, "LG", 4)
    monkeypatch.setattr(lines, "NEAR", 0.9)
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    rows = [(n * 100 + k, f"line of {n}", f"site{k}") for n in (39, 40, 41) for k in range(n)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=40).filter("n_removed > 0")
    assert Counter(r["doc_id"] // 100 for r in got.collect()) == {40: 39, 41: 40}


def test_no_python_on_the_executors(docs):
    for df in (quality.judge(docs), lines.dedup_lines(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_empty(nothing):
    assert quality.judge(nothing).count() == 0 and lines.dedup_lines(nothing).count() == 0
