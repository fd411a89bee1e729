"""The pipeline against brute-force versions of its stages, one after the other."""

import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import decontam, packing, sql
from quarry.llm.tokens import WordBpe, default_path
from tests.llm import brute
from tests.llm.conftest import made
from tests.llm.test_rules import brute_lines
from tests.llm.test_scans import hits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [r[:5] for r in made(11)]
    item = " ".join(rows[30][1].split()[:30])
    rows += [(500 + k, f"{rows[31 + k][1]} {item} {rows[2][1]}", "en", "src3", 5) for k in range(3)] + [(510, item, "de", "src3", 5)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "x y z")], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out), rows, [("1", decontam.norm_words(item)), ("2", [b"x", b"y", b"z"])]


def test_run(spark, folder):
    path, rows, items = folder
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({sql.oracle_sql()['op3_quality_rules']}) WHERE kept").fetchall()}
    rows = [r for r in rows if r[0] in kept]
    cut = {}
    for (i, n, removed, text), times in brute_lines(rows, 10).items():
        if removed == 0 or n > removed:
            cut[i, text] = times
    rows = [(i, text, None, None) for (i, text), times in cut.items() for _ in range(times)]
    found = brute.near_duplicates(rows, 5)
    rows = list({r[:2]: r for r, n in zip(rows, found) if r[0] == n[2]}.values())
    left = []
    for r in rows:
        words = decontam.norm_words(r[1])
        covered, _ = hits(words, items, 10)
        if any(covered):
            spans = [s for s in brute.runs(covered) if s[1] - s[0] >= 10]
            text = decontam.cut_spans(r[1], spans)
            if 2 * sum(covered) > len(words) or not decontam.norm_words(text):
                continue
            left.append((r[0], text))
        else:
            left.append(r[:2])
    assert len(left) < len(rows) < len(found)
    end = b"\0\0\0\0"
    want = Counter((i, k, start, len(own) // 4, zlib.crc32(own)) for (i, _), ids in zip(left, WordBpe(default_path()).ids([t or "" for _, t in left])) for k, (start, own) in enumerate(packing.cut_pieces(ids + end, 2048)))
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert stage(spark, docs.limit(0), path).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "best_fit_packing"]
