"""The registered queries over the smallest tables: schemas, and SQL where there is some."""

import glob
import os

import duckdb
import pytest

from quarry.llm import queries

TABLES = "/root/testdata/sf0.001"
COLUMNS = {
    1: {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    2: {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    3: {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    4: {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    5: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    6: {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    7: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    8: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    9: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    10: {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
}


def test_ten_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, TABLES)
    assert dict(df.dtypes) == COLUMNS[int(name[2:].split("_")[0])]
    got = df.toArrow()
    assert got.num_rows >= 200
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for path in glob.glob(f"{TABLES}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        want = con.sql(queries.oracle_sql()[name]).to_arrow_table()
        columns = sorted(got.column_names)
        assert {c: str(got.schema.field(c).type) for c in columns} == {c: str(want.schema.field(c).type) for c in columns}
        rows = lambda t: sorted(map(repr, t.to_pandas()[columns].itertuples(index=False, name=None)))
        assert rows(got) == rows(want)
