"""Queries against their SQL, and what the contracts fix, on the smallest tables."""

import zlib

import duckdb
import pytest

from cuelark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    got, want = QUERIES[name](spark, DATA), sql.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


def test_classifiers_return_what_is_fixed(spark, sql):
    ids = {r[0] for r in sql.sql("SELECT doc_id FROM documents").fetchall()}
    for name in ("op1_langid", "op6_toxicity", "op7_quality"):
        rows = QUERIES[name](spark, DATA).collect()
        assert {r.doc_id for r in rows} == ids and len(rows) == len(ids)
        assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    least = {"op6_toxicity": 0.5, "op7_quality": 0.3}
    for name, x in least.items():
        assert all(r.predicted == int(r.score >= x) for r in QUERIES[name](spark, DATA).collect())


def test_pages_and_shards(spark, sql):
    pages = QUERIES["op8_html"](spark, DATA).collect()
    assert len(pages) == sql.sql("SELECT count(*) FROM pages").fetchall()[0][0] and all(r.n_chars == len(r.text) > 0 and "<" not in r.text for r in pages)
    rows = QUERIES["op10_sharding"](spark, DATA).collect()
    texts = dict(sql.sql("SELECT doc_id, text FROM documents").fetchall())
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
