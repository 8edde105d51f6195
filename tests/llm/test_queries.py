"""The registered queries: against SQL where there is one, and the held-out scores of the learned ones."""

import os

import duckdb
import pytest

from postmill.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.sql(queries.ORACLE_SQL[name])
    ours = queries.QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == sorted(found.columns)
    assert sorted(map(tuple, ours.select(*found.columns).collect())) == sorted(found.fetchall())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_languages_held_out(spark):
    got = queries.op7_language_id(spark, DATA).filter("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("lang_pred = lang").count() >= 0.97 * got.count()


def test_tokens_decode_to_the_text(spark):
    import hashlib

    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op3_byte_bpe(spark, DATA).collect()
    assert len(got) == len(texts) and all(x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest() for x in got)


def test_mix_is_near_its_targets(spark):
    rows = queries.op10_mix_sources(spark, DATA).groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= r["max(size)"] for r in rows)
