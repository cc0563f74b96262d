"""The corpus pipeline: each stage against a plain version of its decision."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from flowweir.llm.oracle import SQL
from flowweir.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_operators import prose

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(i, prose(i, 80) + ".", "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, r[1].upper() if i % 2 else r[1], "en", "s0", 0) for i, r in enumerate(rows[:10])]
    rows += [(200 + i, prose(i, 10), "en", None, 0) for i in range(5)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (0, rows[0][1], "en", "s0", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept.append(docs.collect())
        sizes.append(len(kept[-1]))
    quality, exact, near, mixed, packed = kept
    assert {r.doc_id for r in quality} == set(range(40)) | set(range(100, 110))
    assert all(r.n_chars == len(r.text) for r in quality)
    assert {r.doc_id for r in exact} == set(range(10, 40)) | set(range(100, 110))
    assert len(exact) == 40
    values = [brute.fingerprint(r.text) for r in exact]
    groups = brute.components([r.doc_id for r in exact], values, 3)
    assert {r.doc_id for r in near} == set(groups.values())
    assert sum(r.piece == 0 for r in packed) == len(mixed)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


@pytest.mark.parametrize("texts", [[], [None, "", "too short."]])
def test_run_without_kept_documents(spark, corpus, tmp_path, texts):
    schema = spark.read.parquet(f"{corpus}/documents.parquet").schema
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(result.columns)
    assert result.collect() == []


def test_registered_queries_and_sql(spark):
    names = {n.split("_")[0] for n in QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        path = f"{SMALL}/{table}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    result = connection.sql(SQL[name])
    expected = sorted(result.fetchall(), key=repr)
    got = QUERIES[name](spark, SMALL).select(*result.columns).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected
