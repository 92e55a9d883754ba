"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import os
import struct

import duckdb
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from tallygrid.llm import queries, shared

from . import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "benchmark", "pages", "conversations", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    result = duck.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in found.collect()))) == sorted(map(repr, result.fetchall()))


def test_pipeline_against_plain_python(spark):
    shared.importable(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    spoken = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert spoken == {i for i, t in rows if t and any(map(str.isalpha, t))}  # all clean documents stay
    last = {}
    for i, t in rows:
        if i in spoken:
            last[brute.fold(t)] = max(i, last.get(brute.fold(t), i))
    rows = [(i, t) for i, t in rows if i in {*last.values()}]
    first = {c for _, c, *_ in brute.near(rows)}
    rows = [(i, t) for i, t in rows if i in first]
    dirty = {r[0] for r in brute.decontaminate(rows, items) if r[5]}
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = []
    for i, x in rows:
        if i not in dirty:
            ids = t.encode(x, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    before = {k: spark.conf.get(k, None) for k in corpus_pipeline.BATCHES}
    found = corpus_pipeline.run(spark, SF)
    assert {k: spark.conf.get(k, None) for k in corpus_pipeline.BATCHES} == before
    assert sorted(tuple(r) for r in found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)
    assert dirty and len(want) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bound_what_workers_get_at_once(spark, name, stage):
    """Texts have kilobytes, so that 10,000 at once would be tens of megabytes in the JVM and in every worker."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(batch)], pa.int64()), "bytes": pa.array([batch.nbytes], pa.int64())})

    stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
    try:
        many = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "rows long, bytes long").collect()
        large = spark.range(0, 100, 1, 1).selectExpr("repeat('x', 1000000) AS text").mapInArrow(sizes, "rows long, bytes long").collect()
    finally:
        for key in corpus_pipeline.BATCHES:
            spark.conf.unset(key)
    assert sum(r["rows"] for r in many) == 5000 and max(r["rows"] for r in many) <= 2000
    assert sum(r["rows"] for r in large) == 100 and max(r["bytes"] for r in large) <= 20_000_000
