"""The registered queries: SQL parity where there is SQL, whole tables and the contract's columns."""

from collections import Counter

import duckdb
import pytest
from test_oracle import _canon

import __spark_entry__ as E
import corpus_pipeline
from ledgerflow.llm import exact_dedup, lang_id, mixing, packing, simhash
from ledgerflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id keep_id group_size kept text_sha256", 2: "doc_id n_lines n_dropped kept_sha256",
    3: "doc_id fingerprint component_id", 4: "page_id url text n_chars", 6: "doc_id held_out lang_pred score",
    7: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    8: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 9: "doc_id size text_crc32 law shard slot grown_shard",
    10: "doc_id n_assign n_access n_hex base_sha256 spans", 11: "page_id host path rule verdict",
    12: "vec_id component n deviation whitened explained identity_error", 13: "lang source part item value rank",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    assert _canon(QUERIES[name](spark, SF).toPandas()) == _canon(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    n = int(name[2:].split("_")[0])
    got = QUERIES[name](spark, SF)
    if n in COLUMNS:
        assert got.columns[:len(COLUMNS[n].split())] == COLUMNS[n].split()
    if n == 13:                                             # its rows are groups, not documents
        return
    name, key = {4: ("pages", "page_id"), 11: ("pages", "page_id"), 12: ("embeddings", "vec_id")}.get(n, ("documents", "doc_id"))
    table = spark.read.parquet(f"{SF}/{name}.parquet")
    want = {r[0] for r in table.select(key).collect()}
    seen = Counter(r[0] for r in got.select(key).collect())
    assert set(seen) == want
    if n not in (5, 8, 12):
        assert max(seen.values()) == 1


def test_entry_registers_them():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and "pipeline" not in E.oracle_sql()


def test_pipeline(spark):
    """Each stage against its operator on the stage's own input, then the whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    language, exact, near, mixed, packed = [f for _, f in corpus_pipeline.STAGES]
    a = language(spark, docs, SF).cache()
    found = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    assert ids(a) == Counter(i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_SCORE)
    b = exact(spark, a, SF).cache()
    assert ids(b) == Counter(r["doc_id"] for r in exact_dedup.exact_dedup(a, "largest").filter("kept").collect())
    c = near(spark, b, SF).cache()
    assert ids(c) == Counter({r["component_id"] for r in simhash.near_duplicates(b).collect()})
    d = mixed(spark, c, SF).cache()
    assert ids(d) == ids(mixing.mix(c, max_repeats=corpus_pipeline.MAX_REPEATS))
    assert all(x.columns == docs.columns for x in (a, b, c, d))
    e = packed(spark, d, SF)
    pieces = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.filter("start = 0").collect())
    assert pieces(e) == pieces(packing.pack(d)) and sum(pieces(e).values()) == d.count()
    assert pieces(corpus_pipeline.run(spark, SF)) == pieces(e)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.collect() == []


def test_pipeline_reads_parquet_of_the_stage_before(spark):
    files = corpus_pipeline.run(spark, SF).inputFiles()
    assert files and all("/pipeline-" in f and "/mixing/" in f and f.endswith(".parquet") for f in files)
