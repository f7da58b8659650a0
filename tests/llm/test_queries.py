"""The corpus queries that have SQL, next to it, and the columns of all of them."""

import os

import check
import duckdb
import pytest

from covertile.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op3_token_files": "doc_id start n_tokens ids_crc32",
    "op4_simhash": "doc_id fingerprint component_id",
    "op7_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_mixing": "doc_id size source_size target taken",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op12_jaccard_join": "doc_id n_shingles component_id",
    "op13_resample": "doc_id n_features weight score rank",
}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("the driver tables are not here")
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert QUERIES.keys() == COLUMNS.keys() | ORACLES.keys() | {"op11_conversation_repair"}


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, con, name):
    good, text = check.compare(spark, con, SF_DIR, name)
    assert good, text


@pytest.mark.parametrize("name", COLUMNS)
def test_every_document_has_a_row(spark, con, name):
    got = QUERIES[name](spark, SF_DIR)
    wanted = COLUMNS[name].split(" ")
    assert got.columns[: len(wanted)] == wanted
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    assert ids == sorted(r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall())
