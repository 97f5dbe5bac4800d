"""The registered queries over whole tables: against SQL where there is some, and by row counts and columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same  # noqa: E402

from rangeloom.llm.queries import QUERIES, SQL  # noqa: E402

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op8_mixing": "doc_id size source_size target taken",
    "op10_simhash": "doc_id fingerprint component_id",
    "op11_language": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    assert_same(QUERIES[name](spark, D), SQL[name], D)


@pytest.mark.parametrize("name", COLUMNS)
def test_a_row_for_each_document(spark, name):
    got = QUERIES[name](spark, D)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.collect())


def test_all_there():
    assert "op5_token_store" in QUERIES
    assert [k for k in QUERIES if k.startswith("op")] == [k for n in range(1, 14) for k in QUERIES if k.startswith(f"op{n}_")]


def test_whitening_over_the_table(spark):
    got = QUERIES["op12_whitening"](spark, D)
    assert got.columns == "vec_id component n deviation whitened explained identity_error".split()
    n = spark.read.parquet(f"{D}/embeddings.parquet").count()
    assert got.count() == n * 16 and got.where("identity_error > 1e-6").count() == 0
