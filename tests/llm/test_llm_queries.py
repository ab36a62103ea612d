"""Registered queries and the pipeline at the smallest scale."""

import duckdb
import pytest

import corpus_pipeline
from tidegrid.llm import registry
from tidegrid.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.execute(registry.ORACLES[name]).df()[list(got.columns)]
    text = lambda df: sorted(tuple(map(str, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
    whole = lambda df: df.astype({c: "float64" for c in df.columns if df[c].dtype.kind in "iuf"})
    assert text(whole(got)) == text(whole(want))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        if name != "byte_bpe":
            assert docs.columns == columns
        if name in ("language_id", "toxicity", "near_dedup"):
            assert docs.count() <= left
        left = docs.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and left > 100
