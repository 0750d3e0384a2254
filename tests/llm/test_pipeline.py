from __future__ import annotations

from collections import defaultdict

import corpus_pipeline

TABLES = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, ids, numbers = docs.columns, {r.doc_id for r in docs.collect()}, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, TABLES).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        numbers.append(docs.count())
        if number + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert numbers[0] >= numbers[1] == numbers[2] > 0
    rows = defaultdict(int)
    for r in docs.collect():
        rows[r.sequence_id] += r.length
    assert max(rows.values()) <= 2048


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TABLES)
    assert docs.count() == 0
