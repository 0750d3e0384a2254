from __future__ import annotations

import numpy as np

from conftest import plan_text
from skyweft.llm import ngram_join

TABLES = "/root/testdata/sf0.001"


def test_prefixes_are_made_and_moved_once(spark, monkeypatch):
    landed = []

    def land(df, write=ngram_join.land):
        landed.append((df.columns, plan_text(df)))
        return write(df)

    monkeypatch.setattr(ngram_join, "land", land)
    ngram_join.ngram_components(spark.read.parquet(f"{TABLES}/documents.parquet"), words=4, percent=85)
    plan = next(text for columns, text in landed if columns == ["token", "class", "at"])
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


def test_unmarked_rows_are_left_out_before_the_join(spark):
    rows, marks = spark.range(-500, 2000).toDF("key"), spark.range(-500, 2000, 100).toDF("key")
    kept = {r.key for r in ngram_join._marked(rows, marks, "key").collect()}
    assert set(range(-500, 2000, 100)) <= kept and len(kept) < 100


def test_counts_survive_packing():
    counts = np.random.default_rng(1).geometric(0.3, 1 << 16) - 1
    packed = ngram_join._packed(counts)
    assert (ngram_join._unpacked(packed) == counts).all() and len(packed) < 1 << 16
