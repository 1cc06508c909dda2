"""Features leave a task slice by slice, and what reads them once does not store them."""

import os

import pyarrow as pa

from textmill.models import grams
from textmill.plans import registered
from textmill.session import shared_dir


def test_batches_are_weighed_in_slices():
    texts = pa.array([f"w{i:04d} " * 40 for i in range(5000)])
    sizes = [len(part[0]) for part in grams.pieces(texts, texts)]
    assert sum(sizes) == 5000
    assert max(sizes) * 2 * len("w4999 " * 40) <= grams._WEIGHED
    assert len(sizes) > 3


def test_scoring_stores_no_features(spark, tables, tmp_path):
    d = str(tmp_path)
    spark.read.parquet(f"{tables}/documents.parquet").write.parquet(f"{d}/documents.parquet")
    before = set(os.listdir(shared_dir(spark)))
    got = sorted(map(tuple, registered.QUERIES["score_stream"](spark, d).collect()))
    new = set(os.listdir(shared_dir(spark))) - before
    assert not [f for f in new if f.startswith("features-")]
    registered.prepared(spark, d)
    assert got == sorted(map(tuple, registered.QUERIES["score_documents"](spark, d).collect()))
