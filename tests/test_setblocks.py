"""Near duplicates by blocks: only true pairs leave a group."""

import random

import numpy as np
import pyarrow as pa
import pytest

from textmill.operators import neardup, setblocks


def test_no_candidates_are_joined(spark, tables, monkeypatch):
    monkeypatch.setattr(neardup, "candidate_pairs", None)
    df = spark.read.parquet(f"{tables}/documents.parquet")
    out = neardup.near_duplicates(df, "doc_id", "text", 0.8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
@pytest.mark.parametrize("same", [True, False])
def test_a_group_yields_exactly_the_true_pairs(monkeypatch, threshold, same):
    monkeypatch.setattr(setblocks, "_LEFT", 7)
    monkeypatch.setattr(setblocks, "_RIGHT", 11)
    rng = random.Random(3)
    base = [rng.sample(range(4000), 300) for _ in range(6)] + [[5], [5, 6], list(range(2000))]
    sets = [np.array(sorted({x for x in rng.choice(base) if rng.random() > 0.06} | {rng.randrange(1 << 60)})) for _ in range(90)]
    side = [not same and i % 3 == 0 for i in range(len(sets))]
    table = pa.record_batch([pa.array(side), pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                             pa.array([setblocks.pack(s) for s in sets], pa.binary())], ["side", "id", "size", "packed"])
    got = {}
    for b in setblocks._comparing(threshold)(iter([table])):
        for x, y, s in zip(*(c.to_pylist() for c in b.columns)):
            assert (min(x, y), max(x, y)) not in got
            got[min(x, y), max(x, y)] = s
    want = {}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            similarity = common / (len(sets[i]) + len(sets[j]) - common)
            if similarity >= threshold and (same or side[i] != side[j]):
                want[i, j] = similarity
    assert got == want and want
