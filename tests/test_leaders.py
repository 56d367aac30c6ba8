"""Clusters without a table of links against those from all links."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitforge.operators import blocks, clusters, leaders, sweep
from splitforge.operators import similarity as N

WEIGHTS, CUTOFFS = [0.0, 0.5, 1.0], [0.2, 0.35, 0.55]


@pytest.mark.parametrize("head", [1, 8, leaders.HEAD])
def test_leaders_equal_clusters_of_all_links(spark, monkeypatch, head):
    for module in (leaders, blocks):
        monkeypatch.setattr(module, "TILE", 600)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    for name, value in (("HEAD", head), ("STEP", 8), ("RANKS", 4 if head < 100 else leaders.RANKS)):
        monkeypatch.setattr(leaders, name, value)
    rng = random.Random(11)
    rows = [(3 * k, [rng.getrandbits(12), rng.getrandbits(3)], {f: float(rng.randrange(1, 6)) for f in "abc" if f == "a" or rng.random() < 0.7}) for k in range(90)]
    rows += [(1000 + k, rows[k % 5][1], rows[k % 5][2]) for k in range(30)] + [(2000, [0, 0], {"a": 3.0})]
    entities = spark.createDataFrame(rows, "id long, words array<long>, counts map<string,double>")
    found, _ = N.entity_classes(entities, "id")
    monkeypatch.setattr(N, "_prunes", lambda *_: False)
    dense = N.dense_sums(found, "id", max(CUTOFFS))
    got = leaders.leader_clusters(*dense, [(w, c) for w in WEIGHTS for c in CUTOFFS])
    want = sweep._linked_clusters(found, "id", WEIGHTS, CUTOFFS)
    columns = ["weight", "cutoff", "center", "id", "size"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_a_dense_sweep_writes_no_links(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("links")

    monkeypatch.setattr(clusters, "butina_clusters", refused)
    monkeypatch.setattr(sweep, "two_distances", refused)
    rows = spark.range(600).select("id", F.array(F.col("id") % 64, F.lit(7).cast("long")).alias("words"), F.create_map(F.lit("a"), (1 + F.col("id") % 9).cast("double")).alias("counts"))
    found, splits, summary = sweep.sweep_tunable_splits(rows, "id", WEIGHTS, CUTOFFS)
    assert summary.count() == 9 and found.count() == 9 * 600
    assert {r.n for r in splits.groupBy("weight", "cutoff").agg(F.sum("n_rows").alias("n")).collect()} == {600}


@pytest.mark.parametrize(("width", "features", "zero"), [(10, 2, 0.3), (64, 5, 0.1), (130, 3, 0.0), (20, 0, 0.0)])
def test_neighbours_are_those_within_the_cutoff(monkeypatch, width, features, zero):
    """A pair's distances are not taken again for each setting: a number of shared bits decides, as the distance itself does."""
    monkeypatch.setattr(leaders, "COLUMNS", 31)
    monkeypatch.setattr(leaders, "TILE", 90)
    rng = np.random.default_rng(width)

    def made(n):
        bits, counts = rng.random((n, width)) < 0.5, rng.integers(1, 5, (features, n)).astype(float)
        bits[0], counts[rng.random((features, n)) < zero] = False, 0
        code = [c.tobytes() for c in np.packbits(np.pad(bits, ((0, 0), (0, -width % 64))), axis=1)]
        sums = {f"s{k}": c for k, c in enumerate(counts)}
        rows = pa.table({"id": np.arange(n), "code": pa.array(code, pa.binary()), **sums, "size": rng.choice([1, 1, 3], n)})
        return bits.astype(int), counts, leaders.Rows(rows, list(sums))

    (bits_a, counts_a, a), (bits_b, counts_b, b) = made(120), made(70)
    shared = bits_a @ bits_b.T
    either = bits_a.sum(1)[:, None] + bits_b.sum(1) - shared
    structure = np.where(either > 0, 1 - shared / np.maximum(either, 1), 0.0)
    i, j = np.divmod(np.arange(120 * 70), 70)
    gaps = blocks.count_gaps(counts_a[:, i], counts_b[:, j]).reshape(120, 70)
    settings = [leaders.Setting(w, c, width) for w in (0.0, 0.1, 0.5, 1.0) for c in (0.2, 0.35, 0.45, 0.5, 0.75)]
    n_a, n_b = leaders.neighbour_weights(a, b, settings)
    for k, s in enumerate(settings):
        near = (s.weight * structure + (1 - s.weight) * gaps).clip(0, 1).astype(np.float32).astype(float) <= s.cutoff
        assert (near @ b.codes.weight == n_a[k]).all() and (a.codes.weight @ near == n_b[k]).all()
        assert (leaders.first_leader(b, a, s) == np.where(near.any(0), near.argmax(0), -1)).all()
        assert (np.array([leaders.linked_to(a, r, b, s) for r in range(40)]) == near[:40]).all()
