import math
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sumline.llm.sharding import communication_matrix, hypergeometric_shuffle, large_hypergeometric, shard_sizes, sharded_digest


def test_matrix_margins_and_law():
    rows = [5, 0, 17, 3, 100]
    sizes = shard_sizes(125, 7)
    total = np.zeros((5, 7))
    for seed in range(400):
        m = communication_matrix(rows, sizes, seed)
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == sizes.tolist() and (m >= 0).all()
        total += m
    assert abs(total / 400 - np.outer(rows, sizes) / 125).max() < 0.5


def test_digest(spark):
    data = [(i, None if i % 50 == 0 else "é" * (i % 30)) for i in range(997)] + [(5, "same"), (5, "same"), (None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("shard", F.lit(9)).withColumn("slot", F.lit(9)).repartition(5)
    got = sharded_digest(df, 40).collect()
    assert len(got) == 1000
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(v) == list(range(25)) for v in slots.values())
    want = sorted((i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in data)
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    again = sharded_digest(df.repartition(3), 40).collect()
    key = lambda r: (r.doc_id or 0, r["size"], r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_passes_columns_and_empty(spark):
    df = spark.createDataFrame([(i, "t") for i in range(10)], "doc_id long, text string").withColumn("a.b", F.lit(1))
    out = hypergeometric_shuffle(df, [F.col("doc_id")], 3)
    assert out.columns == ["doc_id", "text", "a.b", "shard", "slot"] and out.count() == 10
    assert sharded_digest(df.filter("false")).count() == 0


def test_large_draws_keep_the_law():
    # Parts of one row among 2e9: each shard gets a fortieth of them.
    m = communication_matrix([1] * 2000 + [2 * 10**9 - 2000], shard_sizes(2 * 10**9, 40), 3)
    assert (m.sum(0) == 5 * 10**7).all() and (m[:-1].sum(1) == 1).all()
    assert (abs(m[:-1].sum(0) - 50) < 35).all()
    # The sampler against the law itself, where that can be counted out.
    draw = np.random.Generator(np.random.PCG64(1))
    for good, bad, wanted in [(7, 5, 6), (3, 40, 9), (30, 2, 31), (5, 0, 3), (0, 4, 2), (6, 6, 12), (50, 60, 40)]:
        got = np.bincount([large_hypergeometric(draw, good, bad, wanted) for _ in range(20000)], minlength=wanted + 1) / 20000
        law = [math.comb(good, x) * math.comb(bad, wanted - x) / math.comb(good + bad, wanted) for x in range(wanted + 1)]
        assert np.abs(got - law).max() < 0.02 and not got[np.array(law) == 0].any()


def test_law_of_places(spark):
    """Counts of a row group by shard have the hypergeometric variance, slots are uniform, and rows next to each other part."""
    n, n_shards, group = 4000, 8, 400
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    held, slots, near = [], [], []
    for seed in range(12):
        rows = sorted((r.doc_id, r.shard, r.slot) for r in hypergeometric_shuffle(df, [F.col("doc_id")], n_shards, seed, n_parts=16, n_blocks=4).collect())
        held.append(np.bincount([s for i, s, _ in rows if i < group], minlength=n_shards))
        slots += [t / (n / n_shards) for i, _, t in rows if i < group]
        near.append(np.mean([a[1] == b[1] for a, b in zip(rows, rows[1:])]))
    held = np.array(held)
    share = 1 / n_shards
    variance = group * share * (1 - share) * (n - group) / (n - 1)
    assert 0.6 < held.var() / variance < 1.5 and abs(held.mean() - group * share) < 1e-9
    assert np.abs(np.histogram(slots, 10, (0, 1))[0] / len(slots) - 0.1).max() < 0.02
    assert abs(np.mean(near) - share) < 0.01


def test_rows_equal_at_cuts(spark):
    """A group of equal rows that spans many shards is counted out exactly."""
    df = spark.createDataFrame([(7, "t")] * 700 + [(i, "t") for i in range(100, 400)], "doc_id long, text string").repartition(6)
    got = hypergeometric_shuffle(df, [F.col("doc_id"), F.col("text")], 7, n_parts=3, n_blocks=2).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sorted(map(len, slots.values())) == [142] + [143] * 6
    assert len({r.shard for r in got if r.doc_id == 7}) == 7
