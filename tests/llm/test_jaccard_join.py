import random
import re

import numpy as np
from pyspark.sql import functions as F

from sumline.llm import jaccard_join
from sumline.llm.components import components
from sumline.llm.jaccard_join import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[p + 1 :]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i if i is not None else -9), len(s), find(i) if i is not None else None) for i, s in sets)


def corpus(seed, n=250):
    r = random.Random(seed)
    vocab = [f"{a}{b}é" for a in "abcdefghij" for b in "klmnopqrs"]
    line = lambda n: [r.choice(vocab) for _ in range(n)]
    common = line(60)
    bases = [line(r.randint(1, 160)) for _ in range(25)]
    rows = [(1000, None), (1001, ""), (1002, "One"), (1003, "one"), (1004, "a B"), (1005, "A b"), (1006, "a b c"), (1007, "a b c a b c")]
    for i in range(n):
        ws = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            ws[r.randrange(len(ws))] = r.choice(vocab)
        if r.random() < 0.2:
            ws = ws + common if r.random() < 0.5 else common + line(r.randint(1, 30))
        rows.append((i, (" ".join(ws)).upper() if r.random() < 0.1 else " \n".join(ws)))
    chain = line(200)
    for i in range(60):  # neighbours link, ends don't
        chain[i * 3] = r.choice(vocab)
        rows.append((3000 - i, " ".join(chain)))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pivot", F.lit(1)).withColumn("n", F.lit(1)).repartition(5)
        got = sorted(tuple(r) for r in jaccard_components(df, log2_width=18).collect())
        assert got == brute(rows)


def test_odd_tables(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (4, "a b c d"), (7, "x y z w"), (7, "p q r s"), (8, "p q r s"), (9, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_components(df, log2_width=16).collect())
    assert got == [(0, 2, None), (4, 2, 4), (5, 2, 4), (5, 2, 4), (7, 2, 7), (7, 2, 7), (8, 2, 7), (9, 2, 7)]
    assert jaccard_components(df.filter("false"), log2_width=16).count() == 0


def test_repeated_id_without_text(spark):
    words = [f"w{i}" for i in range(60)]
    near = words[:57] + ["x", "y", "z"]
    rows = [(1, " ".join(words)), (1, None), (2, " ".join(near)), (2, None), (2, ""), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), log2_width=16).collect()))
    assert got == [(1, 0, 1), (1, 58, 1), (2, 0, 1), (2, 0, 1), (2, 58, 1), (3, 0, 3)]


def test_components(spark):
    r = np.random.Generator(np.random.PCG64(0))
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(500, 560)]
    edges = path + star + [tuple(map(int, e)) for e in r.integers(1000, 1200, (120, 2))] + [(3, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(500, 560))
    assert all(got[a] == got[b] <= min(a, b) for a, b in edges if a != b)


def test_split_meets_every_near_pair(monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    r = np.random.Generator(np.random.PCG64(4))
    bases = r.integers(0, 12, (12, jaccard_join.BINS))
    bins = np.clip(bases[r.integers(0, 12, 300)] + r.integers(-1, 2, (300, jaccard_join.BINS)) * (r.random((300, 1)) < 0.5), 0, 255).astype(np.uint8)
    size = bins.sum(1).astype(np.int64) + (r.random(300) < 0.1) * 500  # as if some bins were full
    for percent in (90, 80):
        region = jaccard_join.Region({"doc": np.arange(300), "bins": bins, "root": np.arange(300), "n": size, "pos": np.zeros(300, np.int64)}, percent)
        met, blocks = set(), 0
        for home, others in region.split(np.arange(300), np.arange(300)):
            blocks += 1
            met |= {(a, b) for a in home.tolist() for b in others.tolist()}
        near = [(a, b) for a in range(300) for b in range(300) if a != b and region.distance(np.array([a]), b)[0] <= 1 - percent / 100]
        assert blocks > 8 and len(near) > 300 and met.issuperset(near)


def test_blocks_and_small_cells(spark, monkeypatch):
    """A common shingle's region in blocks, cells of few sets."""
    monkeypatch.setattr(jaccard_join, "HOT", 16)
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    monkeypatch.setattr(jaccard_join, "MIN_CELLS", 14)
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(500)]
    family = [r.choice(vocab) for _ in range(45)]
    rows = [(i, " ".join(w if r.random() > 0.04 else r.choice(vocab) for w in family)) for i in range(150)]
    got = sorted(tuple(x) for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), log2_width=16).collect())
    assert got == brute(rows) and 5 < len({x[2] for x in got}) < 150


def test_words_built_to_collide(spark):
    """Words of repeated complements, which collide in any polynomial hash modulo a power of two."""
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    got = {x.doc_id: x.component_id for x in jaccard_components(spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string"), log2_width=16).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
