import hashlib
import re

import numpy as np

from sumline.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, ws in split:
        for p in range(len(ws) - k + 1):
            key = tuple(ws[p : p + k])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = {}
    for i, ws in split:
        gone = set()
        for p in range(len(ws) - k + 1):
            if first[tuple(ws[p : p + k])] < (i, p):
                gone.update(range(p, p + k))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def rows():
    import random

    r = random.Random(5)
    vocab = [f"w{i}é" for i in range(60)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = line(40)
    out = [(9, shared), (3, line(50) + "\n" + shared + "\t" + line(10)), (7, shared + " " + shared), (1, "x " * 60), (2, "x " * 25), (4, None), (5, ""), (6, " \x0b\r "), (8, "a b c " * 30), (10, line(20))]
    out += [(20 + i, shared) for i in range(30)]
    return out + [(60, line(3000) + " " + shared)]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for k in (20, 5):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df, k, log2_width=18).collect()}
        assert got == brute(data, k)


def test_narrow_sketch_loses_nothing(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in dedup_substrings(df, 20, log2_width=16).collect()}
    assert got == {i: v[1] for i, v in brute(data, 20).items()}


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string").selectExpr("*", "1 as h1", "2 as starts", "'x' as run")
    got = sorted((r.doc_id or 0, r.n_removed) for r in dedup_substrings(df, 3, 16).collect())
    assert got == [(0, 0), (1, 6), (1, 6)]
    assert dedup_substrings(df.filter("false"), 3, 16).count() == 0


def test_words_built_to_collide_stay(spark):
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    tail = " ".join(f"t{i}" for i in range(19))
    got = {r.doc_id: r.n_removed for r in dedup_substrings(spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}


def test_sketch_follows_the_input():
    """With eight cells an anchor few windows pass that stand alone; sparse and dense counting agree."""
    from sumline.llm import substring_dedup as sd

    r = np.random.Generator(np.random.PCG64(9))
    n_words = 600_000
    width = sd.sketch_width(n_words)
    anchors = r.integers(0, 2**63, n_words // 6, dtype=np.uint64)
    hit = [np.bincount(x.astype(np.int64), minlength=1 << width) for x in sd._cells(anchors, width)]
    passed = np.logical_and.reduce([h[x.astype(np.int64)] > 1 for h, x in zip(hit, sd._cells(anchors, width))])
    assert passed.mean() < 0.05


def test_wide_sketch(spark, monkeypatch):
    from sumline.llm import substring_dedup as sd

    rows = [(i, " ".join(f"w{(i * 37 + j) % 900}" for j in range(60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dense = sorted(map(tuple, dedup_substrings(df, with_text=False, log2_width=17).collect()))
    monkeypatch.setattr(sd, "DENSE", 16)
    assert sorted(map(tuple, dedup_substrings(df, with_text=False, log2_width=17).collect())) == dense
