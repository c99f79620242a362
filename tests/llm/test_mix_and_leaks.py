import random

import numpy as np
from pyspark.sql import functions as F

from sumline.llm import decontamination as dc
from sumline.llm import source_mixing as sm


def test_rake_meets_margins():
    r = np.random.Generator(np.random.PCG64(1))
    codes = [c.ravel() for c in np.meshgrid(range(5), range(3), range(4), indexing="ij")]
    tokens = r.integers(1, 1000, 60).astype(float)
    targets = [x / x.sum() for x in (r.random(5) + 0.1, r.random(3) + 0.1, r.random(4) + 0.1)]
    w = sm.rake(tokens, codes, targets)
    for code, goal in zip(codes, targets):
        assert np.allclose(np.bincount(code, w * tokens) / tokens.sum(), goal, atol=1e-8)
    # Goals that some mixture under the cap has: those of any probabilities.
    q = np.minimum(1, (0.3 + r.random(5))[codes[0]] * (0.5 + r.random(3))[codes[1]] * (0.5 + r.random(4))[codes[2]])
    goals = [np.bincount(code, q * tokens) for code in codes]
    p = sm.calibrated(w, tokens, codes, goals)
    assert p.max() <= 1 and (p == 1).any()
    for code, goal in zip(codes, goals):
        assert np.allclose(np.bincount(code, p * tokens), goal, rtol=0.01)


def full_share(out, names):
    held = out.groupby(out.source.fillna("?")).n_tokens.sum() / out.n_tokens.sum()
    return held[names].sum()


def test_goals_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(i, "w " * 50, "a" if i % 10 else "b", "en") for i in range(500)], "doc_id long, text string, source string, lang string")
    mix = sm.plan_mix(sm.measured(df), 0.8, {"source": {"a": 0.5, "b": 0.5}})
    assert {(m, k) for m, k, _, _ in mix.unmet} >= {("source", "b")}
    assert sm.plan_mix(sm.measured(df), 0.8).unmet == []


def test_mixed(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 200))), r.choice(["a", "a", "a", "b", None]), r.choice(["en", "fr"])) for i in range(4000)]
    rows += [(9000, None, "a", "en"), (9001, "", "c", "en"), (9002, "x y", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("weight", F.lit(1)).withColumn("topic", F.lit("old"))
    out = sm.mixed(sm.measured(df), 0.4, {"source": {"b": 0.5}}).toPandas()
    assert len(out) == 4003 and set(out.topic) <= {"table", "list", "note", "article", "essay"}
    assert out.n_tokens.tolist() == [len((rows[i if i < 4000 else i - 5000][1] or "").split()) for i in out.doc_id]
    total = out.n_tokens.sum()
    kept = out[out.kept]
    assert abs(kept.n_tokens.sum() / total - 0.4) < 0.03
    shares = kept.groupby(kept.source.fillna("?")).n_tokens.sum() / kept.n_tokens.sum()
    mix = sm.plan_mix(sm.measured(df), 0.4, {"source": {"b": 0.5}})
    goal = {k: g for m, k, g, _ in mix.unmet if m == "source"}
    assert not goal and abs(shares["b"] - 0.5 / (0.5 + full_share(out, ["a", "c", "?"]))) < 0.03
    rows_before = {r.doc_id: r for r in df.collect()}
    assert all(r == rows_before[r.doc_id] for r in sm.sample_mix(df).collect())
    assert sm.sample_mix(df).columns == df.columns and sm.sample_mix(df.filter("false")).count() == 0


def test_common_subsequence():
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 20))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert dc.common_subsequence(a, b) == t[-1][-1]


def test_leaks(spark):
    r = random.Random(7)
    stop, rare = ["the", "of", "and", "to", "in"], [f"w{i}" for i in range(3000)]
    word = lambda: r.choice(stop) if r.random() < 0.5 else r.choice(rare)
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(r.randint(12, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "zq zr zs")]
    docs, want = [], set()
    for d in range(400):
        ws = prose(r.randint(1, 400))
        if d % 4 == 0:
            i, t = items[r.randrange(30)]
            ts = t.split()
            if d % 8 == 0:  # a paraphrase: words changed, added and left out
                ts = [w if r.random() > 0.1 else r.choice([w + " " + word(), "", word()]) for w in ts]
            at = r.randint(0, len(ws))
            ws[at:at] = ts
            want.add((d, i))
        docs.append((d, " ".join(ws).title() if d % 3 == 0 else "\n".join(ws)))
    docs += [(1000, None), (1001, ""), (1002, items[0][1]), (1003, "x zq zr zs y"), (1003, "x zq zr zs y")]
    want |= {(1002, 0), (1003, 92)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    assert dc.decontaminate(df.drop("hits"), bench).count() == len(docs) - len({d for d, _ in want}) - 1
    assert dc.contaminated(df, bench.filter("false")).count() == 0 and dc.contaminated(df.filter("false"), bench).count() == 0


def test_leaks_against_all_windows(spark):
    """Every hit of the common subsequence and the answer check over all windows, for paraphrases among foreign words and short items at any place."""
    r = random.Random(5)
    rare = [f"w{i}" for i in range(1200)]
    items = [(i, " ".join(r.choice(rare) for _ in range(n))) for i, n in enumerate([*range(1, 13), *(r.randint(12, 60) for _ in range(30))])]
    foreign = lambda n: [f"f{r.randrange(10**6)}" for _ in range(n)]
    docs = []
    for d in range(1000):
        words = items[d % len(items)][1].split()
        if len(words) > 8:
            rate = r.choice([0.2, 0.3, 0.35])
            words = [w if r.random() > rate else foreign(1)[0] for w in words]
        elif d % 3 == 0:  # words added to a short item
            words = [x for w in words for x in (w, *foreign(r.randint(0, 1)))]
        docs.append((d, " ".join(foreign(r.randint(0, 40)) + words + foreign(r.randint(0, 40)))))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    known = dc.Items.of(items)
    idf, table = dc.fit_space(df, known).idf, known.table()
    want = {}
    for d, text in docs:
        raw = np.frombuffer(text.encode(), np.uint8)
        f = known.features(dc._slice_words(raw, np.array([0, len(raw)]))[0], table).tolist()
        for i, item in zip(known.ids, known.words):
            once = np.unique(item)
            asked = set(once[np.argsort(-idf[once], kind="stable")][: max(3, len(once) // 3)].tolist())
            width = -(-len(item) // 4) * 4 + 2 * (4 + len(item) // 8)
            for at in range(max(1, len(f) - width + 1)):
                window = f[at : at + width]
                held = len(asked.intersection(window))
                if 2 * held >= len(asked) and (n := dc.common_subsequence(item.tolist(), window)) >= dc.needed(len(item)):
                    want[d, i] = max(want.get((d, i), (0, 0)), (n, held))
    got = {(x.doc_id, x.item_id): (x.lcs_words, x.answer_hits) for x in dc.contaminated(df, bench).collect()}
    assert len(want) > 800 and got == want


def test_features_of_many_words():
    words = [f"w{i}" for i in range(20_000)]
    known = dc.Items.of([(k, " ".join(words[k::40])) for k in range(40)])
    table = known.table()
    assert len(known.vocabulary) == len(words) and table.nbytes <= 256 * len(words)  # grows with the words, not with their pairs
    assert (known.after >= 0).any()  # some share a slot
    assert known.features(known.vocabulary, table).tolist() == list(range(len(words))) == sorted(np.concatenate(known.words).tolist())
    others = " ".join(f"x{i}" for i in range(20_000)).encode()
    raw = np.frombuffer(others, np.uint8)
    assert (known.features(dc._slice_words(raw, np.array([0, len(raw)]))[0], table) == -1).all()
    assert dc.Items.of([(1, ""), (2, None), (3, " ")]).ids == []


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c", "kept as it is"), (2, "zq zr zs zt zu", "x")], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(None, "zq zr zs zt zu")], "item_id long, text string")
    assert dc.decontaminate(df, bench).collect() == df.filter("doc_id = 1").collect()
