import pytest
import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sumline.llm import decision_lists as dl
from sumline.llm.token_counts import Automaton, count_tokens, read_vocabulary
from sumline.llm.warc import read_warc, round_trip, write_warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = set()
    for i in range(len(ws) - 7):
        if seen[tuple(ws[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def texts():
    r = random.Random(8)
    vocab = ["a", "é", "日本", "x|y", "#", "😀", "and", "the"]
    out = [None, "", " \n\x0b\x1c ", "a\n\na\n a\na", "w " * 7, "w " * 8, "w " * 9, "    x"]
    return out + ["".join(r.choice(vocab) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.randint(0, 200))) for _ in range(80)]


def test_counts(spark):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("rule", F.lit(7))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in dl.stats(df).collect()}
    assert got == {i: brute_counts(t) for i, t in data}


def test_learn_and_emit(spark):
    r = np.random.Generator(np.random.PCG64(4))
    n = 3000
    counts = {c: r.integers(1, 100, n) for c in dl.COUNTS}
    table = dl.feature_arrays(counts)
    bad = (table["repeat_share"] > 2.0) & (table["n_words"] > 10) | (table["upper_share"] > 6)
    rules = dl.learn(table, bad)
    hit = np.zeros(n, bool)
    for rule in rules:
        hit |= dl._covers(rule, table, n)
    assert rules and (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.05 * hit.sum()
    df = spark.createDataFrame([tuple(int(counts[c][i]) for c in dl.COUNTS) for i in range(n)], dl.COUNTS)
    got = [x[0] > 0 for x in df.select(dl.rules_column(rules)).collect()]
    assert got == hit.tolist()


def test_judged(spark):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 997}" for j in range(120))) for i in range(300)]
    junk = [(1000 + i, " | ".join(f"W{(i + j * j) % 991}" for j in range(60))) for i in range(60)]
    df = spark.createDataFrame(good + junk + [(5000, "few words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:250]] + [(i, 0, 0) for i, _ in junk[:45]] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in dl.judged(df, labels).collect()}
    assert sum(got[i] for i, _ in good) >= 297 and not any(got[i] for i, _ in junk) and not got[5000]
    assert all(r.kept == (not r.base_failed) for r in dl.judged(df, labels.filter("false")).collect())
    assert dl.judged(df.filter("false"), labels).count() == 0


def greedy(pieces, symbols):
    longest, n, at = max(map(len, pieces)), 0, 0
    while at < len(symbols):
        for k in range(min(longest, len(symbols) - at), 0, -1):
            if tuple(symbols[at : at + k]) in pieces:
                at, n = at + k, n + 1
                break
        else:
            return -1
    return n


def test_automaton_against_greedy():
    r = random.Random(2)
    for _ in range(150):
        pieces = {tuple(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 25))}
        pieces |= {(32, *p) for p in r.sample(sorted(pieces), len(pieces) // 2)} | ({(32,)} if r.random() < 0.8 else set())
        a = Automaton(pieces, 32)
        for _ in range(40):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            assert a.count(word) == greedy(pieces, (32, *word))
    a = Automaton.of_wordpieces(["un", "##aff", "##able", "##a", "##f", "a"])
    assert a.count(b"unaffable") == 3 and a.count(b"zzz") == -1 and a.count(b"aa") == 2


def test_token_counts(spark):
    vocab = read_vocabulary()
    pieces = {tuple(v) for v in vocab}
    data = list(enumerate([None, "", "Hello wörld 日本語 supercalifragilistic\n\x0bnow", "z" * 5000, *texts()[8:14]]))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_words", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in count_tokens(df, Automaton.of_bytes(vocab)).collect()}
    for i, t in data:
        ws = WORD.findall(t or "")
        assert got[i] == (len(ws), sum(greedy(pieces, (32, *w.encode())) for w in ws), 0)
    few = Automaton.of_bytes([b" ", b"a", b" a"])
    assert [tuple(x) for x in count_tokens(df.selectExpr("1L as doc_id", "'aa b aab' as text").limit(1), few).collect()] == [(1, 3, 4, 2)]


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a\r\nb", big), (2, "http://b", big), (5, "u", big), (3, "u", "small"), (4, "u", "small"), (6, None, None), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (9, "u", "y" * 1000), (2, "again", big), (None, "n", big)]
    rows += [(100 + i, "u", f"{i}" * 3000) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    got = Counter(tuple(r) for r in round_trip(df).collect())
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        best = max((x[0] for x in rows if x[2] == h and x[0] is not None), default=None)
        revisit = len(p) >= 1000 and i != best
        want[(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", best if revisit else None, True)] += 1
    assert got == want
    names = lambda d: [(r["name"], r["sha1"], r["records"]) for r in write_warc(df, f"file://{tmp_path}/{d}", 3, roll_bytes=2000)]
    first = names("a")
    assert first == names("b") and len(first) > 5
    assert not (tmp_path / "a/_temporary").exists()
    back = {(r.page_id, r.payload) for r in read_warc(spark, f"file://{tmp_path}/a").filter("record_type = 'response'").collect()}
    assert (6, b"") in {(a, bytes(b)) for a, b in back} and (101, b"1" * 3000) in {(a, bytes(b)) for a, b in back}
    assert round_trip(df.filter("false")).count() == 0


def test_warc_target_in_use(spark, tmp_path):
    pages = lambda n: spark.createDataFrame([(i, "http://a", "x" * 1200) for i in range(n)], "page_id long, url string, html string")
    target = f"file://{tmp_path}/w"
    write_warc(pages(5), target, 4)
    with pytest.raises(FileExistsError):
        write_warc(pages(3), target, 4)
    assert read_warc(spark, target).count() == 5
    write_warc(pages(3), target, 2, overwrite=True)
    assert read_warc(spark, target).count() == 3 and not (tmp_path / "w" / "_temporary").exists()


def test_warc_any_partitioning(spark, tmp_path):
    """The same archives whatever the order and the partitions of the input."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", "y" * (i * 37 % 3000)) for i in range(400)], "page_id long, url string, html string")
    made = [[(r["name"], r["sha1"]) for r in write_warc(pages.repartition(n).orderBy(F.rand(n)), f"file://{tmp_path}/v{n}", 3, roll_bytes=3000)] for n in (1, 4, 9)]
    assert made[0] == made[1] == made[2]
