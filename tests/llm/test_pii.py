import hashlib
import random
import re

from pyspark.sql import functions as F

from sumline.llm import pii
from sumline.llm.pii import estimate, redact, span_digest

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    d = [int(c) for c in m if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def texts():
    r = random.Random(3)
    parts = ["a.b@c.de", "a@b.c_d@e.f.g", "x@y", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.02.255.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+1--", "++49 30 123456", "é", "ü@x.com", "😀 t@t.io", ". ", " ", "-", "..", "@", "9" * 30, "12 34", "tel 555-123-4567", "password=b7db7aa4a5fcc78305", "the", "word", "%", "\n", "a@b.c.@d.e"]
    out = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 25))) for _ in range(300)]
    long = "1 2 3 " * 6000 + "a@" + "b." * 9000 + "c " + "." * 5000 + "x" * 20000 + "1" * 20000 + " +1" + "-" * 5000
    return [None, "", *out, long]


def test_base_against_brute_force(spark):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("text_key", F.lit(1)).repartition(4)
    got = {r.doc_id: r for r in span_digest(df).collect()}
    assert len(got) == len(data)
    for i, t in data:
        want = brute(t)
        r = got[i]
        counts = {k: sum(x[0] == k for x in want) for k in PLAIN}
        assert {k: r[f"n_{k}"] for k in PLAIN} == counts, (i, t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, t)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_adds_secrets_and_redacts(spark):
    clean = [(i, "the mail of a word: and more, at 12 o'clock") for i in range(30)]
    df = spark.createDataFrame([(100 + i, f"é and password=b7db7aa4a5fcc783{i:02d} here, a{i}@b.com") for i in range(40)] + clean, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in span_digest(df).collect()}
    assert got[100] == "email:40:48,secret:6:33" and got[0] == ""
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert out[100] == "é and [SECRET] here, [EMAIL]" and out[0] == clean[0][1]


def test_secrets_with_blanks_and_quotes(spark):
    forms = ['token = "{}"', "password: '{}'", '"api_key": "{}"', "secret = {}", "token={}", 'note: token = "{}"', "token\t:\t{}"]
    value = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f"é ti of {forms[i % 7].format(value(i))} enon, a{i}@b.com") for i in range(210)]
    prose = [(1000 + i, "Remember: everything = nothing, note: 'something' and the word: whatever") for i in range(60)]
    df = spark.createDataFrame(rows + prose, "doc_id long, text string")
    out = {r.doc_id: r.text for r in redact(df).collect()}
    for i, text in rows:
        assert value(i) not in out[i] and out[i].count("[SECRET]") == 1, text
        assert out[i].startswith("é ti of ") and out[i].endswith(" enon, [EMAIL]")
    assert all(out[i] == text for i, text in prose)
    spans = {r.doc_id: r.spans for r in span_digest(df).collect()}
    start = rows[0][1].index("token")
    assert f"secret:{start}:{start + len(value(0)) + 10}" in spans[0].split(",") and spans[1000] == ""


def test_long_secrets_are_redacted_whole(spark):
    value = lambda i, n: (hashlib.sha256(str(i).encode()).hexdigest() * (n // 64 + 1))[:n]
    rows = [(i, f'so token{"=" if i % 2 else " = "}{value(i, n)} ends') for i, n in enumerate([40, 199, 200, 201, 500, 1000] * 8)]
    out = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out.values()) == {"so [SECRET] ends"}


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd"), (1, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in span_digest(df).collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert span_digest(df.filter("false")).count() == 0


def test_em_recovers_labelers():
    r = random.Random(1)
    right = [0.95, 0.8, 0.7]
    counts: dict = {}
    for _ in range(20000):
        y = r.random() < 0.3
        v = tuple(int(y if r.random() < a else not y) for a in right)
        counts[v] = counts.get(v, 0) + 1
    prior, law, _ = estimate(sorted(counts.items()), 200)
    assert abs(prior - 0.3) < 0.05
    for j, a in enumerate(right):
        assert abs(law[j][1][1] - a) < 0.08 and abs(law[j][0][0] - a) < 0.08


def _planted(n=300):
    """Texts with secrets and national phone numbers, others with what only looks like one, and the true spans."""
    import random

    r = random.Random(2)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    true = [lambda: f'token = "{hexes(40)}"', lambda: f"api_key={hexes(24)}1a", lambda: f"password: {hexes(16)}9f", lambda: "(212) 555-01" + f"{r.randrange(10, 99)}", lambda: f"030 {r.randrange(100, 999)} {r.randrange(100, 999)}"]
    false = [lambda: "note = something", lambda: "colour=ultramarine", lambda: "see: chapters", lambda: f"{r.randrange(100, 999)}.{r.randrange(10, 99)} {r.randrange(10, 99)}.50"]
    docs, want = [], set()
    for i in range(n):
        found = r.choice(true if i % 2 else false)()
        lead = r.choice(["call me ", "the ", "lorem ipsum "])
        docs.append((i, f"{lead}{found} and so on"))
        if i % 2:
            want.add((i, len(lead), len(lead) + len(found)))
    return docs, want


def test_added_spans_precision_and_recall(spark):
    docs, want = _planted()
    got = {(r.doc_id, r.start, r.end) for r in pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string")).filter("not base").collect()}
    got = {(d, a + (docs[d][1][a] == " "), b) for d, a, b in got}  # a phone's leading blank
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_estimates_decide(spark, monkeypatch):
    """Other reliabilities, another result: what EM finds goes into the spans."""
    docs, _ = _planted(100)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = pii.find_spans(df).filter("not base").count()
    real = pii.estimate

    def turned(patterns, **options):
        prior, law, post = real(patterns, **options)
        return prior, law, [1 - p for p in post]

    monkeypatch.setattr(pii, "estimate", turned)
    after = pii.find_spans(df).filter("not base").count()
    assert before > 40 and after < 0.8 * before
