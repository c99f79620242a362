"""Personal data by weak supervision, in DataFrame functions only.

Method. Broad patterns give candidate spans with the text before them. Three labelers vote on each
candidate: a regex labeler (strict shape and checksums), a gazetteer labeler (known endings,
prefixes, key names) and a context labeler (words in the CONTEXT characters before it). Votes are
yes, no or abstain. Expectation-maximisation estimates, per kind, how often each labeler votes
which way on true and false candidates; it needs only the counts of vote patterns, a table of at
most kinds x 27 rows whatever the corpus. A logistic span classifier is then trained on the
posteriors by vote, length and digit share (again a bounded table of counts), and its score is a
Spark expression. Spans of the base rules always stand; the classifier adds others whose score is
THRESHOLD or more.

A secret is a name, = or : and a value, with or without blanks and quotes around the sign and the
value; its span runs from the name to the value's closing quote.

Offsets come from the lengths of the pieces between matches, summed by a window over one
document's matches, so that the work is linear in the number of matches.

Defined cases. Null and empty texts have no spans. Rows that share id and text get the same spans
each. A null id is kept. An empty table gives an empty result. Other columns of the input are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

CONTEXT = 24
THRESHOLD = 0.9
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "local_phone", "secret"]
_KEY = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
_NAME, _VALUE = r"[A-Za-z][A-Za-z0-9_-]{0,30}+", r"[A-Za-z0-9+/_-]{8,}+"
#: Between a secret's name and its value: = or :, with blanks around it and the name's closing quote.
_SIGN = r"[\"']?[ \t]*+[=:][ \t]*+"
#: name=value; else with blanks or quotes, where a known name's value is taken as it stands, and any other name's only if it isn't itself
#: the name of a value ("note: token = ..."). No form takes a known name for a value.
_SECRET = (
    rf"(?<![A-Za-z0-9_-])(?:{_NAME}[=:](?!(?i:{_KEY}){_SIGN}){_VALUE}"
    rf"|(?:(?i:{_KEY}){_SIGN}(?![\"']?(?i:{_KEY}){_SIGN})|{_NAME}{_SIGN}(?![\"']?{_NAME}{_SIGN}[\"']?[A-Za-z0-9+/_-]{{8}}))(?:[\"']{_VALUE}[\"']?|{_VALUE}))"
)
#: Possessive loops and look-behinds keep matching linear; they match what the plain patterns match.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # An area code in parentheses or with a sign after it, or a trunk zero, and groups of digits.
    "local_phone": r"(?<![+0-9(). /-])(?: )?(?:(?:\([0-9]{2,5}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,4}\)?(?:[ ./-][0-9]{2,4}){2,4}+)(?![0-9.-])",
    "secret": _SECRET,
}
#: A cheap look before the pattern runs.
HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\."),
    "card": lambda t: t.rlike(r"[0-9][ -]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "local_phone": lambda t: t.rlike(r"[0-9][) ./-]{1,2}[0-9]{2,4}[ ./-][0-9]{2}"),
    "secret": lambda t: t.rlike(r"[=:][ \t]*+[\"']?[A-Za-z0-9+/_-]{8}"),
}
#: Common mail and host endings, card prefixes, dialling prefixes, names of keys.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|co|info|biz|de|fr|es|uk|eu|it|nl)$",
    "ip": r"^(?!0\.|127\.|255\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": r"^[ (]*[02-9][0-9]{1,4}[) ./-]",
    "secret": rf"(?i)^{_KEY}{_SIGN}",
}
WORDS_BEFORE = {
    "email": r"(mail|contact|write|address|kontakt|courriel|correo)",
    "ip": r"(ip|host|server|address|from)\W*$",
    "card": r"(card|visa|credit|carte|karte|tarjeta)",
    "phone": r"(tel|phone|call|fax|mobile)",
    "local_phone": r"(tel|phone|call|fax|mobile)\W*$",
    "secret": r"(^|\W)(and|the|your|my|with|set|use|is|key|login)\W*$",
}
YES, NO, ABSTAIN = 1, 0, 2
VOTES = ["by_regex", "by_gazetteer", "by_context"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(F.try_to_number(d, F.lit("9")).cast("int") * 2))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    """What the base rules ask of a match beyond its pattern."""
    digits = _digits(found)
    n = F.length(digits)
    parts = F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", parts)
        .when(kind == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, nth, start, end, found, before): every match of a broad pattern, offsets in code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,before:string,found:string>>")

    def matches(kind: str) -> Column:
        pieces, found = F.split("text", PATTERN[kind], -1), F.regexp_extract_all("text", F.lit(PATTERN[kind]), F.lit(0))
        each = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("found"), p.alias("piece")))
        row = F.transform(each, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("nth"), F.char_length(x["piece"]).cast("int").alias("gap"), F.lower(F.right(x["piece"], F.lit(CONTEXT))).alias("before"), x["found"].alias("found")))
        return F.when(HINT[kind](F.col("text")), row).otherwise(none)

    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.concat(*[matches(k) for k in KINDS]).alias("all")).filter(F.size("all") > 0)
    rows = rows.select("doc_id", "text_key", F.inline("all")).dropDuplicates(["doc_id", "text_key", "kind", "nth"])
    order = Window.partitionBy("doc_id", "text_key", "kind").orderBy("nth")
    length = F.char_length("found")
    end = F.sum((F.col("gap") + length).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - length).drop("gap")


def labelled(found: DataFrame) -> DataFrame:
    """Votes of the labelers on each candidate, whether it is a base span, and the classifier's other features."""
    kind, match = F.col("kind"), F.col("found")
    digits = F.length(_digits(match))
    share = (F.least(F.lit(3), F.floor(digits * 4 / F.greatest(F.lit(1), F.char_length(match))))).cast("int")
    value = F.regexp_extract(match, r"[=:][ \t]*[\"']?([A-Za-z0-9+/_-]*)", 1)

    def by_kind(patterns: dict[str, str], of: Column) -> Column:
        out = F.lit(False)
        for k, p in patterns.items():
            out = F.when(kind == k, of.rlike(p)).otherwise(out)
        return out

    base = F.coalesce(_valid(kind, match), F.lit(False))
    secret_shape = (F.length(value) >= 12) & value.rlike("[0-9].*[0-9]") & value.rlike("[A-Za-z]")
    shape = F.when(kind.isin(BASE), F.col("base")).when(kind == "secret", secret_shape).otherwise(match.rlike(r"\)|-.*-|^ ?0") & digits.between(8, 12))
    vote = lambda c, otherwise: F.when(c, YES).otherwise(otherwise)
    return found.withColumn("base", base).select(
        "doc_id", "text_key", "kind", "start", "end", "base",
        vote(shape, NO).alias("by_regex"),
        vote(by_kind(GAZETTEER, match), NO).alias("by_gazetteer"),
        vote(by_kind(WORDS_BEFORE, F.col("before")), ABSTAIN).alias("by_context"),
        F.least(F.lit(3), F.floor(F.char_length(match) / 12)).cast("int").alias("size_bin"), share.alias("digit_bin"),
    )


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[list[list[float]]], list[float]]:
    """EM over counted vote patterns: the share of true candidates, the law of each labeler's votes for false
    and true ones, and the posterior of each pattern. Starts from labelers that are right four times in five."""
    n_votes = len(VOTES)
    law = [[[0.6, 0.15, 0.25], [0.15, 0.6, 0.25]] for _ in range(n_votes)]
    prior, post = 0.5, [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (votes, _) in enumerate(patterns):
            like = [1 - prior, prior]
            for j, v in enumerate(votes):
                like = [like[y] * law[j][y][v] for y in (0, 1)]
            post[i] = like[1] / max(sum(like), 1e-300)
        total = sum(n for _, n in patterns)
        true = sum(p * n for p, (_, n) in zip(post, patterns))
        prior = min(0.99, max(0.01, true / max(total, 1)))
        for j in range(n_votes):
            for y in (0, 1):
                # The prior belief weighs as much as 20 candidates; it keeps the classes from changing places.
                belief = [12.0, 3.0, 5.0] if y == 0 else [3.0, 12.0, 5.0]
                for votes, n in ((v, n * (p if y else 1 - p)) for (v, n), p in zip(patterns, post)):
                    belief[votes[j]] += n
                law[j][y] = [b / sum(belief) for b in belief]
    return prior, law, post


def _features(kind: str, votes: tuple[int, ...], size_bin: int, digit_bin: int) -> list[str]:
    return ["bias", f"kind={kind}", *(f"{name}={v}" for name, v in zip(VOTES, votes)), f"size={size_bin}", f"digits={digit_bin}"]


def train_classifier(cells: list[tuple[list[str], float, int]], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, float]:
    """Logistic regression on (features, posterior, count) by full gradient steps over the bounded table of cells."""
    weights = {f: 0.0 for cell in cells for f in cell[0]}
    total = sum(n for _, _, n in cells) or 1
    for _ in range(steps):
        grad = {f: ridge * w for f, w in weights.items()}
        for names, target, n in cells:
            miss = 1 / (1 + math.exp(-sum(weights[f] for f in names))) - target
            for f in names:
                grad[f] += miss * n / total
        weights = {f: w - rate * grad[f] * 4 for f, w in weights.items()}
    return weights


def find_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, kind, start, end, base, score): base spans and those that the classifier adds."""
    votes = stash(labelled(candidates(docs)), "pii")
    table = votes.groupBy("kind", *VOTES, "size_bin", "digit_bin").count().collect()  # at most kinds x 27 x 16 rows
    cells = []
    for kind in KINDS:
        mine = [r for r in table if r.kind == kind]
        counted: dict[tuple[int, ...], int] = {}
        for r in mine:
            key = tuple(r[v] for v in VOTES)
            counted[key] = counted.get(key, 0) + r["count"]
        if not counted:
            continue
        patterns = sorted(counted.items())
        posterior = dict(zip((p for p, _ in patterns), estimate(patterns)[2]))
        for r in mine:
            key = tuple(r[v] for v in VOTES)
            cells.append((_features(kind, key, r.size_bin, r.digit_bin), posterior[key], r["count"]))
    weights = train_classifier(cells)
    score = F.lit(weights.get("bias", 0.0))
    for column, name in [("kind", "kind"), *((v, v) for v in VOTES), ("size_bin", "size"), ("digit_bin", "digits")]:
        for f, w in sorted(weights.items()):
            if f.startswith(f"{name}="):
                score = score + F.when(F.col(column).cast("string") == f[len(name) + 1 :], F.lit(w)).otherwise(0.0)
    scored = votes.withColumn("score", 1 / (1 + F.exp(-score)))
    # A failed match of a base pattern is no span of that kind, whatever its score; of the other kinds the classifier decides alone.
    return scored.filter(F.col("base") | ((F.col("score") >= threshold) & ~F.col("kind").isin(BASE))).select("doc_id", "text_key", "kind", "start", "end", "base", "score")


def span_digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    place = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    item = F.struct(place.alias("k"), F.col("start").alias("s"), F.concat_ws(":", "kind", "start", "end").alias("t"), F.col("base").alias("b"))
    by_doc = find_spans(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(item)).alias("items"), *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE])
    joined = lambda items: F.concat_ws(",", F.transform(items, lambda x: x["t"]))
    by_doc = by_doc.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), *[f"n_{k}" for k in BASE], F.sha2(joined(F.filter("items", lambda x: x["b"])), 256).alias("base_sha256"), joined(F.col("items")).alias("spans"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    out = keys.join(by_doc, F.expr("doc_id <=> __d and text_key = __t"), "left")
    empty = F.sha2(F.lit(""), 256)
    return out.select("doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.coalesce("base_sha256", empty).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text with every span's code points replaced by a mark of its kind; earlier spans win overlaps."""
    spans = find_spans(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), "spans")
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    rows = rows.join(spans, F.expr("doc_id <=> __d and text_key = __t"), "left")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(acc, s):
        kept = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at")))

    done = F.aggregate("spans", zero, add, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.char_length("text"))))
    return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"))
