import random

import pytest
from pyspark.sql import functions as F

from sumline.functions.numbers import _parsed, coerce_cell, parse_number
from sumline.functions.text import norm_label, selection

SPACE = [" ", " ", "  "]


def grouped(n, sep):
    return f"{n:,}".replace(",", sep)


def printed(r):
    """A random figure, as text and as number, by the grammar of printed figures: a body, a decoration, a footnote mark."""
    n = r.choice([r.randrange(10), r.randrange(1000, 10**6), r.randrange(10**6, 10**12)])
    cents = r.choice([None, r.randrange(100)])
    whole = r.choice([str(n), grouped(n, ","), grouped(n, " ")])
    body, value = whole, float(n)
    if cents is not None:
        body, value = f"{whole}.{cents:02d}", float(f"{n}.{cents:02d}")
        if r.random() < 0.3 and " " not in whole:
            body = f"{grouped(n, '.')},{cents:02d}"
    way = r.randrange(9)
    text = [body, f"({body})", f"-{body}", f"{body}-", f"AED {body}", f"{body} CR", f"{body} DR", f"{body}%", f"){body}("][way]
    mark = r.choice(["", "", "*", " (a)", "¹"]) if way in (0, 2) else ""
    pad = r.choice(["", "", *SPACE])
    return pad + text + mark + pad, -value if way in (1, 2, 3, 5, 8) else value


@pytest.fixture(scope="module")
def figures(spark):
    r = random.Random(13)
    return spark.createDataFrame([printed(r) for _ in range(3000)], "a string, b double").cache()


def test_parse_printed(figures):
    assert [(r.a, r.b, r.p) for r in figures.select("a", "b", parse_number(F.col("a"))["num"].alias("p")).collect() if r.p != r.b] == []


def test_common_forms_parse_as_the_long_way(figures):
    a = F.col("a")
    common = figures.select(F.regexp_replace(a, r"(?U)^\s+|\s+$", "").alias("a"))
    assert common.select(parse_number(a).alias("x"), _parsed(a).alias("y"), a).filter("not (x <=> y)").collect() == []
    assert common.select(coerce_cell(a)["num"].alias("x"), parse_number(a)["num"].alias("y"), a).filter("not (x <=> y) and a not rlike '^[(-]?[0-9]+,[0-9]{2}[^0-9]*$'").collect() == []


def test_no_figures(spark):
    blanks = ["", " ", "-", "–", "—", "--", "nil", "NIL", "n/a", "na"]
    words = ["profit", "note 7a", ".", "()", "%", "1 -2 -", "AED '000"]
    too_long = ["7" * 17, "8" * 40, "3e400"]
    glued = ["1,204 1,187 2,055", "2019 2018", "17.5 18.25 3,000"]
    rows = [(x,) for x in [*blanks, *words, *too_long, *glued, None]]
    got = spark.createDataFrame(rows, "a string").select("a", parse_number(F.col("a"))["num"].alias("p")).collect()
    assert [(r.a, r.p) for r in got if r.p is not None] == []


def test_torn_figures(spark):
    rows = [("4, 312,905", 4312905.0), ("23, 118,040", 23118040.0), ("5,0\n61,220", 5061220.0), (") (902,114", -902114.0), ("(6,340", None)]
    for r in spark.createDataFrame(rows, "a string, b double").select("a", "b", parse_number(F.col("a"))["num"].alias("p")).collect():
        assert r.p == r.b, r.a


def test_coerce(spark):
    rows = ["(7,015", "-", "(83)%", "$4,400", "Trade \n payables", "6" * 25, "", "61,5"]
    got = [(r.c.txt, r.c.num, r.c.suffix) for r in spark.createDataFrame([(x,) for x in rows], "a string").select(coerce_cell(F.col("a")).alias("c")).collect()]
    assert got == [(None, 7015.0, None), ("-", None, None), (None, -83.0, "%"), (None, 4400.0, ""), ("Trade payables", None, None), (None, float("6" * 25), None), (None, None, None), (None, 615.0, None)]


def test_labels(spark):
    df = spark.createDataFrame([("Turnover (note 3, 4)",), ("Property, plant & equipment",)], "s string")
    assert [r[0] for r in df.select(norm_label(F.col("s"))).collect()] == ["revenue", "property plant equipment"]
    assert selection("2,4-6,77,y,9-8", 6) == [2, 4, 5, 6]
