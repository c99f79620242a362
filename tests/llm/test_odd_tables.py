"""Every operator's query over tables that are empty, or that have nulls in every column, repeated rows and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from sumline.llm.queries import QUERIES

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
LONG = " ".join(f"w{i % 97}" for i in range(3000))
ROWS = {
    "documents": [(1, "alpha beta gamma delta " * 8, "en", "s", 5), (2, "alpha beta gamma delta " * 8, "en", "s", 5), (2, None, None, None, None), (None, "x y z", None, "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t", "en", "s", 3), (5, LONG, "en", "s", 9), (5, LONG, "en", "s", 9)],
    "pages": [(1, "http://a", "<p>x</p>" * 300), (2, None, "<p>x</p>" * 300), (3, "http://b", None), (None, None, None), (4, "http://c", "")],
    "benchmark": [(1, "alpha beta gamma delta alpha beta gamma delta"), (1, None), (None, "x y"), (2, "")],
    "labels": [(1, 1, 0), (1, 1, 0), (None, None, None), (5, None, 1), (2, 0, None)],
    "conversations": [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>"), (1, None, None, None), (None, None, None, None), (2, 0, "user", None), (2, 1, "assistant", None)],
}
CLASHING = ["shard", "slot", "size", "kept", "weight", "n_words", "head", "a", "b", "n", "pivot", "root", "spans", "rule", "value"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {"empty": tmp_path_factory.mktemp("empty"), "odd": tmp_path_factory.mktemp("odd")}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{out['empty']}/{name}.parquet")
        odd = spark.createDataFrame(ROWS[name], schema).select("*", *[F.lit("x").alias(c) for c in CLASHING])
        odd.write.parquet(f"{out['odd']}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_odd(spark, folders, name):
    assert len(QUERIES[name](spark, str(folders["empty"])).collect()) == (name == "op7_reply_trees")  # conversation -7
    got = QUERIES[name](spark, str(folders["odd"])).collect()
    want = {"op6_warc": len(ROWS["pages"]), "op7_reply_trees": 4}.get(name, len(ROWS["documents"]))
    if name != "op3_decontamination":  # one row for each leak
        assert len(got) == want
