"""The stages against their operators, and planted cases through the whole pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, prose(35)) for i in range(6)]
    docs = [(i, prose(r.randint(80, 200)), "en", f"s{i % 3}") for i in range(300)]
    docs += [(400 + i, " | ".join(w.upper() for w in prose(60).split()), "en", "s0") for i in range(60)]
    docs += [(500 + i, docs[i][1] + " end", "en", "s1") for i in range(20)] + [(600 + i, prose(40) + " " + bench[i % 6][1] + " " + prose(40), "fr", "s2") for i in range(18)]
    docs += [(700, None, "en", "s0"), (701, "", None, None), (702, "few words", "de", "s1")]
    labels = [(i, 1, 0) for i in range(250)] + [(400 + i, 0, 0) for i in range(50)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not ids["quality"] & set(range(400, 460)) and not ids["quality"] & {700, 701, 702} and len(ids["quality"] & set(range(300))) >= 297
    assert ids["near_duplicates"] == ids["quality"] - {500 + i for i in range(20) if i in ids["quality"]}
    assert ids["decontamination"] == ids["near_duplicates"] - set(range(600, 618))
    assert ids["mixing"] < ids["decontamination"] and len(ids["mixing"]) > 0.6 * len(ids["decontamination"])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert not set(out.doc_id) & set(range(400, 460)) and not set(out.doc_id) & set(range(600, 618))
